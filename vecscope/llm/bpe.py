"""BPE encoding and decoding by speculation: longest matches first, pair checks next, exact merging for the rest.

A sequence of tokens is the BPE encoding of a word exactly if every adjacent pair (a, b) is *compatible*, that is if
merging the symbols of a followed by those of b yields a, b again, and a lone token yields itself.  So each distinct
word of a batch is first cut greedily into longest vocabulary entries; the distinct adjacent pairs of all words are
then looked up together in sorted runs of known verdicts, bounded in number (unknown ones are settled by merging the
two tokens alone); only words that hold an incompatible pair are merged exactly.

The vocabulary file is a parameter.  Files with the layout of the `tokenizers` library are read for a BPE model with
an end-of-word suffix, NFC + white-space + lower-case normalisation and a byte-level split; special tokens in a text
are cut out first, as that library does.  Texts with characters outside PLAIN are normalised and split by that library
itself, as classes of characters differ between Unicode versions; their words are encoded here like all others.

Defined results
  null or empty text   no tokens; both digests are those of the empty string
  very long texts      pieces are found by one linear scan; long words are merged with a heap, n log n
  null ids             rows like others
  repeated rows, ties  rows are encoded one by one; equal merge ranks go to the leftmost pair
  empty table          no rows
  extra columns        only the key and text columns are read, others are ignored
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts made of these characters only are composed already and lower-case in the same way everywhere.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-įı-ɏ‐-‧€]*")
WORDS_KEPT = 400_000
#: Verdicts on pairs that a worker keeps.
PAIRS_KEPT = 1_000_000
#: Words of fewer symbols are merged by scanning a short list, longer ones with a heap.
SHORT = 48
NEVER = (1 << 60, -1)


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: Latin-1's printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(own))
    return table


class Codec:
    """Encoder and decoder for one vocabulary file; holds a bounded cache of encoded words."""

    def __init__(self, source: str):
        """source: the text of a vocabulary file."""
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.size = max(self.text_of) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.bytes = [byte_alphabet()[b] for b in range(256)]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        self.source = source
        self._library = None
        #: Sorted runs of (codes, verdicts), each more than twice as long as the next.
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[str, tuple[str, str]] = {}
        self.exact_words = self.fast_words = 0

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    # -- text to words ------------------------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if PLAIN.fullmatch(text):
            return self.find(text.lower())
        if self._library is None:  # characters whose classes differ between Unicode versions: the library's own split
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
            self._byte = {c: b for b, c in enumerate(self.bytes)}
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes([self._byte[c] for c in w]).decode(errors="surrogateescape") for w, _ in split]

    # -- one word -----------------------------------------------------------------------------------------------
    def symbols(self, word: str) -> list[str]:
        s = [self.bytes[b] for b in word.encode(errors="surrogateescape")]
        s[-1] += self.suffix
        return s

    def parts(self, token: int) -> list[int]:
        t = self.text_of[token]
        end = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
        s = list(t[: -len(self.suffix)] if end else t)
        if end:
            s[-1] += self.suffix
        return [self.vocab[c] for c in s]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact BPE: the pair of least rank, leftmost first, until none is left."""
        n, rank = len(ids), self.rank
        if n < SHORT:
            found = [rank.get(p, NEVER) for p in zip(ids, ids[1:])]
            while found:
                best = min(found)
                if best is NEVER:
                    break
                i = found.index(best)
                ids = [*ids[:i], best[1], *ids[i + 2 :]]
                del found[i]
                if i < len(found):
                    found[i] = rank.get((ids[i], ids[i + 1]), NEVER)
                if i:
                    found[i - 1] = rank.get((ids[i - 1], ids[i]), NEVER)
            return ids
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        ids = list(ids)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = made, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if r := rank.get((made, ids[nxt[j]])):
                    heapq.heappush(heap, (r[0], i, r[1], made, ids[nxt[j]]))
            if prv[i] >= 0 and (r := rank.get((ids[prv[i]], made))):
                heapq.heappush(heap, (r[0], prv[i], r[1], ids[prv[i]], made))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def greedy(self, word: str) -> list[int]:
        chars = "".join([self.bytes[b] for b in word.encode(errors="surrogateescape")])
        n, i, out, vocab, suffix = len(chars), 0, [], self.vocab, self.suffix
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (t := vocab.get(chars[i:j] + suffix if j == n else chars[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    # -- many words ---------------------------------------------------------------------------------------------
    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Verdict for each pair code a * size + b; code a * size + (size) * size stands for the lone token a."""
        codes, back = np.unique(codes, return_inverse=True)
        out, new = np.zeros(len(codes), bool), np.ones(len(codes), bool)
        for known, fits in self.runs:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = known[at] == codes
            out[hit] = fits[at[hit]]
            new &= ~hit
        if new.any():
            lone = self.size * self.size
            ok = []
            for c in codes[new].tolist():
                want = [c - lone] if c >= lone else [c // self.size, c % self.size]
                ok.append(self.merge([s for t in want for s in self.parts(t)]) == want)
            out[new] = ok
            self._remember(codes[new], out[new])
        return out[back]

    def _remember(self, codes: np.ndarray, fits: np.ndarray) -> None:
        if sum(len(k) for k, _ in self.runs) + len(codes) > PAIRS_KEPT:
            self.runs.clear()
        while self.runs and len(self.runs[-1][0]) <= 2 * len(codes):
            known, verdicts = self.runs.pop()
            at = np.searchsorted(known, codes)
            codes, fits = np.insert(known, at, codes), np.insert(verdicts, at, fits)
        self.runs.append((codes, fits))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word: speculate, verify all pairs at once, merge what failed."""
        guess = [self.greedy(w) for w in words]
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(guess)), size)
        inner = owner[1:] == owner[:-1]
        pairs, pair_owner = (flat[:-1] * self.size + flat[1:])[inner], owner[:-1][inner]
        alone = size[owner] == 1
        codes = np.concatenate([pairs, flat[alone] + self.size * self.size])
        owners = np.concatenate([pair_owner, owner[alone]])
        failed = np.unique(owners[~self.compatible(codes)])
        for k in failed.tolist():
            guess[k] = self.merge([self.vocab[s] for s in self.symbols(words[k])])
        self.exact_words += len(failed)
        self.fast_words += len(guess) - len(failed)
        return guess

    def learn(self, words: set[str]) -> None:
        fresh = list(words)
        for w, ids in zip(fresh, self.encode_words(fresh), strict=True):
            self.words[w] = " ".join(map(str, ids)), self.decode(ids)

    # -- whole texts --------------------------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: what the library gives for a file without a decoder."""
        return " ".join([self.text_of[i] for i in ids])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids, as decimals joined by spaces, and the decoded text."""
        cut: list[list[list[str] | str]] = []
        for text in texts:
            parts = self.cut.split(text or "") if self.cut else [text or ""]
            cut.append([p if k % 2 else self.pieces(p) for k, p in enumerate(parts)])
        known = self.words
        self.learn({w for parts in cut for p in parts[::2] for w in p if w not in known})
        out = []
        for parts in cut:
            got: list[tuple[str, str]] = []
            for k, p in enumerate(parts):
                got += [(str(self.special[p]), p)] if k % 2 else [known[w] for w in p]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        if len(known) > WORDS_KEPT:
            known.clear()
        return out

    def encode(self, text: str | None) -> tuple[str, str]:
        return self.encode_batch([text])[0]


_TYPES = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The key of each row with the asked `columns`: n_tokens, ids, decoded, and the digests of the latter two."""
    narrow = docs.select(docs[key].alias("key_"), docs[text].cast("string").alias("text_"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, _TYPES[c]) for c in columns])

    with open(vocabulary, encoding="utf-8") as f:  # a fixed file of a few MB, sent to the executors once
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source.value)
        make = {
            "n_tokens": lambda i, d: i.count(" ") + 1 if i else 0,
            "ids": lambda i, d: np.array(i.split(), np.int32),
            "decoded": lambda i, d: d,
            "ids_sha256": lambda i, d: hashlib.sha256(i.encode()).hexdigest(),
            "decoded_sha256": lambda i, d: hashlib.sha256(d.encode()).hexdigest(),
        }
        arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out: list[list] = [[] for _ in columns]
                for ids, decoded in codec.encode_batch(part.column(1).to_pylist()):
                    for col, c in zip(out, columns, strict=True):
                        col.append(make[c](ids, decoded))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, arrow[c]) for v, c in zip(out, columns, strict=True)]], [key, *columns])

    return narrow.mapInArrow(run, schema)


def decode_ids(vocabulary: str, ids: list[int]) -> str:
    return Codec.load(vocabulary).decode(ids)
