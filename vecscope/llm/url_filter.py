"""URL filters: prefix rules first, and for the rest a ratio of two character language models.  Built-ins only.

Both models are variable-order Markov models over characters, trained on the URLs that rules accept and reject.  The
probability of a character after a context of n characters mixes the counts at that order with the probability at
order n - 1 (weight MIX); contexts seen less than LEAST times are skipped, so the order varies with the evidence.
The models see a URL's host and path only, as its rules do: what follows the first ? or # is neither trained on nor
scored, so URLs that differ only there get one verdict.
A URL's score is the mean over those characters of log P(accepted) - log P(rejected).  One fold of the URLs with rules
is kept from training; the cut on the score is the one that best separates its two classes.

Scoring takes one row of two numbers for each character, the URL's and the gram's; the table of grams is broadcast
below BROADCAST_ROWS rows, which are counted, and joined by a shuffle of those numbers beyond, in which frequent grams
are dealt to many tasks.  The characters of a URL are added up before anything else is shuffled.

Defined results
  null url, or none with ://   host and path empty, no rule; the model judges the empty string
  very long urls               characters are taken from one array, in time linear in the length
  ties                         a score equal to the cut is allowed; of rules that fit, the longest wins
  repeated rows                each gets its row; equal urls get equal verdicts
  empty table, no rules        no rows; without a class to learn from, every score is 0 and allowed
  extra columns                `judge` returns its own columns only
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import spread
from .common import Scratch, hot_bound, join_unique, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
MIX = 4.0
LEAST = 3
ALPHABET = 128
FOLDS = 5
BROADCAST_ROWS = 200_000
SLICE = 10_000
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fold(shown: Column) -> Column:
    """The fold of a URL, from its digest; fold 0 is kept from training."""
    return F.conv(F.substring(F.md5(shown.cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def by_rule(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        text = F.when(fits(r, host, path), r.text).otherwise(text)
        verdict = F.when(fits(r, host, path), r.verdict).otherwise(verdict)
    return text, verdict


def grams(s: Column) -> Column:
    """Every character of a string, and its end, with the ORDER characters before it."""
    chars = F.concat(F.array(*[F.lit(START)] * ORDER), F.filter(F.split(s, ""), lambda c: c != ""), F.array(F.lit(END)))
    return let(chars, lambda c: F.transform(F.slice(c, ORDER + 1, F.size(c)), lambda x, i: F.concat(*[F.get(c, i + k) for k in range(ORDER)], x)))


def log_ratios(labelled: DataFrame, every: DataFrame) -> DataFrame:
    """(gram, ratio): log P(accepted) - log P(rejected) of the last character of each gram in `every`.

    labelled: (gram, good, bad) counts of the training URLs; every: (gram) without repeats.
    """
    tail = lambda n: F.substring("gram", ORDER + 1 - n, n + 1)  # noqa: E731  a character and n before it
    head = lambda n: F.substring("gram", ORDER + 1 - n, n)  # noqa: E731  those n alone
    keyed = F.array(*[F.concat(F.lit("g"), tail(n)) for n in range(ORDER + 1)], *[F.concat(F.lit("c"), head(n)) for n in range(1, ORDER + 1)])
    slot = F.posexplode(keyed).alias("slot", "key")
    counts = labelled.select(slot, "good", "bad").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    few = counts.count() <= BROADCAST_ROWS
    found = every.select("gram", slot).join(F.broadcast(counts) if few else counts, "key")
    all_of = dict(zip(("good", "bad"), labelled.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first(), strict=True))
    pick = lambda c, k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    wide = found.groupBy("gram").agg(*[pick(c, k) for c in ("good", "bad") for k in range(2 * ORDER + 1)])
    # a gram of characters that no training URL has is found nowhere, and has the base chance
    wide = every.join(wide, "gram", "left").na.fill(0)
    logs = {}
    for c in ("good", "bad"):
        p = (F.col(f"{c}0") + 0.5) / F.lit(all_of[c] + 0.5 * ALPHABET)
        for n in range(1, ORDER + 1):
            wide = wide.withColumn(f"p_{c}{n - 1}", p)
            lower, seen = F.col(f"p_{c}{n - 1}"), F.col(f"{c}{ORDER + n}")
            p = F.when(seen >= LEAST, (F.col(f"{c}{n}") + MIX * lower) / (seen + MIX)).otherwise(lower)
        logs[c] = F.log(p)
    return wide.select("gram", (logs["good"] - logs["bad"]).alias("ratio"))


def _ratios(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """rows (row, gram) with the ratio of their gram from (gram, n, ratio); n says how often a gram occurs."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.select("gram", "ratio")), "gram")
    return join_unique(rows, table.select("gram", "ratio"), table.where(F.col("n") > hot_bound(total)).select("gram", "ratio"), ["gram"], ["row"])


def scores(pages: DataFrame, rules: tuple[UrlRule, ...], scratch: Scratch) -> DataFrame:
    """(row, page_id, copies, host, path, rule, ruled, shown, score) for each distinct page_id and url."""
    host, path = host_path(F.col("url"))
    rule, ruled = by_rule(rules, F.col("host"), F.col("path"))
    d = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies")).select("*", host.alias("host"), path.alias("path"))
    d = d.select("*", rule.alias("rule"), ruled.alias("ruled"), F.concat("host", "path").alias("shown"))
    # work goes by characters, so rows are dealt to every core; the number of a row is settled by being stored
    d = scratch.save(spread(d, "page_id", "url").withColumn("row", F.monotonically_increasing_id()), "urls")
    train = d.where(F.col("ruled").isNotNull() & (fold(F.col("shown")) != 0))
    every = scratch.save(d.select(F.explode(grams(F.col("shown"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    labelled = train.select(F.explode(grams(F.col("shown"))).alias("gram"), "ruled").groupBy("gram").agg(
        F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    both = train.agg(F.count_if(F.col("ruled") == "allow"), F.count_if(F.col("ruled") == "block")).first()
    if not all(both):  # a class is missing: nothing to compare
        return d.withColumn("score", F.lit(0.0))
    learnt = log_ratios(scratch.save(labelled, "labelled"), every.select("gram"))
    # sums of rounded terms are the same in any order
    table = learnt.join(every, "gram").select(F.xxhash64("gram").alias("gram"), "n", F.round(F.col("ratio") * 1e9).cast("long").alias("ratio"))
    table = scratch.save(table, "ratios")
    rows = d.select("row", F.explode(grams(F.col("shown"))).alias("gram")).select("row", F.xxhash64("gram").alias("gram"))
    total = every.agg(F.sum("n")).first()[0] or 0
    mean = _ratios(rows, table, total).groupBy("row").agg((F.sum("ratio") / F.count("*") / 1e9).alias("score"))
    return d.join(mean, "row")


def best_cut(scored: DataFrame) -> float:
    """The score that best separates the kept fold: its true less its false acceptance is largest, then nearest 0."""
    held = scored.where(F.col("ruled").isNotNull() & (fold(F.col("shown")) == 0))
    # a histogram of bounded size comes to the driver
    bins = held.groupBy(F.round(F.greatest(F.least("score", F.lit(10.0)), F.lit(-10.0)) * 100).cast("int").alias("bin")).agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("copies")).otherwise(0)).alias("good"), F.sum(F.when(F.col("ruled") == "block", F.col("copies")).otherwise(0)).alias("bad")
    ).orderBy("bin").collect()
    good, bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not good or not bad:
        return 0.0
    best, cut, g, x = -1.0, 0.0, good, bad
    for b in bins:
        gain, at = g / good - x / bad, (b["bin"] - 0.5) / 100
        if gain > best + 1e-12 or (abs(gain - best) <= 1e-12 and abs(at) < abs(cut)):
            best, cut = gain, at
        g, x = g - b["good"], x - b["bad"]
    return cut


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row."""
    scratch = Scratch(pages.sparkSession, "urls")
    narrow = pages.select(pages[key].alias("page_id"), pages[url].cast("string").alias("url"))
    scored = scratch.save(scores(narrow, rules, scratch), "scored")
    cut = best_cut(scored)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    one = scored.select(F.col("page_id").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"), "copies")
    # a repeated row is given back in slices of bounded length
    parts = one.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SLICE))))
    if scored.where(F.col("copies") > SLICE).isEmpty():
        dealt = parts
    else:
        dealt = parts.repartition("part_", key, "host", "path")
    size = F.least(F.lit(SLICE).cast("long"), F.col("copies") - F.col("part_") * SLICE)
    return dealt.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("copy_", "part_", "copies")
