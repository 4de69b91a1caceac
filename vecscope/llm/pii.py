"""Personal data: fixed patterns as seeds, bootstrapped contextual patterns for what those miss.  Built-ins only.

1.  One scan finds the base spans of each kind (email, ip, card, phone) and looser candidates of the same kinds, each
    with its lexical pattern: the two words to its left, or one that ends in a colon, an equals or a number sign.
2.  Base spans are seeds.  Patterns and instances form a graph.  A pattern's confidence is the mean score of the
    distinct instances it stands before, damped by one of score 0; an instance's score is the best confidence of its
    supported patterns, seeds have 1, and seeds of other kinds that have the looser shape of this one have 0.  Scores
    are the fixed point of that: a pattern alone has seeds / (seeds + others + 1), however many instances are unseen.
3.  A pattern is supported by LEAST_SEEDS distinct instances that are seeds, or that other patterns have given a score
    of LEAST_CONFIDENCE or more: what was discovered induces further patterns, with its own lower scores, generation
    by generation until nothing new is found.
4.  Candidates behind a supported pattern of high confidence become spans as well.

Copies of a text don't raise a pattern's confidence, as instances count once.  Patterns before many instances and
instances behind many patterns are dealt to many tasks.

Defined results
  null or empty text   no spans, base_sha256 of the empty string
  very long texts      runs are matched possessively and from their starts, so time stays linear; positions come from
                       running sums in blocks of the square root of the number of matches
  ties                 candidates of two kinds at one start: the more confident, then the kind listed first
  null ids             rows like others
  repeated rows        equal rows get equal results, once for each row
  empty table          no rows
  extra columns        `find` returns its own columns only; `redact` returns its input's columns, text and n_chars new
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_bound, join_unique, let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, equal in what they match to the plain forms, but free of backtracking and of deep recursion.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that hold wherever the base pattern can match and be accepted.
GUARD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: Looser shapes of the same kinds.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
}
LOOSE_GUARD = {
    "email": lambda t: t.rlike(r"@|\[at\]|\(at\)"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ ./-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"[0-9](?:[ ().-]{0,2}[0-9]){6}"),
}
SETTLED = 1e-9
LEAST_SEEDS = 3
LEAST_CONFIDENCE = 0.7
LEFT = 64
BROADCAST_ROWS = 100_000

_SPAN = "struct<start:int,end:int,kind:int,found:string>"


def _running(z: Column) -> Column:
    """Spans from an array of (gap, size, found): running sums in blocks, in time n * sqrt(n)."""
    width = F.greatest(F.ceil(F.sqrt(F.size(z).cast("double"))).cast("int"), F.lit(1))

    def blocks(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(z, b * n + 1, n))

    def place(c: Column) -> Column:
        sums = F.transform(c, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        first = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]
        inner = lambda b, o: F.aggregate(
            b,
            F.struct(o.alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(
                    a["out"],
                    F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["found"].alias("found"))),
                ).alias("out"),
            ),
        )["out"]
        return F.flatten(F.zip_with(c, first, inner))

    return let(let(width, blocks), place)


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, end, found) in code points."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        z = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("found")))
        return F.when(F.size(found) > 0, let(z, _running))

    return F.when(guard, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def term(a: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
            return a + x - F.when(x > 9, 9).otherwise(0)

        return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), term) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(m), total)


def _octets(m: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\."), small)


CHECK = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _tagged(a: Column, kind: int, check) -> Column:
    ok = F.filter(a, lambda x: check(x["found"]))
    tag = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
    return F.coalesce(F.transform(ok, tag), F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    return F.sort_array(F.concat(*[_tagged(spans(text, BASE[k], GUARD[k](text)), i, CHECK[k]) for i, k in enumerate(KINDS)]))


def loose_spans(text: Column) -> Column:
    return F.concat(*[_tagged(spans(text, LOOSE[k], LOOSE_GUARD[k](text)), i, lambda m: F.lit(True)) for i, k in enumerate(KINDS)])


def _patterns(text: Column, start: Column) -> Column:
    """The lexical patterns in front of a position: its last two words, and its last if that is a label."""
    left = F.lower(F.substring(text, F.greatest(start - LEFT, F.lit(0)) + 1, F.least(start, F.lit(LEFT))))
    two, label = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1), F.regexp_extract(left, r"(\S+[:=#])\s*$", 1)
    return F.array_remove(F.array_distinct(F.array(F.regexp_replace(two, r"\s+", " "), label)), "")


def scan(docs: DataFrame, carry: list[Column], text: Column) -> DataFrame:
    """`carry`, the base spans, and each seed or candidate with its patterns, from one pass over the texts."""
    t = F.coalesce(text, F.lit(""))
    d = docs.select(*carry, t.alias("t_"), base_spans(t).alias("base"))
    # a text without any identifier shape leaves here with empty arrays
    d = d.select("*", loose_spans(F.col("t_")).alias("loose_"))
    seeds = lambda x: F.struct(x["start"], x["end"], x["kind"], F.lower(x["found"]).alias("found"), F.lit(True).alias("seed"), _patterns(F.col("t_"), x["start"]).alias("patterns"))
    free = lambda x: ~F.exists(F.col("base"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    cands = lambda x: F.struct(x["start"], x["end"], x["kind"], F.lower(x["found"]).alias("found"), F.lit(False).alias("seed"), _patterns(F.col("t_"), x["start"]).alias("patterns"))
    seen = F.concat(F.transform("base", seeds), F.transform(F.filter("loose_", free), cands))
    keep = [c for c in d.columns if c not in ("t_", "loose_")]
    return d.select(*keep, F.xxhash64("t_").alias("text_hash"), seen.alias("seen"))


def pattern_scores(seen: DataFrame, scratch: Scratch, least_seeds: int = LEAST_SEEDS, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(kind, pattern, confidence, times) of supported patterns from rows (kind, found, seed, patterns).

    Instances that a better pattern vouches for enter a pattern's mean with that one's confidence, the others with its
    own, which solves for them at once; so no pattern raises itself, confidences rise to the fixed point and are
    iterated until none moves.  times says how often a pattern stands before anything.
    """
    both, one = ["kind", "pattern"], ["kind", "found"]
    marks = seen.select("kind", "found", "seed", F.explode("patterns").alias("pattern"))
    edges = scratch.save(marks.groupBy("kind", "pattern", "found").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "edges")
    bound = hot_bound(edges.count())
    shapes = F.array_compact(F.array(*[F.when((F.col("kind") != i) & F.col("found").rlike(rf"^(?:{LOOSE[k]})\z"), F.lit(i)) for i, k in enumerate(KINDS)]))
    others = edges.where("seed").select(F.explode(shapes).alias("kind"), "pattern", "found").distinct().groupBy(*both).agg(F.count("*").alias("others"))
    able = edges.groupBy(*both).agg(F.count_if("seed").alias("seeds"), F.count("*").alias("n"), F.sum("times").alias("times")).where(F.col("n") >= least_seeds)
    known = able.join(others, both, "left").na.fill(0, ["others"]).withColumn("supported", F.col("seeds") >= least_seeds)
    first = F.when(F.col("supported"), F.col("seeds") / (F.col("seeds") + F.col("others") + 1)).otherwise(F.lit(0.0))
    known = scratch.save(known.select("*", first.alias("confidence")), "patterns-0")
    # behind one pattern only, an instance has that pattern's confidence and supports no other
    free = edges.where(~F.col("seed")).select("kind", "pattern", "found")
    free = scratch.save(join_unique(free, known.select(*both, "n"), known.where(F.col("n") > bound).select(*both, "n"), both, ["found"]).where("n IS NOT NULL").drop("n"), "free")
    several = free.groupBy(*one).count().where("count > 1")
    many = scratch.save(several.where(F.col("count") > bound).select(*one), "many")
    several = scratch.save(several, "several")
    shared = join_unique(free, several, several.where(F.col("count") > bound), one, ["pattern"])
    shared = scratch.save(shared.where("count IS NOT NULL").drop("count"), "shared")
    step = 0
    while True:
        now = known.select(*both, "confidence", "seeds")
        scored = join_unique(shared, now, known.where(F.col("n") > bound).select(*now.columns), both, ["found"])
        best = scored.groupBy(*one).agg(F.max("confidence").alias("best")).where("best > 0")
        rated = join_unique(scored, best, best.join(F.broadcast(many), one, "left_semi"), one, ["pattern"])
        vouched = (F.col("best") > F.col("confidence")) & ((F.col("seeds") >= least_seeds) | (F.col("best") >= confidence))
        lift = rated.where(vouched).groupBy(*both).agg(F.sum("best").alias("more"), F.count("*").alias("m"), F.count_if(F.col("best") >= confidence).alias("backed"))
        m = F.coalesce("m", F.lit(0))
        new = (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("seeds") + F.col("others") + 1 + m)
        supported = F.col("supported") | (F.col("seeds") + F.coalesce("backed", F.lit(0)) >= least_seeds)
        step += 1
        moved = known.join(lift, both, "left").select(
            *both, "seeds", "n", "times", "others", supported.alias("supported"),
            F.greatest("confidence", F.when(supported, new).otherwise(F.lit(0.0))).alias("confidence"), F.col("confidence").alias("was"),
        )
        moved = scratch.save(moved, f"patterns-{step}")
        scratch.drop(f"patterns-{step - 1}")
        known = moved.drop("was")
        if moved.where(F.abs(F.col("confidence") - F.col("was")) > SETTLED).isEmpty():
            return known.where("supported").select(*both, "confidence", "times")


def discovered(scanned: DataFrame, keys: list[str], scratch: Scratch, confidence: float = LEAST_CONFIDENCE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """`keys` with the array `added` of spans that confident patterns discover."""
    rows = scanned.where(F.size("seen") > 0).select(*keys, F.explode("seen").alias("s")).select(*keys, "s.*")
    good = pattern_scores(rows, scratch, least_seeds, confidence).where(F.col("confidence") >= confidence)
    good = scratch.save(good, "good")
    bound = hot_bound(good.agg(F.sum("times")).first()[0] or 0)
    cands = rows.where(~F.col("seed")).withColumn("pattern", F.explode("patterns")).drop("seed", "patterns")
    worth = ["kind", "pattern", "confidence"]
    hits = join_unique(cands, good.select(*worth), good.where(F.col("times") > bound).select(*worth), ["kind", "pattern"], [*keys, "start"]).where("confidence IS NOT NULL")
    best = F.max(F.struct("confidence", -F.col("kind"), "end", "kind", "found"))
    one = hits.groupBy(*keys, "start").agg(best.alias("m"))
    return one.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start", F.col("m.end").alias("end"), F.col("m.kind").alias("kind"), F.col("m.found").alias("found")))).alias("added")
    )


def _listed(a: Column) -> Column:
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])
    return F.array_join(F.transform(a, name), ",")


def _by_start(a: Column) -> Column:
    """Spans by start, then kind, then end."""
    keyed = F.transform(a, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["start"], x["end"], x["kind"]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: base counts, digest of the base spans, the number of added spans, and all spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    # the number of a row is settled by being stored; added spans find their row by it
    s = scratch.save(scan(docs, [docs[key].alias("key_")], docs[text]).withColumn("row_", F.monotonically_increasing_id()), "scan")
    more = discovered(s, ["row_"], scratch)
    found = s.select("row_", "key_", "base").join(more, "row_", "left").select(
        F.col("key_").alias(key),
        _by_start(F.col("base")).alias("base"),
        _by_start(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")))).alias("all_"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all_")).alias("spans"), F.greatest("n_added", F.lit(0)).alias("n_added"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets, and its length column, where it has one, made anew.

    Base spans are found again in the row they belong to; only the few that contexts add are joined, by a broadcast
    below BROADCAST_ROWS rows, which are counted, and by a shuffle beyond.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    # saved whole first: a filter on `seen` would be pushed below and make Spark evaluate the scan again in lambdas
    s = scratch.save(scan(docs, [docs[key].alias("key_")], docs[text]), "scan")
    more = discovered(s, ["key_", "text_hash"], scratch)
    # rows that are equal in key and text have their spans twice; one set of them stands for all
    more = scratch.save(more.select(F.col("key_").alias("k_"), F.col("text_hash").alias("h_"), _by_start(F.col("added")).alias("added")), "added")
    scratch.keep("added")
    few = more.count() <= BROADCAST_ROWS
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row_")
    boxed = docs.select(row, docs[text].alias("t_"), docs[key].alias("key_"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("text_hash"))
    joined = boxed.join(F.broadcast(more) if few else more, boxed["key_"].eqNullSafe(more["k_"]) & (boxed["text_hash"] == more["h_"]), "left")
    t = F.col("t_")
    every = F.concat(_by_start(base_spans(t)), F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:int>>")))
    new = F.when(t.isNotNull(), let(F.array_distinct(_by_start(every)), lambda a: F.when(F.size(a) == 0, t).otherwise(_blanked(t, a))))
    out = joined.select("row_", new.alias("new_"))
    return out.select(*[
        F.col("new_").alias(c) if c == text else F.length("new_").cast(docs.schema[c].dataType).alias(c) if c == size else F.col(f"row_.`{c}`").alias(c)
        for c in docs.columns
    ])


def _blanked(t: Column, a: Column) -> Column:
    """The text with spans, sorted by start, replaced; of overlapping ones the first stands."""
    tag = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)), F.lit("]"))
    done = F.aggregate(
        a,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(t, s["at"] + 1, x["start"] - s["at"]), tag(x))).alias("out"))
        ),
    )
    return let(done, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.length(t))))
