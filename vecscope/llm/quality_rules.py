"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule names a statistic, a comparison and a bound; `verdict` turns the table into a single boolean
expression, so a corpus is judged in one scan without a shuffle and without Python on the executors.

Defined results
  null or empty text   no words: every count is 0 and base_failed is true
  very long texts      repeated windows are found by sorting (hash, position) pairs, n log n in the words of a text
  repeated rows, ties  rows are judged one by one, so equal rows get equal results
  empty table          no rows
  extra columns        `score_rules` keeps no column but its own; `keep_good` returns its input's columns unchanged
                       and computes under reserved names, so clashing names do no harm
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, words

SYMBOLS = "#*$%&|<>"
BULLETS = r"^[\x20\x09-\x0D]*[-*•●]"
#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in a is it that for with as on be at by this are was from "
    "der die und das von mit den zu ist im nicht ein eine auf für dem des sich als auch "
    "le la les de et un une des en que qui dans est pour par sur au pas du avec "
    "el los las y en que se del con por su una para al es no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if `stat` lies below `least` or above `most`."""

    name: str
    stat: str
    least: float | None = None
    most: float | None = None


#: The production table.  Ratios are per word unless the name says lines.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.1),
    Rule("duplicate_line_ratio", "dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", "ellipsis_line_ratio", None, 0.3),
    Rule("alphabetic_words", "alpha_word_ratio", 0.6, None),
    Rule("distinct_words", "distinct_word_ratio", 0.05, None),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("shouting", "upper_ratio", None, 0.5),
)


def repeated_words(ws: Column) -> Column:
    """Words covered by a 3-word window found twice or more in the array `ws`.

    Windows are compared by a 64-bit hash of their words within one text.
    """
    n = F.size(ws)
    windows = F.transform(
        F.slice(ws, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spans(p: Column) -> Column:
            twice = F.filter(
                p,
                lambda x, k: (x["h"] == F.get(p, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(p, F.greatest(k - 1, F.lit(0)))["h"])),
            )
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("c"), F.lit(0).alias("upto")),
                lambda a, i: F.struct((a["c"] + i + 3 - F.greatest(i, a["upto"])).alias("c"), (i + 3).alias("upto")),
            )["c"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, spans))

    return let(windows, covered)


def _base(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [t.alias("t_"), words(t).alias("w_"), F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0).alias("l_")]


def statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry` columns, the four base counts with n_words, and every statistic a rule may name."""
    d = docs.select(*[F.col(c) for c in carry], *_base(F.col(text)))
    w, lines, t = F.col("w_"), F.col("l_"), F.col("t_")
    d = d.select(
        *carry,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(lines).alias("lines_"),
        F.size(F.filter(lines, lambda x: x.rlike(BULLETS))).alias("bullets_"),
        F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))).alias("ellipses_"),
        F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).alias("letters_"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("uppers_"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("alphas_"),
        F.size(F.array_distinct(w)).alias("distinct_"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("stops_"),
    )
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return d.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word_length"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_dup_lines", "lines_").alias("dup_line_ratio"),
        per("bullets_", "lines_").alias("bullet_line_ratio"),
        per("ellipses_", "lines_").alias("ellipsis_line_ratio"),
        per("alphas_", "n_words").alias("alpha_word_ratio"),
        per("distinct_", "n_words").alias("distinct_word_ratio"),
        per("stops_", "n_words").alias("stop_word_ratio"),
        per("uppers_", "letters_").alias("upper_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression: true if no rule fails."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (F.col(r.stat) >= F.lit(float(r.least)))
        if r.most is not None:
            ok = ok & (F.col(r.stat) <= F.lit(float(r.most)))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def score_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: counts, base_failed, kept, and the ratios the rules read."""
    d = statistics(docs, text, (key,)).withColumn("base_failed", base_failed())
    ratios = [c for c in d.columns if c.endswith("_ratio") or c == "mean_word_length"]
    return d.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict(rules)).alias("kept"), *ratios,
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, that neither the base nor a rule rejects."""
    boxed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs[text].alias("text_"))
    judged = statistics(boxed, "text_", ("row_",)).select("row_", (~base_failed() & verdict(rules)).alias("kept_"))
    # a filter would be pushed below the statistics, whose arrays Spark would then make again for each element
    return judged.select(F.explode(F.when(F.col("kept_"), F.array("row_")).otherwise(F.slice(F.array("row_"), 1, 0))).alias("row_")).select("row_.*")
