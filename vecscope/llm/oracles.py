"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import url_filter as uf
from .quality_rules import RULES, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_VERDICT = " AND ".join(
    f"{r.stat} {op} CAST({bound!r} AS DOUBLE)" for r in RULES for op, bound in ((">=", r.least), ("<=", r.most)) if bound is not None
)

OP1 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT doc_id, i, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM win WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS lines_,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•●]'))) AS bullets_,
    len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) AS ellipses_,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters_,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS uppers_,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS alphas_,
    len(list_distinct(w)) AS distinct_,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops_
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    coalesce(word_chars / nullif(n_words, 0), 0.0) AS mean_word_length,
    coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_ratio,
    coalesce(n_dup_lines / nullif(lines_, 0), 0.0) AS dup_line_ratio,
    coalesce(bullets_ / nullif(lines_, 0), 0.0) AS bullet_line_ratio,
    coalesce(ellipses_ / nullif(lines_, 0), 0.0) AS ellipsis_line_ratio,
    coalesce(alphas_ / nullif(n_words, 0), 0.0) AS alpha_word_ratio,
    coalesce(distinct_ / nullif(n_words, 0), 0.0) AS distinct_word_ratio,
    coalesce(stops_ / nullif(n_words, 0), 0.0) AS stop_word_ratio,
    coalesce(uppers_ / nullif(letters_, 0), 0.0) AS upper_ratio
  FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_VERDICT}) AS kept,
  mean_word_length, symbol_ratio, dup_line_ratio, bullet_line_ratio, ellipsis_line_ratio, alpha_word_ratio,
  distinct_word_ratio, stop_word_ratio, upper_ratio
FROM r
"""


def shingle_ctes(source: str, k: int = 5) -> str:
    """CTEs `w` (words by position) and `sets` (doc_id, s: distinct shingles) of a table or subquery with doc_id and text."""
    return rf"""
w AS (
  SELECT doc_id, unnest(x) AS x, unnest(range(len(x))) AS i, len(x) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS x FROM {source})),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS s FROM w)
  WHERE i + {k} <= n OR (n < {k} AND i = 0))"""


def component_ctes(percent: int) -> str:
    """CTEs from `sets` to `comp` (doc_id, component_id) over documents linked at `percent` or more."""
    return f"""
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL)
  JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT a, a FROM edges UNION SELECT reach.doc_id, b FROM reach JOIN edges ON reach.r = edges.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)"""


OP8 = f"""
WITH RECURSIVE {shingle_ctes("documents")}, {component_ctes(85)}
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP4 = f"""
WITH {shingle_ctes("documents").replace("w AS", "dw AS", 1).replace("FROM w)", "FROM dw)").replace("sets AS", "docs AS")},
{shingle_ctes("(SELECT item_id AS doc_id, text FROM benchmark)")},
size AS (SELECT doc_id AS item_id, count(*) AS n FROM sets GROUP BY ALL),
hits AS (SELECT docs.doc_id, sets.doc_id AS item_id, count(*) AS c FROM docs JOIN sets USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(c AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_item FROM hits JOIN size USING (item_id) WHERE 100 * c >= 80 * n
"""



def _url_rules(field: str) -> str:
    """The longest URL rule that fits, as its text or its verdict."""
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'"
        for r in sorted(uf.RULES, key=lambda r: -len(r.text))
    ]
    return f"CASE {' '.join(cases)} END"


def _url_models() -> str:
    """CTEs from `parts` (gram, key columns) to `ratios`: both models at every order."""
    n = uf.ORDER
    keys = [f"'g' || substr(gram, {n + 1 - k}, {k + 1})" for k in range(n + 1)] + [f"'c' || substr(gram, {n + 1 - k}, {k})" for k in range(1, n + 1)]
    joins = " ".join(f"LEFT JOIN counts k{i} ON k{i}.key = {key}" for i, key in enumerate(keys))
    columns = ", ".join(f"coalesce(k{i}.{c}, 0) AS {c}{i}" for c in ("good", "bad") for i in range(len(keys)))
    steps = []
    for k in range(1, n + 1):
        new = ", ".join(f"CASE WHEN {c}{n + k} >= {uf.LEAST} THEN ({c}{k} + {uf.MIX} * p_{c}) / ({c}{n + k} + {uf.MIX}) ELSE p_{c} END AS p_{c}" for c in ("good", "bad"))
        steps.append(f"o{k} AS (SELECT * EXCLUDE (p_good, p_bad), {new} FROM o{k - 1})")
    first = ", ".join(f"({c}0 + 0.5) / (total.{c} + {0.5 * uf.ALPHABET}) AS p_{c}" for c in ("good", "bad"))
    return f"""counts AS (SELECT key, sum(good) AS good, sum(bad) AS bad FROM (SELECT unnest([{", ".join(keys)}]) AS key, good, bad FROM learnt) GROUP BY key),
total AS (SELECT sum(good) AS good, sum(bad) AS bad FROM learnt),
wide AS (SELECT gram, {columns} FROM (SELECT DISTINCT gram FROM grams) {joins}),
o0 AS (SELECT wide.*, {first} FROM wide, total), {", ".join(steps)},
ratios AS (SELECT gram, CAST(round((ln(p_good) - ln(p_bad)) * 1e9) AS BIGINT) AS ratio FROM o{n})"""


OP5 = f"""
WITH rest AS (SELECT page_id, url, count(*) AS copies, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages GROUP BY page_id, url),
hp AS (SELECT page_id, url, copies, translate(regexp_extract(rest, '^[^/?#]*'), '{uf.UPPER}', '{uf.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
d AS MATERIALIZED (SELECT *, {_url_rules("text")} AS rule, {_url_rules("verdict")} AS ruled, host || path AS shown,
  CAST('0x' || substr(md5(host || path), 1, 8) AS BIGINT) % {uf.FOLDS} AS fold FROM hp),
grams AS MATERIALIZED (SELECT page_id, url, ruled, fold, substr(repeat(chr(2), {uf.ORDER}) || shown || chr(3), i, {uf.ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(shown) + 2)) AS i FROM d)),
learnt AS (SELECT gram, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM grams WHERE ruled IS NOT NULL AND fold <> 0 GROUP BY gram),
{_url_models()},
scored AS MATERIALIZED (SELECT d.*, s.score FROM d JOIN (SELECT page_id, url, sum(ratio) / count(*) / 1e9 AS score FROM grams JOIN ratios USING (gram) GROUP BY page_id, url) s USING (page_id, url)),
bins AS (SELECT CAST(round(greatest(least(score, 10.0), -10.0) * 100) AS INTEGER) AS bin, sum(copies) FILTER (ruled = 'allow') AS good, sum(copies) FILTER (ruled = 'block') AS bad
  FROM scored WHERE ruled IS NOT NULL AND fold = 0 GROUP BY 1),
above AS (SELECT bin, coalesce(sum(good) OVER o, 0) / (SELECT sum(good) FROM bins) - coalesce(sum(bad) OVER o, 0) / (SELECT sum(bad) FROM bins) AS gain FROM bins WINDOW o AS (ORDER BY bin DESC)),
cut AS (SELECT (bin - 0.5) / 100 AS cut FROM above ORDER BY round(gain, 12) DESC, abs((bin - 0.5) / 100), bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM (SELECT *, unnest(range(copies)) AS copy FROM scored), cut
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY html) THEN min(page_id) OVER (PARTITION BY html) END AS refers_to FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM m
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1, "op4_decontamination": OP4, "op5_url_filter": OP5, "op8_near_dedup": OP8, "op10_warc": OP10,
}
