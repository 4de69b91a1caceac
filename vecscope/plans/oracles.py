"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from .queries import CAND, DEPTH, K, P, R


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
EVERY = f"every AS MATERIALIZED (SELECT vec_id, {VEC} AS v FROM embeddings)"
BASE = f"{EVERY}, base AS (SELECT vec_id AS id, v FROM every WHERE vec_id % 10 <> 0), query AS (SELECT vec_id AS q_id, v FROM every WHERE vec_id % 10 = 0)"


def gt(k: int, base: str = "base", name: str = "gt", dist: str = d2("query.v", "b.v")) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * FROM (SELECT q_id, id, d, row_number() OVER (PARTITION BY q_id ORDER BY d, id) AS rank
    FROM (SELECT q_id, b.id, {dist} AS d FROM query, {base} b)) WHERE rank <= {k})"""


def kg(k: int = CAND) -> str:
    return f"""kg AS MATERIALIZED (
  SELECT * FROM (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) - 1 AS pos
    FROM (SELECT a.id AS src, b.id AS dst, {d2("a.v", "b.v")} AS d FROM base a, base b WHERE a.id <> b.id)) WHERE pos < {k})"""


TESTS = {
    "mrng": f"{d2('u.v', 'x[1].v')} < x[1].d",
    "ssg": f"{d2('u.v', 'x[1].v')} < x[1].d + u.d - 2.0 * sqrt(x[1].d) * sqrt(u.d) * cos(radians(60.0))",
    "taumg": f"{d2('u.v', 'x[1].v')} < x[1].d - 3.0 * 0.01",
}


def edges(method: str = "mrng") -> str:
    return f"""{kg()},
cand AS (SELECT src, list(struct_pack(dst := dst, d := d, v := v, place := pos) ORDER BY pos) AS c FROM kg JOIN base ON base.id = dst GROUP BY src),
kept AS (SELECT src, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda u: {TESTS[method]})) = 0
  THEN list_concat(acc, x) ELSE acc END, c[1:0]) AS k FROM cand),
edges AS MATERIALIZED (SELECT src, i - 1 AS pos, k[i].dst AS dst, k[i].d AS d, k[i].place AS place FROM (SELECT src, k, unnest(range(1, len(k) + 1)) AS i FROM kept))"""


CAP = 100
RANKED = f"""er AS MATERIALIZED (
  SELECT g.q_id, g.rank AS u, h.rank AS v, e.pos FROM gt g JOIN edges e ON e.src = g.id JOIN gt h ON h.q_id = g.q_id AND h.id = e.dst
  WHERE g.rank <= {CAP} AND h.rank <= {CAP})"""


def least(source: str) -> str:
    """CTEs from bottleneck paths `w` to `pth`: the p-th least over sources of the r-th least over targets."""
    return f"""{source},
b AS (SELECT q_id, s, v, min(bn) AS b FROM w WHERE v <= {K} GROUP BY ALL),
rth AS (SELECT q_id, s, b FROM b QUALIFY row_number() OVER (PARTITION BY q_id, s ORDER BY b, v) = {R}),
pth AS (SELECT q_id, b FROM rth QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY b, s) = {P})"""


W_RANK = f"""w(q_id, s, v, bn) AS (SELECT q_id, rank, rank, rank FROM gt WHERE rank <= {K}
  UNION SELECT w.q_id, w.s, er.v, greatest(bn, er.v) FROM w JOIN er ON er.q_id = w.q_id AND er.u = w.v)"""
DELTA = f"""{least(W_RANK)},
delta AS (SELECT q_id, coalesce(greatest(b, {K}), (SELECT count(*) FROM base) + 1) AS delta0 FROM query LEFT JOIN pth USING (q_id))"""
FIXED = f"delta AS (SELECT q_id, {K} + 30 AS delta0 FROM query)"


CHEAPEST = f"""dist(q_id, s, v, d) USING KEY (q_id, s, v) AS (
  SELECT q_id, rank, rank, CAST(0 AS BIGINT) FROM gt WHERE rank <= {K}
  UNION (SELECT n.q_id, n.s, n.v, n.d FROM (
      SELECT dist.q_id, dist.s, ei.v, min(dist.d + ei.c) AS d FROM dist JOIN ei ON ei.q_id = dist.q_id AND ei.u = dist.v GROUP BY ALL) n
    LEFT JOIN recurring.dist o ON o.q_id = n.q_id AND o.s = n.s AND o.v = n.v WHERE o.d IS NULL OR n.d < o.d))"""
TIGHT = f"""pred AS MATERIALIZED (SELECT t.q_id, t.s, t.v, f.v AS u FROM reached t JOIN ei ON ei.q_id = t.q_id AND ei.v = t.v JOIN reached f ON f.q_id = t.q_id AND f.s = t.s AND f.v = ei.u
  WHERE t.v <> t.s AND f.d + ei.c = t.d QUALIFY row_number() OVER (PARTITION BY t.q_id, t.s, t.v ORDER BY f.d, f.v) = 1)"""
BREADTH = f"""dist(q_id, s, v, u, nth) USING KEY (q_id, s, v) AS (
  SELECT q_id, rank, rank, CAST(NULL AS BIGINT), CAST(1 AS BIGINT) FROM gt WHERE rank <= {K}
  UNION (SELECT q_id, s, v, u, row_number() OVER (PARTITION BY q_id, s ORDER BY before, pos) FROM (
      SELECT dist.q_id, dist.s, ei.v, ei.u, dist.nth AS before, ei.pos FROM dist JOIN ei ON ei.q_id = dist.q_id AND ei.u = dist.v
      LEFT JOIN recurring.dist o ON o.q_id = dist.q_id AND o.s = dist.s AND o.v = ei.v WHERE o.v IS NULL
      QUALIFY row_number() OVER (PARTITION BY dist.q_id, dist.s, ei.v ORDER BY dist.nth, ei.pos) = 1)))"""
FOUND = "pred AS (SELECT q_id, s, v, u FROM dist JOIN able USING (q_id, s) WHERE u IS NOT NULL)"


def me(expand: bool = True, bfs: bool = False) -> str:
    grown = "UNION SELECT q_id, e.dst FROM path JOIN gt USING (q_id, rank) JOIN edges e ON e.src = gt.id" if expand else ""
    return f"""deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src),
ei AS MATERIALIZED (SELECT er.q_id, u, v, pos, coalesce(deg.n, 0) AS c FROM er JOIN delta USING (q_id) JOIN gt ON gt.q_id = er.q_id AND gt.rank = u LEFT JOIN deg ON deg.src = gt.id
  WHERE u <= delta0 AND v <= delta0),
{BREADTH if bfs else CHEAPEST},
able AS (SELECT q_id, s FROM (SELECT q_id, s, row_number() OVER (PARTITION BY q_id ORDER BY s) AS nth, count(*) OVER (PARTITION BY q_id) AS n
    FROM (SELECT q_id, s FROM dist WHERE v <= {K} GROUP BY ALL HAVING count(*) >= {R})) WHERE nth <= {P} AND n >= {P}),
reached AS (SELECT q_id, s, v, {'nth' if bfs else 'd'} AS d FROM dist JOIN able USING (q_id, s)),
{FOUND if bfs else TIGHT},
chain(q_id, s, n) AS (SELECT q_id, s, u FROM pred WHERE v <= {K} UNION SELECT chain.q_id, chain.s, u FROM chain JOIN pred ON pred.q_id = chain.q_id AND pred.s = chain.s AND pred.v = chain.n),
path AS (SELECT DISTINCT q_id, n AS rank FROM chain),
counted AS (SELECT q_id, id FROM path JOIN gt USING (q_id, rank) {grown}
  UNION SELECT q_id, id FROM (SELECT DISTINCT q_id, v AS rank FROM reached WHERE v <= {K}) JOIN gt USING (q_id, rank)),
lone AS (SELECT q_id, id FROM gt JOIN delta USING (q_id) WHERE rank <= delta0 UNION SELECT q_id, e.dst FROM gt JOIN delta USING (q_id) JOIN edges e ON e.src = gt.id WHERE rank <= delta0),
hard AS MATERIALIZED (SELECT q_id, delta0, coalesce(a.n, b.n) AS me FROM delta LEFT JOIN (SELECT q_id, count(*) AS n FROM counted GROUP BY q_id) a USING (q_id)
  LEFT JOIN (SELECT q_id, count(*) AS n FROM lone GROUP BY q_id) b USING (q_id))"""


ME_MAX = """, goal AS (SELECT DISTINCT gt.q_id, gt.id FROM reached JOIN gt ON gt.q_id = reached.q_id AND gt.rank = reached.v WHERE v <= {k}),
each AS (SELECT chain.q_id, s, gt.id FROM chain JOIN gt ON gt.q_id = chain.q_id AND gt.rank = chain.n
  UNION SELECT chain.q_id, s, e.dst FROM chain JOIN gt ON gt.q_id = chain.q_id AND gt.rank = chain.n JOIN edges e ON e.src = gt.id
  UNION SELECT able.q_id, able.s, goal.id FROM able JOIN goal USING (q_id)),
dearest AS (SELECT q_id, max(n) AS n FROM (SELECT q_id, s, count(*) AS n FROM each GROUP BY ALL) GROUP BY q_id)
SELECT hard.q_id, delta0, coalesce(dearest.n, me) AS me FROM hard LEFT JOIN dearest USING (q_id)"""


def rank_rounds(rounds: int) -> str:
    """CTEs r0 to r<rounds> of PageRank with a damping of 0.85; what nodes without edges hold goes to all."""
    out = [
        "n AS (SELECT count(*) AS n FROM base), deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src)",
        "r0 AS MATERIALIZED (SELECT id AS node, 1.0::DOUBLE / n AS rank FROM base, n)",
    ]
    for k in range(1, rounds + 1):
        out.append(
            f"r{k} AS MATERIALIZED (SELECT base.id AS node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + lost / n) AS rank FROM base CROSS JOIN n "
            f"CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE node NOT IN (SELECT src FROM deg)) "
            f"LEFT JOIN (SELECT dst, sum(rank / deg) AS got FROM edges JOIN deg USING (src) JOIN r{k - 1} ON node = src GROUP BY dst) g ON g.dst = base.id)"
        )
    return ", ".join(out)


G = f"WITH {BASE}, {gt(DEPTH)}"
E = f"WITH {BASE}, {edges()}"
ALL = f"WITH RECURSIVE {BASE}, {gt(100_000)}, {edges()}, {RANKED}, {DELTA}"
HARD = f"{ALL}, {me()}"
IN = "ind AS (SELECT id AS node, count(src) AS degree FROM base LEFT JOIN edges ON dst = id GROUP BY id)"
NEAR = f"WITH {BASE}, {gt(5)}, p AS (SELECT q_id, id, query.v AS a, base.v AS b FROM gt JOIN base USING (id) JOIN query USING (q_id))"
INT8 = "list_transform({0}, lambda x: CAST(sign(x) * floor(abs(x * 127) + 0.5) AS INTEGER))"
MIX = "((((({0} % 2147483647) * 48271) % 2147483647 + {1} * 69621 + 11) % 2147483647 * 16807) % 2147483647 * 39373 + {1}) % 2147483647"
SHORT = f"""WITH {BASE}, {gt(DEPTH)}, {gt(K, name="near", dist=d2("query.v[1:16]", "b.v[1:16]"))},
truth AS (SELECT q_id, id FROM gt WHERE rank <= {K})"""
DK = f"dk AS (SELECT q_id, max(d) FILTER (rank = {K}) AS dk, max(d) FILTER (rank = {K + 1}) AS d1, max(d) FILTER (rank = {2 * K + 1}) AS d2 FROM gt GROUP BY q_id)"
FIRST = f"{G}, {DK}, f AS (SELECT gt.*, dk FROM gt JOIN dk USING (q_id) WHERE rank <= {K})"


def value(cte: str, expr: str, group: str = "GROUP BY q_id") -> str:
    return f"{cte} SELECT q_id, round({expr}, 6) AS value FROM f {group}"


ME_BINS = """, n AS (SELECT *, row_number() OVER (ORDER BY me, q_id) AS lo, row_number() OVER (ORDER BY me DESC, q_id DESC) AS hi FROM hard),
kept_q AS (SELECT q_id, me FROM n WHERE lo > 2 AND hi > 2), lim AS (SELECT CAST(min(me) AS DOUBLE) AS a, CAST(max(me) AS DOUBLE) AS z FROM kept_q),
binned AS (SELECT q_id, me, CAST(1 + (a + 1 * (z - a) / 5 < me)::INT + (a + 2 * (z - a) / 5 < me)::INT + (a + 3 * (z - a) / 5 < me)::INT
  + (a + 4 * (z - a) / 5 < me)::INT AS BIGINT) AS bin FROM kept_q, lim)"""

MINUS = "list_transform(list_zip({0}, {1}), lambda z: z[1] - z[2])"
MU = "mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(range(len(v))) AS i, unnest(v) AS x FROM base) GROUP BY i))"
#: Squared lengths of the rows of `gap` by the base's inverse covariance: elimination, one pivot a round.
SOLVED = f"""centred AS (SELECT id, unnest(range(1, len(v) + 1)) AS i, {MINUS.format('v', 'mu')} AS c FROM base, mu),
cov AS (SELECT i, list(x ORDER BY j) AS cells FROM (SELECT i, j, sum(c[i] * c[j]) / (count(*) - 1) AS x FROM (SELECT i, c, unnest(range(1, len(c) + 1)) AS j FROM centred) GROUP BY i, j) GROUP BY i),
sides AS (SELECT i, list(x[i] ORDER BY q_id) AS cells FROM (SELECT q_id, x, unnest(range(1, len(x) + 1)) AS i FROM gap) GROUP BY i),
solve(k, i, cells) AS (SELECT 0, i, list_concat(cov.cells, sides.cells) FROM cov JOIN sides USING (i)
  UNION ALL SELECT e.k + 1, e.i, CASE WHEN e.i = e.k + 1 THEN list_transform(p.cells, lambda x: x / p.cells[p.i]) ELSE list_transform(list_zip(e.cells, p.cells), lambda z: z[1] - z[2] * e.cells[p.i] / p.cells[p.i]) END
  FROM solve e JOIN solve p ON p.i = e.k + 1),
solved AS (SELECT i, cells[-(SELECT count(*) FROM gap) :] AS y FROM solve WHERE k = (SELECT count(*) FROM cov))
SELECT q_id, round(sum(x[i] * y[nth]), 6) AS dist FROM (SELECT q_id, x, row_number() OVER (ORDER BY q_id) AS nth FROM gap), solved GROUP BY q_id"""

ORACLES: dict[str, str] = {
    "exact_knn": f"{G} SELECT q_id, rank, id, round(d, 6) AS dist FROM gt",
    "exact_knn_expressions": f"{G} SELECT q_id, rank, id, round(d, 6) AS dist FROM gt WHERE rank <= {K}",
    "knn_graph": f"WITH {BASE}, {kg(K)} SELECT src, pos, dst FROM kg",
    "mips_knn": f"WITH {BASE}, {gt(K, dist='-' + ip('query.v', 'b.v'))} SELECT q_id, rank, id FROM gt",
    "l2_pairs": f"{NEAR} SELECT q_id, id, round({d2('a', 'b')}, 6) AS value FROM p",
    "l2_by_norms": f"{NEAR} SELECT q_id, id, round({d2('a', 'b')}, 6) AS value FROM p",
    "l2_int8": f"{NEAR} SELECT q_id, id, CAST({d2(INT8.format('a'), INT8.format('b'))} AS DOUBLE) AS value FROM p",
    "inner_product": f"{NEAR} SELECT q_id, id, round({ip('a', 'b')}, 6) AS value FROM p",
    "ip_distance": f"{NEAR} SELECT q_id, id, round(1 - {ip('a', 'b')}, 6) AS value FROM p",
    "cosine": f"{NEAR} SELECT q_id, id, round({ip('a', 'b')} / (sqrt({ip('a', 'a')}) * sqrt({ip('b', 'b')})), 6) AS value FROM p",
    "early_abandoned": f"""WITH {BASE}, {gt(40)}, t AS (SELECT q_id, d AS far FROM gt WHERE rank = 5),
g AS (SELECT q_id, id, far, d, list_transform(list_zip(query.v, base.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])) AS g FROM gt JOIN base USING (id) JOIN query USING (q_id) JOIN t USING (q_id)),
p AS (SELECT q_id, id, far, d, i, list_sum(g[1 : i]) * 64 / i AS e FROM (SELECT *, unnest([16, 32, 48]) AS i FROM g)),
o AS (SELECT q_id, id, any_value(d) AS d, arg_min(e, i) FILTER (e > far * (1 + 0.2 / sqrt(i)) ** 2) AS e FROM p GROUP BY q_id, id)
SELECT q_id, id, round(CASE WHEN e IS NULL THEN d ELSE -e END, 6) AS value FROM o""",
    "norms": f"WITH {EVERY} SELECT vec_id, round({ip('v', 'v')}, 6) AS norm2 FROM every",
    "normalized": f"WITH {EVERY}, n AS (SELECT vec_id, v, sqrt({ip('v', 'v')}) AS n FROM every) SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(v) / CASE WHEN n = 0 THEN 1e-10 ELSE n END, 6) AS x FROM n",
    "segment_means": f"WITH {EVERY}, i AS (SELECT vec_id, v, unnest(range(8)) AS i FROM every) SELECT vec_id, i, round(list_avg(v[i * 8 + 1 : i * 8 + 8]), 6) AS x FROM i",
    "centred_length": f"""WITH {BASE}, {MU},
far AS (SELECT max(sqrt({d2("v", "mu")})) AS far FROM base, mu) SELECT q_id, round(sqrt({d2("v", "mu")}) / far, 6) AS length FROM query, mu, far""",
    "neighbour_products": f"{G} SELECT q_id, rank, id, round({ip('query.v', 'base.v')}, 6) AS ip FROM gt JOIN base USING (id) JOIN query USING (q_id) WHERE rank <= {K}",
    "upsert_remove": f"""WITH {EVERY}, query AS (SELECT vec_id AS q_id, v FROM every WHERE vec_id % 10 = 0),
base AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 <> 0 AND vec_id % 7 = 1 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM every WHERE NOT (vec_id % 10 <> 0 AND vec_id % 5 = 2)), {gt(K)}
SELECT q_id, rank, id FROM gt""",
    "rescore": f"{G} SELECT q_id, rank - {K} AS rank, id, round(d, 6) AS dist FROM gt WHERE rank > {K} AND rank <= 20",
    "vecfile_roundtrip": f"WITH {EVERY} SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(v), 6) AS x FROM every",
    **{f"{m}_edges": f"WITH {BASE}, {edges(m)} SELECT src, pos, dst FROM edges" for m in TESTS},
    "reverse_graph": f"{E} SELECT dst AS src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos, src AS dst FROM edges",
    "in_degree": f"{E}, {IN} SELECT * FROM ind",
    "out_degree": f"{E} SELECT id AS node, count(src) AS degree FROM base LEFT JOIN edges ON src = id GROUP BY id",
    "graph_summary": f"{E}, o AS (SELECT id, count(src) AS n FROM base LEFT JOIN edges ON src = id GROUP BY id) SELECT CAST(sum(n) AS BIGINT) AS edges, count(*) AS nodes, round(avg(n), 6) AS avg_degree, max(n) AS max_degree FROM o",
    "graph_quality": f"{E}, h AS (SELECT count(*) AS h FROM edges JOIN kg USING (src, dst) WHERE kg.pos < {K}), n AS (SELECT count(*) AS n FROM edges) SELECT n AS edges, h AS exact_edges, round(h / n, 6) AS quality FROM h, n",
    "node_quality": f"{E} SELECT src, count(*) FILTER (kg.pos < {K}) AS exact_edges FROM edges LEFT JOIN kg USING (src, dst) GROUP BY src",
    "edge_positions": f"{E} SELECT src, dst, place + 1 AS position FROM edges",
    "edge_distances": f"{E} SELECT src, dst, round(d, 6) AS dist FROM edges",
    "hub_density": f"""{E}, {IN}, hubs AS (SELECT node FROM ind ORDER BY degree DESC, node LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM base)),
o AS (SELECT dst FROM edges WHERE src IN (FROM hubs)) SELECT (SELECT count(*) FROM hubs) AS hubs, count(*) AS links, count(*) FILTER (dst IN (FROM hubs)) AS inner_links,
round(count(*) FILTER (dst IN (FROM hubs)) / count(*), 6) AS density FROM o""",
    "degree_histogram": f"{E}, {IN}, lim AS (SELECT min(degree) AS lo, max(degree) AS hi FROM ind) SELECT CAST(least(floor((degree - lo) * 10 / (hi - lo)) + 1, 10) AS BIGINT) AS bin, count(*) AS n FROM ind, lim GROUP BY 1",
    "degree_skewness": f"{E}, {IN}, m AS (SELECT avg(degree) AS mu FROM ind) SELECT round(avg((degree - mu) ** 3) / avg((degree - mu) ** 2) ** 1.5, 6) AS skewness FROM ind, m",
    "graph_integrity": f"""{E}, {IN} SELECT count(*) FILTER (dst NOT IN (SELECT id FROM base)) AS unknown, count(*) FILTER (src = dst) AS loops,
CAST(count(*) - count(DISTINCT (src, dst)) AS BIGINT) AS repeats, (SELECT count(*) FROM ind WHERE degree = 0) AS unreached FROM edges""",
    "csr_rows": f"{E}, o AS (SELECT id, count(src) AS n FROM base LEFT JOIN edges ON src = id GROUP BY id) SELECT id AS src, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS first, n AS degree FROM o",
    "padded_graph": f"{E} SELECT id AS src, p AS pos, coalesce(edges.dst, -1) AS dst FROM (SELECT id, unnest(range(24)) AS p FROM base) LEFT JOIN edges ON edges.src = id AND edges.pos = p",
    "shuffled_ids": f"SELECT vec_id AS old, row_number() OVER (ORDER BY {MIX.format('vec_id', 3)}, vec_id) - 1 AS new FROM embeddings",
    "shuffled_gt": f"{G}, m AS (SELECT id, row_number() OVER (ORDER BY {MIX.format('id', 3)}, id) - 1 AS new FROM base) SELECT q_id, rank, new AS id FROM gt JOIN m USING (id) WHERE rank <= {K}",
    "bfs_hops": f"WITH RECURSIVE {BASE}, {edges()}, r(node, hops) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, hops + 1 FROM r JOIN edges ON src = node WHERE hops < 12) SELECT node, min(hops) AS hops FROM r GROUP BY node",
    "pagerank": f"{E}, {rank_rounds(10)} SELECT node, round(rank, 6) AS rank FROM r10",
    "me_max": f"{HARD}{ME_MAX.format(k=K)}",
    "me_bfs": f"{ALL}, {me(bfs=True)} SELECT q_id, delta0, me FROM hard",
    "delta0": f"{ALL} SELECT q_id, delta0 FROM delta",
    "hardness": f"{HARD} SELECT q_id, delta0, me FROM hard",
    "me_touched": f"{ALL}, {me(False)} SELECT q_id, delta0, me FROM hard",
    "me_fixed_delta": f"WITH RECURSIVE {BASE}, {gt(100_000)}, {edges()}, {RANKED}, {FIXED}, {me()} SELECT q_id, me FROM hard",
    "k0": f"""WITH RECURSIVE {BASE}, {gt(2 * K)}, {kg()},
er AS MATERIALIZED (SELECT g.q_id, g.rank AS u, h.rank AS v, pos + 1 AS p FROM gt g JOIN kg ON kg.src = g.id JOIN gt h ON h.q_id = g.q_id AND h.id = kg.dst),
{least(f'''w(q_id, s, v, bn) AS (SELECT q_id, rank, rank, CAST(0 AS BIGINT) FROM gt WHERE rank <= {K}
  UNION SELECT w.q_id, w.s, er.v, greatest(bn, er.p) FROM w JOIN er ON er.q_id = w.q_id AND er.u = w.v)''')}
SELECT q_id, CASE WHEN b IS NOT NULL THEN greatest(b, 1) END AS k0 FROM query LEFT JOIN pth USING (q_id)""",
    "recall_of_prefix": f"{SHORT} SELECT q_id, count(near.id) AS hits FROM truth LEFT JOIN near USING (q_id, id) GROUP BY q_id",
    "result_confusion": f"""{SHORT} SELECT q_id, count(*) FILTER (t AND n) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (n IS NULL) AS fn
FROM (SELECT q_id, id, true AS t FROM truth) FULL JOIN (SELECT q_id, id, true AS n FROM near) USING (q_id, id) GROUP BY q_id""",
    "lid_mle": value(FIRST, "-1 / avg(ln(d / dk))"),
    "lid_stable": value(FIRST, "-count(*) / sum(CASE WHEN d < dk / 2 THEN ln(d / dk) ELSE ln(1 + (d - dk) / dk) END)"),
    "lid_exp": value(FIRST, "exp(20 * exp(sum(ln(d / dk))))").replace(", 6)", ", 3)"),
    "lid_linear": value(FIRST, f"sum(d / dk) / {K}"),
    "expansion": f"{G}, {DK} SELECT q_id, round(CASE WHEN d1 <= 1e-3 THEN 0 ELSE d2 / d1 END, 6) AS value FROM dk",
    "epsilon_hardness": f"{G}, {DK} SELECT q_id, CAST(least(count(*) FILTER (d <= (1 + CAST(0.1 AS DOUBLE)) * d1), count(*) - 1) AS DOUBLE) AS value FROM gt JOIN dk USING (q_id) GROUP BY q_id",
    "relative_contrast": f"WITH {BASE}, {gt(100_000)}, {DK} SELECT q_id, round(avg(d) / max(d1), 6) AS value FROM gt JOIN dk USING (q_id) GROUP BY q_id",
    "pairwise_distance": f"{G}, n AS (SELECT q_id, rank, v FROM gt JOIN base USING (id) WHERE rank <= {K}) SELECT a.q_id, round(avg({d2('a.v', 'b.v')}), 6) AS value FROM n a JOIN n b ON a.q_id = b.q_id AND a.rank < b.rank GROUP BY a.q_id",
    "k_occurrence": f"{G}, {kg(K)}, ind AS (SELECT base.id, count(src) AS degree FROM base LEFT JOIN kg ON dst = base.id GROUP BY base.id) SELECT q_id, round(avg(degree), 6) AS value FROM gt JOIN ind USING (id) WHERE rank <= 50 GROUP BY q_id",
    "mahalanobis": f"WITH RECURSIVE {BASE}, {MU}, gap AS MATERIALIZED (SELECT q_id, {MINUS.format('v', 'mu')} AS x FROM query, mu), {SOLVED}",
    "mahalanobis_nearest": f"WITH RECURSIVE {BASE}, {gt(1)}, {MU}, gap AS MATERIALIZED (SELECT q_id, {MINUS.format('query.v', 'base.v')} AS x FROM gt JOIN base USING (id) JOIN query USING (q_id)), {SOLVED}",
    "hardness_correlation": f"""{HARD}, {DK}, l AS (SELECT q_id, -count(*) / sum(CASE WHEN d < dk / 2 THEN ln(d / dk) ELSE ln(1 + (d - dk) / dk) END) AS lid
  FROM gt JOIN dk USING (q_id) WHERE rank <= {K} GROUP BY q_id) SELECT round(corr(me, lid), 6) AS corr FROM hard JOIN l USING (q_id)""",
    "hardness_report": f"{HARD} SELECT round(CAST(min(me) AS DOUBLE), 6) AS lo, round(CAST(max(me) AS DOUBLE), 6) AS hi, round(avg(me), 6) AS mean, round(quantile_cont(CAST(me AS DOUBLE), 0.99), 6) AS p99 FROM hard",
    "hardness_boxes": f"""{HARD}, q AS (SELECT q_id % 20 AS part, quantile_cont(CAST(me AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(me AS DOUBLE), 0.5) AS median, quantile_cont(CAST(me AS DOUBLE), 0.75) AS q3 FROM hard GROUP BY 1),
i AS (SELECT q.*, me, me BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM hard JOIN q ON q_id % 20 = part)
SELECT part, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(CAST(min(me) FILTER (ok) AS DOUBLE), 6) AS low, round(CAST(max(me) FILTER (ok) AS DOUBLE), 6) AS high,
count(*) FILTER (NOT ok) AS outliers FROM i GROUP BY part, i.q1, i.median, i.q3""",
    "hardness_grid": f"""{HARD}, lim AS (SELECT min(delta0) AS x0, max(delta0) AS x1, min(me) AS y0, max(me) AS y1 FROM hard)
SELECT CAST(least(floor((delta0 - x0) * 5 / (x1 - x0)), 4) AS BIGINT) AS bx, CAST(least(floor((me - y0) * 5 / (y1 - y0)), 4) AS BIGINT) AS by, count(*) AS n FROM hard, lim GROUP BY 1, 2""",
    "workload_bins": f"{HARD}{ME_BINS} SELECT q_id, me, bin FROM binned",
    "workload_sample": f"{HARD}{ME_BINS} SELECT q_id, me, bin FROM binned QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {MIX.format('q_id', 3)}, q_id) <= 4",
    "random_subset": f"SELECT vec_id FROM embeddings ORDER BY {MIX.format('vec_id', 3)}, vec_id LIMIT 100",
}
