"""Registered queries over graphs derived from the input tables, and the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import layout, ranking, stats, traversal
from tessella.sources import edge_list
from tessella.sources.derived import SQL, cust_day, part_chain, part_supp
from tessella.tables import scratch_path

W, R = 100, 4  # tile width and stripe height of the registered layout queries


def _graph(name: str) -> str:
    edges, n = SQL[name]
    return f"WITH RECURSIVE e AS MATERIALIZED ({edges}), n AS MATERIALIZED (SELECT CAST({n} AS BIGINT) AS n), v AS MATERIALIZED (SELECT range AS id FROM range((SELECT n FROM n)))"


PC, CD, PS = _graph("part_chain"), _graph("cust_day"), _graph("part_supp")
_TILES = f"""{PC}, s AS MATERIALIZED (SELECT CAST(ceil(n / {W}.0) AS BIGINT) AS side FROM n),
t AS MATERIALIZED (SELECT src, dst, src // {W} AS tile_row, dst // {W} AS tile_col, (src // {W}) * side + dst // {W} AS tile_id, side FROM e, s)"""
_BFS = """, b(id, level, parent) USING KEY (id) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT
UNION SELECT e.dst, min(b.level) + 1, min(e.src) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst)"""


def _relax(start: str, value: str) -> str:
    return f""", b(id, value) USING KEY (id) AS ({start}
UNION SELECT e.dst, min({value}) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b r ON r.id = e.dst GROUP BY e.dst, r.value HAVING r.value IS NULL OR min({value}) < r.value)"""


_BOTH = ", u AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"
_WCC = f"{CD}{_BOTH}, b(id, value) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT u.dst, min(b.value) FROM b JOIN u ON u.src = b.id LEFT JOIN recurring.b r ON r.id = u.dst GROUP BY u.dst, r.value HAVING min(b.value) < r.value)"


def _pagerank(k: int) -> str:
    steps = [f"{PC}, d AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    for i in range(k):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * coalesce(s, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst AS id, sum(r{i}.rank / d.d) AS s FROM e JOIN r{i} ON r{i}.id = e.src JOIN d ON d.id = e.src GROUP BY e.dst) x ON x.id = v.id)")
    return ", ".join(steps) + f" SELECT id, round(rank, 6) AS rank FROM r{k}"


def _betweenness(depth: int = 8) -> str:
    steps = [f"{PC}{_BFS}, s0 AS MATERIALIZED (SELECT 0::BIGINT AS id, 1::HUGEINT AS sigma)"]
    for k in range(1, depth + 1):
        steps.append(f"s{k} AS MATERIALIZED (SELECT e.dst AS id, sum(s.sigma) AS sigma FROM s{k - 1} s JOIN e ON e.src = s.id JOIN b ON b.id = e.dst AND b.level = {k} GROUP BY e.dst)")
    steps.append(f"x{depth} AS MATERIALIZED (SELECT id, sigma, 1.0::DOUBLE / sigma AS x FROM s{depth})")
    for k in reversed(range(depth)):
        steps.append(f"x{k} AS MATERIALIZED (SELECT s.id, s.sigma, 1.0::DOUBLE / s.sigma + coalesce(y.t, 0) AS x FROM s{k} s LEFT JOIN (SELECT e.src AS id, sum(x.x) AS t FROM e JOIN x{k + 1} x ON x.id = e.dst GROUP BY e.src) y ON y.id = s.id)")
    union = " UNION ALL ".join(f"SELECT id, {k}::BIGINT AS level, CAST(sigma AS BIGINT) AS sigma, round(sigma * x - 1, 6) + 0.0 AS dependency FROM x{k}" for k in range(depth + 1))
    return ", ".join(steps) + " " + union


def _betweenness_sum(sources: list[int]) -> str:
    parts = [f"SELECT id, dependency FROM ({_betweenness().replace('SELECT 0::BIGINT', f'SELECT {k}::BIGINT').replace(', 0::BIGINT, 0::BIGINT', f', 0::BIGINT, {k}::BIGINT').replace('round(sigma * x - 1, 6) + 0.0', 'sigma * x - 1')}) WHERE id <> {k}" for k in sources]
    return f"SELECT id, round(sum(dependency), 6) + 0.0 AS dependency FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


def _mis(rounds: int = 24) -> str:
    steps = [f"{CD}{_BOTH}, f0 AS MATERIALIZED (SELECT id, 1 AS st FROM v)"]
    for k in range(rounds):
        steps.append(f"i{k} AS MATERIALIZED (SELECT id FROM f{k} f WHERE st = 1 AND NOT EXISTS (SELECT 1 FROM u JOIN f{k} g ON g.id = u.dst WHERE u.src = f.id AND u.dst < u.src AND g.st = 1))")
        steps.append(f"f{k + 1} AS MATERIALIZED (SELECT id, CASE WHEN st <> 1 THEN st WHEN id IN (SELECT id FROM i{k}) THEN 3 WHEN id IN (SELECT u.dst FROM u JOIN i{k} ON i{k}.id = u.src) THEN 2 ELSE 1 END AS st FROM f{k})")
    return ", ".join(steps) + f" SELECT id, st AS status FROM f{rounds}"


def _visits(hops: int, sources: int) -> str:
    return f"""{CD}, w AS (SELECT source, id, 0 AS level FROM (SELECT range AS source, range AS id FROM range(0, (SELECT n FROM n), (SELECT greatest(1, n // {sources}) FROM n)))
UNION SELECT w.source, e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id WHERE w.level < {hops + 1})"""


def _rounded(df, *names: str):
    return df.withColumns({x: F.round(x, 6) + 0.0 for x in names})


_EDGES = f"{PC} SELECT src, dst, weight FROM e"


def _advice(spark, sf_dir):
    g = part_chain(spark, sf_dir)
    least, most = layout.tile_width_range(g.n * 1000, g.edges.count() * 1000)
    return spark.createDataFrame([(least, most)], "min_width long, max_width long")


#: name -> (query, SQL)
TABLE = {
    "out_degree": (lambda s, d: part_chain(s, d).degrees().select("id", "out_degree"), f"{PC} SELECT v.id, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"),
    "in_degree": (lambda s, d: part_supp(s, d).degrees().select("id", "in_degree"), f"{PS} SELECT v.id, count(e.dst) AS in_degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "degree_histogram": (
        lambda s, d: stats.degree_histogram(part_chain(s, d)),
        f"{PC}, g AS MATERIALIZED (SELECT v.id, count(e.src) AS k FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT range AS degree, (SELECT count(*) FROM g WHERE k = range) AS vertices FROM range((SELECT max(k) + 1 FROM g))",
    ),
    "symmetrize": (lambda s, d: part_chain(s, d).symmetrized().edges, f"{PC} SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e"),
    "reverse_edges": (lambda s, d: part_chain(s, d).reversed().edges, f"{PC} SELECT dst AS src, src AS dst, weight FROM e"),
    "source_order": (lambda s, d: layout.source_order(part_chain(s, d)), f"{PC} SELECT src, dst, weight, row_number() OVER (ORDER BY src, dst, weight) - 1 AS position FROM e"),
    "shift_ids": (lambda s, d: layout.shifted(part_chain(s, d).edges, 1), f"{PC} SELECT src + 1 AS src, dst + 1 AS dst, weight FROM e"),
    "invalid_edges": (lambda s, d: Graph((g := part_chain(s, d)).edges, g.n // 2).invalid_edges(), f"{PC} SELECT e.* FROM e, n WHERE src < 0 OR dst < 0 OR src >= n // 2 OR dst >= n // 2"),
    "adjacency_lists": (
        lambda s, d: layout.adjacency(part_chain(s, d)).select("id", "degree", "offset", F.array_min("neighbours").alias("first"), F.array_max("neighbours").alias("last")),
        f"{PC}, a AS (SELECT v.id, count(e.src) AS degree, min(e.dst) AS first, max(e.dst) AS last FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", first, last FROM a",
    ),
    "adjacency_explode": (lambda s, d: layout.adjacency_to_edges(layout.adjacency(part_chain(s, d))), f"{PC} SELECT src, dst FROM e"),
    "tile_assign": (lambda s, d: layout.tiled(part_chain(s, d), W).select("src", "dst", "tile_row", "tile_col", "tile_id"), f"{_TILES} SELECT src, dst, tile_row, tile_col, tile_id FROM t"),
    "tile_sizes": (lambda s, d: layout.tile_sizes(part_chain(s, d), W), f"{_TILES} SELECT tile_id, count(*) AS size FROM t GROUP BY tile_id"),
    "tile_offsets": (
        lambda s, d: layout.tile_offsets(part_chain(s, d), W),
        f"{_TILES}, z AS (SELECT range AS tile_id, (SELECT count(*) FROM t WHERE t.tile_id = range) AS size FROM range((SELECT side * side FROM s))) SELECT tile_id, size, CAST(coalesce(sum(size) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM z",
    ),
    "reverse_tile_sizes": (lambda s, d: layout.tile_sizes(part_chain(s, d).reversed(), W), f"{_TILES} SELECT tile_col * side + tile_row AS tile_id, count(*) AS size FROM t GROUP BY ALL"),
    "stripe_order": (
        lambda s, d: layout.striped(part_chain(s, d), W, R).select("src", "dst", "tile_id", "stripe_order"),
        f"{_TILES} SELECT src, dst, tile_id, (tile_row // {R}) * {R} * side + tile_col * least({R}, side - {R} * (tile_row // {R})) + tile_row % {R} AS stripe_order FROM t",
    ),
    "reverse_stripe_order": (
        lambda s, d: layout.striped(part_chain(s, d).reversed(), W, R).select("src", "dst", "tile_id", "stripe_order"),
        f"{_TILES} SELECT dst AS src, src AS dst, tile_col * side + tile_row AS tile_id, (tile_col // {R}) * {R} * side + tile_row * least({R}, side - {R} * (tile_col // {R})) + tile_col % {R} AS stripe_order FROM t",
    ),
    "tile_size_advisor": (
        _advice,
        f"""{PC}, p AS (SELECT 64 * (1::BIGINT << range) AS w FROM range(40)), q AS (SELECT w, CAST(ceil(n * 1000 / w::DOUBLE) AS HUGEINT) AS side, (SELECT count(*) FROM e) * 1000 AS m FROM p, n),
        a AS (SELECT min(w) AS least FROM q WHERE side * side <= 4294967295), b AS (SELECT min(w) AS least FROM q, a WHERE w >= a.least AND (m // (side * side) >= 8 OR side <= 1)),
        c AS (SELECT min(w) AS w FROM q, b WHERE q.w >= b.least AND side <= 64) SELECT CAST(least AS BIGINT) AS min_width, CAST(w // 2 AS BIGINT) AS max_width FROM b, c""",
    ),
    "relabel_by_degree": (
        lambda s, d: layout.relabelled(g := part_chain(s, d), layout.labels_by_degree(g)).edges,
        f"{PC}, l AS (SELECT v.id, row_number() OVER (ORDER BY count(e.src) DESC, v.id DESC) - 1 AS k FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT a.k AS src, b.k AS dst, weight FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst",
    ),
    "relabel_by_bfs": (
        lambda s, d: layout.labels_by_bfs(part_chain(s, d)),
        f"{PC}{_BFS} SELECT v.id, row_number() OVER (ORDER BY level ASC NULLS LAST, v.id) - 1 AS new_id FROM v LEFT JOIN b ON b.id = v.id",
    ),
    "bfs_levels": (lambda s, d: traversal.bfs(part_chain(s, d).bucketed()).select("id", "level"), f"{PC}{_BFS} SELECT id, level FROM b"),
    "bfs_parents": (lambda s, d: traversal.bfs(part_chain(s, d).bucketed()).select("id", "parent"), f"{PC}{_BFS} SELECT id, parent FROM b"),
    "bfs_level_sizes": (lambda s, d: traversal.bfs(part_chain(s, d).bucketed()).groupBy("level").agg(F.count(F.lit(1)).alias("vertices")), f"{PC}{_BFS} SELECT level, count(*) AS vertices FROM b GROUP BY level"),
    "bfs_bounded": (lambda s, d: traversal.bfs(part_chain(s, d).bucketed(), 1, 2).select("id", "level"), f"{PC}{_BFS.replace('SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT', 'SELECT 1::BIGINT, 0::BIGINT, 1::BIGINT')} SELECT id, level FROM b WHERE level <= 2"),
    "frontier_stats": (
        lambda s, d: traversal.frontier_stats(part_chain(s, d).bucketed()),
        f"{PC}{_BFS}, k AS (SELECT src, count(*) AS d FROM e GROUP BY src), m AS (SELECT count(*) AS m FROM e) SELECT level, count(*) AS frontier, CAST(coalesce(sum(d), 0) AS BIGINT) AS out_edges, any_value(m) AS edges, CAST(1000000 * coalesce(sum(d), 0) // any_value(m) AS BIGINT) AS needed_ppm FROM b LEFT JOIN k ON k.src = b.id CROSS JOIN m GROUP BY level",
    ),
    "visit_counts": (lambda s, d: traversal.visit_counts(cust_day(s, d), 2, 50), f"{_visits(2, 50)} SELECT id, count(DISTINCT source) AS visits FROM w WHERE id <> source GROUP BY id"),
    "access_ranks": (
        lambda s, d: stats.access_ranks(traversal.visit_counts(cust_day(s, d), 2, 50)),
        f"{_visits(2, 50)} SELECT row_number() OVER (ORDER BY visits DESC, id) - 1 AS rank, visits FROM (SELECT id, count(DISTINCT source) AS visits FROM w WHERE id <> source GROUP BY id)",
    ),
    "sssp_unweighted": (lambda s, d: traversal.sssp(_plain(part_chain(s, d)).bucketed()), f"{PC}{_BFS} SELECT id, level AS dist FROM b"),
    "sssp_weighted": (lambda s, d: traversal.sssp(part_chain(s, d).bucketed()), f"{PC}{_relax('SELECT 0::BIGINT, 0::BIGINT', 'b.value + e.weight')} SELECT id, value AS dist FROM b"),
    "bellman_ford": (lambda s, d: traversal.bellman_ford(part_chain(s, d).bucketed()), f"{PC}{_relax('SELECT 0::BIGINT, 0::BIGINT', 'b.value + 1')} SELECT id, value AS dist FROM b"),
    "pagerank_1": (lambda s, d: _rounded(ranking.pagerank(part_chain(s, d)), "rank"), _pagerank(1)),
    "pagerank_5": (lambda s, d: _rounded(ranking.pagerank(part_chain(s, d).bucketed(), iterations=5), "rank"), _pagerank(5)),
    "min_label": (lambda s, d: traversal.min_label(cust_day(s, d).bucketed()), f"{CD}{_relax('SELECT id, id FROM v', 'b.value')} SELECT id, value AS label FROM b"),
    "connected_components": (lambda s, d: stats.connected_components(cust_day(s, d)), f"{_WCC} SELECT id, value AS component FROM b"),
    "component_sizes": (lambda s, d: stats.component_sizes(stats.connected_components(cust_day(s, d))), f"{_WCC} SELECT value AS component, count(*) AS size FROM b GROUP BY value"),
    "component_summary": (
        lambda s, d: stats.component_summary(stats.connected_components(cust_day(s, d))),
        f"{_WCC}, z AS (SELECT value, count(*) AS size FROM b GROUP BY value) SELECT (SELECT count(*) FROM z) AS components, value AS largest, size AS largest_size FROM z ORDER BY size DESC, value LIMIT 1",
    ),
    "betweenness": (lambda s, d: _rounded(ranking.betweenness(part_chain(s, d).bucketed()), "dependency").withColumn("sigma", F.col("sigma").cast("long")), _betweenness()),
    "betweenness_sum": (lambda s, d: _rounded(ranking.betweenness_sum(part_chain(s, d).bucketed(), [0, 1, 2]), "dependency"), _betweenness_sum([0, 1, 2])),
    "independent_set": (lambda s, d: ranking.independent_set(cust_day(s, d)), _mis()),
    "independent_set_check": (
        lambda s, d: ranking.independent_set_violations(g := cust_day(s, d), ranking.independent_set(g)).groupBy("fault").agg(F.count(F.lit(1)).alias("faults")),
        "SELECT 'edge' AS fault, 0::BIGINT AS faults WHERE false",
    ),
    "independent_set_size": (lambda s, d: ranking.independent_set_size(ranking.independent_set(cust_day(s, d))), f"SELECT count(*) FILTER (status = 3) AS size FROM ({_mis()})"),
    "independent_set_faults": (
        lambda s, d: ranking.independent_set_violations(g := cust_day(s, d), g.ids.select("id", F.when(F.col("id") % 3 == 0, 3).otherwise(2).alias("status"))),
        f"{CD}{_BOTH} SELECT 'edge' AS fault, src AS id FROM u WHERE src < dst AND src % 3 = 0 AND dst % 3 = 0 UNION ALL SELECT 'gap', id FROM v WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM u WHERE src = id AND dst % 3 = 0)",
    ),
    "bfs_profile": (lambda s, d: traversal.bfs_profile(part_chain(s, d).bucketed()).select("level", "vertices"), f"{PC}{_BFS} SELECT level, count(*) AS vertices FROM b GROUP BY level"),
    "bellman_ford_weighted": (lambda s, d: traversal.bellman_ford(part_chain(s, d).bucketed(), weight="weight"), f"{PC}{_relax('SELECT 0::BIGINT, 0::BIGINT', 'b.value + e.weight')} SELECT id, value AS dist FROM b"),
    "relabelled_by_bfs": (
        lambda s, d: layout.relabelled(g := part_chain(s, d).bucketed(), layout.labels_by_bfs(g)).edges,
        f"{PC}{_BFS}, l AS (SELECT v.id, row_number() OVER (ORDER BY level ASC NULLS LAST, v.id) - 1 AS k FROM v LEFT JOIN b ON b.id = v.id) SELECT a.k AS src, z.k AS dst, weight FROM e JOIN l a ON a.id = e.src JOIN l z ON z.id = e.dst",
    ),
    # Files: written to the shared folder and read again.
    "edge_list_file": (lambda s, d: _back(s, d, lambda g, p: edge_list.write_edge_list(g, p), lambda p, g: edge_list.read_edge_list(s, p, True).edges), _EDGES),
    "plain_edge_list_file": (lambda s, d: _back(s, d, lambda g, p: edge_list.write_edge_list(_plain(g), p), lambda p, g: edge_list.read_edge_list(s, p).edges), f"{PC} SELECT src, dst FROM e"),
    "headless_file": (lambda s, d: _back(s, d, edge_list.write_headless, lambda p, g: edge_list.read_headless(s, p, g.n, True).edges), _EDGES),
    "converted_file": (lambda s, d: _back(s, d, edge_list.write_converted, lambda p, g: edge_list.read_converted(s, p, g.n).edges), _EDGES),
    "sharded_files": (lambda s, d: _back(s, d, lambda g, p: edge_list.write_shards(g, p, 8), lambda p, g: edge_list.read_shards(s, p, 8, True).edges), _EDGES),
    "plain_sharded_files": (lambda s, d: _back(s, d, lambda g, p: edge_list.write_shards(_plain(g), p, 8), lambda p, g: edge_list.read_shards(s, p, 8).edges), f"{PC} SELECT src, dst FROM e"),
    "reversed_files": (lambda s, d: _back(s, d, lambda g, p: edge_list.write_shards(g, p, 8), lambda p, g: edge_list.read_shards(s, p, 8, True).reversed().edges), f"{PC} SELECT dst AS src, src AS dst, weight FROM e"),
    "tiled_files": (
        lambda s, d: _back(s, d, lambda g, p: edge_list.write_shards(g, p, 8, ["tile_id"], layout.tiled(g, W)), lambda p, g: layout.tiled(edge_list.read_shards(s, p, 8, True), W).select("src", "dst", "weight", "tile_id")),
        f"{PC}, s AS MATERIALIZED (SELECT CAST(ceil(n / {W}.0) AS BIGINT) AS side FROM n) SELECT src, dst, weight, (src // {W}) * side + dst // {W} AS tile_id FROM e, s",
    ),
    "striped_files": (
        lambda s, d: _back(s, d, lambda g, p: edge_list.write_shards(g, p, 8, ["stripe_order"], layout.striped(g, W, R)), lambda p, g: edge_list.read_shards(s, p, 8, True).edges),
        _EDGES,
    ),
    "degree_file": (lambda s, d: _back(s, d, lambda g, p: edge_list.write_shards(g, p, 8), lambda p, g: edge_list.read_degrees(s, p)), f"{PC} SELECT v.id, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"),
    "offset_file": (
        lambda s, d: _back(s, d, lambda g, p: edge_list.write_offsets(layout.tile_offsets(g, W), p), lambda p, g: edge_list.read_offsets(s, p)),
        f"{_TILES}, z AS (SELECT range AS tile_id, (SELECT count(*) FROM t WHERE t.tile_id = range) AS size FROM range((SELECT side * side FROM s))) SELECT tile_id, CAST(coalesce(sum(size) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM z",
    ),
    "adjacency_file": (lambda s, d: _back(s, d, edge_list.write_adjacency, lambda p, g: edge_list.read_adjacency(s, p).edges), f"{PC} SELECT src, dst FROM e"),
    "bin_average": (
        lambda s, d: stats.bin_average(part_chain(s, d).degrees().select((F.col("id") + 1).alias("pos"), F.col("out_degree").alias("value")), 16),
        f"{PC}, g AS (SELECT v.id + 1 AS pos, count(e.src) AS k FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT (pos - 1) // 16 + 1 AS bin, CAST(sum(k) // 16 AS BIGINT) AS average FROM g GROUP BY 1 HAVING count(*) = 16",
    ),
    "aggregate_messages": (
        lambda s, d: stats.aggregate_messages(g := part_chain(s, d), g.degrees().select("id", "out_degree"), F.col("out_degree") * F.col("weight"), F.max("message").alias("most")),
        f"{PC}, g AS (SELECT src, count(*) AS k FROM e GROUP BY src) SELECT e.dst AS id, max(g.k * e.weight) AS most FROM e JOIN g USING (src) GROUP BY e.dst",
    ),
}


def _plain(graph):
    return type(graph)(graph.edges.select("src", "dst"), graph.n)


def _back(spark, sf_dir, write, read):
    """What ``read`` finds at the path where ``write`` put the part chain."""
    graph, path = part_chain(spark, sf_dir), scratch_path(spark, "file")
    write(graph, path)
    return read(path, graph)


def queries():
    return {k: q for k, (q, _) in TABLE.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in TABLE.items()}
