"""Hand graphs with known answers, random graphs against plain Python, and round trips of the file formats."""

import heapq
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import components, layout, ranking, stats, traversal
from tessella.operators.components import star_components
from tessella.plans import loop
from tessella.plans.registry import TABLE
from tessella.sources import edge_list

T8 = [(0, 1, 5), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 2), (5, 6, 7)]


@pytest.fixture(scope="module")
def t8(spark):
    return Graph(spark.createDataFrame(T8, "src long, dst long, weight long"), 8)


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_t8(t8):
    plain = Graph(t8.edges.select("src", "dst"), 8)
    assert rows(traversal.bfs(t8), "id", "level", "parent") == {(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 1), (4, 3, 3)}
    assert rows(traversal.bfs(t8, 0, 1), "id") == {(0,), (1,), (2,)}
    assert rows(traversal.sssp(t8), "id", "dist") == {(0, 0), (1, 5), (2, 1), (3, 2), (4, 4)}
    assert rows(traversal.sssp(plain), "id", "dist") == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert rows(traversal.bellman_ford(t8, 0, 2), "id", "dist") == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert rows(traversal.min_label(t8), "id", "label") == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5), (6, 5), (7, 7)}
    ranks = {r["id"]: round(r["rank"], 5) for r in ranking.pagerank(t8).collect()}
    assert ranks == {0: 0.01875, 1: 0.44375, 2: 0.44375, 3: 1.71875, 4: 0.86875, 5: 0.01875, 6: 0.86875, 7: 0.01875}
    assert {(r["id"], r["sigma"], round(r["dependency"], 9)) for r in ranking.betweenness(t8).collect()} == {(0, 1, 4), (1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 2, 0)}
    status = ranking.independent_set(t8)
    assert rows(status, "id", "status") == {(0, 3), (1, 2), (2, 2), (3, 3), (4, 2), (5, 3), (6, 2), (7, 3)}
    assert ranking.independent_set_violations(t8, status).count() == 0
    assert ranking.independent_set_size(status).first()[0] == 4
    bad = status.withColumn("status", F.when(F.col("id").isin(1, 3, 4), 3).otherwise(2))
    assert rows(ranking.independent_set_violations(t8, bad), "fault", "id") == {("edge", 1), ("edge", 3), ("gap", 5), ("gap", 6), ("gap", 7)}
    assert rows(traversal.bellman_ford(t8, 0, 9, "weight"), "id", "dist") == rows(traversal.sssp(t8), "id", "dist")
    parts = stats.connected_components(t8)
    assert rows(stats.component_sizes(parts), "component", "size") == {(0, 5), (5, 2), (7, 1)}
    assert rows(stats.component_summary(parts), "components", "largest", "largest_size") == {(3, 0, 5)}
    assert rows(stats.degree_histogram(t8), "degree", "vertices") == {(0, 3), (1, 4), (2, 1)}


def test_t8_layout(t8):
    assert rows(layout.tile_sizes(t8, 3), "tile_id", "size") == {(0, 2), (1, 2), (4, 1), (5, 1)}
    assert [r["offset"] for r in layout.tile_offsets(t8, 3).orderBy("tile_id").collect()] == [0, 2, 4, 4, 4, 5, 6, 6, 6]
    every = t8.spark.createDataFrame([(3 * r, 3 * c) for r in range(3) for c in range(3)], "src long, dst long")
    walk = layout.striped(Graph(every, 9), 3, 2).orderBy("stripe_order").collect()
    assert [(r["tile_row"], r["tile_col"]) for r in walk] == [(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert rows(layout.labels_by_degree(t8), "id", "new_id") == {(0, 0), (5, 1), (3, 2), (2, 3), (1, 4), (7, 5), (6, 6), (4, 7)}
    assert all(a == b for a, b in rows(layout.labels_by_bfs(t8), "id", "new_id"))
    assert layout.tile_width_range(1632803, 30622564) == (1024, 16384)
    assert layout.tile_width_range(41652230, 1468365182) == (4096, 524288)
    with pytest.raises(ValueError):
        layout.checked_tiles(t8, 1)
    assert t8.invalid_edges().count() == 0
    assert Graph(t8.edges, 6).invalid_edges().count() == 1


def test_odd_graphs(spark, monkeypatch):
    none = Graph(spark.createDataFrame([], "src long, dst long"), 0)
    assert traversal.bfs(none).count() == traversal.min_label(none).count() == ranking.pagerank(none).count() == 0
    assert ranking.independent_set(none).count() == stats.connected_components(none).count() == ranking.betweenness(none).count() == 0
    double = Graph(spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 2), (2, 0)], "src long, dst long"), 3)
    assert rows(traversal.bfs(double), "id", "level") == {(0, 0), (1, 1), (2, 2)}
    assert {r["id"]: r["sigma"] for r in ranking.betweenness(double).collect()} == {0: 1, 1: 2, 2: 2}
    loose = Graph(spark.createDataFrame([(0, 1), (0, None), (None, 1), (1, 9), (-1, 0), (1, 2)], "src long, dst long"), 3)
    assert loose.invalid_edges().count() == 4
    assert rows(traversal.bfs(loose), "id", "level") == {(0, 0), (1, 1), (2, 2)} == rows(traversal.sssp(loose), "id", "dist")
    assert {r["id"] for r in ranking.pagerank(loose).collect()} == {r["id"] for r in stats.connected_components(loose).collect()} == {0, 1, 2}
    assert rows(traversal.bfs_profile(loose), "level", "vertices") == {(0, 1), (1, 1), (2, 1)}
    assert ranking.betweenness_sum(loose, []).count() == 0 and rows(ranking.betweenness_sum(loose, [0, 1]), "id", "dependency") == {(1, 1.0), (2, 0.0)}
    monkeypatch.setattr(loop, "MERGE", 3)
    many = Graph(spark.createDataFrame([(k, k + 1) for k in range(8)] * 256, "src long, dst long"), 9)
    assert {r["id"]: r["sigma"] for r in ranking.betweenness(many).collect()}[8] == 2.0**64
    path = Graph(spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long"), 13)
    assert traversal.bellman_ford(path, 0, 9).count() == 10
    assert rows(stats.bin_average(spark.createDataFrame([(i, i) for i in range(1, 8)], "pos long, value long"), 3), "bin", "average") == {(1, 2), (2, 5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 9)) for _ in range(70)]
    g = Graph(spark.createDataFrame(edges, "src long, dst long, weight long"), n).bucketed()
    out = defaultdict(list)
    for a, b, w in edges:
        out[a].append((b, w))
    dist, heap = {}, [(0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for b, w in out[v]:
                heapq.heappush(heap, (d + w, b))
    assert dict(rows(traversal.sssp(g), "id", "dist")) == dist
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    inside = set()
    for v in range(n):
        if not near[v] & inside:
            inside.add(v)
    assert {i for i, s in rows(ranking.independent_set(g), "id", "status") if s == 3} == inside
    least = list(range(n))
    for _ in range(n):
        for a, b, _w in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(rows(stats.connected_components(g), "id", "component")) == dict(enumerate(least))
    found = {(r["id"], r["component"]) for r in star_components(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).collect()}
    assert all(least[i] == c for i, c in found)


def test_few_edges_are_joined_at_once(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(70)] + [(None, 3), (4, None), (7, 7)]
    found, tables, write = [], [], components.stored
    monkeypatch.setattr(components, "stored", lambda *a: tables.append(a[1]) or write(*a))
    for kind in ("long", "int"):
        edges = spark.createDataFrame(pairs, f"u {kind}, v {kind}")
        out = star_components(edges)
        assert [k for _, k in out.dtypes] == [k for _, k in edges.dtypes]
        found.append(sorted(rows(out, "id", "component")))
        assert out.count() == len(found[-1])
    assert len(tables) == 2  # one for each: no rounds
    monkeypatch.setattr(components, "FEW", 0)
    found.append(sorted(rows(star_components(edges), "id", "component")))
    assert len(tables) > 4 and all(x == found[0] for x in found) and (60, 0) in found[0]


def test_files(spark, t8, tmp_path):
    want = Counter(T8)
    back = lambda g: Counter(tuple(r) for r in g.edges.select("src", "dst", *(["weight"] if g.weighted else [])).collect())
    edge_list.write_edge_list(t8, f"{tmp_path}/one")
    assert open(f"{tmp_path}/one").readline() == "8 6\n"
    g = edge_list.read_edge_list(spark, f"{tmp_path}/one", True)
    assert g.n == 8 and back(g) == want
    edge_list.write_shards(t8, f"{tmp_path}/s", 4)
    assert [sum(1 for _ in open(f"{tmp_path}/s-{k}")) for k in range(4)] == [2, 1, 1, 3]
    assert back(edge_list.read_shards(spark, f"{tmp_path}/s", 4, True)) == want
    assert rows(edge_list.read_degrees(spark, f"{tmp_path}/s"), "id", "out_degree") == {(0, 2), (1, 1), (2, 1), (3, 1), (4, 0), (5, 1), (6, 0), (7, 0)}
    edge_list.write_shards(t8, f"{tmp_path}/t", 2, ["stripe_order"], layout.striped(t8, 3, 2))
    assert back(edge_list.read_shards(spark, f"{tmp_path}/t", 2, True)) == want
    edge_list.write_offsets(layout.tile_offsets(t8, 3), f"{tmp_path}/t")
    assert open(f"{tmp_path}/t-offsets").read().split() == ["0", "2", "4", "4", "4", "5", "6", "6", "6"]
    edge_list.write_headless(t8, f"{tmp_path}/h")
    assert back(edge_list.read_headless(spark, f"{tmp_path}/h", 8, True)) == want
    edge_list.write_adjacency(t8, f"{tmp_path}/a.adj")
    assert back(edge_list.read_adjacency(spark, f"{tmp_path}/a.adj")) == Counter((a, b) for a, b, _ in T8)
    edge_list.write_converted(t8, f"{tmp_path}/v")
    assert back(edge_list.read_converted(spark, f"{tmp_path}/v", 8)) == want
    assert rows(edge_list.read_offsets(spark, f"{tmp_path}/t"), "tile_id", "offset") >= {(0, 0), (3, 4), (8, 6)}
    (tmp_path / "c").write_text("word\n0 1 5\n5 6 7\n")
    assert back(edge_list.read_converted(spark, f"{tmp_path}/c", 8)) == Counter({(0, 1, 5): 1, (5, 6, 7): 1})


def test_registry_has_sql_for_every_query():
    assert len(TABLE) > 35 and all(callable(q) and sql for q, sql in TABLE.values())
