import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import queries as Q
from trailmark.llm import vector_graph
from trailmark.llm.kmeans_tree import Tree, nearest_neighbours
from trailmark.llm.vector_graph import near_vectors

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, v string, head int"


def unit(x):
    x = np.asarray(x, float)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    x[50:90] = x[50] + rng.normal(size=(40, 12)) * 0.05  # near copies
    x[100:110] = x[100]  # exact copies
    x[110] = 2 * x[100]
    out = [(i, [float(c) for c in v], 0, "clash", 1) for i, v in enumerate(np.float32(x))]
    bad = [None, [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11]
    return out, [(1000 + i, v, 0, "", 1) for i, v in enumerate(bad)] + [(None, out[0][1], 0, "", 1)]


def cosines(good):
    x = unit([r[1] for r in good])
    return x @ x.T


def test_near_vectors(spark, rows):
    good, bad = rows
    got = near_vectors(spark.createDataFrame(good + bad, SCHEMA)).collect()
    c = cosines(good)
    np.fill_diagonal(c, -1)
    links = list(zip(*np.nonzero(c >= 0.95)))
    label = brute.classes(range(300), links)
    named = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert {i: named[i] for i in range(300)} == {i: (int((c[i] >= 0.95).sum()), label[i], label[i] == i) for i in range(300)}
    assert all(named[r[0]] == (0, r[0], True) for r in bad[:-1])
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_near_vectors_with_links_in_many_shards(spark):
    x = np.float32(np.random.default_rng(4).normal(size=(400, 5)))
    got = near_vectors(spark.createDataFrame([(i, [float(c) for c in v], 0, "", 1) for i, v in enumerate(x)], SCHEMA), 0.8, shard_rows=16).collect()  # 25 shards
    c = cosines([(i, v) for i, v in enumerate(x)])
    np.fill_diagonal(c, -1)
    label = brute.classes(range(400), list(zip(*np.nonzero(c >= 0.8))))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int((c[i] >= 0.8).sum()), label[i]) for i in range(400)}


def test_near_vectors_in_parts(spark):
    """Clusters above the size of a shard's part, copies, and one id with two vectors."""
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(size=(12, 6))[rng.integers(0, 12, 500)] + 0.15 * rng.normal(size=(500, 6)))
    x[::9] = x[0]
    rows = [(i, [float(c) for c in v], 0, "", 1) for i, v in enumerate(x)]
    twice = rows + [(3, [9.0] * 6, 0, "", 1), rows[4]]
    got = near_vectors(spark.createDataFrame(twice, SCHEMA).repartition(5), 0.95, shard_rows=24, shards=20).collect()
    x[3] = min(x[3].tolist(), [9.0] * 6)
    c = cosines([(i, v) for i, v in enumerate(x)])
    np.fill_diagonal(c, -1)
    label = brute.classes(range(500), list(zip(*np.nonzero(c >= 0.95))))
    want = {i: (int((c[i] >= 0.95).sum()), label[i]) for i in range(500)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == 502


def test_near_vectors_store_as_much_for_each_row_of_a_larger_table(spark):
    """Of spread-out vectors any two shards must be compared; only computing may grow with the square. One cluster fills several cells."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    rng, each = np.random.default_rng(6), []
    for n in (500, 2000):
        x = unit(rng.normal(size=(n, 32)))
        x[: n // 8] = x[0] + 0.04 * rng.normal(size=(n // 8, 32))
        x = np.float32(x)
        rows = spark.createDataFrame([(i, [float(c) for c in v], 0, "", 1) for i, v in enumerate(x)], SCHEMA)
        before = written()
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(rows, shard_rows=64).collect()}
        each.append((written() - before) / n)
        c = cosines([(i, v) for i, v in enumerate(x)])
        np.fill_diagonal(c, -1)
        label = brute.classes(range(n), list(zip(*np.nonzero(c >= 0.95))))
        assert got == {i: (int((c[i] >= 0.95).sum()), label[i]) for i in range(n)}
    assert each[1] < 1.2 * each[0] and each[1] < 16 * 4 * 32  # times the bytes of a vector


def test_linked_decides_as_double_precision_does():
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(1500, 40)))
    x[700:] = unit(x[:800] + 0.0519 * rng.normal(size=(800, 40)))  # cosines around 0.95
    near = x @ x.T
    assert (np.abs(near - 0.95) < 1e-5).sum() > 0
    found = [np.stack(p) for p in vector_graph.linked(x[:600], x, 0.95)]
    assert set(zip(*np.concatenate(found, axis=1).tolist())) == set(zip(*(p.tolist() for p in np.nonzero(near[:600] >= 0.95))))


def test_reachable_rules_out_no_link():
    rng = np.random.default_rng(5)
    for d, threshold in ((3, 0.95), (8, 0.9), (4, -0.2)):
        x = unit(rng.normal(size=(600, d)) + 3 * rng.normal(size=(6, d))[rng.integers(0, 6, 600)])
        centres = unit(rng.normal(size=(20, d)))
        home, radius = (x @ centres.T).argmax(axis=1), np.full(20, -1.0)
        np.maximum.at(radius, home, np.arccos(np.clip((x @ centres.T).max(axis=1), -1, 1)))
        a, b = np.nonzero(x @ x.T >= threshold)
        may = vector_graph.reachable(x, centres, radius, threshold)
        assert may[a, home[b]].all()
        assert threshold < 0 or may.mean() < 0.6


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest(spark, rows):
    good, bad = rows
    got = nearest_neighbours(spark.createDataFrame(good + bad, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    c = cosines(good)
    np.fill_diagonal(c, -2)
    hit = 0
    for q in range(0, 300, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - c[q, v]) < 1e-9 for _, v, s in mine)
        best = np.lexsort((np.arange(300), -np.round(c[q], 12)))[:5]
        hit += len(set(best.tolist()) & {v for _, v, _ in mine})
    assert hit >= 27
    assert {r.query_id for r in got} == set(range(0, 300, 50))


def test_nearest_in_a_deep_tree(spark):
    """Three levels, leaves in several parts, and more equal vectors than are asked for."""
    rng = np.random.default_rng(9)
    x = np.float32(rng.normal(size=(40, 10))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 10)))
    x[1000:1400] = x[50]
    tree = Tree(unit(x), 4000, 8)
    depth = lambda nodes: 1 + max((depth(tree.children[n]) for n in nodes if tree.children[n]), default=0)
    assert depth(tree.top) >= 3 and tree.n_leaves > 256
    rows = spark.createDataFrame([(i, [float(c) for c in v], 0, "", 1) for i, v in enumerate(x)], SCHEMA).repartition(6)
    got = nearest_neighbours(rows, F.col("vec_id") % 50 == 0, leaf_rows=8, part=16).collect()
    c = cosines([(i, v) for i, v in enumerate(x)])
    np.fill_diagonal(c, -2)
    hit = 0
    for q in range(0, 4000, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s - c[q, v]) < 1e-9 for _, v, s in mine)
        hit += len(set(np.lexsort((np.arange(4000), -np.round(c[q], 12)))[:5].tolist()) & {v for _, v, _ in mine})
    assert hit >= 0.9 * 400
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [1000, 1001, 1002, 1003, 1004]
    everything = nearest_neighbours(rows.filter("vec_id between 1000 and 1399"), F.col("vec_id") % 100 == 0).collect()
    assert len(everything) == 20  # k rows for each query, however many tie


def test_nearest_with_few_candidates(spark):
    three = [(0, [1.0, 0.0], 0, "", 1), (1, [1.0, 1.0], 0, "", 1), (2, [0.0, 1.0], 0, "", 1)]
    got = nearest_neighbours(spark.createDataFrame(three, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)]
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = unit(np.stack(table["embedding"])), table["vec_id"].to_numpy()
    got = Q.op8_kmeans_tree(spark, sf_dir).toPandas()
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        hit += len(set(best) & set(got[got["query_id"] == ids[i]]["vec_id"]))
        total += 5
    assert hit >= 0.9 * total
