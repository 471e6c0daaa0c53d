"""Ward's merges of any number of rows, against merging the nearest two each time."""

import numpy as np
import pytest

from corpuslab.operators import clustering, merging, neighbours
from corpuslab.plans import catalog


def plain(points, k):
    groups = [[i] for i in range(len(points))]
    spread = lambda g: ((points[g] - points[g].mean(axis=0)) ** 2).sum()
    while len(groups) > k:
        _, a, b = min((spread(x + y) - spread(x) - spread(y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    return {i: n for n, g in enumerate(sorted(groups, key=min)) for i in g}


@pytest.mark.parametrize("k,last", [(1, 4), (3, 4), (7, 10), (7, 100)])
def test_against_plain_merges(spark, k, last):
    rng = np.random.default_rng(k)
    points = rng.normal(size=(36, 4)) + 3 * rng.integers(0, 2, (36, 4))
    points[20], points[21] = points[4], points[5]
    rows = [*((i, p.tolist(), i) for i, p in enumerate(points)), (99, None, 1), (98, [float("nan")] * 4, 2), (97, [None, 1.0, 1.0, 1.0], 3), (None, points[0].tolist(), 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").repartition(3)
    got = [tuple(r) for r in merging.agglomerative(df, k, "vec_id", "embedding", last).select("vec_id", "node", "cluster_id").collect()]
    assert len(got) == len(rows) and all(c is None for i, _, c in got if i in (97, 98, 99))
    # the row without a key is a copy of row 0 and counts as a point
    want = plain(np.concatenate([points, points[:1]]), k)
    want.pop(36)
    assert {i: c for i, _, c in got if i is not None and i < 97} == want
    assert [c for i, _, c in got if i is None] == [want[0]]


def test_defined_cases(spark):
    kind = "vec_id long, embedding array<double>"
    assert clustering.agglomerative(spark.createDataFrame([], kind), 3, most=None).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], kind)
    assert [r["cluster_id"] for r in clustering.agglomerative(same, 3, most=None).collect()] == [0] * 5
    with pytest.raises(ValueError, match="lengths"):
        clustering.agglomerative(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind), 2, most=None)
    with pytest.raises(ValueError, match="least"):
        clustering.agglomerative(same, 0, most=None)


def test_all_embeddings(spark):
    """The registered query against the merges of one task over the same vectors."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    want = clustering.ward(np.array([r["embedding"] for r in rows], float), 10)
    got = {r["vec_id"]: r["cluster_id"] for r in catalog.queries()["agglomerated_vectors"](spark, sf).collect()}
    assert [got[r["vec_id"]] for r in rows] == want.tolist()


def test_equal_costs_dont_wait(spark):
    """Points at equal distances on a line: all merges tie, and rounds stay few."""
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(256)], "vec_id long, embedding array<double>")
    points = rows.selectExpr("vec_id AS node", "embedding AS vector", "1L AS weight", "true AS core")
    merges = merging.tree(neighbours.materialise(points, "points"), 16).collect()
    assert len(merges) == 255
    turns = {r["turn"] for r in merges}
    assert len(turns) - 15 <= 16


def test_nearest_in_tiles(monkeypatch):
    monkeypatch.setattr(merging, "TILE_ROWS", 4)
    rng = np.random.default_rng(2)
    points, sizes = rng.normal(size=(50, 3)) + 1e6, rng.integers(1, 9, 50)
    points[7] = points[31] + 1e-5
    every = neighbours.Points(np.arange(50), points, sizes, np.ones(50, bool))
    cost = [[np.inf if i == j else float(merging.merge_cost(points[[i]], points[[j]], sizes[[i]], sizes[[j]])[0]) for j in range(50)] for i in range(50)]
    node, near, found = merging.nearest_of_shard(every, iter([every.part(slice(i, i + 7)) for i in range(0, 50, 7)]))
    assert node.tolist() == list(range(50)) and near.tolist() == np.argmin(cost, axis=1).tolist()
    assert found.tolist() == np.min(cost, axis=1).tolist()


def test_more_rows_than_one_task_takes(spark):
    """5,000 vectors in twelve far groups, one of which holds a third: the groups come back."""
    rng = np.random.default_rng(6)
    centres = 20 * rng.normal(size=(12, 8))
    own = np.where(np.arange(5000) % 3 == 0, 0, rng.integers(0, 12, 5000))
    points = centres[own] + rng.normal(0, 0.1, (5000, 8))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster_id"] for r in clustering.agglomerative(df, 12, most=None).collect()}
    assert len({(got[i], own[i]) for i in range(5000)}) == 12 and len(set(got.values())) == 12


@pytest.mark.parametrize("kind", range(5))
def test_rough_products_lose_none(kind):
    """32-bit products only leave out pairs: offsets, ties, numbers they can't hold and clusters of very different spread."""
    rng = np.random.default_rng(kind)
    for sizes in (np.ones(300, int), rng.integers(1, 900, 300)):
        x = rng.normal(size=(300, 5))
        x = (x, x + 1e6, np.round(2 * x), x * 1e20, np.where(rng.random((300, 1)) < 0.5, x * 1e-7, x * 1e4))[kind]
        x = np.unique(x, axis=0)
        points = neighbours.Points(3 * np.arange(len(x)), x, sizes[: len(x)], np.ones(len(x), bool))
        i, j = np.nonzero(~np.eye(len(x), dtype=bool))
        _, cost, node, near = merging.first_pairs(i, merging.merge_cost(x[i], x[j], sizes[i], sizes[j]), points.node[i], points.node[j])
        got = merging.nearest_of_shard(points, iter([points.part(slice(at, at + 37)) for at in range(0, len(x), 37)]))
        assert [g.tolist() for g in got] == [node.tolist(), near.tolist(), cost.tolist()]


def test_rounds_compare_what_changed(spark):
    """A cluster that knows its nearest meets new clusters only; one that doesn't meets all."""
    at = {0: 0.0, 1: 1.0, 2: 10.0, 3: 11.5, 4: 12.0}
    kind = "node long, vector array<double>, weight long, core boolean, near long, cost double"
    # 0 isn't told of 1, which is nearer than what it knows but not new; 2 is told of 3, and 4 is new but farther; 3 finds 4
    rows = [(n, [x], 1, n == 4, {0: 2, 2: 3}.get(n), {0: 100.0, 2: 2.25}.get(n)) for n, x in at.items()]
    stored = neighbours.materialise(spark.createDataFrame(rows, kind), "clusters")
    got = sorted((r["node"], r["near"], r["cost"]) for r in merging.nearest(stored, 2).collect())
    assert got == [(0, 2, 100.0), (1, 0, 1.0), (2, 3, 2.25), (3, 4, 0.25), (4, 3, 0.25)]


def test_rest_of_tree_with_ties():
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 6, (90, 2)).astype(float), axis=0)
    node, means, sizes = 2 * np.arange(len(x)), x.copy(), np.ones(len(x))
    want, left = [], list(range(len(x)))
    while len(left) > 1:
        pairs = [(float(merging.merge_cost(means[[i]], means[[j]], sizes[[i]], sizes[[j]])[0]), int(merging.tie(node[[i]], node[[j]])[0]), i, j) for i in left for j in left if i < j]
        cost, _, i, j = min(pairs)
        want.append((int(node[i]), int(node[j]), cost))
        means[i] = (sizes[i] * means[i] + sizes[j] * means[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        left.remove(j)
    assert merging.rest_of_tree(node, x, np.ones(len(x))) == want
