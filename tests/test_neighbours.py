"""Density clusters and components of any number of rows, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import clustering, neighbours


def plain(rows, eps, least):
    """cluster of each row (by place): cores that hang together, named by the least key, borders to the least name, else -1."""
    use = [i for i, (key, v) in enumerate(rows) if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in use}
    near = {i: [j for j in use if len(unit[i]) == len(unit[j]) and round(1 - float(unit[i] @ unit[j]), 12) <= eps] for i in use}
    core = {i for i in use if len(near[i]) >= least}
    out, seen = [-1] * len(rows), set()
    for start in core:
        if start in seen:
            continue
        group, todo = set(), [start]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += [j for j in near[i] if j in core]
        seen |= group
        for i in group:
            out[i] = min(rows[j][0] for j in group)
    for i in use:
        if i not in core and (names := [out[j] for j in near[i] if j in core]):
            out[i] = min(names)
    return out


@pytest.mark.parametrize("eps,least", [(0.02, 2), (0.05, 4), (0.0, 2), (0.1, 6), (1.0, 3)])
def test_against_all_pairs(spark, monkeypatch, eps, least):
    for name, value in (("BLOCK_ROWS", 5), ("TILE_ROWS", 7), ("SHARD_BYTES", 600), ("PIVOTS", 6)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(int(eps * 100) + least)
    rows = [(int(k), (rng.normal(size=3) + 2 * np.eye(3)[k % 3]).tolist()) for k in rng.permutation(110)]
    rows += [(200 + i, rows[5][1]) for i in range(12)] + [(300 + i, [2 * x for x in rows[6][1]]) for i in range(3)]
    rows += [(400, None), (401, [0.0] * 3), (402, [float("nan"), 1.0, 1.0]), (403, []), (404, [1.0, 2.0]), (405, [2.0, 4.0]), (406, [None, 1.0, 1.0]), (None, rows[5][1]), (7, rows[8][1]), (7, rows[9][1])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = {r["cluster"]: r["cluster_id"] for r in clustering.density(df, eps, least).collect()}
    assert [got[i] for i in range(len(rows))] == plain(rows, eps, least)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [1.0, 0.0], 6, "y")], "vec_id int, embedding array<float>, node int, vector string")
    out = clustering.density(df, 0.3, 2)
    assert sorted(map(tuple, out.select("vec_id", "node", "vector", "cluster_id").collect())) == [(1, 5, "x", 1), (2, 6, "y", 1)]
    assert out.columns == [*df.columns, "cluster_id"] and out.schema["cluster_id"].dataType == df.schema["vec_id"].dataType
    assert clustering.density(df.limit(0)).collect() == []


def test_components(spark):
    """Chains, rings and single links, against a walk."""
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(300) if i % 50] + [(int(a), int(b)) for a, b in rng.integers(400, 500, (40, 2))]
    found = {r["node"]: r["component"] for r in neighbours.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_more_rows_than_pairs_fit(spark):
    """60,000 vectors, a third of them one vector: forty clusters and noise, without all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    points = np.concatenate([np.repeat(centres[:1], 20_000, axis=0), centres[rng.integers(0, 40, 39_900)] + rng.normal(0, 0.02, (39_900, 16)), rng.normal(size=(100, 16))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    got = clustering.density(df, 0.02, 5, most=None).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).collect()
    assert {r["cluster_id"] for r in got} >= {-1} and len(got) == 41
    assert sum(r["n"] for r in got) == 60_000 and all(r["least"] == r["cluster_id"] for r in got if r["cluster_id"] >= 0)
    assert next(r["n"] for r in got if r["cluster_id"] == -1) == 100


def test_tiles_blocks_and_shards(monkeypatch):
    """In one process, where tiles of a few rows take effect: near pairs, and a forest that joins what they join."""
    monkeypatch.setattr(neighbours, "TILE_ROWS", 4)
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(90, 3))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.round(1 - unit @ unit.T, 12) <= 0.02
    points = neighbours.Points(np.arange(90), unit, np.ones(90, int), np.ones(90, bool))
    order = np.argsort(unit[:, 0])
    for blocks in ([points.part(order[i : i + 6]) for i in range(0, 90, 6)], [points.part(slice(i, i + 30)) for i in range(0, 90, 30)]):
        shards, links = [points.part(slice(0, 50)), points.part(slice(50, 90))], set()
        found = {(int(s.node[i]), int(b.node[j])) for s in shards for b in blocks for rows, others in neighbours.near_tiles(s, b, 0.02) for i, j in zip(rows, others, strict=True)}
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}
        for shard in shards:
            links |= {(int(a), int(b)) for x, y in neighbours.links_of_shard(shard, iter(blocks), 0.02) for a, b in zip(x, y, strict=True)}

        def classes(pairs):
            label = list(range(90))
            for _ in range(90):
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        assert classes(links) == classes(found)
        assert len(links) < len(found)
