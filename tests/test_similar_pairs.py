"""The most similar pairs of any number of rows, against all pairs."""

import numpy as np
import pytest

from corpuslab.operators import clustering


def plain(rows, k):
    use = [(key, np.array(v, float)) for key, v in rows if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = [(-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 12), a, b) for a, x in use for b, y in use if a < b and len(x) == len(y)]
    return [(a, b, -s) for s, a, b in sorted(found)[:k]]


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(clustering, "TILE_ROWS", 7)
    rng = np.random.default_rng(1)
    key = (lambda i: f"k{i:03d}é") if kind == "string" else (lambda i: i)
    rows = [(key(i), rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(key(100), None), (key(101), [0.0] * 4), (key(102), [float("nan")] * 4), (key(103), [1.0, 2.0]), (key(104), [2.0, 1.0]), (key(105), []), (None, [1.0] * 4), (key(5), rows[9][1])]
    df = spark.createDataFrame(rows, f"key {kind}, embedding array<double>")
    for k in (1, 12, 5000):
        got = [(r["a"], r["b"], r["similarity"]) for r in clustering.similar_chapters(df, "key", k).collect()]
        want = plain(rows, k)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert clustering.similar_chapters(df.limit(0), "key", 3).collect() == []


def test_more_rows_than_pairs_fit(spark):
    """20,000 rows have 200 million pairs; two planted ones are found."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(20_000, 16))
    points[19_990], points[15_000] = points[3] * 2, points[77] + 1e-3
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "key long, embedding array<double>").repartition(4)
    got = [(r["a"], r["b"]) for r in clustering.similar_chapters(df, "key", 2).collect()]
    assert got == [(3, 19_990), (77, 15_000)]
