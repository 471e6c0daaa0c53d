"""Whitened embeddings against numpy on the whole table, and odd vectors."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import whitening
from corpuslab.llm.queries import queries
from tests.llm.tables import SF, write

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} by exact sums and numpy's symmetric solver."""
    use = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in use})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    trace = sum((n * c - s) ** 2 for x in fit for c, s in zip(x, sums, strict=True)) / n**3
    out = {}
    for i, x in use:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        w = (np.array(d) / n) @ v / np.sqrt(e)
        out |= {(i, j + 1): (n, sum(c * c for c in d), w[j], e[j] / trace) for j in range(len(e))}
    return out


def same(got, want):
    """Equal rows, up to one sign a component."""
    assert len(got) == len(want) and {(r["vec_id"], r["component"]) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(whitened), rel=1e-7, abs=1e-9)
        if abs(whitened) > 1e-6:
            assert signs.setdefault(r["component"], np.sign(r["whitened"] * whitened)) == np.sign(r["whitened"] * whitened)
        assert r["identity_error"] < 1e-9


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    same(queries()["op11_whitening"](spark, "/root/testdata/sf0.01").collect(), plain(rows))


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, [1, 2, 3, 4, 5, 6], (300, 6)))]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies count once in the fit
    rows += [(None, rows[3][1]), (7, rows[8][1])]
    bad = [(2000, None), (2001, [nan] * 6), (2002, [inf] * 6), (2003, [None] * 6), (2004, [1.0, 2.0]), (2005, [])]
    base = spark.createDataFrame([(*r, 0) for r in rows + bad], SCHEMA).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    write(base, tmp_path, "embeddings")
    got = queries()["op11_whitening"](spark, str(tmp_path)).collect()
    assert len(got) == 4 * len(rows)
    want = plain(rows)
    for r in got:
        if r["vec_id"] == 7:
            continue  # two rows share this id
        assert r["deviation"] == want[r["vec_id"], r["component"]][1]
    same([r for r in got if r["vec_id"] not in (7,)], {k: v for k, v in want.items() if k[0] != 7})


def test_far_from_zero(spark):
    """A mean of 20,000 deviations: exact centring loses nothing."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(70_000 + x)) for x in v]) for i, v in enumerate(rng.normal(0, [1, 2, 3], (400, 3)).round(2))]
    got = whitening.apply(base := spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), whitening.fit(base)).collect()
    want = plain(rows)
    assert {r["component"] for r in got} == {1, 2, 3}
    same(got, {k: v for k, v in want.items() if k[1] <= 3})


def test_little_variance(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 4.0, 5.0], 0), (3, [2.0, 4.0, 5.0], 0)], SCHEMA)
    got = whitening.apply(two, whitening.fit(two)).collect()  # two points span one component
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)]
    one = two.filter("vec_id > 1")
    assert whitening.fit(one) is None
    assert whitening.apply(one, None).collect() == []


def test_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    n, sums = 1 << 30, [5, 7]
    d = whitening.deviations(x, n, sums)
    assert d.tolist() == [[n * a - 5, n * b - 7] for a, b in x.tolist()]
    assert whitening.squared(d) == [None, Decimal((3 * n - 5) ** 2 + (4 * n - 7) ** 2)]


def test_empty_table(spark, tmp_path):
    write(spark.read.parquet(f"{SF}/embeddings.parquet").limit(0), tmp_path, "embeddings")
    out = queries()["op11_whitening"](spark, str(tmp_path))
    assert out.collect() == []
    assert out.columns == queries()["op11_whitening"](spark, SF).columns
