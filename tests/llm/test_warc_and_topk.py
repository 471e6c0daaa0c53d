"""Operators 2 and 5 beyond their queries."""

import io
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuslab.llm import topk, warc


def test_records_by_index(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i % 7} ".encode() * 500) for i in range(60)]
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(rows, "record_id long, url string, payload binary")
    index = warc.write(pages, folder)
    assert index.count() == 60
    got = {r["record_id"]: r for r in warc.fetch(pages.filter("record_id IN (3, 59)"), folder).collect()}
    assert bytes(got[59]["payload"]) == rows[59][2]
    assert (got[3]["record_type"], got[3]["refers_to"], got[3]["payload"]) == ("revisit", 59, None)


def test_bundles_are_read_in_as_many_tasks(spark, monkeypatch, tmp_path):
    """Every task writes a bundle here: the tiny rows that name bundles must not be merged into few tasks."""
    folder = f"file://{tmp_path}/many"
    rows = spark.range(0, 1000, 1, 250).selectExpr("id AS record_id", "'u' AS url", "encode(CAST(id AS STRING), 'utf-8') AS payload", "CAST(NULL AS BIGINT) AS refers_to")
    monkeypatch.setattr(warc, "with_references", lambda pages, least: pages)
    index = warc.write(rows, folder)
    bundles = index.select("bundle").distinct().count()
    assert bundles >= 200
    out = warc.read(spark, folder).withColumn("task", F.spark_partition_id())
    assert out.count() == 1000
    assert out.select("task").distinct().count() >= 0.9 * bundles


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(i % 3 if i % 4 else None, "u", f"p{i // 4}".encode()) for i in range(24)]
    rows = list(dict.fromkeys(rows))
    folder = f"file://{tmp_path}/ids"
    index = warc.write(spark.createDataFrame(rows, "record_id long, url string, payload binary"), folder)
    ids = []
    for r in index.collect():
        with warc.open_file(f"{folder}/bundles", r["bundle"]) as file:
            ids.append(warc.parse(warc.BundleReader(file).frame(r["frame"]), r["frame_offset"])[0][b"WARC-Record-ID"])
    assert len(set(ids)) == len(rows)


def test_bundles_are_plain_zstandard_and_seekable():
    out = io.BytesIO()
    bundle = warc.BundleWriter(out)
    records = [warc.record(i, b"http://x", b"y" * 100_000, None, "2024-01-01T00:00:00Z") for i in range(9)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(records)

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = warc.BundleReader(File(out.getvalue()))
    assert len(reader) > 1
    for (frame, offset), r in zip(places, records, strict=True):
        headers, block, end = warc.parse(reader.frame(frame), offset)
        assert end - offset == len(r)
        assert block.endswith(b"y" * 100_000)
        assert headers[b"WARC-Type"] == b"response"


def test_short_payloads_are_responses(spark, tmp_path):
    rows = [(1, None, b"ab"), (2, None, b"ab"), (3, None, b"abcd"), (4, None, b"abcd")]
    out = warc.round_trip(spark.createDataFrame(rows, "record_id long, url string, payload binary"), min_revisit=3)
    assert {r["record_id"]: r["record_type"] for r in out.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("scale", [1, 10**4, 10**9])
def test_products_are_exact(scale):
    rng = np.random.default_rng(2)
    a, b = (np.floor(rng.normal(0, 1, (3, 5)) * scale) for _ in range(2))
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert topk.product(a, b).tolist() == exact


def test_tiles_shards_and_blocks(spark, monkeypatch):
    for name, n in (("QUERY_ROWS", 3), ("SHARD_BYTES", 100), ("TILE_ROWS", 4), ("PARTS", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(3)
    ids, vectors = np.arange(40), rng.integers(-3, 4, (40, 4)).astype(float)
    ids[5] = 4  # a repeated id
    vectors[5] = vectors[4]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, df.filter("vec_id % 4 = 0"), k=5, scale=1).collect())
    want = []
    for i in np.flatnonzero(ids % 4 == 0):
        others = sorted((-int(vectors[i] @ vectors[j]), int(ids[j])) for j in range(40) if j != i)[:5]
        want += [(int(ids[i]), rank, j, -s) for rank, (s, j) in enumerate(others, 1)]
    assert got == sorted(want)


def test_long_vectors_stay_within_bounds():
    """4,096 dimensions: blocks, shards and tiles are bounded by bytes."""
    rng, n = np.random.default_rng(5), 4096
    flat = rng.integers(-999, 999, 40_000 * 32).astype(np.float32) / 256

    def batches():
        for at in range(0, 40_000, 2000):
            matrix = np.tile(flat[at * 32 : (at + 2000) * 32].reshape(2000, 32), (1, n // 32))
            offsets = pa.array(np.arange(0, 2001 * n, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 2000)), pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))], ["id", "v"])

    tracemalloc.start()
    query = next(topk.blocks(batches(), lambda m: min(topk.QUERY_ROWS, topk.QUERY_BYTES // (8 * m)), topk.SHARD_BYTES, 256))
    assert 256 < len(query[1]) <= 512
    seen, best = 0, None
    for ids, shard in topk.blocks(batches(), lambda m: 1 << 62, topk.SHARD_BYTES, 256):
        assert shard.dtype == np.int16
        assert shard.nbytes <= topk.SHARD_BYTES + topk.TILE_ROWS * n * 2
        seen += len(ids)
        found = topk.search_shard(query[1][:4], ids, shard, 6)
        best = found if best is None else topk.merged([best, found], 6)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert seen == 40_000
    small = np.floor(flat.reshape(-1, 32) * 256).astype(np.int64)
    for i in range(4):
        scores = small @ small[i] * (n // 32)
        assert best[2][best[0] == i].tolist() == np.lexsort((np.arange(40_000), -scores))[:6].tolist()


@pytest.mark.parametrize("scale", [1, 10**4, 10**9, 10**12])
def test_own_scores_are_exact(scale):
    a = np.floor(np.random.default_rng(2).normal(0, 1, (3, 5)) * scale)
    assert topk.own_scores(a).tolist() == [min(sum(int(x) * int(x) for x in r), (1 << 63) - 1) for r in a]


def test_many_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    vectors = rng.integers(-40, 40, (3000, 16)) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    got = sorted(tuple(r) for r in topk.search(df, df.filter("vec_id % 10 = 0"), k=5).collect())
    whole = np.floor(vectors * 256).astype(np.int64)
    want = []
    for i in range(0, 3000, 10):
        scores = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(3000), -scores))[:6].tolist() if j != i][:5]
        want += [(i, rank, j, int(scores[j])) for rank, j in enumerate(order, 1)]
    assert got == want
