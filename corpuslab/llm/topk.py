"""Exact top-k search by tiled matrix products (operator 5).

Vectors are quantised to integers and kept in the smallest type that holds them. The queries are packed into
blocks, which are written to the shared folder with their scores with themselves; the corpus is never
shuffled. Each task buffers its own rows as a shard of bounded bytes, streams the query blocks past it, and
multiplies tile by tile. A tile keeps, for each query, the scores not below its k-th largest (partial
selection); the lists of a shard's tiles are merged in the task. The lists of a query block are one row, which
is merged in a tree: those of a part of the tasks, then those of all parts. Nothing but the lists moves.

Products are exact: a tile is computed in float32 or float64 only where no partial sum can leave the
integers that the type holds, else in Python integers.

Each query's own row is searched too, as k + 1 are kept; one row with its id and its score with itself
is then left out. So repeated rows stay candidates for each other.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id,
take no part; vectors are compared with those of equal length only; scores beyond 64 bits are clipped;
ties go to the smaller id; a query that is repeated has a list for each; a query with fewer candidates
gets them all; long vectors make blocks, shards and tiles shorter, a vector being the least of each;
an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import pieces
from corpuslab.llm.files import create, make_dir, open_file
from corpuslab.session import work_dir

#: Rows and bytes of a query block (as float64), bytes of a shard (as stored), rows and bytes of a tile (as float64).
QUERY_ROWS, QUERY_BYTES = 1024, 16 << 20
SHARD_BYTES = 128 << 20
TILE_ROWS, TILE_BYTES = 4096, 16 << 20
#: Parts of all tasks whose lists are merged first.
PARTS = 32
_LONG = np.iinfo(np.int64)


def takes_part(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def smallest(matrix: np.ndarray) -> np.ndarray:
    """Integer-valued floats in the smallest type that holds them."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def blocks(batches: Iterator[pa.RecordBatch], rows: Callable[[int], int], most: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer-valued matrix) of vectors of one length: up to rows(length) of them, and ``most`` bytes of all lengths at a time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[int, int] = {}
    for batch in pieces(batches, rows=TILE_ROWS):
        ids, vectors = batch.column(0).to_numpy(), batch.column(1)
        lengths = np.asarray(vectors.value_lengths(), np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            step = max(1, rows(n))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                matrix = smallest(flat[starts[part][:, None] + np.arange(n)])
                have = held.setdefault(n, [])
                if have and sum(len(x) for x, _ in have) + len(part) > step:
                    yield _joined(held.pop(n))
                    size.pop(n)
                    have = held.setdefault(n, [])
                have.append((ids[part], matrix))
                size[n] = size.get(n, 0) + matrix.nbytes + 8 * len(part)
                while sum(size.values()) > most:
                    largest = max(size, key=size.__getitem__)
                    yield _joined(held.pop(largest))
                    size.pop(largest)
    for have in held.values():
        yield _joined(have)


def _joined(have: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of several types the widest, by numpy's own rule."""
    return np.concatenate([x for x, _ in have]), np.concatenate([m for _, m in have])


def _most(matrix: np.ndarray) -> float:
    return max(abs(float(matrix.max(initial=0))), abs(float(matrix.min(initial=0))))


def _python(matrix: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)


def _clipped(exact: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda x: min(max(int(x), _LONG.min), _LONG.max), otypes=[np.int64])(exact)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which all inner products of rows of a and b are exact: float32, float64 or Python's integers."""
    bound = _most(a) * _most(b) * max(1, a.shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The exact inner products of integer-valued rows."""
    kind = exact_type(queries, shard)
    if not queries.shape[1] or not len(queries) or not len(shard):
        return np.zeros((len(queries), len(shard)), np.int64)
    if kind is object:
        return _clipped(_python(queries) @ _python(shard).T)
    return (queries.astype(kind) @ shard.astype(kind).T).astype(np.int64)


def own_scores(queries: np.ndarray) -> np.ndarray:
    """The exact inner product of each row with itself."""
    kind = exact_type(queries, queries)
    if not queries.shape[1] or not len(queries):
        return np.zeros(len(queries), np.int64)
    if kind is object:
        whole = _python(queries)
        return _clipped((whole * whole).sum(axis=1))
    wide = queries.astype(np.float64)
    return np.einsum("ij,ij->i", wide, wide).astype(np.int64)


def select(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], score[kept], ids[kept]


Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(lists: list[Lists], k: int) -> Lists:
    return select(*(np.concatenate(x) for x in zip(*lists, strict=True)), k)


def search_shard(queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int) -> Lists:
    """The top lists of a query block in a shard, tile after tile: (query row, score, id)."""
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    tile = max(1, min(TILE_ROWS, TILE_BYTES // (8 * max(1, shard.shape[1]))))
    for at in range(0, len(ids), tile):
        scores = product(queries, shard[at : at + tile])
        own = ids[at : at + tile]
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            row, column = np.nonzero(scores >= least[:, None])
        else:
            row, column = (x.ravel() for x in np.indices(scores.shape))
        best = merged([best, select(row, scores[row, column], own[column], k)], k)
    return best


def write_queries(queries: DataFrame, folder: str, scale: int) -> list[str]:
    """Query blocks as files; the names, one for each task."""
    make_dir(queries.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blocks(batches, lambda n: min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, n))), SHARD_BYTES, scale)
        block = next(found, None)
        if block is not None:
            with create(folder, f"part-{TaskContext.get().partitionId():06d}", ".queries") as (name, stream):
                while block is not None:
                    buffer = io.BytesIO()
                    np.savez(buffer, ids=block[0], vectors=block[1], own=own_scores(block[1]))
                    stream.write(buffer.tell().to_bytes(8, "little") + buffer.getvalue())
                    block = next(found, None)
            yield pa.RecordBatch.from_pylist([{"name": name}])

    queries.mapInArrow(run, "name string").write.parquet(f"{folder}.names")
    return sorted(r["name"] for r in queries.sparkSession.read.parquet(f"{folder}.names").collect())


def read_queries(folder: str, names: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(file, place of the block in it, ids, matrix), one block at a time."""
    for i, name in enumerate(names):
        with open_file(folder, name) as file:
            at = 0
            while size := file.read(8):
                arrays = np.load(io.BytesIO(file.read(int.from_bytes(size, "little"))))
                yield i, at, arrays["ids"], arrays["vectors"]
                at = file.tell()


def read_own(folder: str, name: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores with themselves) of the block at a place."""
    with open_file(folder, name) as file:
        file.seek(at)
        arrays = np.load(io.BytesIO(file.read(int.from_bytes(file.read(8), "little"))))
        return arrays["ids"], arrays["own"]


LISTS = "file int, block bigint, part int, lists binary"


def _packed(file: int, block: int, part: int, lists: Lists) -> pa.RecordBatch:
    data = np.stack([x.astype("<i8") for x in lists]).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["file", "block", "part", "lists"])


def by_block(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple[int, int, int], Lists]]:
    """Rows of one (file, block, part) behind one another, merged two at a time."""
    now, best = None, None
    for batch in batches:
        for file, block, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lists = tuple(np.frombuffer(data, "<i8").reshape(3, -1))
            if now != (file, block, part):
                if best is not None:
                    yield now, best
                now, best = (file, block, part), lists
            else:
                best = merged([best, lists], k)
    if best is not None:
        yield now, best


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score) of the k largest inner products of each query with all vectors."""
    spark = vectors.sparkSession
    part = lambda df: df.select(F.col(key).cast("long").alias(key), F.col(vector).alias(vector)).filter(F.col(key).isNotNull() & takes_part(vector))
    folder = work_dir(spark, "queries")
    names = write_queries(part(queries), folder, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() % PARTS
        for ids, shard in blocks(batches, lambda n: 1 << 62, SHARD_BYTES, scale):
            for file, block, _, query in read_queries(folder, names):
                if query.shape[1] == shard.shape[1]:
                    yield _packed(file, block, own, search_shard(query, ids, shard, k + 1))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, _), best in by_block(batches, k + 1):
            yield _packed(file, block, 0, best)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, _), (row, score, found) in by_block(batches, k + 1):
            ids, own = read_own(folder, names[file], block)
            # the query's own row, of which one is left out; later ranks move up
            itself = np.flatnonzero((found == ids[row]) & (score == own[row]))
            itself = itself[np.unique(row[itself], return_index=True)[1]]
            row, score, found = (np.delete(x, itself) for x in (row, score, found))
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            kept = rank <= k
            columns = [pa.array(ids[row][kept]), pa.array(rank[kept].astype(np.int32)), pa.array(found[kept]), pa.array(score[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "rank", key, "score"])

    lists = part(vectors).mapInArrow(run, LISTS)
    parts = lists.repartition("file", "block", "part").sortWithinPartitions("file", "block", "part").mapInArrow(merge, LISTS)
    return parts.repartition("file", "block").sortWithinPartitions("file", "block").mapInArrow(finish, f"query_id bigint, rank int, `{key}` bigint, score bigint")


#: The same rows in DuckDB SQL for k 5, scale 256 and queries of vec_id divisible by 50, where ids are unique.
ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
