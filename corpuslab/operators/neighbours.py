"""Density clusters of any number of vectors, and components of a table of links (CLU-06).

The points are the distinct unit vectors. They lie in the order of their nearest pivots, so that a block of consecutive ones is a small
ball; by the triangle inequality a task leaves out of the comparison with a block what is too far from its centre. What is left is
compared by matrix products, exactly. No pair is a row: a task sums up neighbours, and of the links between dense points it
emits a forest that joins the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import vectors as V
from corpuslab.session import materialise

#: Vectors that set the order of the points; the clusters don't depend on them.
PIVOTS = 256
#: Points of a block, of a tile of a task's own points, and bytes of vectors that a task holds at a time.
BLOCK_ROWS, TILE_ROWS, SHARD_BYTES = 1024, 4096, 64 << 20
#: Distances are rounded to so many digits, so that copies and multiples have none.
DIGITS = 12


@dataclass
class Points:
    """Points whose vectors have one length, and the ball that holds them."""

    node: np.ndarray
    vectors: np.ndarray
    weight: np.ndarray
    core: np.ndarray

    def __post_init__(self) -> None:
        self.centre = self.vectors.mean(axis=0)
        self.radius = float(np.linalg.norm(self.vectors - self.centre, axis=1).max())

    def part(self, which: np.ndarray | slice) -> Points:
        return Points(self.node[which], self.vectors[which], self.weight[which], self.core[which])


COLUMNS = ["node", "vector", "weight", "core"]


def points_of(batch: pa.RecordBatch) -> Iterator[Points]:
    """The points of a batch of node, vector, weight and core, apart by the length of their vectors."""
    node, vector, weight, core = (batch.column(batch.schema.get_field_index(c)) for c in COLUMNS)
    lengths = np.asarray(vector.value_lengths(), np.int64)
    starts, flat = np.cumsum(lengths) - lengths, np.asarray(vector.flatten(), float)
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        of = lambda x: x.to_numpy(zero_copy_only=False)[own]
        yield Points(of(node), flat[starts[own][:, None] + np.arange(n)], of(weight), of(core))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Points]:
    """The points of a task, in shards of one length and a bounded size."""
    held: dict[int, list[Points]] = {}
    join = lambda parts: Points(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("node", "vectors", "weight", "core")))
    for batch in batches:
        for points in points_of(batch):
            held.setdefault(points.vectors.shape[1], []).append(points)
        if sum(p.vectors.nbytes for parts in held.values() for p in parts) >= SHARD_BYTES:
            yield from map(join, held.values())
            held = {}
    yield from map(join, held.values())


def block_reader(stored: DataFrame) -> Callable[[], Iterator[Points]]:
    """For tasks: the points of a written table, a block at a time."""
    files = sorted(unquote(urlsplit(f).path) if urlsplit(f).scheme == "file" else f for f in stored.inputFiles())

    def blocks() -> Iterator[Points]:
        for name in files:
            store, path = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(BLOCK_ROWS, columns=COLUMNS):
                    yield from points_of(batch)

    return blocks


def near_tiles(own: Points, block: Points, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of own, rows of the block) of the pairs whose cosine distance is at most eps, a tile of own at a time."""
    # of unit vectors, half the squared distance is the cosine distance
    reach = math.sqrt(2 * max(eps, 0) + 10.0**-DIGITS) + 1e-9
    if own.vectors.shape[1] != block.vectors.shape[1] or np.linalg.norm(own.centre - block.centre) > own.radius + block.radius + reach:
        return
    close = np.flatnonzero(np.linalg.norm(own.vectors - block.centre, axis=1) <= block.radius + reach)
    for at in range(0, len(close), TILE_ROWS):
        rows = close[at : at + TILE_ROWS]
        i, j = np.nonzero(np.round(1 - own.vectors[rows] @ block.vectors.T, DIGITS) <= eps)
        if len(i):
            yield rows[i], j


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of rows (each the least row of its class) after the classes of rows a[i] and b[i] are joined."""
    while (differ := label[a] != label[b]).any():
        a, b = a[differ], b[differ]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (to != (further := to[to])).any():
            to = further
        label = to[label]
    return label


def links_of_shard(own: Points, blocks: Iterator[Points], eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, node) links that join the same core points as all near pairs of the shard's core points and those of the blocks do."""
    label = np.arange(len(own.node))
    for block in blocks:
        first = np.full(len(block.node), len(label))
        for i, j in near_tiles(own, block, eps):
            np.minimum.at(first, j, i)
            label = merge(label, i, first[j])
        met = np.flatnonzero(first < len(label))
        yield block.node[met], own.node[label[first[met]]]
    yield own.node, own.node[label]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes a and b of a table of links; component is the least node.

    A round takes the least component of the neighbours and then that component's own, so chains halve; rounds are written to the shared folder.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(least, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        step = materialise(step, "labels")
        further = step.select(F.col("node").alias("of"), F.col("next").alias("component"))
        new = materialise(step.join(further, F.col("next") == F.col("of")).select("node", "component", (F.col("component") < F.col("was")).alias("moved")), "labels")
        if new.filter("moved").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def usable(key: Column, vector: Column) -> Column:
    """Rows with a key and a vector of finite components that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(key.isNotNull() & vector.isNotNull() & finite & (V.norm(vector) > 0), F.lit(False))


def _order(points: DataFrame) -> DataFrame:
    """Points by their two nearest pivots, dealt over tasks; equal places are split by a hash of the vector."""
    found = points.orderBy(F.xxhash64("vector")).limit(PIVOTS).select("vector").toPandas()["vector"]
    pivots: dict[int, list[np.ndarray]] = {}
    for vector in found:
        pivots.setdefault(len(vector), []).append(np.asarray(vector, float))
    matrices = {n: np.stack(v) for n, v in pivots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(batch.schema.get_field_index("vector"))
            lengths = np.asarray(vector.value_lengths(), np.int64)
            starts, flat = np.cumsum(lengths) - lengths, np.asarray(vector.flatten(), float)
            place = np.zeros((len(lengths), 2), np.int64)
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                if n in matrices:
                    order = np.argsort(-(flat[starts[own][:, None] + np.arange(n)] @ matrices[n].T), axis=1, kind="stable")
                    place[own] = order[:, [0, min(1, order.shape[1] - 1)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), *(pa.array(x) for x in place.T)], [*batch.schema.names, "length", "pivot", "second"])

    placed = points.mapInArrow(place, "vector array<double>, weight long, least long, length long, pivot long, second long")
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["length", "pivot", "second", F.xxhash64("vector")]
    return placed.repartitionByRange(tasks, *by).sortWithinPartitions(*by)


def density(rows: DataFrame, eps: float, least: int, key: str, vector: str) -> DataFrame:
    """CLU-06: adds cluster_id to rows: that of the dense points they hang together with, named by its least key; -1 for noise.

    A row with at least ``least`` rows (itself included) in a cosine distance of ``eps`` is dense; one that is not but is near dense ones goes to the cluster
    of the least name among theirs. Every row is a point of its own, also where keys repeat; equal vectors have one cluster. Rows without a
    key, and vectors that are null, zero or hold null or non-finite components, are noise and count for nothing; vectors of different
    length are never near. Keys are whole numbers. Distances are rounded to 12 digits.
    """
    own = F.when(usable(F.col(key), F.col(vector)), V.unit(F.col(vector)))
    marked = rows.select("*", own.alias("vector of density"))
    distinct = marked.filter("`vector of density` IS NOT NULL").groupBy(F.col("vector of density").alias("vector")).agg(F.count(F.lit(1)).alias("weight"), F.min(F.col(key).cast("long")).alias("least"))
    ordered = _order(materialise(distinct, "points"))
    # ids are made once, in the written table
    points = materialise(ordered.select(F.monotonically_increasing_id().alias("node"), "vector", "weight", F.lit(True).alias("core"), "least"), "points")
    blocks = block_reader(points)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            total = np.zeros(len(shard.node), np.int64)
            for block in blocks():
                for i, j in near_tiles(shard, block, eps):
                    np.add.at(total, i, block.weight[j])
            # the shard's order is kept, so blocks stay small balls
            yield pa.RecordBatch.from_arrays([pa.array(shard.node), pa.array(list(shard.vectors), pa.list_(pa.float64())), pa.array(shard.weight), pa.array(total >= least)], COLUMNS)

    known = materialise(points.select(COLUMNS).mapInArrow(count, "node long, vector array<double>, weight long, core boolean"), "points")
    dense = block_reader(known)

    def cores() -> Iterator[Points]:
        return (b.part(b.core) for b in dense() if b.core.any())

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            if shard.core.any():
                for a, b in links_of_shard(shard.part(shard.core), cores(), eps):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], ["a", "b", "border"])
            if not shard.core.all():
                # fewer than ``least`` neighbours each
                edge = shard.part(~shard.core)
                for block in cores():
                    for i, j in near_tiles(edge, block, eps):
                        yield pa.RecordBatch.from_arrays([pa.array(edge.node[i]), pa.array(block.node[j]), pa.array(np.ones(len(i), bool))], ["a", "b", "border"])

    links = materialise(known.mapInArrow(link, "a long, b long, border boolean"), "links")
    of = components(links.filter("NOT border"))
    names = of.join(points.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("cluster"))
    named = of.join(names, "component").select("node", "cluster")
    border = links.filter("border").join(named, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("cluster")).select(F.col("a").alias("node"), "cluster")
    clusters = points.select("node", F.col("vector").alias("vector of cluster")).join(named.union(border), "node").select("vector of cluster", F.col("cluster").alias("name of cluster"))
    out = marked.join(clusters, F.col("vector of density") == F.col("vector of cluster"), "left")
    # numbers of the keys' own type; -1 where there is none
    name = F.coalesce(F.col("name of cluster").cast(rows.schema[key].dataType), F.lit(-1))
    return out.select(*(marked[c] for c in rows.columns), name.alias("cluster_id"))
