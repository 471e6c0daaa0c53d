"""Agglomerative clusters of any number of vectors by Ward's rule (CLU-06).

Ward's rule never makes a merge that is nearer to a third cluster than the two merged were, so all pairs of clusters that are each
other's nearest can merge at once: the tree is the one that merging the nearest pair each time makes. A round finds every cluster's nearest by
matrix products in tiles and merges the pairs; once few clusters are left, one task of that bounded size makes the rest of the tree. A cluster that
was not merged, nor the one nearest to it, is compared only with those that the last round made. The k - 1 costliest merges are then left out, and
what the others join is a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators import neighbours
from corpuslab.operators.neighbours import Points
from corpuslab.session import materialise

#: Clusters from which on one task makes the rest of the tree, and own clusters that are compared with a block at a time.
LAST, TILE_ROWS = 4096, 1024
#: Bound of the error of a squared distance from a product, as a share of the squared lengths.
ERROR = 1e-12
#: The same for each term of a product of 32-bit numbers, and the largest numbers that these products are made of.
ROUGH_ERROR, ROUGH_MOST = 2.0**-23, 1e30
#: Pairs of a cluster with a block that are measured one by one, on average.
MANY = 4
NEAREST = "node long, near long, cost double"
MERGES = "a long, b long, cost double, turn int"


def tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each pair in either order, by which equal costs are told apart, so that chains of equal costs don't wait for one another."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def merge_cost(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Twice what the union of clusters with means x, y and sizes n, m adds to the squared distances from the means; the same for (y, x)."""
    return 2 * (n * m) / (n + m) * ((x - y) ** 2).sum(axis=1)


def first_pairs(row: np.ndarray, cost: np.ndarray, node: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row the pair of least cost, equal ones by ``tie`` and then by the other cluster."""
    order = np.lexsort((near, tie(node, near), cost, row))
    order = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
    return row[order], cost[order], node[order], near[order]


@dataclass
class Rough:
    """Points as 32-bit numbers from a centre on, so that one product of two of them gives squared distances."""

    left: np.ndarray
    right: np.ndarray
    square: np.ndarray
    size: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, points: Points, centre: np.ndarray) -> Rough:
        x = points.vectors - centre
        square, size = (x * x).sum(axis=1), points.weight.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            one = np.ones(len(x))
            left, right = (np.column_stack(c).astype(np.float32) for c in ((-2 * x, square, one), (x, one, square)))
        return cls(left, right, square, size, (1 / size).astype(np.float32))

    def part(self, which: slice) -> Rough:
        return Rough(self.left[which], self.right[which], self.square[which], self.size[which], self.inverse[which])


def nearer(own: Rough, block: Rough, same: tuple[np.ndarray, np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of own, and of these pairs (row, row of the block)) that may have a cost within the bound: no other pair has one.

    The bound is lowered where the block allows it. ``same`` are pairs of a cluster with itself.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        widest = own.square + block.square.max()
        if not (widest * np.maximum(own.size, block.size.max())).max() < ROUGH_MOST:
            i, j = np.divmod(np.arange(len(bound) * len(block.size)), len(block.size))
            return np.arange(len(bound)), i, j
        cost, factor = own.left @ block.right.T, np.full(len(bound), 2.0)
        if (block.inverse == block.inverse[0]).all():
            factor = 2 / (1 / own.size + 1 / block.size[0])
        else:
            cost /= own.inverse[:, None] + block.inverse[None]
        cost[same] = np.inf
        least = factor * cost.min(axis=1)
        slack = 2 * np.minimum(own.size, block.size.max()) * (2 * (own.left.shape[1] + 8) * ROUGH_ERROR * widest + 1e-30)
        near = np.flatnonzero(~(least - 1e-6 * np.abs(least) - slack > bound))
        bound[near] = np.fmin(bound[near], (least + 1e-6 * np.abs(least) + slack)[near])
        most = (bound + 2e-6 * np.abs(bound) + slack)[near]
        i, j = np.nonzero(~(factor[near, None] * cost[near] > most[:, None]))
    return near, near[i], j


class Nearest:
    """The nearest clusters of a shard's, found block by block: of least cost, equal ones by ``tie`` and then by the other cluster."""

    def __init__(self, own: Points, near: np.ndarray | None = None, cost: np.ndarray | None = None):
        """With what is known to be nearest so far, if anything."""
        self.own, known = own, np.arange(len(own.node) if near is not None else 0)
        self.best = (known, np.zeros(0) if cost is None else cost, own.node[known], own.node[:0] if near is None else near)
        self.bound, self.square = np.full(len(own.node), np.inf) if cost is None else cost.copy(), (own.vectors**2).sum(axis=1)
        self.rough = Rough.of(own, own.centre)

    def meet(self, block: Points) -> None:
        own, found = self.own, [self.best]
        norms, sizes, rough = (block.vectors**2).sum(axis=1), block.weight.astype(float), Rough.of(block, own.centre)
        for at in range(0, len(own.node), TILE_ROWS):
            part = slice(at, at + TILE_ROWS)
            _, *itself = np.intersect1d(own.node[part], block.node, assume_unique=True, return_indices=True)
            rows, i, j = nearer(self.rough.part(part), rough, tuple(itself), self.bound[part])
            rows, i = at + rows, at + i
            if len(i) > MANY * len(rows):
                # too many to be measured one by one: by products of 64-bit numbers first
                size, norm = own.weight[rows].astype(float)[:, None], self.square[rows][:, None] + norms[None]
                scale = 2 * size * sizes / (size + sizes)
                far, slack = norm - 2 * own.vectors[rows] @ block.vectors.T, ERROR * norm
                same = own.node[rows][:, None] == block.node[None]
                upper = np.where(same, np.inf, scale * (far + slack))
                self.bound[rows] = np.minimum(self.bound[rows], upper.min(axis=1))
                i, j = np.nonzero(~same & (scale * (far - slack) <= self.bound[rows][:, None]))
                i = rows[i]
            if len(i):
                # what may be the nearest by its product is measured by its differences
                other = own.node[i] != block.node[j]
                i, j = i[other], j[other]
                cost = merge_cost(own.vectors[i], block.vectors[j], own.weight[i].astype(float), sizes[j])
                found.append((i, cost, own.node[i], block.node[j]))
        if len(found) > 1:
            self.best = first_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, nearest, cost) of the clusters that have another one."""
        return self.best[2], self.best[3], self.best[1]


def nearest_of_shard(own: Points, blocks: Iterator[Points]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, nearest, cost) of the clusters of a shard that have another one."""
    found = Nearest(own)
    for block in blocks:
        found.meet(block)
    return found.result()


def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of a bounded size, as large as that allows."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[pa.RecordBatch]:
        return iter(pa.Table.from_batches(held).combine_chunks().to_batches() if held else ())

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= neighbours.SHARD_BYTES:
            yield from joined()
            held = []
    yield from joined()


def nearest(clusters: DataFrame, tasks: int) -> DataFrame:
    """(node, near, cost) of a written table of clusters: those without a ``near`` meet all others, the rest those that are new (``core``)."""
    blocks = neighbours.block_reader(clusters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            for own in neighbours.points_of(batch):
                near, cost = (batch.column(batch.schema.get_field_index(c)) for c in ("near", "cost"))
                kept = near.is_valid().to_numpy(zero_copy_only=False)
                known, value = near.fill_null(0).to_numpy()[kept], cost.fill_null(0.0).to_numpy()[kept]
                lone = Nearest(own.part(~kept)) if not kept.all() else None
                held = Nearest(own.part(kept), known, value) if kept.any() else None
                for block in blocks():
                    if lone:
                        lone.meet(block)
                    if held and block.core.any():
                        held.meet(block.part(block.core))
                for part in filter(None, (lone, held)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in part.result()], ["node", "near", "cost"])

    return materialise(clusters.repartition(tasks, "node").mapInArrow(run, NEAREST), "nearest")


def rest_of_tree(node: np.ndarray, means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, cost) of all merges of so few clusters, the nearest first; b goes into a, the smaller."""
    means, sizes, left, out = means.copy(), sizes.astype(float), np.ones(len(node), bool), []
    n = len(node)
    cost = np.full((n, n), np.inf)
    for i in range(n):
        cost[i] = merge_cost(means[i][None], means, sizes[i], sizes)
    np.fill_diagonal(cost, np.inf)
    lowest = cost.min(axis=1)
    for _ in range(n - 1):
        least = lowest.min()
        rows = np.flatnonzero(lowest == least)
        i, j = np.nonzero(cost[rows] == least)
        i = rows[i]
        at = np.lexsort((node[j], node[i], tie(node[i], node[j])))[0]
        i, j = (x for x in sorted((i[at], j[at]), key=lambda x: node[x]))
        means[i] = (sizes[i] * means[i] + sizes[j] * means[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        left[j] = False
        row = np.where(left, merge_cost(means[i][None], means, sizes[i], sizes), np.inf)
        row[i] = np.inf
        # rows whose lowest was that of one of the two are looked through again, the others have the new cost beside it
        again = np.flatnonzero(left & ((cost[:, i] == lowest) | (cost[:, j] == lowest)))
        cost[i], cost[:, i], cost[j], cost[:, j] = row, row, np.inf, np.inf
        lowest = np.minimum(lowest, row)
        lowest[again], lowest[i], lowest[j] = cost[again].min(axis=1), row.min(), np.inf
        out.append((int(node[i]), int(node[j]), float(least)))
    return out


def tree(clusters: DataFrame, last: int) -> DataFrame:
    """(a, b, cost, turn) of all merges of a written table of node, vector, weight and core; a merge goes from b into a, the smaller."""
    spark, turn, n = clusters.sparkSession, 0, clusters.count()
    merges = spark.createDataFrame([], MERGES)
    # each task reads all clusters, so there are no more of them than cores
    tasks = spark.sparkContext.defaultParallelism
    if n > last:
        clusters = clusters.select(*neighbours.COLUMNS, F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("cost"))
    while n > last:
        found = nearest(clusters, tasks)
        both = found.groupBy(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("cost")).filter("n = 2")
        pairs = materialise(both.select("a", "b", "cost", F.lit(turn).alias("turn")), "merges")
        merged = pairs.select(F.explode(F.array("a", "b")).alias("of"), "a")
        # what was nearest holds where neither of the two has merged
        held = found.join(merged.select(F.col("of").alias("near"), F.lit(True).alias("gone")), "near", "left").select("node", F.when(F.col("gone").isNull(), F.col("near")).alias("near"), "cost")
        members = clusters.select("node", "vector", "weight").join(held, "node").join(merged, F.col("node") == F.col("of"), "left")
        of = lambda c, b: F.first(F.when(F.col("node") != F.col("into") if b else F.col("node") == F.col("into"), F.col(c)), True)
        sides = members.withColumn("into", F.coalesce("a", "node")).groupBy("into").agg(
            of("vector", False).alias("x"), of("weight", False).alias("n"), of("vector", True).alias("y"), of("weight", True).alias("m"), of("near", False).alias("near"), of("cost", False).alias("cost")
        )
        total, new = F.col("n") + F.col("m"), F.col("m").isNotNull()
        mean = F.when(new, F.zip_with("x", "y", lambda x, y: (F.col("n") * x + F.col("m") * y) / total)).otherwise(F.col("x"))
        known = ~new & F.col("near").isNotNull()
        clusters = materialise(sides.select(F.col("into").alias("node"), mean.alias("vector"), F.coalesce(total, F.col("n")).alias("weight"), new.alias("core"), F.when(known, F.col("near")).alias("near"), F.when(known, F.col("cost")).alias("cost")), "clusters")
        merges, turn, n = merges.union(pairs), turn + 1, n - pairs.count()

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = pd.concat(list(frames) or [pd.DataFrame({"node": [], "vector": [], "weight": []})]).sort_values("node")
        if len(left) > 1:
            rest = rest_of_tree(left["node"].to_numpy(), np.stack(left["vector"]).astype(float), left["weight"].to_numpy())
            yield pd.DataFrame(rest, columns=["a", "b", "cost"]).assign(turn=range(turn, turn + len(rest)))

    # no more than ``last`` rows
    return merges.union(materialise(clusters.repartition(1).mapInPandas(finish, MERGES), "merges"))


def agglomerative(rows: DataFrame, k: int, key: str, vector: str, last: int = LAST) -> DataFrame:
    """CLU-06: adds cluster_id, the number of one of k clusters in the order of their least keys.

    Equal vectors always share a cluster, so there are fewer than k where there are fewer different vectors. Rows whose vector is null or has null or
    non-finite components get null; rows without a key have the cluster of their vector but no part in the order. Vectors of different lengths
    end it with a ValueError. Of equal costs the order is that of ``tie`` over numbers of the vectors in their order by length and hash.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = F.when(F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False)), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)))
    marked = rows.select("*", own.alias("vector of cluster"))
    distinct = materialise(marked.filter("`vector of cluster` IS NOT NULL").groupBy(F.col("vector of cluster").alias("vector")).agg(F.count(F.lit(1)).alias("weight"), F.min(key).alias("least")), "points")
    if len(distinct.select(F.size("vector")).distinct().limit(2).collect()) > 1:
        raise ValueError("the vectors have different lengths")
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.xxhash64("vector")
    points = materialise(distinct.repartitionByRange(tasks, place).sortWithinPartitions(place, "vector").select(F.monotonically_increasing_id().alias("node"), "vector", "weight", F.lit(True).alias("core"), "least"), "points")
    merges = tree(points.select(neighbours.COLUMNS), last)
    undone = merges.orderBy(F.desc("cost"), F.desc("turn"), F.desc("a")).limit(k - 1).select("a", "b")
    of = neighbours.components(merges.join(undone, ["a", "b"], "left_anti").select("a", "b"))
    named = points.join(of, "node", "left").select("vector", "least", F.coalesce("component", "node").alias("component"))
    # no more than k rows
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    number = first.select("component", (F.row_number().over(Window.orderBy(F.col("first").asc_nulls_last(), "component")) - 1).alias("cluster_id"))
    numbered = named.join(number, "component").select(F.col("vector").alias("vector of number"), F.col("cluster_id").alias("number of cluster"))
    out = marked.join(numbered, F.col("vector of cluster") == F.col("vector of number"), "left")
    return out.select(*(marked[c] for c in rows.columns), F.col("number of cluster").alias("cluster_id"))
