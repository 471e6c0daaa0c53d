"""Clusters of vectors and similarity of chapters (CLU, AGG-32)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import vectors as V
from corpuslab.operators import merging, neighbours
from corpuslab.operators.retrieval import TILE_ROWS, block_reader, shards
from corpuslab.session import materialise


def _points(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(V.unit(F.col(vector))))


def kmeans(rows: DataFrame, k: int = 20, seed: int = 42, starts: int = 10, max_iter: int = 300, vector: str = "embedding"):
    """CLU-01, CLU-02: the best of several starts on unit vectors: (assignments with cluster_id, unit centroids, cost).

    The starts run at the same time, over one cached table: an iteration is a small job, most of which is waiting.
    """
    points = materialise(_points(rows, vector), "points").persist()
    try:
        fit = inheritable_thread_target(rows.sparkSession)(lambda i: KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(points))
        with ThreadPool(max(1, starts)) as pool:
            models = pool.map(fit, range(starts))
    finally:
        points.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    centers = [c / n if (n := float((c @ c) ** 0.5)) else c for c in best.clusterCenters()]
    assigned = best.transform(points).drop("features").withColumnRenamed("prediction", "cluster_id")
    return assigned, centers, best.summary.trainingCost


#: Rows of a chapter-level table: what compares all pairs takes no more unless asked to.
MOST_CHAPTERS = 2048


def chapter_level(rows: DataFrame, most: int = MOST_CHAPTERS) -> DataFrame:
    """The rows, if they are few enough for all their pairs; else a ValueError, before any pair is made."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"all pairs are compared for up to {most} rows; say most=None, or use kmeans or bisecting, for more")
    return rows


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Clusters of the rows: the two whose union adds least to the squared distances from the means merge, until k are left.

    Clusters are numbered in the order of their first rows; of equal merges that of the first rows comes first.
    """
    n = len(points)
    sizes, label = np.ones(n), np.arange(n)
    norms = (points * points).sum(axis=1)
    cost = norms[:, None] + norms[None] - 2 * points @ points.T
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - k):
        i, j = sorted(np.unravel_index(np.argmin(cost), cost.shape))
        both = ((sizes[i] + sizes) * cost[i] + (sizes[j] + sizes) * cost[j] - sizes * cost[i, j]) / (sizes[i] + sizes[j] + sizes)
        both[[i, j]] = np.inf
        both[np.isinf(cost[i])] = np.inf  # clusters that are gone
        cost[i], cost[:, i] = both, both
        cost[j], cost[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def agglomerative(rows: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding", most: int | None = MOST_CHAPTERS) -> DataFrame:
    """CLU-06: adds cluster_id, by Ward's merges over a chapter-level table in one task; null without a vector.

    Tables of more than ``most`` rows are refused; with None any number is taken, in rounds over tasks (``merging.agglomerative``).
    """
    if most is None:
        return merging.agglomerative(rows, k, key, vector)
    held = chapter_level(rows.select(F.col(key).alias("own"), F.col(vector).alias("vector")).filter("vector IS NOT NULL"), most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(frames) or [pd.DataFrame({"own": [], "vector": []})]).sort_values("own")
        if len(found):
            yield pd.DataFrame({"own": found["own"], "cluster_id": ward(np.stack(found["vector"]).astype(float), k)})

    labels = held.repartition(1).mapInPandas(run, f"own {held.schema['own'].dataType.simpleString()}, cluster_id int")
    return rows.join(labels, rows[key] == F.col("own"), "left").drop("own")


def bisecting(rows: DataFrame, k: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """A hierarchical clustering that scales beyond chapter level; divisive, so not equal to an agglomerative one."""
    return BisectingKMeans(k=k, seed=seed).fit(points := _points(rows, vector)).transform(points).drop("features").withColumnRenamed("prediction", "cluster_id")


def density(rows: DataFrame, eps: float = 0.3, least: int = 2, key: str = "vec_id", vector: str = "embedding", most: int | None = MOST_CHAPTERS) -> DataFrame:
    """CLU-06: density clusters by cosine distance: components of core rows, borders to their smallest core, -1 for noise.

    Tables of more than ``most`` rows are refused; with None any number is taken, by neighbours found with pivots (``neighbours.density``).
    """
    return neighbours.density(rows if most is None else chapter_level(rows, most), eps, least, key, vector)


def silhouette(assigned: DataFrame, vector: str = "embedding", cluster: str = "cluster_id", distance: str = "squaredEuclidean") -> float:
    """AGG-32: by squared Euclidean distance of unit vectors, or by cosine distance; either follows from sums over clusters, without pairs."""
    points = _points(assigned, vector)
    return ClusteringEvaluator(predictionCol=cluster, featuresCol="features", distanceMeasure=distance).evaluate(points)


Labeller = Callable[[int, list[str]], str]


def parse_label(answer: str | None, cluster: int) -> tuple[str, str]:
    """CLU-04: LABEL: and EXPLANATION: lines of an answer; "Cluster c" where there is none."""
    label = re.search(r"(?im)^\s*LABEL:\s*(.+)$", answer or "")
    why = re.search(r"(?ims)^\s*EXPLANATION:\s*(.+)", answer or "")
    return (label[1].strip() if label else f"Cluster {cluster}", why[1].strip() if why else "")


def parsed_label(answer: Column, cluster: Column) -> tuple[Column, Column]:
    """CLU-04 for columns: (label, explanation) of an answer."""
    label = F.trim(F.regexp_extract(answer, r"(?im)^\s*LABEL:\s*(.+)$", 1))
    why = F.trim(F.regexp_extract(answer, r"(?ims)^\s*EXPLANATION:\s*(.+)", 1))
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Cluster "), cluster.cast("string"))), F.coalesce(why, F.lit(""))


def chapter_vectors(vectors: DataFrame, chapter: str, vector: str = "embedding") -> DataFrame:
    """CLU-07: unit mean vector of each chapter."""
    return V.mean_vectors(vectors, [chapter], vector, "mean").select(chapter, V.unit(F.col("mean")).alias("embedding"))


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def best_pairs(found: Pairs, k: int) -> Pairs:
    """Of (similarity, a, b) the k best, ties by a and b, which may be of any type that has an order."""
    score, a, b = found
    rank = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    order = np.lexsort((rank[len(a) :], rank[: len(a)], -score))[:k]
    return score[order], a[order], b[order]


def pairs_of_tile(own: np.ndarray, shard: np.ndarray, keys: np.ndarray, block: np.ndarray, k: int, least: float) -> Pairs:
    """The pairs a < b, a of the shard and b of the block, that may be among the k best: not below ``least`` nor the tile's k-th."""
    rank = np.unique(np.concatenate([own, keys]), return_inverse=True)[1]
    score = np.where(rank[: len(own), None] < rank[None, len(own) :], np.round(shard @ block.T, 12), -np.inf)
    if score.size > k:
        least = max(least, float(np.partition(score, score.size - k, axis=None)[score.size - k]))
    i, j = np.nonzero((score >= least) & (score > -np.inf))
    return best_pairs((score[i, j], own[i], keys[j]), k) if len(i) else (np.zeros(0), own[:0], keys[:0])


def similar_chapters(chapters: DataFrame, key: str, k: int = 20, vector: str = "embedding") -> DataFrame:
    """CLU-08, JN-12, TOP-08: (a, b, similarity) of the k most similar pairs, a < b, whatever the number of rows.

    Unit vectors are written to the shared folder; each task streams them past its own, tile by tile, with the k-th best similarity so far as the
    bound, and emits k pairs. So all pairs are compared by matrix products but none is a row unless it may be a result. Vectors that are
    null, of length zero or with null or non-finite components, and rows without a key, have no pairs; vectors of different length aren't compared;
    repeated keys have no pair with one another; similarities are rounded to 12 digits, so that copies tie, and ties go to the smaller keys.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = chapters.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).filter(V.norm(F.col(vector)) > 0)
    stored = materialise(usable.select(F.col(key).alias("key"), V.unit(F.col(vector)).alias("vector")), "chapters")
    kind, blocks = stored.schema["key"].dataType.simpleString(), block_reader(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, shard in shards(batches):
            best = (np.zeros(0), own[:0], own[:0])
            for n, keys, block in blocks():
                for at in range(0, len(own) if n == shard.shape[1] else 0, TILE_ROWS):
                    least = best[0][-1] if len(best[0]) == k else -np.inf
                    more = pairs_of_tile(own[at : at + TILE_ROWS], shard[at : at + TILE_ROWS], keys, block, k, least)
                    best = best_pairs(tuple(np.concatenate(x) for x in zip(best, more, strict=True)), k)
            of_kind = batches_type(kind)
            yield pa.RecordBatch.from_arrays([pa.array(best[1], of_kind), pa.array(best[2], of_kind), pa.array(best[0])], ["a", "b", "similarity"])

    def batches_type(name: str) -> pa.DataType | None:
        return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(name)

    lists = stored.mapInArrow(run, f"a {kind}, b {kind}, similarity double")
    return lists.orderBy(F.desc("similarity"), "a", "b").limit(k)
