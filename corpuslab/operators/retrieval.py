"""Retrieval: exact dense search, BM25, rank fusion, coarse-to-fine search, rerank, history (RET, TOP, JN-01..04).

A ranker is a frame (id, score). Limits come before filters where the order of the two is part of the
meaning (over-fetch, then filter); ``prefilter=True`` turns it round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions import vectors as V
from corpuslab.session import materialise, stamps, work_dir

RRF_K = 60
TOKEN = "[a-z]{2,}"
Terms = Callable[[Column], Column]


@dataclass(frozen=True)
class Parameters:
    """RET-19: numbers of chapters and passages, and how far to over-fetch."""

    chapters: int = 5
    passages: int = 8
    rerank: bool = True
    dense_wide: int = 400
    sparse_wide: int = 200
    candidates: int = 20
    over_fetch: int = 6

    def __post_init__(self) -> None:
        if not 1 <= self.chapters <= 15 or not 2 <= self.passages <= 20:
            raise ValueError("chapters are 1 to 15, passages 2 to 20")


def dense_scores(vectors: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """RET-03: adds score, the inner product with one query vector, whose literal is part of the plan."""
    return vectors.withColumn("score", V.dot(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))


def top(scored: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """TOP-01..03: the k best, ties by key; a TakeOrderedAndProject."""
    return scored.orderBy(F.desc(score), key).limit(k)


#: Queries that are compared at a time, vectors that a task holds for them (in bytes), and vectors of a tile: its scores take 32 MB.
QUERY_ROWS, SHARD_BYTES, TILE_ROWS = 1024, 64 << 20, 4096


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the vectors of each length."""
    lengths = np.asarray(batch.column(1).value_lengths(), np.int64)
    starts, flat, ids = np.cumsum(lengths) - lengths, np.asarray(batch.column(1).flatten(), float), batch.column(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        yield n, ids[own], flat[starts[own][:, None] + np.arange(n)]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of a task that have one length; so many bytes are held at a time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    for batch in batches:
        for n, ids, matrix in _by_length(batch):
            held.setdefault(n, []).append((ids, matrix))
        if sum(m.nbytes for parts in held.values() for _, m in parts) >= SHARD_BYTES:
            yield from map(join, held.values())
            held = {}
    yield from map(join, held.values())


def _best(lists: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (query row, score, id) the k best of each query, ties by id."""
    query, score, ids = lists
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], score[kept], ids[kept]


def topk_of_shard(own: np.ndarray, shard: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, score, id) of the k best rows of a shard for each query, tile by tile: a tile gives what is not below its k-th score."""
    found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    for at in range(0, len(own), TILE_ROWS):
        scores = shard[at : at + TILE_ROWS] @ queries.T
        n = len(scores)
        least = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(len(queries), -np.inf)
        row, query = np.nonzero(scores >= least)
        found = _best(tuple(np.concatenate(x) for x in zip(found, (query, scores[row, query], own[at + row]), strict=True)), k)
    return found


def block_reader(stored: DataFrame) -> Callable[[], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """For tasks: (length, keys, matrix) of a written table of keys and vectors (array<double>), a block at a time."""
    files = sorted(unquote(urlsplit(f).path) if urlsplit(f).scheme == "file" else f for f in stored.inputFiles())

    def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for name in files:
            store, path = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(QUERY_ROWS):
                    yield from _by_length(batch)

    return blocks


def dense_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """RET-03 for any number of queries in one job: (query_id, <key>, score, rank).

    Queries are written to the shared folder; every task streams them past its own vectors, block by block, so
    neither side is collected or broadcast, and emits k rows for each query and shard of its vectors. Vectors that are null or
    hold null or non-finite components take no part; a vector is compared with those of its own length.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = lambda df: df.filter(F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).filter(F.col(key).isNotNull())
    blocks = block_reader(materialise(plain(queries), "queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, shard in shards(batches):
            for n, ids, matrix in blocks():
                if n == shard.shape[1]:
                    query, score, found = topk_of_shard(own, shard, matrix, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(score)], ["query_id", key, "score"])

    lists = plain(vectors).mapInArrow(run, f"query_id long, `{key}` long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k)


def default_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def plain_terms(text: Column) -> Column:
    """RET-04's own tokens: words of two characters and more, without stop words, stemmed. One Arrow UDF."""
    from corpuslab.functions.stemming import STOP_WORDS, stems

    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    return stems(kept)


def postings(docs: DataFrame, key: str, text: str, terms: Terms = default_terms) -> DataFrame:
    """RET-04: (term, <key>, tf)."""
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str, text: str, terms: Terms = default_terms) -> DataFrame:
    return docs.select(key, F.size(terms(F.col(text))).cast("long").alias("dl"))


def bm25_scores(docs: DataFrame, query_terms: Sequence[str], key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, terms: Terms = default_terms) -> DataFrame:
    """RET-05: (<key>, score) of documents with a query term. Only query terms leave the scan.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); tf saturates by k1 and document length. Texts are split once: lengths and query terms of
    all documents are written to the shared folder, from which the statistics and the scores come.
    """
    wanted = sorted(set(query_terms))
    split = docs.select(key, terms(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    asked = F.filter("tokens", lambda t: t.isin(wanted)) if wanted else F.lit(None).cast("array<string>")
    tokens = materialise(split.select(key, F.size("tokens").alias("dl"), asked.alias("asked")), "tokens")
    stats = tokens.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    hits = tokens.select(key, "dl", F.explode("asked").alias("term"))
    tf = hits.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # df has a row for each query term, stats has one row
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    return scored.groupBy(key).agg(F.sum(idf * saturated).alias("score"))


def _segments(spark, folder: str) -> list[str]:
    """The whole segments of an index, oldest first. A segment's statistics are written last and make it whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/segments/*/stats/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f"{folder}/segments/{s.getPath().getParent().getParent().getName()}" for s in found or [])


def _new_segment(spark, folder: str) -> tuple[int, str]:
    """(number, path) of the next segment. Attempts that fail leave a folder that no reader looks at."""
    number = max((int(s.rpartition("/")[2].partition("-")[0]) for s in _segments(spark, folder)), default=-1) + 1
    return number, f"{folder}/segments/{number:08d}-{uuid.uuid4().hex}"


def _parts(spark, folder: str, name: str) -> DataFrame | None:
    """A table of all segments that have it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{s}/{name}") for s in _segments(spark, folder)]
    there = [p.toString() for p in paths if p.getFileSystem(conf).exists(p)]
    return spark.read.parquet(*there) if there else None


def bm25_append(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", terms: Terms = default_terms) -> None:
    """SNK-04: add documents as a segment of their own; only their texts are split.

    A segment has postings, which carry their document's length and lie in the order of terms, so that a query reads the row groups of its
    terms only; document frequencies, likewise; documents with their lengths; and one row of statistics. Nothing is rewritten.
    """
    spark = docs.sparkSession
    number, segment = _new_segment(spark, folder)
    tokens = docs.select(F.col(key), terms(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens").cast("long")).withColumn("segment", F.lit(number))
    found = tokens.select(key, "dl", "segment", F.explode("tokens").alias("term")).groupBy("term", key, "dl", "segment").agg(F.count(F.lit(1)).alias("tf"))
    found.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(f"{segment}/postings")
    spark.read.parquet(f"{segment}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.parquet(f"{segment}/terms")
    tokens.select(key, "dl", "segment").write.parquet(f"{segment}/docs")
    spark.read.parquet(f"{segment}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.parquet(f"{segment}/stats")


def bm25_delete(keys: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Take documents out of an index: a segment with their keys, which hold for the segments before it, and what they leave of the
    statistics. Keys that aren't there do nothing; a document that is appended again later counts again."""
    spark = keys.sparkSession
    number, segment = _new_segment(spark, folder)
    keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("until", F.lit(number)).write.parquet(f"{segment}/deleted")
    gone = spark.read.parquet(f"{segment}/deleted").select(key)
    docs = _parts(spark, folder, "docs")
    if docs is not None:
        left = _alive(spark, folder, docs, key).join(gone, key, "left_semi").agg((-F.count(F.lit(1))).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("total"))
    else:
        left = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    left.write.parquet(f"{segment}/stats")


def _alive(spark, folder: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows of documents that no later segment deletes."""
    deleted = _parts(spark, folder, "deleted")
    if deleted is None:
        return rows
    until = deleted.groupBy(key).agg(F.max("until").alias("until"))
    return rows.join(until, key, "left").filter(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")


def bm25_index(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", terms: Terms = default_terms) -> None:
    """SNK-04: a new index of all documents, as one segment; ``bm25_append`` and ``bm25_delete`` change it."""
    bm25_append(docs, folder, key, text, terms)


def bm25_from_index(spark, folder: str, query_terms: Sequence[str], key: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """SRC-10: the same scores from the stored segments; the term filter reaches the scans. Statistics are those of all segments together."""
    wanted = sorted(set(query_terms))
    hits = _alive(spark, folder, _parts(spark, folder, "postings").filter(F.col("term").isin(wanted)), key)
    stats = _parts(spark, folder, "stats").agg(F.sum("n").cast("double").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    if _parts(spark, folder, "deleted") is None:
        df = _parts(spark, folder, "terms").filter(F.col("term").isin(wanted)).groupBy("term").agg(F.sum("df").alias("df"))
    else:
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a row for each query term, and one row
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return scored.groupBy(key).agg(F.sum(idf * (F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))).alias("score"))


#: By application, key, text and schema: the files of each table indexed, as they were, and the index's folder.
_INDEXES: dict[tuple[str, str, str, str], list[tuple[dict[str, str], str]]] = {}


def _indexes(scan: DataFrame, key: str, text: str) -> list[tuple[dict[str, str], str]]:
    """The application's indexes of tables of this kind that are still there."""
    spark = scan.sparkSession
    known = _INDEXES.setdefault((spark.sparkContext.applicationId, key, text, scan.schema.simpleString()), [])
    known[:] = [(old, folder) for old, folder in known if _segments(spark, folder)]
    return known


def ready_index(scan: DataFrame, key: str = "doc_id", text: str = "text") -> str | None:
    """The folder of a stored index of just this table as it is now; None if the application has none. Nothing is built."""
    files = stamps(scan)
    return next((folder for old, folder in _indexes(scan, key, text) if old == files and old), None)


def stored_index(docs: DataFrame, scan: DataFrame, key: str = "doc_id", text: str = "text") -> str:
    """The folder of the index of a table, built by the application's first question. Where the table has got new files since, and those it
    had are as they were, the new ones are appended; where files have changed or gone, or the index has been cleaned away, it is built again."""
    spark = docs.sparkSession
    files, known = stamps(scan), _indexes(scan, key, text)
    for i, (old, folder) in enumerate(known):
        if old.items() <= files.items() and old:
            if new := sorted(files.keys() - old.keys()):
                bm25_append(spark.read.schema(scan.schema).parquet(*new), folder, key, text)
                known[i] = files, folder
            return folder
    folder = work_dir(spark, "bm25")
    bm25_index(docs, folder, key, text)
    known.append((files, folder))
    return folder


def ranked(scored: DataFrame, k: int, key: str, ranker: int) -> DataFrame:
    """WIN-01: (id, ranker, place) of the k best, places from 1. The window sees k rows.

    Scores are compared to six decimals, so that equal texts tie whatever the order their terms were added in.
    """
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return top(scored.select(F.col(key).alias("id"), F.round("score", 6).alias("score")), k, "id").withColumn("place", place).select("id", F.lit(ranker).alias("ranker"), "place")


def fuse(rankers: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """RET-06: (id, rrf, first_seen): reciprocal ranks added; first_seen orders ties as the lists were given."""
    both = rankers[0]
    for other in rankers[1:]:
        both = both.unionByName(other)
    return both.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("place"))).alias("rrf"), F.min(F.col("ranker") * F.lit(1_000_000) + F.col("place")).alias("first_seen"))


def best_fused(fused: DataFrame, n: int) -> DataFrame:
    return fused.orderBy(F.desc("rrf"), "first_seen").limit(n)


def hybrid(vectors: DataFrame, docs: DataFrame, query_vector: Sequence[float], query_terms: Sequence[str], n: int = 8, p: Parameters | None = None) -> DataFrame:
    """Dense and BM25 lists over one corpus, fused: (id, rrf, first_seen)."""
    p = p or Parameters()
    dense = ranked(dense_scores(vectors, query_vector), p.dense_wide, "vec_id", 0)
    sparse = ranked(bm25_scores(docs, query_terms), p.sparse_wide, "doc_id", 1)
    return best_fused(fuse([dense, sparse]), n)


def retrieve_chapters(summary_vectors: DataFrame, summaries: DataFrame, query_vector: Sequence[float], query_terms: Sequence[str], p: Parameters | None = None) -> DataFrame:
    """RET-07: the best chapters by their summaries; both lists have six times as many as wanted."""
    p = p or Parameters()
    k = p.over_fetch * p.chapters
    dense = ranked(dense_scores(summary_vectors, query_vector), k, "vec_id", 0)
    sparse = ranked(bm25_scores(summaries, query_terms), k, "doc_id", 1)
    return best_fused(fuse([dense, sparse]), p.chapters)


def retrieve_passages(
    chunk_vectors: DataFrame, chunks: DataFrame, chapters: DataFrame, query_vector: Sequence[float], query_terms: Sequence[str], chapter: str, p: Parameters | None = None, prefilter: bool = False,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """RET-08: passages of the chosen chapters. chunk_vectors (vec_id, embedding, <chapter>), chunks (doc_id, text, <chapter>).

    Vectors that have a level are searched at every level and kept at level 0 (FLT-02). Lists are cut to the
    over-fetch before level and chapters filter them (JN-04), so a passage far down a list
    is lost, unless prefilter is set. Candidates are reranked only if there are more than asked for.
    """
    p = p or Parameters()
    chosen = F.broadcast(chapters.select(chapter).distinct())
    base = lambda df: df.filter("level = 0") if "level" in df.columns else df
    within = lambda df: base(df).join(chosen, chapter, "left_semi")
    dense, sparse = dense_scores(chunk_vectors, query_vector), bm25_scores(chunks, query_terms)
    sparse = sparse.join(chunks.select("doc_id", chapter), "doc_id")
    dense, sparse = (x.withColumn("score", F.round("score", 6)) for x in (dense, sparse))
    if prefilter:
        dense, sparse = top(within(dense), p.dense_wide, "vec_id"), top(within(sparse), p.sparse_wide, "doc_id")
    else:
        dense, sparse = within(top(dense, p.dense_wide, "vec_id")), within(top(sparse, p.sparse_wide, "doc_id"))
    fused = fuse([ranked(dense, p.dense_wide, "vec_id", 0), ranked(sparse, p.sparse_wide, "doc_id", 1)])
    candidates = best_fused(fused, p.candidates if p.rerank else p.passages)
    return rerank(candidates, scorer, p.passages) if p.rerank and scorer else best_fused(candidates, p.passages)


def rerank(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], m: int) -> DataFrame:
    """RET-09, TOP-05: order by a scorer's column; skipped where there is nothing to leave out."""
    # written once: the count and the scorer would each search the corpus again
    candidates = materialise(candidates, "candidates")
    if candidates.count() <= m:
        return candidates
    return scorer(candidates).orderBy(F.desc("rerank_score"), "first_seen").limit(m)


def rows_of_hits(hits: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key, renamed to id, is one of the hits'. The ids go to the rows, so that no text is moved or sorted but those
    of hits; hits are what a limit has left of a question's candidates."""
    return table.withColumnRenamed(key, "id").join(F.broadcast(hits.select("id").distinct()), "id", "left_semi")


def overlap_scorer(texts: DataFrame, query_terms: Sequence[str], key: str = "doc_id", text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """UDF-03's offline default: the share of query terms in a text, by built-in array functions."""
    wanted = F.array(*(F.lit(t) for t in sorted(set(query_terms))))

    def score(candidates: DataFrame) -> DataFrame:
        share = F.size(F.array_intersect(F.array_distinct(default_terms(F.coalesce(text, F.lit("")))), wanted)) / F.size(wanted)
        own = rows_of_hits(candidates, texts.select(key, text), key)
        return candidates.join(own, "id", "left").withColumn("rerank_score", F.coalesce(share, F.lit(0.0))).drop(text)

    return score


def with_texts(hits: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """JN-01: hits with their rows of the sidecar; null where there is none."""
    found = materialise(hits, "hits")
    return found.join(rows_of_hits(found, sidecar, key), "id", "left")


def context(hits: DataFrame, order: str, book: str, chapter: str, text: str) -> DataFrame:
    """FN-32: one row, context: the passages numbered in order. Meant for the handful that a prompt takes."""
    numbered = hits.withColumn("place", F.row_number().over(Window.orderBy(order)))
    line = T.passage_line(F.col("place"), F.col(book), F.col(chapter), F.col(text))
    return numbered.agg(F.concat_ws(T.PASSAGE_SEPARATOR, F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])).alias("context"))


def similar_history(history: DataFrame, query: Sequence[float], least: float = 0.78, k: int = 3, key: str = "id") -> DataFrame:
    """RET-11, FLT-13, TOP-06: past questions at least so similar, the best few."""
    return top(dense_scores(history, query).filter(F.col("score") >= least), k, key)


def history_block(history: DataFrame, longest: int = 600) -> DataFrame:
    """RET-13: (id, block): date, question, and the answer cut to so many characters."""
    answer = F.when(F.length("answer") > longest, F.concat(F.substring("answer", 1, longest), F.lit("…"))).otherwise(F.col("answer"))
    return history.select("id", F.format_string("[%s]\nQ: %s\nA: %s", T.day_of(F.col("timestamp")), F.col("question"), answer).alias("block"))


def last_messages(conversations: DataFrame, n: int = 8, longest: int = 300) -> DataFrame:
    """WIN-11, RET-14: the last n messages of each conversation, each cut."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return conversations.withColumn("place", place).filter(F.col("place") <= n).select("conv_id", "turn", "role", F.substring("text", 1, longest).alias("text"))


def rewrite_query(question: str, history: Sequence[str]) -> str:
    """RET-14's offline default: the question alone without history, else with the words of the last message."""
    return question if not history else f"{question} {history[-1][:300]}"


def rewritten(conversations: DataFrame, longest: int = 300) -> DataFrame:
    """RET-14: (conv_id, turn, question): every user message as ``rewrite_query`` gives it after those before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    asked = conversations.select("conv_id", "turn", "role", "text", F.substring(before, 1, longest).alias("before")).filter("role = 'user'")
    return asked.select("conv_id", "turn", F.concat("text", F.coalesce(F.concat(F.lit(" "), "before"), F.lit(""))).alias("question"))


def chapter_summary(summaries: DataFrame, keys: Sequence[str], preferred: str) -> DataFrame:
    """RET-17: of each chapter's summaries (pos, author, text), the first by a preferred author, else the first; blank ones don't count."""
    filled = summaries.filter(F.trim("text") != "")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.contains(F.lower(F.coalesce("author", F.lit(""))), F.lit(preferred))), "pos")
    return filled.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def merged_stores(scored: DataFrame, store: str, per_store: int, k: int, key: str) -> DataFrame:
    """TOP-07, RET-18: the best of each store, then the best of all."""
    own = F.row_number().over(Window.partitionBy(store).orderBy(F.desc("score"), key))
    return top(scored.withColumn("own", own).filter(F.col("own") <= per_store).drop("own"), k, key)


def first_match(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """JN-08, SET-05: the first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("place", place).filter("place = 1").drop("place")


def sources_panel(hits: DataFrame, order: str, longest: int = 200) -> DataFrame:
    """RET-10, RET-16: (place, line): the hits as a list of sources, for the terminal and the web alike."""
    numbered = hits.withColumn("place", F.row_number().over(Window.orderBy(order)))
    head = F.format_string("%d. Book %s, Ch %s", F.col("place"), F.col("book").cast("string"), F.col("chapter").cast("string"))
    return numbered.select("place", F.concat(head, F.lit(": "), T.excerpt(F.col("text"), longest)).alias("line"))


def extractive_answer(question_terms: Sequence[str], hits: DataFrame, order: str, sentences: int = 3) -> DataFrame:
    """RET-15's offline default (UDF-04): one row, answer: the passages' first sentences that hold a question's term, in order."""
    from corpuslab.functions.fuzzy import sentences as split

    wanted = F.array(*(F.lit(t) for t in sorted(set(question_terms))))
    # written first: what the explode infers about the sentences would be asked of all texts, below the hits' join
    few = materialise(hits.select(order, "text"), "passages")
    rows = few.select(order, F.posexplode(split(F.col("text"))).alias("pos", "sentence"))
    told = rows.filter(F.size(F.array_intersect(default_terms(F.col("sentence")), wanted)) > 0).orderBy(order, "pos").limit(sentences)
    return told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "pos", "sentence"))), lambda x: x["sentence"]), " ").alias("answer"))


def samples(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """TOP-10: the first rows of an explicit order."""
    return rows.orderBy(*order).limit(n)
