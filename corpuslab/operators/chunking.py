"""Chunks of chapters and their hierarchy (CHK, FN-27, UDF-01, UDF-02)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import vectors as V
from corpuslab.session import materialise

CHUNK_SIZE, OVERLAP, SEPARATORS = 1000, 200, ("\n\n", "\n", " ", "")
#: Similarity from which neighbours merge at the first level, fall a level, and the least; levels; chunks to go on; characters of a merged chunk.
FIRST_THRESHOLD, THRESHOLD_STEP, LEAST_THRESHOLD = 0.70, 0.10, 0.20
LEVELS, MIN_CHUNKS, MAX_CHARS = 5, 3, 20_000
#: Chunks of a chapter whose neighbours are compared in one group.
BLOCK = 64


class Embedder(Protocol):
    """UDF-01."""

    def embed_texts(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """The offline default: signed feature hashing of words and their trigrams, unit length."""

    def __init__(self, size: int = 128):
        self.size = size

    def embed_texts(self, texts: Sequence[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                for part in (word, *(word[j : j + 3] for j in range(len(word) - 2))):
                    h = zlib.crc32(part.encode())
                    out[i, h % self.size] += 1 if h & 0x80000000 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def vector_lists(vectors: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))


def _pack(parts: list[str], joiner: str, size: int, overlap: int) -> list[str]:
    """Parts in order, joined up to the size; the next piece begins with as many of the last parts as fit the overlap."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        extra = len(joiner) if held else 0
        if held and total + extra + len(part) > size:
            out.append(joiner.join(held))
            while held and (total > overlap or total + len(joiner) + len(part) > size):
                total -= len(held.pop(0)) + (len(joiner) if held else 0)
        held.append(part)
        total += len(part) + (len(joiner) if len(held) > 1 else 0)
    if held:
        out.append(joiner.join(held))
    return [x for x in (p.strip() for p in out) if x]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """CHK-01: cut at the first separator that occurs; parts still too long are cut by the next ones."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = list(text) if separator == "" else [p for p in text.split(separator) if p]
    out: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if len(part) <= size:
            fitting.append(part)
            continue
        out += _pack(fitting, separator, size, overlap)
        fitting = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + _pack(fitting, separator, size, overlap)


def located(text: str | None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[dict]:
    """FN-27: pieces with their places: searched from behind the last start, then from the front, else at the cursor."""
    if not text or not text.strip():
        return []
    out, cursor = [], 0
    for i, piece in enumerate(split_text(text, size, overlap)):
        start = next((p for p in (text.find(piece, cursor), text.find(piece)) if p >= 0), cursor)
        out.append({"chunk_index": i, "text": piece, "start_offset": start, "end_offset": start + len(piece), "word_count": len(piece.split())})
        cursor = start + 1
    return out


CHUNK = "chunk_index int, text string, start_offset int, end_offset int, word_count int"


def chunk_texts(texts: DataFrame, keys: Sequence[str], text: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """CHK-01, CHK-02: (keys, chunk): a pure function of each row, in Arrow batches; no shuffle."""
    rows = texts.select(*keys, text)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + CHUNK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(*row[:-1], *c.values()) for row in frame.itertuples(index=False, name=None) for c in located(row[-1], size, overlap)]
            yield pd.DataFrame(found, columns=[*keys, "chunk_index", "text", "start_offset", "end_offset", "word_count"])

    return rows.mapInPandas(run, schema)


def threshold(level: int, first: float = FIRST_THRESHOLD) -> float:
    return max(LEAST_THRESHOLD, first - THRESHOLD_STEP * (level - 1))


HIERARCHY = "level int, chunk_index int, merge_depth int, text string, start_offset int, end_offset int, word_count int"
#: A level's chunks: ``own`` names the chapter (also where its key is null), ``at`` counts its chunks from 0 without gaps.
LEVEL = "own string, key {kind}, at bigint, merge_depth int, text string, start_offset int, end_offset int, word_count int, vector array<float>"


def _tasks(rows: DataFrame) -> int:
    """As many tasks as shuffles have: the work in Python costs far more than its bytes suggest, by which adaptive execution would join tasks."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str = "at") -> DataFrame:
    """Rows of each group counted from 0 in their order, whatever a group's size, and how many it has (n).

    Rows are sorted by ranges, so a group may lie in several tasks; it has a count for each of those, and only these counts are a window.
    """
    sorted_rows = rows.repartitionByRange(_tasks(rows), group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id())
    stored = materialise(sorted_rows, "numbered").withColumn("part", F.shiftright("place", 33))
    parts = stored.groupBy(group, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(group)).alias("n"))
    return stored.join(starts, [group, "part"]).withColumn(name, F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _embedded(rows: DataFrame, schema: str, embedder: Embedder, batch: int = 256) -> DataFrame:
    """Vectors and numbers of words of the chunks that have none yet, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                vectors, words = part["vector"].tolist(), part["word_count"].tolist()
                new = [i for i, v in enumerate(vectors) if v is None]
                texts = [part["text"].iat[i] for i in new]
                for i, text, vector in zip(new, texts, embedder.embed_texts(texts) if new else (), strict=True):
                    vectors[i], words[i] = np.asarray(vector, np.float32), len(text.split())
                yield part.assign(vector=vectors, word_count=words)

    return rows.mapInPandas(run, schema)


def next_starts(lengths: np.ndarray, similar: np.ndarray, max_chars: int) -> np.ndarray:
    """CHK-03, WIN-03: for each chunk, where the next run begins if one begins here.

    A run goes on while neighbours are similar. Its first pair is taken whatever its length, further chunks only while the sum of lengths stays
    within the cap.
    """
    n = len(lengths)
    at = np.arange(n)
    total = np.concatenate([[0], np.cumsum(lengths)])
    fits = np.searchsorted(total, total[:-1] + max_chars, side="right") - 1
    ends = np.minimum.accumulate(np.where(similar, n, at + 1)[::-1])[::-1]
    return np.where(similar, np.minimum(np.maximum(fits, at + 2), ends), at + 1)


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by keys, cut anew so that no group lies in two; what a batch ends with waits for the next."""
    held: pd.DataFrame | None = None
    for frame in frames:
        rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = (rows[list(keys)] == rows[list(keys)].iloc[-1]).all(axis=1).to_numpy() if len(rows) else np.zeros(0, bool)
        held = rows[last]
        if not last.all():
            yield rows[~last]
    if held is not None and len(held):
        yield held


def _segments(frames: Iterator[pd.DataFrame], span: int, max_chars: int) -> Iterator[tuple[str, int, int, np.ndarray, pd.DataFrame]]:
    """(chapter, segment, its number of chunks, where the next run begins counted from its first place, rows) of each segment of a task."""
    for rows in whole_groups(frames, ["own", "seg"]):
        owner, seg, at = rows["own"].to_numpy(), rows["seg"].to_numpy(), rows["at"].to_numpy()
        ends = np.append(np.flatnonzero((owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])) + 1, len(rows))
        similar = rows["similar"].to_numpy(bool).copy()
        similar[ends - 1] = False
        following = next_starts(rows["length"].to_numpy(np.int64), similar, max_chars)
        within = at < (seg + 1) * span
        for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            yield owner[start], int(seg[start]), int(within[start:end].sum()), following[start:end] - start, rows.iloc[start:end]


def runs_of_level(level: DataFrame, least: float, max_chars: int) -> DataFrame:
    """CHK-03, CHK-04: (own, at, number, size, n): the run that each chunk of a level belongs to, numbered from 0 in each chapter, its chunks and the chapter's runs.

    Runs depend on where the one before them ends, so a chapter is a sequence. It is cut into segments of as many chunks as a run can have, at
    most; a segment is a group of numbers (no texts), with the segment after it to look ahead. As a first step each segment tells, for each place
    at which a run may begin in it, the place in the next segment at which one then begins. Where neighbours differ anywhere in a segment, that
    is one place. The others are composed in rounds that double their reach. Then all segments give their runs at once.
    """
    span = max(max_chars, 2)
    # neighbours meet in blocks of a chapter, each with the chunk behind it, so vectors are moved once
    block, before = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") - 1) / BLOCK)
    dealt = level.select("own", "at", F.length("text").alias("length"), "vector").withColumn("block", F.explode(F.array_distinct(F.array(block, before)))).filter("block >= 0")
    following = lambda c: F.lead(c).over(Window.partitionBy("own", "block").orderBy("at"))
    beside = dealt.withColumns({"next": following("vector"), "filled": following("length") > 0}).filter(F.col("block") == block)
    similar = F.coalesce((F.col("length") > 0) & F.col("filled") & (V.cosine(F.col("vector"), F.col("next")) >= least), F.lit(False))
    numbers = beside.select("own", "at", "length", similar.alias("similar"))
    seg = F.floor(F.col("at") / span)
    dealt = materialise(numbers.withColumn("seg", F.explode(F.array(seg, seg - 1))).filter("seg >= 0"), "segments")
    # A look-ahead has no segment of its own if the chapter ends before it, so a group always has its own chunks.
    groups = lambda rows: rows.repartition(_tasks(rows), "own", "seg").sortWithinPartitions("own", "seg", "at")

    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for owner, seg, own, following, _ in _segments(frames, span, max_chars):
            out, following = [0] * own, following.tolist()
            for i in range(own - 1, -1, -1):
                out[i] = following[i] - span if following[i] >= own else out[following[i]]
            if seg == 0 or len(set(out)) == 1:
                out = out[:1]
            yield pd.DataFrame({"own": [owner], "seg": [seg], "origin": [seg], "exits": [out]})

    long = dealt.filter("seg > 0").select("own").distinct()
    last = dealt.groupBy("own").agg(F.max("seg").alias("last"))
    inner = dealt.join(long, "own", "left_semi").join(last, "own").filter("seg < last").drop("last")
    maps = materialise(groups(inner).mapInPandas(exits, "own string, seg bigint, origin bigint, exits array<int>"), "exits")
    while not maps.filter(F.size("exits") > 1).isEmpty():
        before = maps.select(F.col("own").alias("b_own"), F.col("seg").alias("b_seg"), F.col("origin").alias("b_origin"), F.col("exits").alias("b_exits"))
        joined = maps.join(before, (F.col("own") == F.col("b_own")) & (F.col("b_seg") == F.col("origin") - 1) & (F.size("exits") > 1), "left")
        through = F.when(F.col("b_exits").isNull(), F.col("exits")).otherwise(F.transform("b_exits", lambda x: F.get("exits", x)))
        maps = materialise(joined.select("own", "seg", F.coalesce("b_origin", "origin").alias("origin"), through.alias("exits")), "exits")
    entries = maps.select("own", (F.col("seg") + 1).alias("seg"), F.get("exits", F.lit(0)).alias("entry"))

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, found = ["own", "seg", "place", "start", "last"], []
        for owner, seg, own, following, rows in _segments(frames, span, max_chars):
            at, following, first, place = int(rows["entry"].iat[0]), following.tolist(), seg * span, 0
            while at < own:
                found.append((owner, seg, place, first + at, first + following[at] - 1))
                at, place = following[at], place + 1
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=columns)
                found = []
        yield pd.DataFrame(found, columns=columns)

    begun = dealt.join(entries, ["own", "seg"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    found = materialise(groups(begun).mapInPandas(runs, "own string, seg bigint, place bigint, start bigint, last bigint"), "runs")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("own").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = found.groupBy("own", "seg").agg(F.count(F.lit(1)).alias("n")).select("own", "seg", before.alias("before"), F.sum("n").over(Window.partitionBy("own")).alias("n"))
    size = (F.col("last") - F.col("start") + 1).alias("size")
    return found.join(sizes, ["own", "seg"]).select("own", (F.col("before") + F.col("place")).alias("number"), size, "n", F.explode(F.sequence("start", "last")).alias("at"))


def merged_level(level: DataFrame, least: float, schema: str, embedder: Embedder, max_chars: int) -> DataFrame:
    """The next level, with the number n of its chunks in the chapter: each run joined to one chunk, embedded anew; chunks that are a run alone stay as they are.

    Those are written as they come from the join; only the others are moved again, without their vectors.
    """
    runs = runs_of_level(level.drop("n"), least, max_chars)
    members = materialise(level.drop("n").join(runs, ["own", "at"]), "members")
    columns = ["own", "key", "at", "merge_depth", "text", "start_offset", "end_offset", "word_count", "vector", "n"]
    lone = members.filter("size = 1").withColumn("at", F.col("number")).select(columns)
    several = members.filter("size > 1").select("own", "key", "number", "at", "merge_depth", "text", "start_offset", "end_offset", "n")
    grouped = several.repartition(_tasks(several), "own", "number").groupBy("own", "number")
    parts = F.array_sort(F.collect_list(F.struct("at", "merge_depth", "text")))
    joined = grouped.agg(parts.alias("parts"), F.first("key").alias("key"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.first("n").alias("n"))
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    depth = F.aggregate(rest, F.get("parts", F.lit(0))["merge_depth"], lambda d, p: F.greatest(d, p["merge_depth"]) + 1)
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    empty = (F.lit(None).cast("int").alias("word_count"), F.lit(None).cast("array<float>").alias("vector"))
    rows = joined.select("own", "key", F.col("number").alias("at"), depth.alias("merge_depth"), text.alias("text"), "start_offset", "end_offset", *empty, "n")
    return lone.union(materialise(_embedded(rows, f"{schema}, n bigint", embedder), "level"))


def build_hierarchy(chunks: DataFrame, key: str, embedder: Embedder | None = None, levels: int = LEVELS, min_chunks: int = MIN_CHUNKS, first: float = FIRST_THRESHOLD, max_chars: int = MAX_CHARS) -> DataFrame:
    """CHK-05..07: chunks (key, chunk_index, text, start_offset, end_offset) of each chapter to all levels.

    A snapshot for each level up to ``levels``, merged chunks beside unmerged ones, until a chapter has ``min_chunks`` or fewer. A level where
    nothing merges counts: the next one asks for less. A chapter of any length is dealt over tasks; a row is one chunk, so it has some
    ``max_chars`` characters at most, or two of the level before it. Chunks are numbered from 0 in each chapter by chunk_index, then
    start_offset, end_offset and text. A null text counts as an empty one; empty texts are like no other, so they don't merge. Rows without a key
    are a chapter of their own. An empty table gives an empty one.
    """
    model, kind = embedder or HashingEmbedder(), chunks.schema[key].dataType.simpleString()
    schema = LEVEL.format(kind=kind)
    rows = chunks.select(F.to_json(F.struct(F.col(key).alias("key"))).alias("own"), F.col(key).alias("key"), "chunk_index", F.coalesce("text", F.lit("")).alias("text"), F.col("start_offset").cast("int").alias("start_offset"), F.col("end_offset").cast("int").alias("end_offset"))
    base = numbered(rows, "own", ["chunk_index", "start_offset", "end_offset", "text"])
    empty = (F.lit(0).alias("merge_depth"), "text", "start_offset", "end_offset", F.lit(None).cast("int").alias("word_count"), F.lit(None).cast("array<float>").alias("vector"))
    found = [materialise(_embedded(base.select("own", "key", "at", *empty, "n"), f"{schema}, n bigint", model), "level")]
    for level in range(1, levels + 1):
        going = found[-1].filter(F.col("n") > min_chunks)
        if going.isEmpty():
            break
        found.append(merged_level(going, threshold(level, first), schema, model, max_chars))
    of_level = [rows.select(F.col("key").alias(key), F.lit(level).alias("level"), F.col("at").cast("int").alias("chunk_index"), *(f.split()[0] for f in HIERARCHY.split(", ")[2:])) for level, rows in enumerate(found)]
    return reduce(DataFrame.unionByName, of_level)


def embed(texts: DataFrame, keys: Sequence[str], text: str = "text", embedder: Embedder | None = None, prefix: str = "passage: ", batch: int = 256) -> DataFrame:
    """RET-01, RET-02, TOP-11: (keys, embedding), in batches."""
    model = embedder or HashingEmbedder()
    rows = texts.select(*keys, text)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the texts of one batch of the embedder are Python objects
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = np.asarray(model.embed_texts([prefix + (t or "") for t in part.column(len(keys)).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], vector_lists(vectors)], [*keys, "embedding"])

    return rows.mapInArrow(run, schema)


def chapter_range(chapters: DataFrame, book: str, first: int, last: int) -> DataFrame:
    """CHK-07."""
    return chapters.filter(F.col(book).between(first, last))
