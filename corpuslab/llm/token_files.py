"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding (operator 3).

Texts are encoded once by a public tokenizer. Ids are counted over all documents and replaced by their
rank (the most frequent id is 0), so that most take one byte. A file holds blocks; a block holds whole
documents, and its ids as a control stream apart from the data stream: two bits an id for the number of
its bytes, four ids a control byte, then the bytes themselves, little-endian. A block is decoded by
numpy alone: a 256-row table turns control bytes into lengths, their running sum into places.

    file   "CLTOK01\\n", then blocks
    block  documents, ids, control bytes, data bytes (4 x uint64)
           doc_id (int64 each), doc_id given (uint8 each), number of ids (uint64 each)
           control bytes, data bytes

Files are written by range of doc_id, in ascending order inside, and named in a manifest (Parquet) with
their numbers of ids; ``start`` follows from the manifest. The rank table is a Parquet table beside it.

Defined cases: null text is empty and gets the end id alone; a null doc_id comes first; rows that share
a doc_id follow one another in the order of a digest of their ids; rows that are equal in both follow one
another in any order, which can't be told apart, and may lie in several files; the strings of the
tokenizer's added tokens are those tokens, as the library has it; a long text is encoded whole, and its
ids (four bytes each) are the most that a task holds; an empty table gives no files; further columns are
not looked at.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import fresh, pieces, utf8
from corpuslab.llm.files import create, make_dir, open_file
from corpuslab.session import work_dir

MAGIC = b"CLTOK01\n"
#: Entries that a worker's dictionary of words holds before it is emptied.
CACHE = 2_000_000
#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 19


class _Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokenizer:
    """A tokenizer whose pre-tokens never hold white space, so that words can be encoded once each.

    The library encodes everything; this class only decides what it is asked. New words made of plain
    letters, with or without a final mark, are sent to it as lines, whose ids are cut where a token
    ends a pre-token (``</w>``); all others are sent one by one. Texts with the control characters on
    which Python and Unicode disagree about white space, and texts that may hold an added token, which the
    library cuts out first, are sent whole. Words have numbers in a bounded
    dictionary, and their ids lie in one flat array, from which numpy gathers those of a batch.
    """

    _PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?")
    _LINE = 1024

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its parallelism
        from tokenizers import Tokenizer, normalizers

        self._tokenizer = Tokenizer.from_file(path)
        # what every text with an added token holds: the signs that the token begins with, which no normaliser makes or takes away
        added = {re.match(r"[!-/:-@\[-`{-~]*", t.content)[0] for t in self._tokenizer.get_added_tokens_decoder().values()}
        self._whole = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, sorted(added))])).search
        # on plain letters the file's normaliser only folds case; where that holds, lines are folded here instead
        letters = [chr(c) for c in range(0x100) if self._PLAIN.fullmatch(chr(c))]
        self._folded = None
        if self._tokenizer.normalizer and all(self._tokenizer.normalizer.normalize_str(x) == x.lower() for x in letters):
            self._folded = Tokenizer.from_file(path)
            self._folded.normalizer = normalizers.Sequence([])
        self.size = self._tokenizer.get_vocab_size()
        self._ends = np.array([(self._tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self._numbers = _Numbers()
        self._starts, self._lengths, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _ids(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        if plain and self._folded:
            return [np.array(x.ids, self.dtype) for x in self._folded.encode_batch_fast([t.lower() for t in texts], add_special_tokens=False)]
        return [np.array(x.ids, self.dtype) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words, whose numbers follow those known."""
        fits = self._PLAIN.fullmatch
        plain = [i for i, w in enumerate(words) if fits(w)]
        found = []  # (places in words, lengths, ids)
        own = [words[i] for i in plain]
        lines = self._ids([" ".join(own[i : i + self._LINE]) for i in range(0, len(own), self._LINE)], plain=True)
        if plain:
            ids = np.concatenate(lines)
            ends = np.flatnonzero(self._ends[ids]) + 1
            parts = np.cumsum(np.fromiter((1 if w[-1].isalpha() else 2 for w in own), np.int64, len(own)))
            if len(ends) == parts[-1] and ends[-1] == len(ids):
                found.append((np.array(plain), np.diff(ends[parts - 1], prepend=0), ids))
            else:
                plain = []
        single = np.setdiff1d(np.arange(len(words)), plain)
        if len(single):
            each = self._ids([words[i] for i in single])
            found.append((single, np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)))
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for places, n, ids in found:
            lengths[places], starts[places] = n, len(self._flat) + np.cumsum(n) - n
            self._flat = np.concatenate([self._flat, ids])
        self._starts, self._lengths = np.concatenate([self._starts, starts]), np.concatenate([self._lengths, lengths])

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text): each text's ids and the end id behind them."""
        if len(self._numbers) > CACHE:
            self._clear()
        odd = {i: self._ids([t])[0] for i, t in enumerate(texts) if self._whole(t)}
        cut = [[] if i in odd else t.split() for i, t in enumerate(texts)]
        number, known = self._numbers.__getitem__, len(self._numbers)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(number, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if len(self._numbers) > known:
            self._learn(list(islice(reversed(self._numbers), len(self._numbers) - known))[::-1])
        lengths = self._lengths[numbers]
        ids = gather(self._starts[numbers], lengths, self._flat)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        stops = sums[np.cumsum(counts)]
        sizes = np.diff(stops, prepend=0)
        ids = np.insert(ids, stops, self.dtype.type(end_id))
        if odd:
            each = np.split(ids, np.cumsum(sizes + 1)[:-1])
            for i, own in odd.items():
                each[i], sizes[i] = np.append(own, self.dtype.type(end_id)), len(own)
            ids = np.concatenate(each)
        return ids, sizes + 1


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of values as a binary column, without a Python object for each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    large = offsets[-1] >= 1 << 31
    kind, offset_type = (pa.large_binary(), np.int64) if large else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets.astype(offset_type)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode(documents: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, width, ids): the ids of each whole text with the end id behind, packed as unsigned integers of ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in pieces(batches):
            texts = [(x or b"").decode("utf-8", "replace") for x in utf8(batch.column(1))]
            ids, counts = tokenizer.encode(texts, end_id)
            width = pa.array(np.full(len(counts), ids.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), width, binary(ids, counts)], [key, "width", "ids"])

    rows = documents.select(F.col(key).cast("long").alias(key), text)
    return rows.mapInArrow(run, f"`{key}` bigint, width int, ids binary")


def _values(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}")


def rank_ids(encoded: DataFrame) -> DataFrame:
    """(id, n, rank) of all ids, the most frequent first. Tasks count; only their counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in pieces(batches):
            for width in set(batch.column(0).to_pylist()):
                same = batch.filter(pa.compute.equal(batch.column(0), width))
                own = np.bincount(_values(b"".join(same.column(1).to_pylist()), width), minlength=len(counts))
                own[: len(counts)] += counts
                counts = own
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["id", "n"])

    counted = encoded.select("width", "ids").mapInArrow(run, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks to (control bytes, data bytes)."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    kept = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


#: The four lengths that each control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks of a block, by table lookup and one running sum."""
    lengths = LENGTHS[control].ravel()[:n]
    places = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 3, 4), (1, 1))[places]
    return np.ascontiguousarray(words).view("<u4").ravel() & _MASKS[lengths]


def _block(rows: list[tuple[int | None, np.ndarray]], rank_of: np.ndarray) -> bytes:
    keys = np.array([k or 0 for k, _ in rows], "<i8")
    given = np.array([k is not None for k, _ in rows], np.uint8)
    numbers = np.array([len(x) for _, x in rows], "<u8")
    control, data = pack(rank_of[np.concatenate([x for _, x in rows])])
    head = struct.pack("<4Q", len(rows), int(numbers.sum()), len(control), len(data))
    return b"".join([head, keys.tobytes(), given.tobytes(), numbers.tobytes(), control, data])


def write(encoded: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write (key, width, ids) as files below ``folder``; returns the manifest and the rank table, both stored there.

    ``encoded`` is a written table, so that its rows have the same places whenever they are read. The driver
    holds the rank table: one number for each id of the vocabulary.
    """
    spark = encoded.sparkSession
    make_dir(spark, f"{folder}/files")
    key = encoded.columns[0]
    counts = sorted((-n, i) for i, n in rank_ids(encoded).collect())
    id_of = np.array([i for _, i in counts], np.int64)
    spark.createDataFrame([(r, i, -n) for r, (n, i) in enumerate(counts)], "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, held, n_docs, n_ids = TaskContext.get().partitionId(), [], 0, 0, 0
        with create(f"{folder}/files", f"part-{shard:06d}", ".tok") as (name, stream):
            stream.write(MAGIC)
            for batch in pieces(batches):
                for k, ids in zip(batch.column(0).to_pylist(), map(_values, batch.column(2).to_pylist(), batch.column(1).to_pylist()), strict=True):
                    if rows and held + len(ids) > BLOCK_IDS:
                        stream.write(_block(rows, rank_of))
                        rows, held = [], 0
                    rows.append((k, ids))
                    held, n_docs, n_ids = held + len(ids), n_docs + 1, n_ids + len(ids)
            if rows:
                stream.write(_block(rows, rank_of))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": n_docs, "n_ids": n_ids}])

    # rows of one key are dealt by a digest of their ids, and equal rows by their place in the encoded table
    digest, place = fresh("digest", encoded.columns), fresh("place", encoded.columns)
    placed = encoded.withColumn(digest, F.xxhash64("ids")).withColumn(place, F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(key, digest, place).sortWithinPartitions(key, digest, place).select(*encoded.columns)
    ordered.mapInArrow(run, "shard bigint, name string, n_docs bigint, n_ids bigint").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest"), spark.read.parquet(f"{folder}/ranks")


def read_blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, numbers of ids, ranks) of each block of a file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while len(head := stream.read(32)) == 32:
        n, total, n_control, n_data = struct.unpack("<4Q", head)
        keys = np.frombuffer(stream.read(8 * n), "<i8").tolist()
        given = np.frombuffer(stream.read(n), np.uint8).tolist()
        numbers = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        control, data = np.frombuffer(stream.read(n_control), np.uint8), np.frombuffer(stream.read(n_data), np.uint8)
        yield [k if g else None for k, g in zip(keys, given, strict=True)], numbers, unpack(control, data, total)


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document, from the files: start counts the ids of all documents before it,
    ids are packed as little-endian unsigned 32-bit integers.

    The driver holds a number for each file and one for each id of the vocabulary.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").filter("n_docs > 0")
    starts, at = {}, 0
    for shard, n in manifest.select("shard", "n_ids").orderBy("shard").collect():
        starts[shard], at = at, at + n
    id_of = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = starts[shard]
                with open_file(f"{folder}/files", name) as stream:
                    for keys, numbers, ranks in read_blocks(stream):
                        ends = np.cumsum(numbers)
                        columns = [pa.array(keys, pa.int64()), pa.array(start + ends - numbers), binary(id_of[ranks], numbers)]
                        start += int(ends[-1])
                        yield pa.RecordBatch.from_arrays(columns, [key, "start", "ids"])

    files = manifest.select("shard", "name").repartition(max(1, len(starts)), "shard")
    return files.mapInArrow(run, f"`{key}` bigint, start bigint, ids binary")


def round_trip(documents: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode, write, read back: (doc_id, start, ids)."""
    spark = documents.sparkSession
    folder = work_dir(spark, "tokens")
    encode(documents, path, end_id).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    write(spark.read.parquet(f"{folder}/encoded"), folder)
    return read(spark, folder)
