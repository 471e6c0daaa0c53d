"""Documents packed into sequences of tokens with balanced attention cost (operator 13).

1. Texts are encoded once, in batches, and their ids written to the shared folder; from then on only lengths move.
2. A document gives as many whole sequences as fit into its tokens, and one rest that is shorter than a sequence.
3. Rests are put in the order of a hash, so that each stretch of it is a sample of all, and the running sum of
   their tokens cuts them into pools of exactly ``pool`` sequences; a rest across a boundary is cut there.
4. In a pool, rests go by falling length to the sequence with the lowest cost, linear plus quadratic in the length of each
   piece, of those that have room for it. Where none has, the sequence with the lowest cost and any room takes what fits,
   and what is left of the rest waits its turn. A pool is filled to the last token, so nothing is padded. The last pool's
   remainder goes to sequences of as many tokens as powers of two add up to it: these are not padded either.
5. The pieces of a document meet its ids again in one join, and each piece's digest is made from its own ids.

A pool is one group of a grouped map: ``pool`` sequences of tokens are the most it has rows, whatever the input.

Defined cases: a null text is empty and has the end id alone; a null id stays; rows that are repeated are documents
each, told apart by their place in the encoded table; equal lengths go in the order of the hash, equal costs to the sequence
with the smaller number; a very long text is encoded whole, and its ids (at most four bytes each) are the most that a task
holds; the strings of the tokenizer's added tokens are those tokens, as the library has it; an empty table gives no
rows; further columns are not looked at.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import pieces, utf8
from corpuslab.llm.token_files import CACHE, binary, gather
from corpuslab.session import materialise, work_dir

#: Tokens at which attention costs as much as the linear layers do: six times this model width.
WIDTH = 2048


#: White space of Unicode and Python, as RE2 takes a class.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters and digits of Latin script, and marks, for RE2 and Python alike.
_LATIN, _MARKS = "A-Za-z0-9À-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"


class UnitTokenizer:
    """A byte-level tokenizer whose pre-tokens never reach across a blank or a line's end between two other characters, nor from a letter to a mark.

    Texts are cut there, in Arrow, and the distinct units of a batch looked up in a bounded dictionary of
    their numbers; their ids lie in one flat array, from which numpy gathers those of the batch. New units go to the library as lines of
    many, whose ids are cut where a token begins with a blank or a line; units with other white space go one by one. Texts that hold an added token go whole,
    as do all where the file has a normaliser or another way of cutting words.

    A unit is known by its key: what follows the blank that it begins with; itself, if it begins with a line's end; the sign \x01 and
    itself, if it is marks behind a letter; and itself with a blank behind it, whatever it is.
    """

    _ODD = rf" [{_WHITE}]|[{_WHITE}] |\A | \z|\x01"
    _LINES = rf"([^{_WHITE}])\n([^{_WHITE}])"
    _ENDS = rf"([{_LATIN}])([{_MARKS}]+) "
    _CUT = re.compile(rf"(?<=\S)(?=[ \n]\S)|(?<=[{_LATIN}])(?=[{_MARKS}]+[ \n]\S)").split
    _SPACE = re.compile(r"[\s\x01]").search
    #: Units of a line, and lines that are with the library at a time.
    _LINE, _CALL = 1024, 32

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        added = [re.escape(x) for x in sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values())]
        self._odd, self._whole = "|".join([self._ODD, *added]), re.compile("|".join(["\x01", *added])).search
        words = self._tokenizer.pre_tokenizer
        self._cuts = self._tokenizer.normalizer is None and isinstance(words, pre_tokenizers.ByteLevel) and not words.add_prefix_space
        size = self._tokenizer.get_vocab_size()
        tokens = [self._tokenizer.id_to_token(i) or "" for i in range(size)]
        self._begins = {c: np.array([t.startswith(x) for t in tokens]) for c, x in ((" ", "Ġ"), ("\n", "Ċ"))}  # how byte-level files write them
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self._numbers: dict[str, int] = defaultdict(count().__next__)
        self._starts, self._lengths, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), self._CALL):
            for x in self._tokenizer.encode_batch_fast(texts[at : at + self._CALL], add_special_tokens=False):
                yield np.array(x.ids, self.dtype)

    def _learn(self, keys: list[str]) -> None:
        """Append the ids of new units, whose numbers follow those known."""
        lengths, starts, flat, held = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [self._flat], len(self._flat)
        blank, line, first, single = [], [], [], []
        space = self._SPACE
        for i, k in enumerate(keys):
            if not space(k):
                blank.append(i)
            elif k[0] == "\n" and len(k) > 1 and not space(k, 1):
                line.append(i)
            elif k[-1] == " " and len(k) > 1 and not space(k, 0, len(k) - 1):
                first.append(i)
            else:
                single.append(i)
        for own, begin, texts, skip in (
            (blank, " ", [" " + keys[i] for i in blank], 0),
            (line, "\n", [keys[i] for i in line], 0),
            (first, "\n", ["\n" + keys[i][:-1] for i in first], 1),  # the line's end is one token, which is left out
        ):
            lines = [slice(at, at + self._LINE) for at in range(0, len(own), self._LINE)]
            for part, ids in zip(lines, self._ids(["".join(texts[x]) for x in lines]), strict=True):
                begins, places = np.flatnonzero(self._begins[begin][ids]), own[part]
                if len(begins) == len(places) and begins[0] == 0:
                    lengths[places], starts[places] = np.diff(begins, append=len(ids)) - skip, held + begins + skip
                    flat.append(ids)
                    held += len(ids)
                else:
                    single += places
        for i, ids in zip(single, self._ids([self._text(keys[i]) for i in single]), strict=True):
            lengths[i], starts[i] = len(ids), held
            flat.append(ids)
            held += len(ids)
        self._flat = np.concatenate(flat)
        self._starts, self._lengths = np.concatenate([self._starts, starts]), np.concatenate([self._lengths, lengths])

    def _key(self, unit: str) -> str:
        if unit.endswith(" ") or not unit.startswith((" ", "\n")) or unit.startswith(" \n"):
            return unit + " "
        return unit.removeprefix(" ")

    def _text(self, key: str) -> str:
        if key.endswith(" "):
            return key[:-1]
        return key.removeprefix("\x01") if key.startswith(("\n", "\x01")) else " " + key

    def _number(self, keys: list[str]) -> np.ndarray:
        known = len(self._numbers)
        numbers = np.fromiter(map(self._numbers.__getitem__, keys), np.int64, len(keys))
        if new := len(self._numbers) - known:
            self._learn(list(islice(reversed(self._numbers), new))[::-1])
        return numbers

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all units, number of units of each text)."""
        if not self._cuts:
            return self._number([t + " " for t in texts]), np.ones(len(texts), np.int64)
        column = pa.array(texts, pa.large_string())
        odd = np.asarray(pa.compute.match_substring_regex(column, self._odd))
        usual, own, counts = np.flatnonzero(~odd), np.flatnonzero(odd), np.zeros(len(texts), np.int64)
        ended = pa.compute.replace_substring_regex(column.take(pa.array(usual)), self._LINES, "\\1 \n\\2")
        lists = pa.compute.split_pattern(pa.compute.replace_substring_regex(ended, self._ENDS, "\\1 \x01\\2 "), " ")
        flat, counts[usual] = lists.flatten(), np.asarray(lists.value_lengths(), np.int64)
        firsts = np.cumsum(counts[usual]) - counts[usual]
        units = pa.compute.dictionary_encode(flat)
        begun = flat.take(pa.array(firsts)).to_pylist()
        known = self._number(units.dictionary.to_numpy(zero_copy_only=False).tolist() + [u + " " for u in begun])
        numbers = known[np.asarray(units.indices)]
        numbers[firsts] = known[len(units.dictionary) :]
        if not len(own):
            return numbers, counts
        cut = [[texts[i] + " "] if self._whole(texts[i]) else list(map(self._key, self._CUT(texts[i]))) for i in own]
        counts[own] = list(map(len, cut))
        rest = self._number([u for x in cut for u in x])
        starts = np.zeros(len(texts), np.int64)
        starts[usual], starts[own] = firsts, len(numbers) + np.cumsum(counts[own]) - counts[own]
        return gather(starts, counts, np.concatenate([numbers, rest])), counts

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text): each text's ids and the end id behind them."""
        if len(self._numbers) > CACHE:
            self._clear()
        numbers, counts = self._cut(texts)
        lengths = self._lengths[numbers]
        stops = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        ids = np.insert(gather(self._starts[numbers], lengths, self._flat), stops, self.dtype.type(end_id))
        return ids, np.diff(stops, prepend=0) + 1


_LOADED: dict[str, UnitTokenizer] = {}


def load(path: str) -> UnitTokenizer:
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]


def encode(documents: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, digest, width, ids): ids with the end id behind, as unsigned integers of ``width`` bytes; their number and crc32."""
    kind = documents.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in pieces(batches, rows=1024, weight=2 << 20):
            ids, counts = tokenizer.encode([(x or b"").decode("utf-8", "replace") for x in utf8(batch.column(1))], end_id)
            packed = binary(ids, counts)
            digest = pa.array([zlib.crc32(x.as_buffer()) for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), digest, pa.array(np.full(len(counts), ids.itemsize, np.int32)), packed], [key, "n", "digest", "width", "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n bigint, digest bigint, width int, ids binary")


def running(rows: DataFrame, size: str, *order: str) -> DataFrame:
    """Rows with ``before``: the sum of ``size`` over all rows that come before in this order, which has to be total.

    Range partitions are summed apart; what lies ahead of each follows from one row a partition.
    """
    parts = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    so_far = lambda window: F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ahead = parts.groupBy("part").agg(F.sum(size).alias(size)).select("part", so_far(Window.orderBy("part")).alias("ahead"))
    within = parts.withColumn("before", so_far(Window.partitionBy("part").orderBy(*order)))
    return within.join(ahead, "part").withColumn("before", F.col("before") + F.col("ahead")).drop("part", "ahead")


def balance(lengths: np.ndarray, capacity: int, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(rest, start in it, length, sequence, offset in it) of pieces that fill sequences to the last token.

    Cost of a piece of n tokens: 6 * width * n for the linear layers, n * n for attention, as integers.
    """
    whole, left = divmod(int(lengths.sum()), capacity)
    room = np.array([capacity] * whole + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1], np.int64)
    most, cost, used, found = np.iinfo(np.int64).max, np.zeros(len(room), np.int64), np.zeros(len(room), np.int64), []
    waiting = [(-int(n), i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        to = int(np.where(fits, cost, most).argmin()) if fits.any() else int(np.where(room > 0, cost, most).argmin())
        take = min(n, int(room[to]))
        found.append((i, start, take, to, int(used[to])))
        room[to], used[to], cost[to] = room[to] - take, used[to] + take, cost[to] + 6 * width * take + take * take
        if take < n:
            heapq.heappush(waiting, (take - n, i, start + take))
    return tuple(np.array(found, np.int64).reshape(-1, 5).T)


def pack(documents: DataFrame, path: str, end_id: int, capacity: int = 2048, pool: int = 256, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): pieces with their ids as little-endian unsigned 32-bit integers."""
    spark = documents.sparkSession
    folder = work_dir(spark, "encoded")
    encode(documents, path, end_id, key, text).withColumn("place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    encoded = spark.read.parquet(folder)
    sizes = encoded.select("place", "n", F.xxhash64(F.col(key), "digest").alias("mix"))
    whole, rest = F.floor(F.col("n") / capacity), F.col("n") % capacity
    # whole sequences of long documents, numbered first
    long = running(sizes.select("place", whole.alias("whole")).filter("whole > 0"), "whole", "place")
    each = long.select("place", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
    full = each.select("place", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_full = sizes.agg(F.coalesce(F.sum(whole), F.lit(0))).first()[0]
    # rests, cut where a pool ends
    rests = running(sizes.select("place", "mix", (F.col("n") - rest).alias("first"), rest.alias("rest")).filter("rest > 0"), "rest", "mix", "place")
    tokens = F.lit(pool * capacity).cast("long")
    pools = F.sequence(F.floor(F.col("before") / tokens), F.floor((F.col("before") + F.col("rest") - 1) / tokens))
    cut = rests.select("place", "mix", "first", "before", "rest", F.explode(pools).alias("pool"))
    begin = F.greatest("before", F.col("pool") * tokens)
    end = F.least(F.col("before") + F.col("rest"), (F.col("pool") + 1) * tokens)
    cut = cut.select("pool", "place", "mix", (F.col("first") + begin - F.col("before")).alias("start"), (end - begin).alias("length"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "place"], kind="stable")
        i, start, length, to, offset = balance(rows["length"].to_numpy(), capacity, width)
        return pd.DataFrame({"place": rows["place"].to_numpy()[i], "start": rows["start"].to_numpy()[i] + start, "length": length, "sequence_id": n_full + rows["pool"].to_numpy()[i] * pool + to, "offset": offset})

    mixed = cut.groupBy("pool").applyInPandas(fill, "place bigint, start bigint, length bigint, sequence_id bigint, offset bigint")
    placed = full.unionByName(mixed).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    kind = documents.select(key).schema[0].dataType.simpleString()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            parts = batch.column(4)
            flat = parts.flatten()
            start, length = (np.asarray(flat.field(f), np.int64) for f in ("start", "length"))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(parts.value_lengths(), np.int64))
            ids = [np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4") for x, w in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            own = pa.array([ids[r][s : s + n].tobytes() for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary())
            to = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(to), flat.field("start"), flat.field("length"), own, batch.column(1).take(to), flat.field("sequence_id"), flat.field("offset")], [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    joined = encoded.join(placed, "place").select(key, "n", "width", "ids", "pieces")
    return joined.mapInArrow(slices, f"`{key}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
