"""Structured Streaming: the query log, conversation state, incremental fill, and event windows (STR, and extensions)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURNS = 4


def query_log(spark: SparkSession, path: str, schema: str, late: str = "10 minutes") -> DataFrame:
    """STR-01: the log's files as a stream, with a watermark on its time."""
    return spark.readStream.schema(schema).json(path).withColumn("timestamp", F.to_timestamp("timestamp")).withWatermark("timestamp", late)


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STR-01: appended as it comes, each record once."""
    return log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def remember(messages: list[tuple[str, str]], role: str, text: str, turns: int = TURNS) -> list[tuple[str, str]]:
    """STR-02: the last turns, a question and an answer each; "clear" forgets them."""
    if role == "user" and text.strip().lower() == "clear":
        return []
    return [*messages, (role, text)][-2 * turns :]


def _clears(frame: pd.DataFrame) -> np.ndarray:
    return ((frame["role"] == "user") & (frame["text"].str.strip().str.lower() == "clear")).to_numpy(bool)


def conversation_state(messages: DataFrame, turns: int = TURNS, idle: float | None = None, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """STR-02: messages (conv_id, turn, role, text) as a stream to (conv_id, turn, kept): messages remembered after each.

    A batch of a session is read a frame at a time: of its texts no more than are remembered are held, of the others only number and
    whether they clear. With ``idle``, a session without a message for so many seconds of event time (``time``, with a watermark of ``late``) is
    forgotten, and messages behind the watermark are left out; else state never ends. Messages are in the order of their numbers
    within a batch (of equal numbers a clear is last), and of batches as they come. Null texts are empty; messages without a number are left out.
    """
    most, names = 2 * turns, ["conv_id", "turn", "role", "text"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *lists, newest = state.get if state.exists else ([], [], 0)
        before = list(zip(*lists, strict=True))
        numbers, clears, held = [], [], []
        for frame in frames:
            frame = frame.assign(text=frame["text"].fillna(""))
            clear, turn = _clears(frame), frame["turn"].to_numpy(np.int64)
            last = np.lexsort((clear, turn))[-most:]
            # equal numbers of equal kind by role and text, so that the frames' limits don't tell
            held = sorted([*held, *((int(turn[i]), bool(clear[i]), frame["role"].iloc[i] or "", frame["text"].iloc[i]) for i in last)])[-most:]
            numbers.append(turn)
            clears.append(clear)
            newest = max(newest, int(frame["at"].max())) if idle is not None else newest
        turn, clear = np.concatenate(numbers), np.concatenate(clears)
        order = np.lexsort((clear, turn))
        turn, clear, place = turn[order], clear[order], np.arange(len(order))
        cleared = np.maximum.accumulate(np.where(clear, place, -1))
        kept = np.minimum(np.where(cleared >= 0, place - cleared, len(before) + place + 1), most)
        since = max((i + 1 for i, h in enumerate(held) if h[1]), default=0)
        memory = ([] if clear.any() else before) + [h[2:] for h in held[since:]]
        memory = memory[-most:]
        state.update(([r for r, _ in memory], [t for _, t in memory], newest))
        if idle is not None:
            state.setTimeoutTimestamp(max(newest + int(idle * 1000), state.getCurrentWatermarkMs() + 1))
        for at in range(0, len(turn), 10_000):
            yield pd.DataFrame({"conv_id": key[0], "turn": turn[at : at + 10_000], "kept": kept[at : at + 10_000]})

    rows = messages.filter("turn IS NOT NULL")
    if idle is not None:
        rows = rows.withWatermark(time, late).select(*names, time, F.unix_millis(time).alias("at")).filter(F.col("at").isNotNull())
    else:
        rows = rows.select(*names)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, kept long", "roles array<string>, texts array<string>, newest long", "append", timeout)


def fill_incrementally(units: DataFrame, target: str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """STR-03: each micro-batch works on what the target doesn't have yet and appends it."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        done = spark.read.schema(work(df.limit(0)).schema).parquet(target).select(*keys) if _exists(spark, target) else None
        todo = df if done is None else df.join(done, keys, "left_anti")
        work(todo.dropDuplicates(keys)).write.mode("append").parquet(target)

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Extension: counts and sums in fixed windows; the same for a batch and, with ``late``, for a stream."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sliding(events: DataFrame, width: str = "2 days", every: str = "1 day", late: str | None = None, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Extension: overlapping windows."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width, every).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, time: str = "ts", user: str = "user_id") -> DataFrame:
    """Extension: a user's events with gaps below a limit."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
