"""Conversation state as a stream: long sessions over frames and batches, late and idle sessions."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np

from corpuslab.streaming import streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(spark, tmp_path, batches, name, **options):
    """The rows after each file of messages, in files' order, as one stream that is taken up again."""
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True)
    out = []
    for i, batch in enumerate(batches):
        lines = [json.dumps({"conv_id": c, "turn": t, "role": r, "text": x, "ts": (START + timedelta(seconds=s)).isoformat()}) for c, t, r, x, s in batch]
        (folder / f"in/{i:03d}.json").write_text("\n".join(lines))
        rows = spark.readStream.schema("conv_id long, turn long, role string, text string, ts timestamp").json(str(folder / "in"))
        q = streams.conversation_state(rows, **options).writeStream.format("parquet").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start(str(folder / "out"))
        q.awaitTermination()
        found = [(r["conv_id"], r["turn"], r["kept"]) for r in spark.read.parquet(str(folder / "out")).collect()]
        out.append(sorted(set(found) - set().union(*out)) if out else sorted(found))
    return out


def test_long_sessions_and_batches(spark, tmp_path):
    """Against ``remember``, one message after another."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(1)
        batches, turn = [], 0
        for n in (60, 1, 45):
            rows = [(c, turn + i, "user" if rng.random() < 0.5 else "assistant", str(rng.choice(["clear", " CLEAR ", "a", "b", ""], p=[0.05, 0.05, 0.3, 0.3, 0.3])), turn + i) for c in (1, 2) for i in range(n)]
            batches.append([rows[i] for i in rng.permutation(len(rows))])
            turn += n
        got = run(spark, tmp_path, batches, "long")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for conv in (1, 2):
        kept, want = [], []
        for c, t, role, text, _ in sorted(r for b in batches for r in b):
            if c == conv:
                kept = streams.remember(kept, role, text, streams.TURNS)
                want.append((c, t, len(kept)))
        assert [r for b in got for r in b if r[0] == conv] == want


def test_nulls_and_ties(spark, tmp_path):
    rows = [(1, 0, "user", None, 0), (1, 1, None, "x", 0), (1, None, "user", "y", 0), (1, 2, "user", "clear", 0), (1, 2, "user", "z", 0), (1, 3, "user", "w", 0)]
    got = run(spark, tmp_path, [rows, [(1, 4, "user", "v", 1)]], "nulls")
    assert got == [[(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (1, 3, 1)], [(1, 4, 2)]]


def test_idle_and_late_sessions(spark, tmp_path):
    """An hour without a message ends a session; what comes behind the watermark is left out."""
    say = lambda conv, turn, at: (conv, turn, "user", "x", at)
    batches = [
        [say(1, 0, 0), say(1, 1, 10), say(2, 0, 0)],
        [say(2, 1, 1800)],  # 1 is idle, but not yet for an hour
        [say(2, 2, 5000)],  # moves the watermark past 1's hour
        [say(3, 0, 5100), say(1, 2, 5100), say(1, 9, 20)],  # 1 begins anew; its late message is left out
        [say(2, 3, 5200), say(1, 3, 5200)],
    ]
    got = run(spark, tmp_path, batches, "idle", idle=3600, late="1 minute")
    assert got == [[(1, 0, 1), (1, 1, 2), (2, 0, 1)], [(2, 1, 2)], [(2, 2, 3)], [(1, 2, 1), (3, 0, 1)], [(1, 3, 2), (2, 3, 4)]]
    never = run(spark, tmp_path, batches[:3] + [[say(1, 2, 5100)]], "never")
    assert never[3] == [(1, 2, 3)]
