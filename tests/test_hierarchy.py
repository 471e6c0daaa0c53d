"""The hierarchy of chunks against one pass from left to right over a list, chapter by chapter."""

import random
from dataclasses import dataclass, field

import numpy as np
import pytest

from corpuslab.operators import chunking
from corpuslab.plans import catalog

SF = "/root/testdata/sf0.001"


@dataclass
class Node:
    text: str
    vector: np.ndarray
    depth: int = 0
    start: int = 0
    end: int = 0
    children: list = field(default_factory=list)


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def merge_runs(nodes, least, embedder, max_chars=chunking.MAX_CHARS):
    similar = [bool(a.text and b.text) and cosine(a.vector, b.vector) >= least for a, b in zip(nodes, nodes[1:], strict=False)]
    out, i = [], 0
    while i < len(nodes):
        last = i
        if i < len(similar) and similar[i]:
            last = i + 1
            while last < len(similar) and similar[last] and sum(len(n.text) for n in nodes[i : last + 2]) <= max_chars:
                last += 1
        node = nodes[i]
        for other in nodes[i + 1 : last + 1]:
            text = f"{node.text}\n\n{other.text}"
            vector = np.asarray(embedder.embed_texts([text])[0], np.float32)
            node = Node(text, vector, max(node.depth, other.depth) + 1, min(node.start, other.start), max(node.end, other.end), [node, other])
        out.append(node)
        i = last + 1
    return out


def hierarchy(nodes, embedder, levels=chunking.LEVELS, min_chunks=chunking.MIN_CHUNKS, first=chunking.FIRST_THRESHOLD, max_chars=chunking.MAX_CHARS):
    out = [nodes]
    for level in range(1, levels + 1):
        if len(out[-1]) <= min_chunks:
            break
        out.append(merge_runs(out[-1], chunking.threshold(level, first), embedder, max_chars))
    return out


class Same:
    def embed_texts(self, texts):
        return np.ones((len(texts), 2))


class Lengths:
    """A direction by the text's length, so neighbours are similar or not without much chance of a tie."""

    def embed_texts(self, texts):
        angle = np.array([(len(t) * 37 % 101) / 101 * 1.9 for t in texts])
        return np.stack([np.cos(angle), np.sin(angle)], axis=1)


def plain(rows, embedder, **options):
    found, chapters = [], {}
    for key, index, text, start, end in rows:
        chapters.setdefault(key, []).append((index, start, end, text or ""))
    for key, own in chapters.items():
        nodes = [Node(t, np.asarray(embedder.embed_texts([t])[0], np.float32), 0, s, e) for _, s, e, t in sorted(own)]
        for level, held in enumerate(hierarchy(nodes, embedder, **options)):
            found += [(key, level, i, n.depth, n.text, n.start, n.end, len(n.text.split())) for i, n in enumerate(held)]
    return sorted(found, key=repr)


SCHEMA = "chapter string, chunk_index int, text string, start_offset int, end_offset int"


def built(spark, rows, embedder, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in chunking.build_hierarchy(df, "chapter", embedder, **options).collect()), key=repr)


def nodes(*sizes):
    return [Node("x" * n, np.ones(2), start=i, end=i + 1) for i, n in enumerate(sizes)]


def test_plain_version():
    merged = merge_runs(nodes(8, 8, 8), 0.7, Same(), max_chars=10)
    assert [len(n.text) for n in merged] == [18, 8]  # the first pair is taken whatever its length
    assert (merged[0].start, merged[0].end, merged[0].depth) == (0, 2, 1)
    assert chunking.threshold(1) == 0.7
    assert chunking.threshold(7) == pytest.approx(0.2)
    apart = [Node("x", np.eye(5)[i]) for i in range(5)]
    assert [len(lv) for lv in hierarchy(apart, Same(), levels=2)] == [5, 5, 5]  # levels go on without a merge
    levels = hierarchy(nodes(5, 5, 5, 5), Same(), levels=2, max_chars=15)
    assert [[len(n.text) for n in lv] for lv in levels] == [[5, 5, 5, 5], [19, 5]]  # what isn't merged stays in the snapshot


@pytest.mark.parametrize("seed", range(200))
def test_next_starts(seed):
    rng = random.Random(seed)
    n, cap = rng.randint(1, 40), rng.choice((1, 2, 7, 30))
    lengths, similar = [rng.randint(1, 9) for _ in range(n)], [rng.random() < 0.8 for _ in range(n - 1)] + [False]
    for i, got in enumerate(chunking.next_starts(np.array(lengths), np.array(similar), cap).tolist()):
        last = i
        if similar[i]:
            last = i + 1
            while similar[last] and sum(lengths[i : last + 2]) <= cap:
                last += 1
        assert got == last + 1


@pytest.mark.parametrize(("embedder", "cap"), [(Same(), 40), (Lengths(), 7), (Lengths(), 40)])
def test_against_lists(spark, embedder, cap):
    """Chapters of many segments (a segment has as many chunks as the cap has characters), with and without neighbours that differ."""
    rng = random.Random(cap)
    rows = []
    for chapter, n in (("a", 1), ("b", 4), ("c", 150), ("d", 90), (None, 20), ("", 30)):
        step = rng.choice((1, 3))  # gaps in the numbering
        rows += [(chapter, i * step + 5, "w" * rng.randint(1, 6) if chapter != "d" else "v", i, i + 2) for i in range(n)]
    rows += [("e", i, rng.choice(("", None, "wort", "two words")), i, i) for i in range(12)]
    rows += [("f", 3, "same", 1, 2)] * 5
    want = plain(rows, embedder, levels=3, max_chars=cap)
    assert built(spark, rows, embedder, levels=3, max_chars=cap) == want
    assert max(r[1] for r in want) == 3


def test_long_chain(spark):
    """No two neighbours differ in the whole chapter, so where a run begins depends on all before it."""
    rng = random.Random(4)
    rows = [("a", i, "x" * rng.randint(1, 4), i, i + 1) for i in range(700)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")  # segments lie in several batches
    try:
        assert built(spark, rows, Same(), levels=1, max_chars=9) == plain(rows, Same(), levels=1, max_chars=9)
    finally:
        spark.conf.set(name, before)


def test_defined_cases(spark):
    assert built(spark, [], Same()) == []
    assert [r[:4] for r in built(spark, [("a", 0, None, 0, 0)], Same())] == [("a", 0, 0, 0)]


def test_query_against_lists(spark):
    rows = [(r["conv_id"], r["turn"], r["text"], 0, len(r["text"])) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect() if r["text"] is not None]
    got = sorted((tuple(r) for r in catalog.queries()["chunk_hierarchy"](spark, SF).collect()), key=repr)
    assert got == plain(rows, chunking.HashingEmbedder())


def test_groups_know_their_size(spark):
    """Which chapters go on is read from each row, so no level is joined to its own counts."""
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2)], "own string, x int").repartition(3)
    assert sorted((r["own"], r["x"], r["at"], r["n"]) for r in chunking.numbered(df, "own", ["x"]).collect()) == [("a", 1, 0, 3), ("a", 2, 1, 3), ("a", 3, 2, 3), ("b", 1, 0, 1)]
