"""Packed sequences: every id once, as the library gives it; no padding; costs close to one another."""

import functools
import struct
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.llm import packing
from corpuslab.llm.queries import queries, vocabulary
from tests.llm.tables import ODD_TEXTS, SF, documents, write

PATH = vocabulary("byte_bpe_50k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library(texts):
    t = tokenizer()
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def holds(rows, docs, capacity=2048):
    """docs: lists of ids by doc_id (unique). All pieces are there, and sequences are full or of a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(docs[k])
            part = docs[k][at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(docs[k])
    odd = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0
        odd += at < capacity
    assert odd <= capacity.bit_length() - 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = queries()["op13_packing"](spark, sf).collect()
    sequences = holds(rows, dict(zip([d["doc_id"] for d in docs], library([d["text"] for d in docs]), strict=True)))
    # documents stay whole where they can, and costs are closer to one another than where the first sequence with room takes a rest
    own = [[r["length"] for r in x] for x in sequences.values() if len(x) > 1 and sum(r["length"] for r in x) == 2048]
    rests = [n % 2048 for n in (r["doc_tokens"] for r in rows if r["start"] == 0) if n % 2048]
    assert sum(map(len, own)) < 1.25 * len(rests)
    assert spread(own) < spread([x for x in first_fit(rests, 2048) if sum(x) == 2048])


def spread(sequences):
    """Deviation of costs over their mean."""
    costs = [sum(6 * packing.WIDTH * n + n * n for n in x) for x in sequences]
    return np.std(costs) / np.mean(costs)


def first_fit(rests, capacity):
    room, found = [capacity] * -(-sum(rests) // capacity), defaultdict(list)
    waiting = sorted(rests, reverse=True)
    while waiting:
        n = waiting.pop(0)
        to = next((i for i, r in enumerate(room) if r >= n), None)
        to = next(i for i, r in enumerate(room) if r) if to is None else to
        take = min(n, room[to])
        room[to] -= take
        found[to].append(take)
        if take < n:
            waiting = sorted([n - take, *waiting], reverse=True)
    return list(found.values())


def test_odd_texts(spark, tmp_path):
    texts = [*ODD_TEXTS, "a  b\n c \n\n d", "x <|endoftext|> y", "it's  we'll I'd", " \n x", "é   b c d", "\x1c a \x1f b", *["" for _ in range(40)]]
    write(documents(spark, texts).withColumns({c: F.lit("clash") for c in ("place", "ids", "start", "length", "pool", "part", "n", "mix")}), tmp_path)
    rows = queries()["op13_packing"](spark, str(tmp_path)).collect()
    holds(rows, {100_000 + i: ids for i, ids in enumerate(library(texts))})


def test_repeated_and_null_ids(spark):
    base = documents(spark, ["one two three " * 900, "four five"]).withColumn("doc_id", F.lit(None).cast("long"))
    base = base.unionByName(base).unionByName(documents(spark, ["six"] * 3).withColumn("doc_id", F.lit(6)))
    rows = packing.pack(base, PATH, end_id=1, capacity=64, pool=4).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, library([r["text"] for r in base.collect()])))
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 3 * 2
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and len(r["ids"]) == 4 * r["length"]
        at[r["sequence_id"]] += r["length"]
    assert all(n & (n - 1) == 0 and n <= 64 for n in at.values())


def test_many_pools_and_reruns(spark):
    """Small pools: rests across their boundaries are cut there; another run gives the same pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pack = lambda df: packing.pack(df, PATH, end_id=1, capacity=128, pool=3).withColumn("ids_crc32", F.crc32("ids"))
    rows = pack(docs).collect()
    own = docs.select("doc_id", "text").collect()
    sequences = holds(rows, dict(zip([d["doc_id"] for d in own], library([d["text"] for d in own]), strict=True)), 128)
    assert max(sequences) > 100
    assert sorted(map(repr, rows)) == sorted(map(repr, pack(docs).collect()))


@given(st.lists(st.integers(1, 63), max_size=40))
@settings(max_examples=200, deadline=None)
def test_balance(lengths):
    rest, start, length, to, offset = packing.balance(np.array(lengths, np.int64), 64)
    assert length.sum() == sum(lengths)
    used = np.bincount(to, length).astype(int) if len(to) else []
    assert all(n & (n - 1) == 0 and n <= 64 for n in used)
    for i, n in enumerate(lengths):
        own = np.flatnonzero(rest == i)
        assert start[own].tolist() == np.concatenate([[0], np.cumsum(length[own])])[:-1].tolist()
        assert length[own].sum() == n


@given(st.text(alphabet="ab1é.' \n\t \x1c", max_size=60))
@settings(max_examples=300, deadline=None)
def test_units_against_the_library(text):
    ids, counts = packing.load(PATH).encode([text], 1)
    assert ids.tolist() == library([text])[0] and counts.tolist() == [len(ids)]


@given(st.lists(st.text(alphabet="aWéɏ1ж,.'!]-\" \n\r\x01Ċ", max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_marks_and_lines_against_the_library(texts):
    ids, counts = packing.load(PATH).encode(texts, 1)
    own = library(texts)
    assert ids.tolist() == [i for x in own for i in x] and counts.tolist() == list(map(len, own))


class Counted:
    """A tokenizer that counts the texts and characters it is given."""

    def __init__(self, own):
        self.own, self.texts, self.characters = own, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.texts, self.characters = self.texts + len(texts), self.characters + sum(map(len, texts))
        return self.own.encode_batch_fast(texts, **options)


def test_words_reach_the_library_once():
    """Marks behind a word make no other unit of it, and a line's end between two words no unit of both."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(2000)]
    texts = ["See " + " ".join(f"{w}{mark}" for w in words) for mark in ("", ",", ".", ";", "!?", '".')]
    texts += ["See " + ".\n".join(f"{w} {v}" for w, v in zip(words, words[k:] + words[:k], strict=True)) for k in (1, 2, 3)]
    own = packing.UnitTokenizer(PATH)
    own._tokenizer = counted = Counted(own._tokenizer)
    ids, _ = own.encode(texts, 1)
    assert ids.tolist() == [i for x in library(texts) for i in x]
    assert counted.texts < 50 and counted.characters < 2.5 * sum(len(w) + 1 for w in words)


def test_empty_table(spark, tmp_path):
    write(spark.read.parquet(f"{SF}/documents.parquet").limit(0), tmp_path)
    assert queries()["op13_packing"](spark, str(tmp_path)).collect() == []
