"""Operator 1 against all pairs in plain Python, and its parts."""

import collections
import math
import random
import tracemalloc
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import near_dedup
from corpuslab.llm import shingles as shingles_module
from corpuslab.llm.components import connected_components
from corpuslab.llm.queries import queries
from corpuslab.llm.shingles import shingle
from tests.llm.tables import ODD_TEXTS, documents, write


def shingles(text):
    w = (text or "").encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    """doc_id to class: components of weighted Jaccard similarity of 0.8 and more."""
    found = {k: s for k, t in rows if (s := shingles(t)) is not None}
    df, n = collections.Counter(g for s in found.values() for g in s), len(rows)

    def weight(g):
        return (1 + math.log(n / df[g]) / math.log(256)) / 2 if df[g] > max(1, n / 256) else 1.0

    parent = {k: k for k, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = []
    keys = sorted(found)
    for x, i in enumerate(keys):
        for j in keys[x + 1 :]:
            a, b = found[i], found[j]
            if not a.keys() & b.keys():
                continue
            s = sum(weight(g) * v for g, v in (a & b).items()) / sum(weight(g) * v for g, v in (a | b).items())
            if abs(s - 0.8) < 0.004:
                close.append((i, j))
            if s >= 0.8:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {k: root(k) for k in parent}, close


def make_texts(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = text(40), []
    for _ in range(25):
        base = text(rng.randint(60, 200))
        out.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    out += [text(30) + passage + text(30) for _ in range(20)]
    joined = [" ".join(x) for x in out]
    return [*joined, joined[0].replace(" ", "\n", 3), "two words", "two words", "two  words", "other words", *ODD_TEXTS]


def test_against_all_pairs(spark, tmp_path):
    df = documents(spark, make_texts())
    write(df, tmp_path)
    want, close = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: r["class_id"] for r in queries()["op1_near_dedup"](spark, str(tmp_path)).collect()}
    assert not close  # pairs within rounding of the sketch may fall either way; this seed has none
    assert got == want
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def varied(n, words=400, seed=2):
    """Copies of one text with a word of their own each: all pairs are similar."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        at = rng.randrange(words)
        out.append(" ".join([*base[:at], f"new{k}", *base[at + 1 :]]))
    return out


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    out = near_dedup.classes(documents(spark, list(dict.fromkeys(varied(45))))).collect()
    assert {r["class_id"] for r in out} == {100_000}


@pytest.mark.parametrize("leaders", [1, 3])
def test_what_leaders_leave_is_compared(spark, monkeypatch, leaders):
    """A chain, in which only neighbours are similar, in one group of many blocks: leaders reach few of its nodes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    monkeypatch.setattr(near_dedup, "LEAST_ESTIMATE", 0.1)
    rng = random.Random(4)
    now, texts = [f"w{i}" for i in range(150)], []
    for k in range(60):
        now = [*now[6:], *(f"n{k}x{j}" for j in range(6))]
        texts.append(" ".join(now))
    others = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(150)) for _ in range(5)]
    df = documents(spark, texts + others)
    want, close = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert not close
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()} == want


def test_leaders_spare_most_pairs(spark, monkeypatch):
    """Signature comparisons of a group grow with its size, not with its square."""
    counted = spark.sparkContext.accumulator(0)
    plain = near_dedup.likely_pairs

    def counting(left, right, same):
        counted.add(len(left) * len(right))
        return plain(left, right, same)

    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, near_dedup.K, dtype=np.uint8)
    n = 6000
    prints = np.repeat(base[None], n, axis=0)
    prints[np.arange(n), rng.integers(0, near_dedup.K, n)] ^= 1
    rows = spark.createDataFrame([(1, i, p.tobytes()) for i, p in enumerate(prints)], "bucket long, node long, prints binary")
    groups = near_dedup.sized(rows.select("bucket", "node", F.lit(0).alias("bytes")), "bucket")
    monkeypatch.setattr(near_dedup, "link", _with(near_dedup.link, likely_pairs=counting))
    out = near_dedup.joined(groups, [rows.select("node", "prints")], near_dedup.any_pair, "test").collect()
    assert {r["component"] for r in out} == {0}
    assert len(out) == n
    assert counted.value < 0.1 * n * n / 2


def _with(fn, **globals_):
    """The function with some of its module's names bound to others (workers import the module anew)."""
    return types.FunctionType(fn.__code__, {**fn.__globals__, **globals_}, fn.__name__, fn.__defaults__, fn.__closure__)


def test_repeated_and_missing_ids(spark):
    df = documents(spark, ["a b c d e f g"] * 3).unionByName(documents(spark, ["a b c d e f g"]))
    df = df.unionByName(spark.createDataFrame([(None, t, None, None, None) for t in ("a b c d e f g", "x y z u v w", "x y z  u v w", "", "")], df.schema))
    out = near_dedup.classes(df).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in out) == [*[(0, 0)] * 4, (0, 100_000), (100_000, 100_000), (100_000, 100_000), (100_001, 100_000), (100_002, 100_000)]
    kept = near_dedup.dedup(df).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").split()[:1]) for r in kept) == [(0, []), (0, ["x"]), (100_000, ["a"])]


@pytest.mark.parametrize("turn", [1, -1])
def test_texts_that_share_an_id_are_compared_each(spark, turn):
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(150)]
    a, b = text(), text()
    near = lambda t: " ".join([*t[:70], "new", *t[71:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(text()))][::turn]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.dedup(df).collect()) == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, rows[::turn][4][1])])


def test_long_texts(spark):
    """Texts of megabytes, in chunks; one word that is longer than a chunk."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**5)}" for _ in range(400_000)]
    texts = [" ".join(words), "\n".join([*words[:1000], "new", *words[1001:]]), "x" * 2_000_000 + " y", "x" * 2_000_000 + "  y", "x" * 1_999_999 + " y"]
    out = {r["doc_id"] - 100_000: r["class_id"] - 100_000 for r in near_dedup.classes(documents(spark, texts)).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_shingles_in_chunks_are_the_same(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab  \n c") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    whole = shingle(texts)
    for chunk in (3, 7, 64):
        monkeypatch.setattr(shingles_module, "CHUNK", chunk)
        cut = shingle(texts)
        assert all(np.array_equal(getattr(whole, f), getattr(cut, f)) for f in ("n_words", "digest", "hashes", "counts", "sizes"))
        one = [shingle([t]) for t in texts]
        assert np.array_equal(whole.hashes, np.concatenate([x.hashes for x in one]))
        assert np.array_equal(whole.digest, np.concatenate([x.digest for x in one]))


def test_shingling_needs_little_memory():
    rng = random.Random(2)
    words = [b"%x" % rng.getrandbits(24) for _ in range(50_000)]
    text = b" ".join(rng.choice(words) for _ in range(7_400_000))
    assert len(text) > 50_000_000
    tracemalloc.start()
    shingle([text])
    assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    tracemalloc.stop()


@pytest.mark.parametrize("n", [2000, 20_000])
def test_sketch_estimates_common_shingles(n):
    """Frequencies above the rare share are within a tenth at either size; the rest keeps full weight."""
    rng = np.random.default_rng(1)
    sketch, total = np.zeros((near_dedup.DEPTH, 1 << near_dedup.COLUMN_BITS)), 0
    common = rng.integers(0, 1 << 32, 40, dtype=np.uint64).astype(np.uint32)
    df = np.zeros(40, int)
    for _ in range(n):
        has = rng.random(40) < np.linspace(0.01, 0.3, 40)
        own = np.concatenate([common[has], rng.integers(0, 1 << 32, 200, dtype=np.uint64).astype(np.uint32)])
        df += has
        total += len(own)
        for i, at in enumerate(near_dedup.columns(own)):
            np.add.at(sketch[i], at, 1)
    sketch -= (total - sketch) / ((1 << near_dedup.COLUMN_BITS) - 1)
    weights = near_dedup.Weights(np.where(sketch > near_dedup.RARE * n, sketch, 0), n)
    where = near_dedup.columns(common)
    found = np.minimum(*(weights.counters[i][where[i]] for i in range(2)))
    assert np.abs(found / df - 1).max() < 0.1
    rare = weights.of(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64).astype(np.uint32), np.ones(20_000, int))
    assert (rare == 1).mean() > 0.999


def test_empty(spark, tmp_path):
    write(documents(spark, []), tmp_path)
    assert queries()["op1_near_dedup"](spark, str(tmp_path)).count() == 0
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(documents(spark, [None, "", " "])).collect()} == {(100_000 + i, 100_000 + i) for i in range(3)}


def test_shingles_are_those_of_the_words():
    a, b = shingle([b"a b c d e f", b"  a\tb c\nd e f ", b"x", b"", b"a b c d e f a b c d e f"]), shingle([b"a b c d e f"])
    assert a.n_words.tolist() == [6, 6, 1, 0, 12]
    assert a.sizes.tolist() == [2, 2, 1, 0, 6]
    assert np.array_equal(a.digest[0], a.digest[1])
    assert not np.array_equal(a.digest[0], a.digest[4])
    assert np.array_equal(np.sort(a.hashes[:2]), np.sort(b.hashes))
    assert a.counts[-6:].sum() == 8


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = list(base)
    for i in rng.sample(range(400), 12):
        other[i] = "new" + str(i)
    found = shingle([" ".join(base).encode(), " ".join(other).encode()])
    weights = near_dedup.Weights(np.zeros((near_dedup.DEPTH, 1 << near_dedup.COLUMN_BITS)), 2)
    codes = near_dedup.signatures(found.hashes, found.counts, found.sizes, weights)
    a, b = (set(found.hashes[:396].tolist()), set(found.hashes[396:].tolist()))
    assert abs((codes[0] == codes[1]).mean() - len(a & b) / len(a | b)) < 0.12


def test_samples_of_weighted_texts():
    """Repeated words weigh more: the full formula must agree with weighted Jaccard similarity, too."""
    base = " ".join(["x y z u v"] * 40 + [f"w{i}" for i in range(150)])
    other = " ".join(["x y z u v"] * 30 + [f"w{i}" for i in range(150)])
    found = shingle([base.encode(), other.encode()])
    weights = near_dedup.Weights(np.zeros((near_dedup.DEPTH, 1 << near_dedup.COLUMN_BITS)), 2)
    codes = near_dedup.signatures(found.hashes, found.counts, found.sizes, weights)
    n = found.sizes[0]
    vectors = [(found.hashes[:n], weights.of(found.hashes[:n], found.counts[:n])), (found.hashes[n:], weights.of(found.hashes[n:], found.counts[n:]))]
    assert abs((codes[0] == codes[1]).mean() - near_dedup.weighted_jaccard(*vectors)) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, {"x": 1}), (1, "a b c d e f", 6, {"x": 2}), (2, "a b c d e f", 5, None)], "doc_id long, text string, place int, node map<string,int>")
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    assert [(r["doc_id"], r["place"]) for r in kept.collect()] == [(1, 6)]


def test_exact_copies_do_not_lower_weights(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = text(204)
    near = [*base[:20], "new0", *base[21:60], "new1", *base[61:100], "new2", *base[101:140], "new3", *base[141:]]  # 180 of 220 shingles: 0.818
    texts = [" ".join(base)] * 300 + [" ".join(near)] + [" ".join(text(20)) for _ in range(600)]
    out = near_dedup.classes(documents(spark, texts)).collect()
    assert {r["class_id"] for r in out if r["doc_id"] <= 100_300} == {100_000}


def test_classes_that_share_an_id_have_names_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, "six other words in this text"), (None, "quite another text of seven words"), (None, ""), (None, None)]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [sorted((r["doc_id"] for r in out if r["class"] == c), key=repr) for c in {r["class"] for r in out}]
    assert len({r["class"] for r in out}) == 6
    assert sorted(map(repr, names)) == sorted(map(repr, [[1, 2], [1, 3], [None], [None], [None], [None]]))


def weighted(shared, own, times, repeat_shared):
    """Two texts' shingles: ``shared`` in common, ``own`` of each; the last (or, of the first, another) tenth counts ``times``."""
    rng = np.random.default_rng(shared + times)
    pool = rng.choice(1 << 32, shared + 2 * own, replace=False).astype(np.uint32)
    texts = [np.sort(np.concatenate([pool[:shared], pool[shared + i * own : shared + (i + 1) * own]])) for i in range(2)]
    heavy = set(pool[: shared // 100].tolist()) if repeat_shared else set(pool[shared : shared + own].tolist())
    counts = [np.array([times if h in heavy else 1 for h in t.tolist()]) for t in texts]
    return np.concatenate(texts), np.concatenate(counts), np.array(list(map(len, texts)))


@pytest.mark.parametrize("shared", [20_000, 200_000, 2_000_000])
@pytest.mark.parametrize("repeat_shared", [True, False])
def test_samples_hold_for_any_length(shared, repeat_shared):
    """The share of equal samples lies within four standard deviations of the similarity, whatever the number of shingles."""
    hashes, counts, sizes = weighted(shared, shared // 10 if repeat_shared else shared // 100, 10, repeat_shared)
    weights = near_dedup.Weights(np.zeros((near_dedup.DEPTH, 1 << near_dedup.COLUMN_BITS)), 1000)
    a, b = (dict(zip(h.tolist(), c.tolist(), strict=True)) for h, c in zip(np.split(hashes, [sizes[0]]), np.split(counts, [sizes[0]]), strict=True))
    low = sum(min(n, b[h]) for h, n in a.items() if h in b)
    true = low / (sum(a.values()) + sum(b.values()) - low)
    codes = near_dedup.signatures(hashes, counts, sizes, weights)
    agree = np.mean(codes[0] == codes[1])
    assert 0.7 < true < 0.95
    assert abs(agree - true) < 4 * (true * (1 - true) / near_dedup.K) ** 0.5


def test_triples_have_their_distributions():
    """What v gives is exponential with the weight as its rate, and the sample of one weight is often that of a near one."""
    v = np.random.default_rng(3).integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32)
    for w in (0.6, 1.0, 3.0, 50.0):
        lna, t = near_dedup.samples(v, np.full(len(v), np.log(w)))
        a = np.sort(np.exp(lna)) * w
        grid = (np.arange(len(a)) + 0.5) / len(a)
        assert np.abs(1 - np.exp(-a) - grid).max() < 0.006
        if w == 1:
            assert np.allclose(lna, near_dedup.unit_samples(v)) and not t.any()
