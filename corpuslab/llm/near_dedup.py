"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles (operator 1).

Similarity is the weighted Jaccard similarity of five-word shingles: a shingle weighs its count in the
text times an inverse document frequency in (1/2, 1], which is 1 up to a share of ``RARE`` of all
documents and falls with the logarithm beyond, so that passages which many documents share count less.
Documents with equal word sequences count as one there.

1. Every text is shingled once. Texts with equal word sequences collapse into one node (128-bit digests);
   documents are rows that point at nodes until the very end, so ids may repeat or be missing.
2. Frequencies: every task adds its nodes' shingles to a count-mean-min sketch; sketches are summed by
   segment, in two levels. Only counters above RARE of the nodes matter (every other shingle weighs its
   count), which are a few hundred times the mean text length at any corpus size, and they alone reach the driver.
3. Signatures: improved consistent weighted sampling, ``K`` samples a node, in ``BANDS`` bands. A sample's
   triple (r, c, beta) is made from all bits of the shingle's hash, in such an order that what it gives for
   weight 1 grows with the hash. So among shingles of weight 1 the sample is the one with the least hash, and
   the full formula is needed only for the others.
4. Nodes that share a band are compared by signature; pairs whose estimate is within four standard
   deviations of the threshold join a family.
5. Inside each family, the pairs that pass the same estimate are verified by their exact weighted Jaccard
   similarity, unless links already join them; a forest of links remains.
6. Classes are the connected components of the links.

Groups (buckets of a band, families) of up to a block are compared in one tile. In larger ones, every
block is first compared with a few leaders, the same for the whole group. Nodes whose leaders are linked
with each other need no further comparison among themselves. Those outside the largest such part of
their group are compared with all its nodes, block by block; so a group of similar texts costs its size
times the number of leaders, nothing is dropped, and only what leaders don't join costs more.
Nothing of document size reaches the driver.

Defined cases: a text without words (null, empty, blank) is in no class but its own; a null doc_id has the
class of its text; texts that share a doc_id are compared each for itself; a text of fewer than five words
is one shingle; ``class_id`` is the smallest doc_id of a class, null if none of its rows has one, so where ids repeat or
are missing classes may share it, and ``class`` (a digest of a text of the class, or the place of a row without words) tells
all of them apart; a pair of
exactly the threshold is linked; repeated rows are one document for ``dedup``; long texts are shingled in
chunks, with up to eight bytes a byte beside them, and make blocks smaller; an empty table gives no rows;
further columns are kept by ``dedup`` and not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from corpuslab.llm.common import fresh, pieces, utf8
from corpuslab.llm.components import connected_components
from corpuslab.llm.shingles import distinct, mix, shingle, unpack
from corpuslab.session import materialise

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
K = BANDS * ROWS
#: Share of documents up to which a shingle has full weight.
RARE = 1 / 256
#: Rows and columns of the sketch, the segments in which sketches are summed, and the parts of all tasks that are summed first.
DEPTH, COLUMN_BITS, SEGMENTS, PARTS = 2, 18, 64, 64
#: Bytes of text that a task shingles at a time, unless one text has more.
PIECE_BYTES = 2 << 20
#: Nodes of a block and bytes of their shingles, unless one node has more; two blocks at most are compared at a time.
BLOCK, BLOCK_BYTES = 1024, 64 << 20
#: Leaders of a group of several blocks, on average; fewer where nodes are so long that these would fill half a block.
LEADERS = 32
#: Estimates of pairs at the threshold fall below this once in some 30,000 times.
LEAST_ESTIMATE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5

_rng = np.random.default_rng(4711)
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_ODD = (_rng.integers(0, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _uniform(v: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from all bits of v."""
    v = v ^ np.uint32(salt)
    v = (v ^ (v >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    v = (v ^ (v >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return ((v ^ (v >> np.uint32(16))).astype(np.float64) + 0.5) / 2.0**32


def unit_samples(v: np.ndarray) -> np.ndarray:
    """ln a of shingles of weight 1, for which a is exponential; it grows with v."""
    return np.log(-np.log1p(-(v.astype(np.float64) + 0.5) / 2.0**32))


def samples(v: np.ndarray, lnw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) of shingles of other weights, from the triple (r, c, beta) that belongs to v.

    r * beta and r * (1 - beta) are independent and exponential, as r is of shape 2 and beta uniform. For weight 1, a is
    c * exp(-r * (1 - beta)). So v gives a for weight 1, and given that, exp(r * (1 - beta)) - 1 is exponential with the mean 1 / a.
    """
    unit = unit_samples(v)
    s, p = np.log1p(-np.log(_uniform(v, 0x3C6EF372)) * np.exp(-unit)), -np.log(_uniform(v, 0x1B873593))
    r = p + s
    t = np.floor((lnw + p) / r)
    return unit + s + p - r * (t + 1), t


def columns(hashes: np.ndarray) -> np.ndarray:
    """(DEPTH, n): the counter of a shingle in each row of the sketch."""
    shift = np.uint32(32 - COLUMN_BITS)
    return np.stack([hashes >> shift, (hashes * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)) >> shift])


@dataclass(frozen=True)
class Weights:
    """Document counts above the rare share, 0 elsewhere, and the number of documents; those with equal words are one."""

    counters: np.ndarray  # (DEPTH, 2**COLUMN_BITS)
    documents: int

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        where = columns(hashes)
        df = np.minimum(*(self.counters[i][where[i]] for i in range(DEPTH)))
        weight = counts.astype(np.float64)
        common = np.flatnonzero(df > max(1.0, RARE * self.documents))
        weight[common] *= (1 + np.log(self.documents / df[common]) / np.log(1 / RARE)) / 2
        return weight


def pack(documents: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns to keep (bigint), and d1, d2 (digest of the word sequence), n_words and the packed shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, weight=PIECE_BYTES):
            found = shingle([x or b"" for x in utf8(batch.column(len(keep)))], WIDTH)
            columns = [pa.array(found.digest[:, 0]), pa.array(found.digest[:, 1]), pa.array(found.n_words), pa.array(found.packed(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, "d1", "d2", "n_words", "shingles"])

    schema = ", ".join([*(f"{c} bigint" for c in keep), "d1 bigint, d2 bigint, n_words bigint, shingles binary"])
    return documents.select(*keep, text).mapInArrow(run, schema)


def document_frequencies(nodes: DataFrame) -> Weights:
    """Count the shingles (packed) of all nodes."""
    part_size = DEPTH * (1 << COLUMN_BITS) // SEGMENTS
    dense = "segment bigint, part bigint, n bigint, counts binary"

    def sketched(segments: dict[tuple[int, int], np.ndarray], n: dict[int, int]) -> pa.RecordBatch:
        # the number of nodes goes with segment 0
        rows = [{"segment": s, "part": p, "n": n.get(p, 0) if s == 0 else 0, "counts": x.astype("<i8").tobytes()} for (s, p), x in segments.items()]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n, part = np.zeros((DEPTH, 1 << COLUMN_BITS), np.int64), 0, TaskContext.get().partitionId() % PARTS
        for batch in pieces(batches, weight=PIECE_BYTES):
            hashes, _, _ = unpack(batch.column(0).to_pylist())
            n += batch.num_rows
            for i, own in enumerate(columns(hashes)):
                sketch[i] += np.bincount(own, minlength=1 << COLUMN_BITS)
        yield sketched({(i, part): x for i, x in enumerate(sketch.reshape(SEGMENTS, -1))}, {part: n})

    def sums(batches: Iterator[pa.RecordBatch]) -> tuple[dict[tuple[int, int], np.ndarray], dict[int, int]]:
        found: dict[tuple[int, int], np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["segment"], row["part"]
                n[key[1]] = n.get(key[1], 0) + row["n"]
                found[key] = found.get(key, 0) + np.frombuffer(row["counts"], "<i8")
        return found, n

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = sums(batches)
        if found:
            yield sketched(found, n)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = sums(batches)
        for segment in sorted({s for s, _ in found}):
            own = sum(x for (s, _), x in found.items() if s == segment)
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at + segment * part_size), pa.array(own[at])], ["counter", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([sum(n.values())], pa.int64())], ["counter", "n"])

    sketches = nodes.select("shingles").mapInArrow(count, dense)
    # a segment of a part of the tasks meets in one task, then a segment of all parts
    parts = sketches.repartition("segment", "part").mapInArrow(add, dense)
    summed = materialise(parts.repartition(SEGMENTS, "segment").mapInArrow(finish, "counter bigint, n bigint"), "frequencies")
    of_documents = F.col("counter") == -1
    n, total = (x or 0 for x in summed.agg(F.sum(F.when(of_documents, F.col("n"))), F.sum(F.when(~of_documents, F.col("n")))).first())
    counters = np.zeros(DEPTH << COLUMN_BITS)
    # a counter also holds its share of all other shingles, on average; without it the estimate has no bias
    for at, value in summed.filter(~of_documents & (F.col("n") > max(1.0, RARE * n))).collect():
        counters[at] = value - (total / DEPTH - value) / ((1 << COLUMN_BITS) - 1)
    return Weights(counters.reshape(DEPTH, -1), n)


def signatures(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: Weights) -> np.ndarray:
    """(texts, K) uint32 sample codes of texts' distinct shingles; texts without any have zeros."""
    out = np.zeros((len(sizes), K), np.uint32)
    text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    weight = weights.of(hashes, counts)
    unit = weight == 1
    plain, plain_text = hashes[unit], text_of[unit]
    other, other_text, lnw = hashes[~unit], text_of[~unit], np.log(weight[~unit])
    plain_texts, plain_starts = np.unique(plain_text, return_index=True)
    other_texts, other_starts, other_sizes = np.unique(other_text, return_index=True, return_counts=True)
    for k in range(K):
        best = np.full(len(out), np.inf)
        code = out[:, k]
        if len(plain):
            least = np.minimum.reduceat((plain ^ _XOR[k]) * _ODD[k], plain_starts)
            best[plain_texts] = unit_samples(least)
            code[plain_texts] = least
        if len(other):
            v = (other ^ _XOR[k]) * _ODD[k]
            lna, t = samples(v, lnw)
            lowest = np.minimum.reduceat(lna, other_starts)
            first = np.flatnonzero(lna == np.repeat(lowest, other_sizes))
            first = first[np.unique(other_text[first], return_index=True)[1]]
            wins = lowest < best[other_texts]
            code[other_texts[wins]] = (v[first] ^ (t[first].astype(np.int64) * 0x5BD1E995).astype(np.uint32))[wins]
    return out


def band_keys(codes: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64."""
    wide = codes.reshape(len(codes), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(codes), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key ^ wide[:, :, j])
    return key.view(np.int64)


def fingerprints(codes: np.ndarray) -> np.ndarray:
    """One byte a sample."""
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def sign(nodes: DataFrame, weights: Weights) -> DataFrame:
    """(node, bytes, keys, prints) of every node (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, weight=PIECE_BYTES):
            packed = batch.column(1).to_pylist()
            codes = signatures(*unpack(packed), weights)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(codes).ravel()), BANDS).cast(pa.list_(pa.int64()))
            prints = pa.array([x.tobytes() for x in fingerprints(codes)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, packed)), pa.int64()), keys, prints], ["node", "bytes", "keys", "prints"])

    return nodes.select("node", "shingles").mapInArrow(run, "node bigint, bytes bigint, keys array<bigint>, prints binary")


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def likely_pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the pairs of a tile whose fingerprints agree often enough; i < j if it is a block with itself."""
    least = LEAST_ESTIMATE * (1 - 1 / 256) + 1 / 256
    found = []
    step = max(1, (1 << 24) // max(1, len(right) * K))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        share = (part[:, None, :] == right[None]).sum(axis=2, dtype=np.uint16) / K
        i, j = np.nonzero(share >= least)
        keep = i + at < j if same else slice(None)
        found.append((i[keep] + at, j[keep], share[i[keep], j[keep]]))
    i, j, share = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    order = np.argsort(-share, kind="stable")
    return i[order], j[order], share[order]


#: What a row is in its tile: all nodes of a small group; a node of a block and a leader; a node outside the main part and any node.
WHOLE, MEMBER, LEADER, OUTSIDE, ANY = range(5)


def sized(rows: DataFrame, group: str) -> DataFrame:
    """(group, node, size, blocks, leads) of the nodes in groups of two and more: the group's nodes, its blocks and its number of leaders."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("all_bytes")).filter("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("all_bytes") / F.lit(BLOCK_BYTES)))
    leads = F.greatest(F.lit(1), F.least(F.lit(LEADERS), F.floor(F.col("size") * F.lit(BLOCK_BYTES // 2) / F.greatest("all_bytes", F.lit(1)))))
    return rows.join(sizes, group).select(F.col(group).alias("group"), "node", "size", F.least(blocks, "size").cast("int").alias("blocks"), leads.cast("int").alias("leads"))


def _hash(n: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(n), *columns)


def first_tiles(rows: DataFrame) -> DataFrame:
    """(tile, role, group, node, label): a tile for each block of each group, with the group's leaders if it has several; no labels."""
    block = F.pmod(_hash(17, "node"), F.col("blocks")).cast("int")
    leader = (F.col("blocks") > 1) & (F.pmod(_hash(23, "node", "group"), F.col("size")) < F.col("leads"))
    own = F.struct(block.alias("block"), F.when(F.col("blocks") == 1, WHOLE).otherwise(MEMBER).alias("role"))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(LEADER).alias("role")))
    dealt = rows.withColumn("at", F.explode(F.when(leader, F.concat(F.array(own), everywhere)).otherwise(F.array(own))))
    return dealt.select(_hash(1, "group", "at.block").alias("tile"), "at.role", "group", "node", F.lit(None).cast("bigint").alias("label"))


def rest_tiles(labelled: DataFrame) -> DataFrame:
    """(tile, role, group, node, label) of what the leaders left, from (group, node, label) of all nodes of the large groups.

    Nodes of one label are linked. All nodes outside the commonest label of a group meet all nodes of the group.
    """
    main = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"))
    sizes = main.select("group", "size", (F.col("size") - F.col("main.n")).alias("outside"), F.col("main.label").alias("main")).filter("outside > 0")
    here = labelled.join(sizes, "group")
    rows, columns = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("outside", "size"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = here.filter("label <> main").select("group", "node", "label", F.lit(OUTSIDE).alias("role"), F.pmod(_hash(29, "node"), rows).cast("int").alias("row"), every(columns).alias("column"))
    anyone = here.select("group", "node", "label", F.lit(ANY).alias("role"), every(rows).alias("row"), F.pmod(_hash(31, "node"), columns).cast("int").alias("column"))
    return outside.unionByName(anyone).select(_hash(2, "group", "row", "column").alias("tile"), "role", "group", "node", "label")


Same = Callable[[pa.Table], Callable[[int, int], bool]]


def by_tile(tiled: DataFrame, same: Same) -> DataFrame:
    """(u, v, group, label): the edges of every tile, and for each MEMBER u of one its group and label, without v.

    A member's label is that of the leaders it is linked with, or itself.

    Tiles are sorted next to each other and handled one at a time. They are named by a hash, so the group is
    compared as well: equal names of two groups stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            tile, own = batch.column("tile").to_numpy(), batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(tile) != 0) | (np.diff(own) != 0)) + 1).tolist(), len(tile)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and (tile[a], own[a]) != now:
                    yield from link(pa.Table.from_batches(held), same)
                    held = []
                now = tile[a], own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from link(pa.Table.from_batches(held), same)

    return tiled.repartition("tile").sortWithinPartitions("tile", "group").mapInArrow(run, "u bigint, v bigint, group bigint, label bigint")


def link(rows: pa.Table, same: Same) -> Iterator[pa.RecordBatch]:
    """The edges of one tile, as many as join what can be joined, and its members with their labels."""
    node, role = rows["node"].to_numpy(), rows["role"].to_numpy()
    prints = np.frombuffer(b"".join(rows["prints"].to_pylist()), np.uint8).reshape(-1, K)
    # a node that is in the tile twice has one place in the forest; places are in the order of nodes
    ordered, place = np.unique(node, return_inverse=True)
    forest, equal = Forest(len(ordered)), same(rows)

    def compare(left: np.ndarray, right: np.ndarray, own: bool, label: np.ndarray | None = None) -> None:
        i, j, _ = likely_pairs(prints[left], prints[right], own)
        i, j = left[i], right[j]
        new = place[i] != place[j]
        if label is not None:
            new &= label[i] != label[j]
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            if forest.root(place[a]) != forest.root(place[b]) and equal(a, b):
                forest.join(place[a], place[b])

    if (role == WHOLE).all():
        compare(np.arange(len(node)), np.arange(len(node)), True)
    elif (role >= OUTSIDE).all():
        compare(np.flatnonzero(role == OUTSIDE), np.flatnonzero(role == ANY), False, rows["label"].to_numpy())
    else:
        leaders, members = np.flatnonzero(role == LEADER), np.flatnonzero(role == MEMBER)
        compare(leaders, leaders, True)
        # leaders that are linked without any member have one name, the same in all tiles of the group
        names: dict[int, int] = {}
        for i in leaders.tolist():
            root = forest.root(place[i])
            names[root] = min(names.get(root, int(node[i])), int(node[i]))
        named = [(i, names[forest.root(place[i])]) for i in leaders.tolist()]
        compare(leaders, members, False)
        labels: dict[int, int] = {}
        for i, name in named:
            root = forest.root(place[i])
            labels[root] = min(labels.get(root, name), name)
        own = [labels.get(forest.root(place[i]), int(node[i])) for i in members.tolist()]
        yield _batch(node[members], None, rows["group"].take(pa.array(members)), own)
    # every node hangs on the smallest one that it is joined with
    root = np.fromiter(map(forest.root, range(len(ordered))), np.int64, len(ordered))
    hangs = np.flatnonzero(root != np.arange(len(ordered)))
    if len(hangs):
        yield _batch(ordered[hangs], ordered[root[hangs]], None, None)


def _batch(*columns: np.ndarray | pa.ChunkedArray | list[int] | None) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [pa.nulls(n, pa.int64()) if c is None else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, ["u", "v", "group", "label"])


def joined(groups: DataFrame, payloads: list[DataFrame], same: Same, name: str) -> DataFrame:
    """(node, component): nodes of a group (as sized has it) that are joined by pairs which are the same; payloads are by node."""

    def run(tiled: DataFrame) -> DataFrame:
        for payload in payloads:
            tiled = tiled.join(payload, "node")
        return by_tile(tiled, same)

    found = materialise(run(first_tiles(groups)), name)
    members = found.filter("group IS NOT NULL").select("group", F.col("u").alias("node"), "label")
    edges = found.filter("group IS NULL").select("u", "v")
    if not members.isEmpty():  # else no group has several blocks
        edges = edges.unionByName(materialise(run(rest_tiles(members)), f"{name}-rest").select("u", "v"))
    return materialise(connected_components(edges), f"{name}-components")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def any_pair(rows: pa.Table) -> Callable[[int, int], bool]:
    """The estimate alone decides."""
    return lambda a, b: True


def equal_texts(weights: Weights) -> Same:
    """The exact similarity of the pair decides; rows have packed shingles."""

    def of(rows: pa.Table) -> Callable[[int, int], bool]:
        packed, vectors = rows["shingles"], {}

        def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in vectors:
                hashes = np.frombuffer(packed[i].as_py(), "<u4")
                hashes, counts, _ = distinct(hashes, np.array([len(hashes)]))
                vectors[i] = hashes, weights.of(hashes, counts)
            return vectors[i]

        return lambda a, b: weighted_jaccard(vector(a), vector(b)) >= THRESHOLD

    return of


@dataclass(frozen=True)
class Classed:
    """rows: place, doc_id, k1, k2, d1, d2, n_words of every document; nodes: d1, d2, class (a node), class_id (its smallest doc_id) and class_name."""

    rows: DataFrame
    nodes: DataFrame


def _row_key(key: str, text: str) -> list[Column]:
    """128 bits that tell rows of different id or text apart."""
    return [F.xxhash64(F.lit(n), F.col(key).isNull(), F.col(key).cast("long"), F.col(text)) for n in (1, 2)]


def classify(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Classed:
    k1, k2 = _row_key(key, text)
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    # the place of a row is fixed by writing it
    rows = materialise(pack(docs, ["doc_id", "k1", "k2"], "text").withColumn("place", F.monotonically_increasing_id()), "rows")
    found = rows.filter("n_words > 0").groupBy("d1", "d2").agg(F.min("place").alias("node"), F.min("doc_id").alias("least"))
    digests = materialise(found, "digests")
    nodes = materialise(rows.select(F.col("place").alias("node"), "shingles").join(digests.select("node"), "node", "left_semi"), "nodes")
    weights = document_frequencies(nodes)
    signed = materialise(sign(nodes, weights), "signatures")
    prints = signed.select("node", "prints")
    buckets = sized(signed.select("node", F.lit(0).alias("bytes"), F.explode("keys").alias("bucket")), "bucket")
    families = joined(buckets, [prints], any_pair, "alike")
    members = families.join(signed.select("node", "bytes"), "node").withColumnRenamed("component", "family")
    linked = joined(sized(members, "family"), [prints, nodes], equal_texts(weights), "links")
    named = digests.join(linked, "node", "left").select("d1", "d2", "least", F.coalesce("component", "node").alias("class"))
    digest = F.concat(F.hex(F.col("least_digest.d1")), F.lit("-"), F.hex(F.col("least_digest.d2")))
    least = named.groupBy("class").agg(F.min("least").alias("class_id"), F.min(F.struct("d1", "d2")).alias("least_digest")).select("class", "class_id", digest.alias("class_name"))
    return Classed(rows.drop("shingles"), named.join(least, "class").select("d1", "d2", "class", "class_id", "class_name"))


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class) of every row: the smallest key of its near-duplicate class, and a name that no other class has."""
    found = classify(documents, key, text)
    rows = found.rows.select("doc_id", "n_words", "d1", "d2", "place").join(found.nodes.select("d1", "d2", "class_id", "class_name"), ["d1", "d2"], "left")
    alone = F.col("n_words") == 0
    return rows.select(F.col("doc_id").alias(key), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.concat(F.lit("row-"), "place")).otherwise(F.col("class_name")).alias("class"))


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that with the smallest key (null last).

    Rows without words are classes of their own, and rows equal in key and text are one. The choice among
    those needs the partitioning that the join has already made.
    """
    names = documents.columns
    k1, k2, kept1, kept2, place = (fresh(c, names) for c in ("k1", "k2", "kept1", "kept2", "place"))
    found = classify(documents, key, text)
    named = found.rows.join(found.nodes, ["d1", "d2"]).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    best = named.groupBy("class").agg(F.min(F.struct("k1", "k2")).alias("first")).select("first.k1", "first.k2")
    kept = best.unionByName(found.rows.filter("n_words = 0").select("k1", "k2")).distinct().toDF(kept1, kept2)
    own1, own2 = _row_key(key, text)
    keyed = documents.withColumns({k1: own1, k2: own2})
    chosen = keyed.join(kept, (F.col(k1) == F.col(kept1)) & (F.col(k2) == F.col(kept2)), "left_semi")
    plain = [f.name for f in documents.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in (key, text)]
    first = F.row_number().over(Window.partitionBy(k1, k2).orderBy(*(F.col(f"`{c}`") for c in plain), F.lit(0)))
    return chosen.withColumn(place, first).filter(F.col(place) == 1).select(*(f"`{c}`" for c in names))
