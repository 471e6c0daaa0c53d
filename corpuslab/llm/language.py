"""Language identification by a bidirectional gated recurrent network over bytes (operator 9).

The network reads UTF-8 bytes in both directions, in windows of ``WINDOW`` bytes that start from the
zero state, and labels every position by a softmax over both states. A document's probabilities are
the mean of those at its letters (ASCII letters and bytes of longer code points). It is trained in numpy
by backpropagation through time with Adam, on windows of a bounded, seeded sample of documents, as many
for each language.

    gates      r, z = sigmoid(E_g[byte] + U' h)
    candidate  c = tanh(E_c[byte] + C' (r h))
    state      h <- h + z (c - h)

Byte 0 is padding: its update gate is shut, so states pass it unchanged. Whole texts are read; windows of
many documents run side by side as one matrix, so the cost follows the bytes and nothing is shuffled.

Defined cases: ``und`` with score 0 if text is null or has no letter, or if there is nothing to learn
from; a sample with one language always answers that; every language that has a text with a letter is
learned, of long texts an excerpt; languages of equal probability give the first by name; repeated rows
are predicted alike, and teach once; texts of any length are read whole, window by window (a piece of
windows at a time, beside four bytes a byte for the whole); an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm import labelled
from corpuslab.llm.common import pieces, utf8

WINDOW = 64
#: Documents a language in the sample, the characters of one that are taken at most, and the documents of all languages together,
#: beyond which each has fewer, but LEAST_ROWS.
SAMPLE_ROWS, SAMPLE_CHARS, ALL_ROWS, LEAST_ROWS = 400, 8_000, 25_600, 16
#: Windows that run side by side.
BATCH = 2048
UNDETERMINED = "und"
_SHUT = -30.0
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER_BYTE = (np.arange(256) >= 0x80) | np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    import regex

    return bool(regex.search(r"\p{L}", text.decode("utf-8", "replace")))


@dataclass
class Network:
    """Weights for both directions: the first axis is the direction (forward, backward)."""

    languages: list[str]
    inputs: np.ndarray  # (2, 256, 3 H): what a byte adds to r, z and c
    gates: np.ndarray  # (2, H, 2 H)
    candidate: np.ndarray  # (2, H, H)
    output: np.ndarray  # (2, H, languages)
    bias: np.ndarray  # (languages,)

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate, self.output, self.bias]

    def shut_padding(self) -> None:
        h = self.candidate.shape[1]
        self.inputs[:, 0, :] = 0
        self.inputs[:, 0, h : 2 * h] = _SHUT


def new_network(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    net = Network(languages, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 2 * hidden, scale=hidden**-0.5), draw(2, hidden, hidden, scale=hidden**-0.5), draw(2, hidden, len(languages), scale=0.1), np.zeros(len(languages), np.float32))
    net.shut_padding()
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(time, languages, batch) of (time, batch) bytes: the label of every position."""
    steps, batch = windows.shape
    hidden = net.candidate.shape[1]
    table = np.ascontiguousarray(net.inputs.transpose(0, 2, 1))
    gates, candidate = np.ascontiguousarray(net.gates.transpose(0, 2, 1)), np.ascontiguousarray(net.candidate.transpose(0, 2, 1))
    h = np.zeros((2, hidden, batch), np.float32)
    states = np.empty((2, steps, hidden, batch), np.float32)
    x = np.empty((2, 3 * hidden, batch), np.float32)
    for t in range(steps):
        np.take(table[0], windows[t], axis=1, out=x[0], mode="clip")
        np.take(table[1], windows[steps - 1 - t], axis=1, out=x[1], mode="clip")
        g = np.matmul(gates, h)
        g += x[:, : 2 * hidden]
        _sigmoid(g)
        c = np.matmul(candidate, g[:, :hidden] * h)
        c += x[:, 2 * hidden :]
        np.tanh(c, out=c)
        c -= h
        c *= g[:, hidden:]
        h = h + c
        states[0, t], states[1, steps - 1 - t] = h[0], h[1]
    logits = np.matmul(net.output[0].T, states[0])
    logits += np.matmul(net.output[1].T, states[1])
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the positions that aren't padding, and its gradient by backpropagation through time.

    windows: (time, batch) bytes; target: (batch,) language numbers.
    """
    steps, batch = windows.shape
    hidden = net.candidate.shape[1]
    states, kept = [], []
    for d in (0, 1):
        h, tape, out = np.zeros((batch, hidden), np.float32), [], np.empty((steps, batch, hidden), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x = net.inputs[d][windows[t]]
            g = _sigmoid(h @ net.gates[d] + x[:, : 2 * hidden])
            r, z = g[:, :hidden], g[:, hidden:]
            c = np.tanh((r * h) @ net.candidate[d] + x[:, 2 * hidden :])
            tape.append((t, h, r, z, c))
            h = h + z * (c - h)
            out[t] = h
        states.append(out)
        kept.append(tape)
    logits = states[0] @ net.output[0] + states[1] @ net.output[1] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    real = windows != 0
    n = max(1, int(real.sum()))
    own = np.take_along_axis(p, np.broadcast_to(target[None, :, None], (steps, batch, 1)), axis=2)[:, :, 0]
    loss = float(-(np.log(own + 1e-12) * real).sum() / n)
    delta = p
    np.put_along_axis(delta, np.broadcast_to(target[None, :, None], (steps, batch, 1)), (own - 1)[:, :, None], axis=2)
    delta *= real[:, :, None] / np.float32(n)
    d_inputs, d_gates, d_candidate, d_output = (np.zeros_like(w) for w in net.weights()[:4])
    d_bias = delta.sum(axis=(0, 1))
    for d in (0, 1):
        d_output[d] = np.tensordot(states[d], delta, axes=((0, 1), (0, 1)))
        from_above = delta @ net.output[d].T
        carried = np.zeros((batch, hidden), np.float32)
        into = np.empty((steps, batch, 3 * hidden), np.float32)
        for t, before, r, z, c in reversed(kept[d]):
            dh = from_above[t] + carried
            dz, dc = dh * (c - before) * z * (1 - z), dh * z * (1 - c * c)
            d_mixed = dc @ net.candidate[d].T
            d_candidate[d] += (r * before).T @ dc
            dg = np.concatenate([d_mixed * before * r * (1 - r), dz], axis=1)
            d_gates[d] += before.T @ dg
            carried = dh * (1 - z) + d_mixed * r + dg @ net.gates[d].T
            into[t, :, : 2 * hidden], into[t, :, 2 * hidden :] = dg, dc
        flat, columns = windows.ravel(), into.reshape(-1, 3 * hidden)
        for j in range(3 * hidden):
            d_inputs[d, :, j] = np.bincount(flat, columns[:, j], 256)
        d_inputs[d, 0] = 0
    return loss, [d_inputs, d_gates, d_candidate, d_output, d_bias]


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, number of each text's windows): texts in windows of WINDOW bytes, padded by byte 0."""
    counts = np.fromiter((-(-len(x) // WINDOW) for x in texts), np.int64, len(texts))
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    for at, text in zip(((np.cumsum(counts) - counts) * WINDOW).tolist(), texts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return flat.reshape(-1, WINDOW), counts


def train(texts: list[bytes], languages: list[str], hidden: int = 8, steps: int = 500, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Network | None:
    """A network from texts and their languages."""
    known = sorted(set(languages))
    windows, counts = cut(texts)
    label = np.repeat([known.index(x) for x in languages], counts) if known else np.zeros(0, int)
    by_language = [np.flatnonzero(label == k) for k in range(len(known))]
    if not known or any(not len(x) for x in by_language):
        return None
    rng, net = np.random.default_rng(seed), new_network(known, hidden, seed)
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    each = max(1, batch // len(known))
    for t in range(1, steps + 1):
        own = np.concatenate([rng.choice(x, each) for x in by_language])
        _, found = gradients(net, np.ascontiguousarray(windows[own].T), label[own])
        norm = float(np.sqrt(sum((g * g).sum() for g in found)))
        now = rate * (0.5 + 0.5 * np.cos(np.pi * t / steps))
        for w, g, m, v in zip(net.weights(), found, first, second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= np.float32(now) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-7))
        net.shut_padding()
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean probabilities over the letters of each text; zeros where there are none."""
    windows, counts = cut(texts)
    sums, letters = np.zeros((len(windows), len(net.languages))), np.zeros(len(windows))
    for at in range(0, len(windows), BATCH):
        own = np.ascontiguousarray(windows[at : at + BATCH].T)
        weight = _LETTER_BYTE[own].astype(np.float32)
        sums[at : at + BATCH] = np.einsum("tlb,tb->bl", position_probabilities(net, own), weight)
        letters[at : at + BATCH] = weight.sum(axis=0)
    out = np.zeros((len(texts), len(net.languages)))
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(sums, starts, axis=0) / np.maximum(np.add.reduceat(letters, starts), 1)[:, None]
    return out


def fit(documents: DataFrame, learnable: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 5) -> Network | None:
    """A network of all languages from ``rows`` documents each, drawn by a seeded hash among those that are learnable.

    Texts with a letter are drawn; of those longer than ``chars`` characters, an excerpt with a letter. Counts by
    language give a bound of the hash below which a few times ``rows`` texts of each are expected, so only those are
    shuffled and ranked, whatever share of the corpus a language has. What the draw returns is bounded by rows *
    languages, so the join that fetches the texts broadcasts a bounded table.
    """
    letter = r"\p{L}"
    usable = documents.filter(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(letter))
    drawn_by = usable.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"))
    counts = drawn_by.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    each = max(min(LEAST_ROWS, rows), min(rows, ALL_ROWS // max(1, len(counts))))
    # draws are even over 64 bits; the least of a language is always drawn, and rows repeated as a whole have one draw
    span = 1 << 64
    bounds = [(lang, max(least, min((1 << 63) - 1, -(1 << 63) + span * 4 * each // n)) if n > 4 * each else (1 << 63) - 1) for lang, n, least in counts]
    if not bounds:
        return None
    bound = documents.sparkSession.createDataFrame(bounds, "bound_lang string, bound long")
    below = drawn_by.select("lang", "draw").join(F.broadcast(bound), (F.col("lang") == F.col("bound_lang")) & (F.col("draw") <= F.col("bound"))).select("lang", "draw").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = below.withColumn("place", place).filter(F.col("place") <= each).select(F.col("lang").alias("drawn_lang"), F.col("draw").alias("drawn"))
    run = labelled.excerpt("text", chars, seed)
    run = F.when(run.rlike(letter), run).otherwise(F.substring(F.col("text"), F.regexp_instr("text", F.lit(letter)), F.lit(chars)))
    fetched = drawn_by.join(F.broadcast(drawn), (F.col("lang") == F.col("drawn_lang")) & (F.col("draw") == F.col("drawn")))
    found = sorted(fetched.groupBy("lang", "draw").agg(F.min(run).alias("text")).collect())
    return train([r["text"].encode() for r in found], [r["lang"] for r in found])


def predict(documents: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [x or b"" for x in utf8(batch.column(1))]
            known = np.fromiter((net is not None and has_letter(x) for x in texts), bool, len(texts))
            if net is None:
                found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            else:
                p = pooled(net, texts)
                best = p.argmax(axis=1)
                found = [net.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    rows = documents.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, lang_pred string, score double")
