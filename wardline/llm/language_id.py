"""Language of a document: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on a bounded sample of
labelled windows. It gives a probability for every language at every byte; a document's
probabilities are the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import hash_share, text_buffer

UNDETERMINED = "und"
HAS_LETTER = r"\p{L}"


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the fit: about so many windows of each language reach the driver."""

    hidden: int = 8
    train_bytes: int = 64
    per_language: int = 500
    updates: int = 300
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    window: int = 128
    windows_at_once: int = 2048


@dataclass(frozen=True)
class Cell:
    """One direction. ``x`` has a row of gate inputs for each byte: update, reset, candidate."""

    x: np.ndarray  # 256 x 3h
    u: np.ndarray  # h x 3h


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    forward: Cell
    backward: Cell
    out: np.ndarray  # 2h x languages
    bias: np.ndarray


def _soft(v: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the squashing function of all gates."""
    return v / (1 + np.abs(v))


def _slope(v: np.ndarray) -> np.ndarray:
    """Derivative of ``_soft``, from its value."""
    return (1 - np.abs(v)) ** 2


# ---------------------------------------------------------------- training


def _run(cell: Cell, data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step, and what the way back needs. ``data``: steps x rows."""
    h = cell.u.shape[0]
    state = np.zeros((data.shape[1], h), np.float32)
    states, tape = [], []
    for byte, on in zip(data, mask, strict=True):
        inputs, inner = cell.x[byte], state @ cell.u
        gate = _soft(inputs[:, : 2 * h] + inner[:, : 2 * h])
        z, r = 0.5 + 0.5 * gate[:, :h], 0.5 + 0.5 * gate[:, h:]
        n = _soft(inputs[:, 2 * h :] + r * inner[:, 2 * h :])
        new = n + z * (state - n)
        tape.append((byte, on, state, gate, z, r, n, inner[:, 2 * h :]))
        state = np.where(on[:, None], new, state)
        states.append(state)
    return np.stack(states), tape


def _back(cell: Cell, tape: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``x`` and ``u`` given those of the states."""
    h = cell.u.shape[0]
    dx, du = np.zeros_like(cell.x), np.zeros_like(cell.u)
    carried = np.zeros_like(upstream[0])
    for (byte, on, before, gate, z, r, n, inner), own in zip(reversed(tape), upstream[::-1], strict=True):
        total = carried + own
        d = total * on[:, None]
        dn = d * (1 - z) * _slope(n)
        dgate = np.concatenate([d * (before - n), dn * inner], axis=1) * 0.5 * _slope(gate)
        dinputs = np.concatenate([dgate, dn], axis=1)
        dinner = np.concatenate([dgate, dn * r], axis=1)
        np.add.at(dx, byte, dinputs)
        du += before.T @ dinner
        carried = d * z + dinner @ cell.u.T + total * ~on[:, None]
    return dx, du


def train(samples: list[tuple[bytes, str]], settings: Settings = Settings()) -> Network | None:
    """Fit on (bytes, language) samples; None without any. The same samples give the same network."""
    samples = sorted((s for s in samples if s[0]), key=lambda s: (s[1], s[0]))
    languages = tuple(sorted({label for _, label in samples}))
    if not languages:
        return None
    rng = np.random.default_rng(settings.seed)
    h, steps, k = settings.hidden, settings.train_bytes, len(languages)
    data = np.zeros((len(samples), steps), np.uint8)
    lengths = np.zeros(len(samples), np.int64)
    for i, (text, _) in enumerate(samples):
        part = text[:steps]
        data[i, : len(part)] = np.frombuffer(part, np.uint8)
        lengths[i] = len(part)
    mask = np.arange(steps) < lengths[:, None]
    target = np.array([languages.index(label) for _, label in samples])
    weight = len(samples) / (k * np.bincount(target, minlength=k))

    def cell() -> list[np.ndarray]:
        return [rng.normal(0, 0.5, (256, 3 * h)).astype(np.float32), rng.normal(0, 0.5 / np.sqrt(h), (h, 3 * h)).astype(np.float32)]

    p = [*cell(), *cell(), rng.normal(0, 0.3, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32)]
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    epochs = -(-settings.updates // -(-len(samples) // settings.batch))  # few samples are read more often
    rounds = epochs * -(-len(samples) // settings.batch)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            bytes_, on = data[rows].T, mask[rows].T
            ahead, behind = Cell(p[0], p[1]), Cell(p[2], p[3])
            left, left_tape = _run(ahead, bytes_, on)
            right, right_tape = _run(behind, bytes_[::-1], on[::-1])
            both = np.concatenate([left, right[::-1]], axis=2)
            logits = both @ p[4] + p[5]
            logits -= logits.max(axis=2, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=2, keepdims=True)
            prob[:, np.arange(len(rows)), target[rows]] -= 1
            scale = on * weight[target[rows]] / (len(rows) * np.maximum(1, on.sum(axis=0)))
            dlogits = (prob * scale[:, :, None]).astype(np.float32)
            dboth = dlogits @ p[4].T
            grads = [
                *_back(ahead, left_tape, dboth[:, :, :h]),
                *_back(behind, right_tape, dboth[::-1, :, h:]),
                np.einsum("tbi,tbk->ik", both, dlogits),
                dlogits.sum(axis=(0, 1)),
            ]
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            step += 1
            rate = settings.rate * (1 - 0.9 * step / rounds)
            for v, g, m, s in zip(p, grads, first, second, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(languages, Cell(p[0], p[1]), Cell(p[2], p[3]), p[4], p[5])


# ---------------------------------------------------------------- prediction


def _states(cell: Cell, data: np.ndarray, out: np.ndarray, logits: np.ndarray) -> None:
    """Add each step's share of the logits. ``data``: steps x rows; steps in reading order."""
    h, rows = cell.u.shape[0], data.shape[1]
    state, inner, gate = (np.zeros((rows, n), np.float32) for n in (h, 3 * h, 2 * h))
    a, b = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
    for byte, to in zip(data, logits, strict=True):
        inputs = cell.x.take(byte, axis=0)
        np.matmul(state, cell.u, out=inner)
        inputs[:, : 2 * h] += inner[:, : 2 * h]
        both = inputs[:, : 2 * h]
        np.abs(both, out=gate)
        gate += 1
        np.divide(both, gate, out=gate)
        gate += 1
        gate *= 0.5
        np.multiply(inner[:, 2 * h :], gate[:, h:], out=a)
        a += inputs[:, 2 * h :]
        np.abs(a, out=b)
        b += 1
        a /= b
        state -= a
        state *= gate[:, :h]
        state += a
        to += state @ out


def window_probabilities(net: Network, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum over its bytes of the probabilities of each row. ``data``: rows x bytes.

    A row ends at its length. The backward pass starts at the last byte of the row: what
    comes after is dealt to the end of the reversed row, where it is not counted.
    """
    rows, steps = data.shape
    h, k = net.forward.u.shape[0], len(net.languages)
    place = np.arange(steps)
    back = lengths[:, None] - 1 - place
    back = np.where(back >= 0, back, place)
    ahead = np.ascontiguousarray(data.T)
    behind = np.ascontiguousarray(np.take_along_axis(data, back, axis=1).T)
    left, right = np.zeros((steps, rows, k), np.float32), np.zeros((steps, rows, k), np.float32)
    _states(net.forward, ahead, net.out[:h], left)
    _states(net.backward, behind, net.out[h:], right)
    if (lengths == steps).all():
        left += right[::-1]
    else:
        left += right[back.T, np.arange(rows)]
    left += net.bias
    np.exp(left, out=left)
    left /= left.sum(axis=2, keepdims=True)
    left *= (place[:, None] < lengths)[:, :, None]
    return left.sum(axis=0, dtype=np.float64)


def document_probabilities(net: Network, body: np.ndarray, offsets: np.ndarray, settings: Settings) -> np.ndarray:
    """Mean probabilities over the bytes of each text; every byte counts once."""
    sizes = np.diff(offsets)
    windows = -(-sizes // settings.window)
    owner = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offsets[:-1][owner] + nth * settings.window
    length = np.minimum(settings.window, offsets[1:][owner] - start)
    order = np.argsort(-length, kind="stable")  # full windows together
    total = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate([body, np.zeros(settings.window, np.uint8)])
    for at in range(0, len(order), settings.windows_at_once):
        part = order[at : at + settings.windows_at_once]
        widest = int(length[part[0]])
        data = padded[start[part][:, None] + np.arange(widest)]
        np.add.at(total, owner[part], window_probabilities(net, data, length[part]))
    return total / np.maximum(1, sizes)[:, None]


# ---------------------------------------------------------------- Spark


def labelled_windows(labelled: DataFrame, settings: Settings = Settings()) -> list[tuple[bytes, str]]:
    """About ``per_language`` short passages of each label, of distinct texts; chosen and placed by a hash of the text.

    A text that any number of rows repeat is one of its label's texts, so every label is
    learned from as many as it has, up to the bound. The distinct texts of each label are
    counted by their hashes, then those with a hash in the share that the bound allows are
    read; copies merge before they are shuffled. What reaches the driver is bounded by
    ``per_language`` times the number of languages.
    """
    clean = (
        labelled.select("text", "lang")
        .filter(F.col("text").rlike(HAS_LETTER) & F.col("lang").isNotNull())
        .withColumn("spread", F.xxhash64("text"))
    )
    found = clean.groupBy("lang").agg(F.approx_count_distinct("spread", 0.02).alias("n")).collect()
    if not found:
        return []
    share = F.lit(0.0)
    for lang, n in sorted((r["lang"], r["n"]) for r in found):
        # a label of few texts, give or take the error of the count, gives all of them
        share = F.when(F.col("lang") == lang, min(1.0, settings.per_language / (0.9 * n))).otherwise(share)
    last = F.greatest(F.length("text") - settings.train_bytes, F.lit(1))
    begin = (F.pmod(F.shiftrightunsigned("spread", 8), last) + 1).cast("int")
    rows = (
        clean.filter(hash_share(F.col("spread"), share))
        .groupBy("lang", "spread")
        .agg(F.min(F.substr("text", begin, F.lit(settings.train_bytes))).alias("text"))
        .collect()
    )
    return [(t.encode(), r["lang"]) for r in rows for t in (r["text"], r["text"].upper())[: 2 if len(r["text"]) % 3 == 0 else 1]]


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Network | None:
    """A network from ``text`` and ``lang`` of the given rows."""
    return train(labelled_windows(labelled, settings), settings)


def _predictor(net: Network | None, settings: Settings, text_at: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the two results to the first ``kept`` columns; the last column tells which texts have a letter."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            label, score = np.full(size, UNDETERMINED, object), np.zeros(size)
            if net is not None and size:
                pooled = document_probabilities(net, *text_buffer(batch.column(text_at)), settings)
                use = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                label[use] = np.array(net.languages, object)[pooled.argmax(axis=1)][use]
                score[use] = np.clip(pooled.max(axis=1), 0, 1)[use]
            columns = [batch.column(i) for i in range(kept)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(label, pa.string()), pa.array(score)], [*batch.schema.names[:kept], "lang_pred", "score"]
            )

    return predict


def _predicted(rows: DataFrame, net: Network | None, settings: Settings, text_at: int, kept: int) -> DataFrame:
    result = T.StructType([*rows.schema.fields[:kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictor(net, settings, text_at, kept), result)


def predict(docs: DataFrame, net: Network | None, *keep: Column, settings: Settings = Settings()) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``.

    Null texts and texts without a letter get ``und`` and 0, as does everything if there
    was nothing to learn from. Whole texts are read, in windows; a text's length only
    adds windows. Rows may repeat.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("__text"), text.rlike(HAS_LETTER).alias("__lettered"))
    return _predicted(rows, net, settings, len(keep), len(keep))


def held_out(doc_id: Column) -> Column:
    """One document in five, by the checksum of its number as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_language_id(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out.

    Null and empty texts, and those without a letter, are ``und`` with score 0, as is every
    text where there is no label to learn from. Null numbers are not held out. Rows that
    repeat are judged alike, each by itself; an empty table gives no rows. Of a very long
    text every byte is read, in windows. Columns beside ``doc_id``, ``text`` and ``lang``
    are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    net = fit(narrow.filter(~held_out(F.col("doc_id"))), settings)
    return predict(narrow, net, F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), settings=settings)


def least_score(languages: int, margin: float) -> float:
    """The probability that is ``margin`` of the way from chance to certainty, however many languages there are."""
    return (1 + margin * (languages - 1)) / languages


def language_stage(docs: DataFrame, margin: float = 0.05, settings: Settings = Settings()) -> DataFrame:
    """Documents whose language can be told: not ``und``, and the best probability above chance by ``margin``.

    Returns the rows with all columns as they were. Null and empty texts, and those without a
    letter, go. Rows that repeat are judged alike, each by itself; an empty table gives no
    rows; very long texts are read whole, in windows. Without any label to learn from, or
    with one language only, every text with a letter stays.
    """
    lettered = docs.filter(F.col("text").rlike(HAS_LETTER))
    net = fit(docs.filter(~held_out(F.col("doc_id"))), settings)
    if net is None or len(net.languages) == 1:
        return lettered
    names = docs.columns
    rows = lettered.select(*[F.col(n).alias(f"__{i}") for i, n in enumerate(names)], F.lit(True).alias("__lettered"))
    scored = _predicted(rows, net, settings, names.index("text"), len(names))
    return scored.filter(F.col("score") >= least_score(len(net.languages), margin)).select(*[F.col(f"__{i}").alias(n) for i, n in enumerate(names)])
