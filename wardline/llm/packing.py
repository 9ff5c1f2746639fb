"""Packing documents into sequences of one length by patterns.

Documents become pieces of at most ``length`` tokens. Only the histogram of piece lengths
reaches the driver (``length`` numbers at any size of the corpus). There, non-negative
least squares fits repeat counts of patterns of one to three lengths that fill a sequence
exactly; the counts are rounded, and what is left over is packed best fit, longest first.
Pieces of one length are numbered across the cluster and take the places of the plan in
that order.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import doc_texts
from wardline.sources.storage import written

LATIN_END = "\u0250"
SIGNS = ".,!"
ODD_SPACE = re.compile(r"[^\S \n]")


@dataclass(frozen=True)
class Settings:
    """``tokenizer`` and ``ranks`` are paths of the two forms of one vocabulary; None takes the public ones.

    ``group_rows`` is the number of pieces of one length that one task numbers at a time.
    ``memo`` bounds the words that a worker remembers.
    """

    length: int = 1024
    end_id: int = 2
    tokenizer: str | None = None
    ranks: str | None = None
    group_rows: int = 10_000
    memo: int = 300_000


# ---------------------------------------------------------------- tokens


class _Words(dict):
    """Token ids (little-endian, 32 bits) of words that stand after ``lead``; learned as words are met.

    A word of Latin letters, digits and signs goes to the faster of two libraries that
    encode this vocabulary alike; any other goes to the one that defines the ids. A sign
    after a letter is a token of its own, so the word without it is looked up first.
    """

    def __init__(self, lead: str, tokens: Tokens, bound: int):
        super().__init__()
        self.lead, self.tokens, self.bound = lead, tokens, bound

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in SIGNS and word[-2:-1].isalpha():
            found = self[word[:-1]] + self.tokens.signs[word[-1]]
        else:
            found = self.tokens.word(self.lead + word)
        if len(self) < self.bound:  # the first words met are the frequent ones
            self[word] = found
        return found


class Tokens:
    """Ids of whole texts.

    The vocabulary splits a text before each space that stands between two other
    characters, and on both sides of such a line feed, whatever stands around. A text in
    which every white space is one of these is put together from its words; any other is
    encoded in one go.
    """

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None, memo: int = 300_000):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.piece = getattr(self.fast, "_encode_single_piece", self.fast.encode_ordinary)
        self.signs = {sign: self.word(sign) for sign in SIGNS}
        self.spaced, self.bare = _Words(" ", self, memo), _Words("", self, memo)
        self.line_feed = self.word("\n")

    def plain(self, text: str) -> bool:
        """Is all white space one space or line feed between two other characters?"""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text or text[0].isspace() or text[-1].isspace():
            return False
        return all(map(str.isprintable, text.split("\n"))) or not ODD_SPACE.search(text)

    def word(self, text: str) -> bytes:
        if text.isascii() or max(text) < LATIN_END:
            if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                return array("I", self.piece(text)).tobytes()  # one cut of the pattern
            if "<|" not in text:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        parts = []
        spaced, bare, feed = self.spaced.__getitem__, self.bare, self.line_feed
        for line in text.split("\n"):
            words = line.split(" ")
            parts += feed, bare[words[0]]
            parts.extend(map(spaced, words[1:]))
        return b"".join(parts[1:])


@cache
def _tokens(settings: Settings) -> Tokens:
    """One for each worker process."""
    return Tokens(settings.tokenizer, settings.ranks, settings.memo)


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than ``length``."""
    head = total % length or min(total, length)
    return [(0, head), *((at, length) for at in range(head, total, length))]


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(settings: Settings, with_ids: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(settings)
        end = np.array([settings.end_id], "<u4").tobytes()
        for batch in batches:
            rows, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = tokens.encode(text.as_py()) + end
                view = memoryview(body)
                for n, (start, size) in enumerate(cut(len(body) // 4, settings.length)):
                    part = view[4 * start : 4 * (start + size)]
                    rows.append((doc, n, start, size, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return make


def pieces(docs: DataFrame, settings: Settings = Settings(), with_ids: bool = False) -> DataFrame:
    """The pieces of every document, on demand with their token ids.

    Whole texts are encoded; a null or empty text is its end token alone.
    """
    return doc_texts(docs).mapInArrow(_pieces(settings, with_ids), PIECE + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- plan


def full_patterns(present: np.ndarray, length: int) -> np.ndarray:
    """All ways to fill ``length`` with two or three of the lengths ``present``; rows of three, 0 for none."""
    have = np.zeros(length + 1, bool)
    have[present] = True
    a, b = np.meshgrid(present, np.append(0, present), indexing="ij")
    c = length - a - b
    use = (a >= b) & (c >= a) & (c < length)
    use &= have[np.where(use, c, 0)]
    return np.stack([c[use], a[use], b[use]], axis=1)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 40, at_once: int = 64) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern to meet the histogram.

    An active-set method: the patterns most wanted by the residual enter, several with no
    length in common at a time, and those that turn negative leave. It works on the normal
    equations of the patterns in use, which are at most as many as there are lengths.
    Long pieces weigh more, for short ones find a place anywhere.
    """
    size = len(histogram)
    weight = 0.1 + np.arange(size) / size
    weight[0] = 0
    target = histogram * weight
    x = np.zeros(len(patterns))
    used = np.zeros(0, np.int64)
    basis, normal = np.zeros((0, size)), np.zeros((0, 0))
    scale = max(1e-9, float(target.max()))

    def rows(which: list[int]) -> np.ndarray:
        out = np.zeros((len(which), size))
        for slot in range(3):
            np.add.at(out, (np.arange(len(which)), patterns[which, slot]), 1)
        return out * weight

    for _ in range(rounds if len(patterns) else 0):
        residual = (target - x[used] @ basis) * weight  # weight[0] = 0: an empty slot adds nothing
        wanted = residual[patterns[:, 0]] + residual[patterns[:, 1]] + residual[patterns[:, 2]]
        wanted[used] = 0
        top = np.argpartition(-wanted, min(len(wanted), 40 * at_once) - 1)[: 40 * at_once]
        new, taken = [], np.zeros(size, bool)
        for p in top[np.argsort(-wanted[top])]:
            lengths = [v for v in patterns[p] if v]
            if wanted[p] <= 1e-4 * scale or len(new) == at_once:
                break
            if not taken[lengths].any():
                new.append(int(p))
                taken[lengths] = True
        if not new:
            break
        added = rows(new)
        own = added @ added.T + 1e-9 * np.eye(len(new))
        side = basis @ added.T
        used, basis = np.append(used, new), np.concatenate([basis, added])
        normal = np.block([[normal, side], [side.T, own]])
        while len(used):
            best = np.linalg.solve(normal, basis @ target)
            if best.min() >= 0:
                x[used] = best
                break
            now = x[used]
            down = best < 0
            step = (now[down] / np.maximum(now[down] - best[down], 1e-300)).min()
            moved = now + step * (best - now)
            stay = ~(down & (moved <= 1e-9 * scale))
            x[used] = np.where(stay, np.maximum(moved, 0), 0)
            used, basis, normal = used[stay], basis[stay], normal[np.ix_(stay, stay)]
    return x


def best_fit(histogram: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: equal sequences are filled together."""
    groups: dict[int, list[list]] = {}  # free tokens -> [pattern, count]
    free: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(free, room)
        groups[room].append([pattern, count])

    for size in range(length, 0, -1):
        left = int(histogram[size])
        while left:
            at = bisect.bisect_left(free, size)
            if at < len(free):
                room = free[at]
                pattern, count = groups[room][-1]
                n = min(left, count)
                if n == count:
                    groups[room].pop()
                    if not groups[room]:
                        del groups[room], free[at]
                else:
                    groups[room][-1][1] -= n
                put(room - size, (*pattern, size), n)
                left -= n
            else:
                each = length // size
                if left >= each:
                    n = left // each
                    put(length - each * size, (size,) * each, n)
                    left -= n * each
                else:
                    put(length - left * size, (size,) * left, 1)
                    left = 0
    return [(p, n) for rows in groups.values() for p, n in rows]


def make_plan(histogram: np.ndarray, length: int, filler: int = 32) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences); every piece has one place.

    Pieces below ``filler`` tokens are kept out of the patterns: they fill the gaps of the
    residual. Counts are rounded down, so that no pattern takes the pieces of another.
    """
    left = histogram.astype(np.int64).copy()
    plan = []
    if left[length]:
        plan.append(((length,), int(left[length])))
        left[length] = 0
    present = np.flatnonzero(left)
    patterns = full_patterns(present[present >= filler], length)
    counts = fit_counts(patterns, left.astype(float))
    for p in np.argsort(-counts, kind="stable"):
        sizes, need = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
        if (n := min(int(counts[p]), *(left[sizes] // need).tolist())) > 0:
            left[sizes] -= n * need
            plan.append((tuple(int(v) for v in patterns[p] if v), n))
        elif counts[p] < 1:
            break
    return plan + best_fit(left, length)


@dataclass(frozen=True)
class Places:
    """The plan by piece length: where the n-th piece of a length goes."""

    first: np.ndarray  # length << 40 | number of the first piece
    sequence: np.ndarray
    slots: np.ndarray
    start: np.ndarray  # of the offsets of the slots
    offsets: np.ndarray


def places(plan: list[tuple[tuple[int, ...], int]]) -> Places:
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in plan:
        ends = np.cumsum(pattern)
        for size in sorted(set(pattern)):
            offsets = [int(e - size) for e, v in zip(ends, pattern, strict=True) if v == size]
            rows.append((size << 40 | seen.get(size, 0), sequence, len(offsets), offsets))
            seen[size] = seen.get(size, 0) + count * len(offsets)
        sequence += count
    rows.sort(key=lambda r: r[0])
    slots = np.array([r[2] for r in rows], np.int64)
    flat = np.array([o for r in rows for o in r[3]], np.int64)
    return Places(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), slots, np.cumsum(slots) - slots, flat)


def _placed(found: Places):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(found.first, length << 40 | rank, "right") - 1
            nth = rank - (found.first[at] & ((1 << 40) - 1))
            sequence = found.sequence[at] + nth // found.slots[at]
            offset = found.offsets[found.start[at] + nth % found.slots[at]]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def pack(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` of ``pieces`` with ``sequence_id`` and ``offset``.

    Pieces of a length are numbered in groups by a hash, so that a length that a third of
    all pieces have is no single task's work. Rows equal in everything may change places;
    the result is the same.
    """
    rows = written(rows)
    histogram = np.zeros(settings.length + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    found = places(make_plan(histogram, settings.length))
    groups = max(64, int(-(-histogram.max() // settings.group_rows)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(order))
        .join(base, ["length", "part"])
        .select(*rows.columns, (F.col("base") + F.col("nth") - 1).alias("rank"))
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.mapInArrow(_placed(found), f"{kept}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces that carry ``ids``; a sequence is one group of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op1_best_fit_packing(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Where each piece of every document goes, over all rows of ``docs`` (doc_id, text).

    Empty tables give no rows. Null and empty texts are a piece of one token. Rows that
    repeat are packed each by itself.
    """
    return pack(pieces(docs, settings), settings)
