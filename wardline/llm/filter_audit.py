"""What each of five filters removes, in every order they could be applied in.

A document fails some of the five filters, whatever the order. Its survival word has one
bit for each of the 32 subsets of filters, set if it survives that subset. Adding the
words up bit by bit, with carry-save adders on whole words, gives the survivors of every
subset; each of the 120 orders is then a walk through six subsets.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOL = re.compile(r"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")
BLOCK = 1 << 22  # characters of a text that are taken apart at a time
PARTS_AT_ONCE = 2000  # parts a task adds up before it passes sums on
#: For each set of failed filters the survival word: bit s is set if no failed filter is in subset s.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)

# ---------------------------------------------------------------- one document


def word_counts(text: str, block: int = BLOCK) -> tuple[int, int]:
    """Words and distinct words. A long text is taken in blocks; only its distinct words are kept."""
    if len(text) <= block:
        words = text.encode().split()  # bytes split at space and the five control signs, at nothing else
        return len(words), len(set(words))
    total, distinct, cut = 0, set(), b""
    for at in range(0, len(text), block):
        part = cut + text[at : at + block].encode()
        words = part.split()
        cut = words.pop() if words and not part[-1:].isspace() else b""
        total += len(words)
        distinct.update(words)
    return total + bool(cut), len(distinct | {cut}) if cut else len(distinct)


def failed_filters(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    words, distinct = word_counts(text)
    raw = text.encode()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * capitals > CAPITAL_PERCENT * len(text),
        SYMBOL.search(text) is not None,
    )
    return sum(bit << i for i, bit in enumerate(fails))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed = [failed_filters(text.as_py()) for text in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(failed, pa.int32())], ["doc_id", "part", "digest", "failed"])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of every row, ``failed`` having a bit for each filter A to E.

    A row is a copy (E) if a row with a smaller number has the same text, anywhere in the
    table. Rows of one number and text are not copies of each other; a row without a number
    is no copy and makes none. Texts stay where they are: their SHA-256 digests are shuffled,
    a group of copies leaves each task as one row, and the join back is by number and digest,
    so that no group of copies meets in one task.
    """
    text = F.coalesce("text", F.lit(""))
    number, digest = F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")
    rows = docs.select(number, F.coalesce("source", F.lit("")).alias("part"), digest, text.alias("text")).mapInArrow(
        _judge, "doc_id long, part string, digest binary, failed int"
    )
    first = (
        docs.select(number, digest)
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
        .filter("doc_id is not null")
        .withColumn("is_first", F.lit(True))
    )
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select(
        "doc_id", "part", F.col("failed").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("failed")
    )


# ---------------------------------------------------------------- counting


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three words in every bit position."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def positional_popcount(words: np.ndarray, rows: int = 64) -> np.ndarray:
    """How many of the words have each of the 32 bits set.

    The words are laid out in ``rows`` rows. Adders reduce the rows of one weight to a single
    row, passing carries on to the next weight; only the few rows that are left, one for
    each power of two, are taken apart into bits.
    """
    columns = -(-len(words) // rows)
    laid = np.zeros(rows * columns, np.uint32)
    laid[: len(words)] = words
    level, weight, total = list(laid.reshape(rows, columns)), 1, np.zeros(SUBSETS, np.int64)
    while level:
        carries = []
        while len(level) > 2:
            low, carry = _add(level.pop(), level.pop(), level.pop())
            level.append(low)
            carries.append(carry)
        if len(level) == 2:
            a, b = level
            level = [a ^ b]
            carries.append(a & b)
        bits = np.unpackbits(level[0].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.int64)
        level, weight = carries, weight * 2
    return total


LABELS = ("all", "good", "toxic")
_SURVIVORS = "part string, subset int, survivors long, good_survivors long, toxic_survivors long"


def _sums(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    parts = list(found)
    counts = np.concatenate([found[p] for p in parts], axis=1) if parts else np.zeros((3, 0), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p in parts for _ in range(SUBSETS)], pa.string()),
            pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(parts))),
            *(pa.array(c) for c in counts),
        ],
        ["part", "subset", "survivors", "good_survivors", "toxic_survivors"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of every subset per part, of all documents and of those with either label."""
    found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((len(LABELS), SUBSETS), np.int64))
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).dictionary_encode()
        code = parts.indices.to_numpy()
        words = WORDS[batch.column(1).to_numpy()]
        good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(parts.dictionary)))
        for name, rows in zip(parts.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True):
            own = words[rows]
            for i, chosen in enumerate((own, own[good[rows]], own[toxic[rows]])):
                found[name][i] += positional_popcount(chosen)
        if len(found) > PARTS_AT_ONCE:
            yield _sums(found)
            found.clear()
    yield _sums(found)


def survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, survivors, good_survivors, toxic_survivors) from (part, failed, good, toxic) rows.

    Tasks add their own rows up, 32 rows for each part; a hot part is a hot part nowhere.
    """
    sums = [F.sum(c).alias(c) for c in ("survivors", "good_survivors", "toxic_survivors")]
    return rows.select("part", "failed", "good", "toxic").mapInArrow(_count, _SURVIVORS).groupBy("part", "subset").agg(*sums)


# ---------------------------------------------------------------- orders

_STEPS = """part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,
    good_lost long, toxic_lost long, shapley long"""


def order_table(counts: np.ndarray) -> list[tuple]:
    """The 600 rows of a part, from its survivors (labels x subsets)."""
    every = SUBSETS - 1
    everyone = counts[0]
    walks = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            walks.append((order, step, f, after, [int(x) for x in counts[:, before] - counts[:, after]]))
            before = after
    shapley = [0] * len(FILTERS)
    for _, _, f, _, lost in walks:
        shapley[f] += lost[0]
    rows = []
    for order, step, f, after, (removed, good, toxic) in walks:
        failing = int(everyone[0] - everyone[1 << f])
        only = int(everyone[every ^ 1 << f] - everyone[every])
        name = "".join(FILTERS[i] for i in order)
        rows.append((name, step, int(everyone[after]), removed, failing - removed, only, good, toxic, shapley[f]))
    return rows


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros((len(LABELS), SUBSETS), np.int64)
            for found in row["found"]:
                counts[:, found["subset"]] = found["survivors"], found["good_survivors"], found["toxic_survivors"]
            columns = list(zip(*order_table(counts), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["part", *names],
            )


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every step of all 120 orders, per part; 600 rows a part.

    Parts are the values of ``source``, null as the empty string. A null text is empty: it
    has no word, so it fails A only, and E behind another empty one. A number that ``labels``
    has more than once counts as good, or toxic, if one of its rows says so; null labels say
    nothing, and rows without a number have no label. Repeated rows count as often as they
    stand there. An empty table gives no row. Very long texts are taken in blocks. Columns
    beside ``doc_id``, ``text``, ``source``, ``quality`` and ``toxic`` are not read.
    """
    said = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")
        .filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    rows = judged(docs).join(said, "doc_id", "left")
    labelled = rows.select("part", "failed", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    found = F.collect_list(F.struct("subset", "survivors", "good_survivors", "toxic_survivors")).alias("found")
    return survivors(labelled).groupBy("part").agg(found).mapInArrow(_expand, _STEPS)


def op12_sql() -> str:
    """The same rows by counting, for every order and step, the documents that get there."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
j AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  len({words}) < {LEAST_WORDS} AS a,
  100 * len(list_distinct({words})) < {DISTINCT_PERCENT} * len({words}) AS b,
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * len(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
f AS (SELECT part, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END
  || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails FROM j),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, good, toxic, fails,
  translate(substr(filter_order, 1, step - 1), fails, '') = substr(filter_order, 1, step - 1) AS here
  FROM n, o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (here AND NOT contains(fails, own)), 0) AS kept,
  coalesce(sum(n) FILTER (here AND contains(fails, own)), 0) AS removed,
  coalesce(sum(n) FILTER (NOT here AND contains(fails, own)), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (here AND contains(fails, own)), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (here AND contains(fails, own)), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""
