"""Near copies by SimHash, found with keys from the binary Golay code.

A 64-bit fingerprint has four segments of 16 bits. Two fingerprints that differ in at
most three bits either agree in two segments, or agree in one and differ in exactly one
bit of each of the others. The first case is met by the six pairs of segments as keys;
the second by four keys of one segment and the Golay codeword index of the next: one
fingerprint gives the index of its own segment, the other the indices of all segments one
bit away. The code is perfect (every word of 23 bits lies within three bits of exactly
one codeword), so these are at most six indices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import doc_texts
from wardline.llm.components import components
from wardline.sources.storage import written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENT_BITS = 16
PAIRS = tuple(combinations(range(4), 2))
BLOCK = 1 << 20  # bytes of a text at a time
BLANK = re.compile(rb"[\x09-\x0d\x20]")

# ---------------------------------------------------------------- fingerprints


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            blank = BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end].split()  # at ASCII white space only
        at = end


def _bit_counts(words: list[bytes], size: int) -> np.ndarray:
    """How often each bit is set in the hashes of the shingles of ``size`` words."""
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])])  # noqa: B905  the shorter ends it
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text over its shingles of three words; 0 without a word."""
    counts, total, words = np.zeros(64, np.int64), 0, []
    for block in _blocks(text.lower()):  # ASCII letters only
        words = words[-(SHINGLE - 1) :] + block if total else words + block
        if len(words) >= SHINGLE:
            counts += _bit_counts(words, SHINGLE)
            total += len(words) - SHINGLE + 1
    if not words:
        return 0
    if not total:
        counts, total = _bit_counts(words, len(words)), 1
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(batch.num_columns - 1)], np.uint64)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def fingerprints(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``rows``, the last one (the text, not null) replaced by ``fp``."""
    return rows.mapInArrow(_fingerprints, f"{schema}, fp bigint")


# ---------------------------------------------------------------- keys


@cache
def golay_indices() -> tuple[np.ndarray, np.ndarray]:
    """For each segment: the index of its codeword, and those of all segments one bit away.

    The second table has a column for each bit flipped and one for the segment itself;
    an index that was there before in the row is -1. Segments are words of 23 bits whose
    first seven are 0.
    """
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, generator << (bit - 11), 0)
        return words

    errors = np.array([sum(1 << b for b in some) for n in range(4) for some in combinations(range(23), n)])
    leader = np.zeros(1 << 11, np.int64)
    leader[remainder(errors)] = errors  # 2048 patterns, one for each remainder
    segments = np.arange(1 << SEGMENT_BITS)
    flipped = np.stack([segments, *[segments ^ (1 << b) for b in range(SEGMENT_BITS)]], axis=1)
    index = (flipped ^ leader[remainder(flipped)]) >> 11
    near = np.sort(index, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return index[:, 0], near


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> (SEGMENT_BITS * i) & 0xFFFF).astype(np.int64) for i in range(4)]


def index_keys(prints: np.ndarray) -> np.ndarray:
    """Ten keys for each fingerprint: six of two segments, four of a segment and an index."""
    s, (own, _) = _segments(prints), golay_indices()
    exact = [n << 40 | s[i] << 16 | s[j] for n, (i, j) in enumerate(PAIRS)]
    fuzzy = [6 + i << 40 | s[i] << 16 | own[s[(i + 1) % 4]] for i in range(4)]
    return np.stack([*exact, *fuzzy], axis=1)


def probe_keys(prints: np.ndarray) -> np.ndarray:
    """The same six, and four times the keys of all segments one bit away; -1 stands for none."""
    s, (_, near) = _segments(prints), golay_indices()
    exact = [(n << 40 | s[i] << 16 | s[j])[:, None] for n, (i, j) in enumerate(PAIRS)]
    fuzzy = [
        np.where(found < 0, -1, 6 + i << 40 | s[i][:, None] << 16 | found)
        for i in range(4)
        for found in [near[s[(i + 1) % 4]]]
    ]
    return np.concatenate([*exact, *fuzzy], axis=1)


def _emit(keys_of):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            keys = keys_of(prints.view(np.uint64))
            row, column = np.nonzero(keys >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, column]), pa.array(prints[row])], ["key", "fp"])

    return emit


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` <= 3 bits.

    A pair may come more than once. Candidates are compared inside the join; what does not
    link is never written.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find differences of up to {MAX_BITS} bits")
    left = prints.mapInArrow(_emit(index_keys), "key bigint, fp bigint").withColumnRenamed("fp", "a")
    right = prints.mapInArrow(_emit(probe_keys), "key bigint, fp bigint").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.hint("merge").join(right, (left.key == right.key) & (F.col("a") != F.col("b")) & near).select("a", "b")


def classes(members: DataFrame) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``members`` (doc_id, fp).

    ``root`` names the component. ``component_id`` is the least doc_id of all documents that links lead to. Documents of
    one fingerprint are one node, however many they are.
    """
    nodes = written(members.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(rooted.join(least, "root").select("fp", "root", "component_id"))


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    Empty and null texts have fingerprint 0 and are linked like any other. Repeated rows
    stay. A null doc_id counts for no component; a component of nothing else has a null id.
    """
    members = written(fingerprints(doc_texts(docs), "doc_id bigint"))
    return members.join(classes(members), "fp").select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns as they were: that of the least doc_id.

    Where that number stands more than once, the least fingerprint and then the least hash
    of the text decide; of rows equal in both, one stays. Only numbers and hashes are
    compared; texts move once, to meet the list of those that stay.
    """
    text = F.coalesce("text", F.lit(""))
    content = F.xxhash64(text)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content.alias("content"), text.alias("text"))
    members = written(fingerprints(narrow, "doc_id bigint, content bigint"))
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", "content", "doc_id")
    kept = members.join(classes(members.select("doc_id", "fp")), "fp").groupBy("root").agg(F.min(order).alias("kept"))
    stay = kept.select(F.col("kept.doc_id").alias("__doc_id"), F.col("kept.content").alias("__content"))
    names = docs.columns
    rows = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__text": content})
    found = rows.join(stay, F.col("__id").eqNullSafe(F.col("__doc_id")) & (F.col("__text") == F.col("__content")), "left_semi")
    return found.dropDuplicates(["__id", "__text"]).select(*names)


def all_keys(fp: int) -> set[int]:
    """Index keys of one fingerprint, for looking one up by hand."""
    return set(chain.from_iterable(index_keys(np.array([fp], np.uint64)).tolist()))
