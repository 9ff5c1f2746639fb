"""Whitening of embeddings from exact integer cross-products.

Entries become integers. Rows are packed 64 to a word: each dimension, shifted so that none
is negative, is a stack of bit planes, and the sum of products of two dimensions is the
weighted number of bits that their planes share. Sums are exact integers, centred before
anything is rounded; only then come eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import reachable
from wardline.sources.storage import fresh_dir, remove_dir

SCALE = 256
ROWS = 8192  # rows whose bit planes are in memory at a time
LONG = (1 << 63) - 1
LIMB = 96  # bits of the lower of the two numbers a sum travels as
WIDEST = 10**38 - 1  # of a decimal(38, 0)


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` distinct vectors with sums ``sums``.

    ``axes`` has a row for each component, its eigenvector over the root of its eigenvalue;
    ``defined`` is false, and the row zero, where the eigenvalue is zero.
    """

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    explained: tuple[float | None, ...]
    defined: tuple[bool, ...]
    identity_error: float | None = None


# ---------------------------------------------------------------- cross-products of a block


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Non-negative integers (rows x dimensions) as dimensions x bits x words, 64 rows to a word."""
    rows, dims = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    planes = np.zeros((dims, bits, -(-rows // 64) * 8), np.uint8)
    for b in range(bits):
        on = ((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[:, b, : -(-rows // 8)] = np.packbits(on, axis=0).T
    return planes.view(np.uint64)


def plane_products(planes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of the dimensions of :func:`bit_planes`, as exact integers.

    One plane is ANDed with all planes of its own and the later dimensions; a count of
    shared bits weighs two to the power of the two bits together.
    """
    dims, bits, _ = planes.shape
    fits = 2 * bits + rows.bit_length() < 63
    weight = np.array([1 << b for b in range(bits)], np.int64 if fits else object)
    own = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    sums = own.astype(weight.dtype) @ weight
    products = np.zeros((dims, dims), weight.dtype)
    for d in range(dims):
        for b in range(bits):
            shared = np.bitwise_count(planes[d:] & planes[d, b]).sum(axis=2, dtype=np.int64)
            products[d, d:] += weight[b] * (shared.astype(weight.dtype) @ weight)
    products = products.astype(object)
    upper = np.triu(products, 1)
    return sums.astype(object), products + upper.T


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of signed 64-bit integers (rows x dimensions).

    Each dimension is shifted by its least value, and the sums are shifted back.
    """
    least = x.min(axis=0)
    shifted = x.view(np.uint64) - least.view(np.uint64)  # below 2**64, also where the signed difference is not
    sums, products = plane_products(bit_planes(shifted), len(x))
    m = least.astype(object)
    return sums + len(x) * m, products + np.outer(m, sums) + np.outer(sums, m) + len(x) * np.outer(m, m)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ROWS rows, with their vectors as rows x dimensions."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.ascontiguousarray(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _scatter(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's number of rows (row -1), sums (column -1) and products, each as two decimals."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for _, x in _blocks(batches, 0, dims):
            s, p = block_sums(x)
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *sums, *products[i, j]]
            decimal = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *range(dims), *i], pa.int32()),
                    pa.array([-1, *[-1] * dims, *j], pa.int32()),
                    pa.array([Decimal(v >> LIMB) for v in values], decimal),
                    pa.array([Decimal(v & ((1 << LIMB) - 1)) for v in values], decimal),
                ],
                ["i", "j", "high", "low"],
            )

    return scatter


# ---------------------------------------------------------------- fit


def components_of(n: int, sums: list[int], products: dict[tuple[int, int], int], count: int) -> Whitening:
    """The first ``count`` components from exact sums; the covariance is centred as integers."""
    dims = len(sums)
    covariance = np.zeros((dims, dims))
    for (i, j), value in products.items():
        covariance[i, j] = covariance[j, i] = (n * value - sums[i] * sums[j]) / n**2
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count], vectors[:, ::-1].T[:count]
    trace = float(np.trace(covariance))
    defined = values > dims * np.finfo(float).eps * max(trace, 0.0)
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    axes = np.where(defined[:, None], vectors * sign[:, None] / np.sqrt(np.where(defined, values, 1.0))[:, None], 0.0)
    explained = tuple(float(max(0.0, v) / trace) if trace > 0 else None for v in values)
    return Whitening(n, tuple(sums), axes, explained, tuple(bool(d) for d in defined))


def centred(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """n x - S, exactly: 64-bit integers where they suffice, else Python's."""
    bound = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if fitted.n * bound + max(abs(s) for s in fitted.sums) <= LONG:
        return fitted.n * x - np.array(fitted.sums, np.int64)
    return fitted.n * x.astype(object) - np.array(fitted.sums, object)


def deviations(deviation: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    bound = max(abs(int(deviation.max(initial=0))), abs(int(deviation.min(initial=0))))
    exact = deviation if deviation.shape[1] * bound**2 <= LONG else deviation.astype(object)
    return [int(v) for v in (exact * exact).sum(axis=1)]


def whitened(deviation: np.ndarray, fitted: Whitening) -> np.ndarray:
    """Components x rows. Each row is summed alone, so that equal vectors give equal numbers."""
    away = np.ascontiguousarray(deviation.astype(float) / fitted.n)
    return np.stack([(away * axis).sum(axis=1) for axis in fitted.axes])


def _moments(fitted: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums (column -1) and sums of products of whitened vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.axes)
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, 0, len(fitted.sums)):
            w = whitened(centred(x, fitted), fitted)
            sums += w.sum(axis=1)
            products += w @ w.T
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*range(k), *i], pa.int32()),
                pa.array([*[-1] * k, *j], pa.int32()),
                pa.array(np.concatenate([sums, products.ravel()])),
            ],
            ["i", "j", "value"],
        )

    return moments


def identity_error(vectors: DataFrame, fitted: Whitening) -> float | None:
    """Largest entry by which the covariance of the whitened vectors differs from the identity.

    Measured on the vectors themselves, in a pass of their own. Components without spread
    do not count; None if there is no other.
    """
    on = [k for k, d in enumerate(fitted.defined) if d]
    if not on:
        return None
    found = vectors.mapInArrow(_moments(fitted), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    value = {(r["i"], r["j"]): r["value"] / fitted.n for r in found.collect()}
    return max(abs(value[i, j] - value[i, -1] * value[j, -1] - (i == j)) for i in on for j in on)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): entries as floor(256 c). Vectors that are null or have null or non-finite entries are dropped.

    Entries beyond a long are held to its range.
    """
    infinity = float("inf")
    usable = F.forall("c", lambda c: F.coalesce((c < infinity) & (c > -infinity), F.lit(False)))
    return (
        embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
        .filter(F.col("c").isNotNull() & usable)
        .select("vec_id", F.transform("c", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("bigint")).alias("x"))
    )


def fit(rows: DataFrame, dims: int, count: int) -> Whitening:
    """A fit to the distinct vectors among ``rows`` (column ``x``, all of ``dims`` entries).

    Copies of a vector merge before the shuffle. The distinct vectors are written once and
    read twice, for the cross-products and for the check. The driver gets the sums and
    products of dimensions, whose number does not depend on the rows.
    """
    spark = rows.sparkSession
    path = fresh_dir(spark, "whitening")
    try:
        rows.select("x").distinct().write.parquet(path)
        vectors = spark.read.parquet(path)
        total = [F.sum(c).alias(c) for c in ("high", "low")]
        sums = vectors.mapInArrow(_scatter(dims), "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(*total)
        value = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in sums.collect()}
        n = value.pop((-1, -1))
        fitted = components_of(n, [value.pop((d, -1)) for d in range(dims)], value, count)
        return replace(fitted, identity_error=identity_error(vectors, fitted))
    finally:
        remove_dir(spark, path)


# ---------------------------------------------------------------- result

_RESULT = {
    "vec_id": "long",
    "component": "int",
    "n": "long",
    "deviation": "long",
    "whitened": "double",
    "explained": "double",
    "identity_error": "double",
    "deviation_exact": "decimal(38,0)",
}
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _RESULT.items())


def _rows_of(fitted: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(fitted.axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, len(fitted.sums)):
            deviation = centred(x, fitted)
            squares = deviations(deviation)
            rows = part.num_rows
            values = whitened(deviation, fitted).T
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fitted.n, np.int64)),
                    pa.array([s if s <= LONG else None for s in squares], pa.int64()).take(pa.array(each)),
                    pa.array(values.ravel(), pa.float64(), mask=~np.tile(np.array(fitted.defined), rows)),
                    pa.array(list(fitted.explained) * rows, pa.float64()),
                    pa.array([fitted.identity_error] * (rows * k), pa.float64()),
                    pa.array([Decimal(s) if s <= WIDEST else None for s in squares], pa.decimal128(38, 0)).take(pa.array(each)),
                ],
                list(_RESULT),
            )

    return project


def op13_whitening(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Each vector on the leading components of the distinct ones, whitened; see ``integer_vectors`` for what is dropped.

    One row for each remaining row and component, repeated vectors and numbers and null
    numbers included. Vectors have as many entries as most of them (the longer ones of two
    equally frequent lengths); rows of another length, empty ones included, have no place
    among these dimensions and are left out. A component without spread has null
    ``whitened`` and explains 0; with a single distinct vector ``explained`` and
    ``identity_error`` are null. ``deviation`` is null where it does not fit a long, as may
    happen from a few million vectors on; ``deviation_exact`` has it up to 38 digits. An
    empty table gives no row. Columns beside ``vec_id`` and ``embedding`` are not read.
    """
    reachable(embeddings.sparkSession)
    rows = integer_vectors(embeddings)
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).filter("dims > 0")
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return embeddings.sparkSession.createDataFrame([], _SCHEMA)
    rows = rows.filter(F.size("x") == most["dims"])
    return rows.mapInArrow(_rows_of(fit(rows, most["dims"], min(components, most["dims"]))), _SCHEMA)
