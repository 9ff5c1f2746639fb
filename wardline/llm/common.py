"""What the operators of this package share."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"


def reachable(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers look for this package where the driver found it, too.

    On a cluster ship the package (``--py-files``); where that folder is not there, nothing changes.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return spark


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` (bigint) and ``text`` of every row, a null text as the empty one.

    Columns are taken by these two names; whatever else the table has is not read.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, LOWER.upper(), LOWER)


def crc_held_out(doc_id: Column) -> Column:
    """One document in five, by the checksum of its number as text; false for a null number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


FULL_SHARE = 1 << 40


def hash_share(spread: Column, share: Column) -> Column:
    """True for about the ``share`` (0 to 1) of all hashes; the same ones on every run and every partitioning."""
    return F.pmod(spread, F.lit(FULL_SHARE)) < F.least(share, F.lit(1.0)) * FULL_SHARE


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, laid end to end, and the n + 1 offsets."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]
