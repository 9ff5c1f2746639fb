"""The query log as it is stored: loaded in parts that may overlap, read as one.

A load is a partition below the days it has queries of. Loads never touch each other's
files; a reader keeps, of a query that several loads have, the row of the last one. Most
days came in one load, or were settled into one, and are read as they are.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.sources import schemas
from wardline.sources.storage import Folder

DAY, LOAD = schemas.LOG_DATE, schemas.LOAD
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
QUERY = [DAY, "query_id"]


def loads_by_day(spark: SparkSession, path: str) -> dict[date | None, list[int]]:
    """The numbers of the loads each stored day has, from the names of folders alone."""
    found: dict[date | None, list[int]] = {}
    for name in Folder(spark, path).folders(f"{DAY}=*/{LOAD}=*"):
        day, load = (part.partition("=")[2] for part in name.split("/"))
        found.setdefault(None if day == NO_DAY else date.fromisoformat(day), []).append(int(load))
    return {day: sorted(loads) for day, loads in found.items()}


def write_query_history(history: DataFrame, path: str, load: int | None = None) -> int:
    """Add a load of the log to ``path``; returns its number, the next free one unless given.

    Days may come in any number of loads: a query that several have is read as the last of
    them has it, so that a log loaded twice counts once, and a late part of a day adds to
    it. A load written again under its own number replaces itself. The accessed objects are
    parsed here, once, and stored as an array: parsing JSON is the dearest part of every
    report on objects. The rebalance hint gathers a day's rows and lets AQE cut a busy day
    into files of the advisory size. Rows are parsed behind it: a compressed log is read in
    few splits, and the texts are dealt out to all cores first.
    """
    if load is None:
        load = max((max(loads) for loads in loads_by_day(history.sparkSession, path).values()), default=0) + 1
    rows = history.withColumn(DAY, F.col("start_time").cast("date")).hint("rebalance", DAY)
    _write(rows.withColumn("objects_accessed", F.from_json("objects_accessed", schemas.OBJECTS_ACCESSED)), path, load)
    return load


def _write(rows: DataFrame, path: str, load: int) -> None:
    (
        rows.withColumn(LOAD, F.lit(load))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, LOAD)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STORED_QUERY_HISTORY).parquet(path)


def merged_loads(rows: DataFrame) -> DataFrame:
    """Of the rows of a query id and day those of its last load; of several there the last to start.

    Only ids and numbers of loads are shuffled to find the queries that stand more than
    once; whole rows meet that list by a join, which AQE turns into a broadcast where the
    list is small. Of a query that two loads have once each, the older row goes by that join;
    only rows that may stand twice in the last load are compared. Rows without a query id
    all stay.
    """
    again = (
        rows.filter("query_id is not null")
        .groupBy(*QUERY)
        .agg(F.max(LOAD).alias("last"), F.min(LOAD).alias("first"), F.count("*").alias("found"))
        .filter("found > 1")
        .withColumn("compared", F.expr("found > 2 or first = last"))
        .select(*(F.col(c).alias(f"again_{c}") for c in QUERY), "last", "compared")
    )
    same = (F.col(DAY) == F.col(f"again_{DAY}")) & (F.col("query_id") == F.col("again_query_id"))
    alone = rows.join(again, same & ((F.col(LOAD) < F.col("last")) | F.col("compared")), "left_anti")
    order = Window.partitionBy(*QUERY).orderBy(F.desc("start_time"), F.xxhash64(*(c for c in rows.columns if c not in (DAY, LOAD))))
    # >= and not =, though no load is later: a key of the join would have the list shuffled once more
    last = (
        rows.join(again.filter("compared"), same & (F.col(LOAD) >= F.col("last")), "left_semi")
        .withColumn("nth", F.row_number().over(order))
        .filter("nth = 1")
        .drop("nth")
    )
    return alone.unionByName(last)


def read_query_history(spark: SparkSession, path: str) -> DataFrame:
    """The log in ``path``, each query once.

    A filter on the day reaches the scan of either part as a partition filter. Which days
    have several loads is looked up when this is called, from folder names. Queries without
    a start have no day: no report has them, and they are not merged.
    """
    stored = _stored(spark, path)
    several = [day for day, loads in loads_by_day(spark, path).items() if len(loads) > 1 and day is not None]
    columns = [c for c in stored.columns if c != LOAD]
    if not several:
        return stored.select(*columns)
    open_days = F.coalesce(F.col(DAY).isin(several), F.lit(False))
    return stored.filter(~open_days).unionByName(merged_loads(stored.filter(open_days))).select(*columns)


def settle_query_history(spark: SparkSession, path: str) -> int:
    """Rewrite every day of several loads as one load; returns how many days there were.

    The merged rows are one more load with a number of its own, so that readers get the
    same rows before, during and after; the older loads go when it is complete. A crash in
    between leaves days of several loads, which are read right and settled the next time.
    """
    by_day = loads_by_day(spark, path)
    several = {day: loads for day, loads in by_day.items() if len(loads) > 1 and day is not None}
    if several:
        number = max(max(loads) for loads in by_day.values()) + 1
        rows = merged_loads(_stored(spark, path).filter(F.col(DAY).isin(list(several)))).drop(LOAD)
        _write(rows.hint("rebalance", DAY), path, number)
        folder = Folder(spark, path)
        for day, loads in several.items():
            for load in loads:
                folder.remove(f"{DAY}={day.isoformat()}/{LOAD}={load}")
    return len(several)
