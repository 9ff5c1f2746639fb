"""Who used which object on which day: kept beside a stored log and renewed for changed days.

A day's facts are small, mergeable rows. Reports on a long window add them up instead of
taking every query's accessed objects apart again; days the facts do not cover, and the
parts of days at the edges of a window, come from the log. What a report gets does not
depend on when the facts were renewed.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources import schemas
from wardline.sources.query_log import loads_by_day, read_query_history
from wardline.sources.storage import Folder

DAY, UP_TO = schemas.LOG_DATE, "up_to_load"
KEY = ["database_name", "schema_name", "table_name", "role_name", "user_name"]
FACTS = f"""{", ".join(f"{k} string" for k in KEY)}, mentions bigint, queries bigint, read_write_queries bigint,
    after_hours_selects bigint, last_accessed timestamp_ntz, last_read_write timestamp_ntz, {DAY} date, {UP_TO} int"""


def object_facts(history: DataFrame, names: Column, read_write: Column, after_hours_select: Column) -> DataFrame:
    """A log added up per day, object, role and user.

    ``names`` are the objects of a query. ``mentions`` counts every time an object stands
    there, the other figures count queries. An object that a query names twice is told
    apart in the row, by the place it first has there, so nothing later has to be distinct
    over queries. Everything merges on the map side.
    """
    start = F.col("start_time")
    first = F.array_position("names", F.col("table_name")) == F.col("place") + 1
    return (
        history.select(
            "database_name",
            "schema_name",
            "role_name",
            "user_name",
            "start_time",
            start.cast("date").alias(DAY),
            F.coalesce(read_write, F.lit(False)).alias("read_write"),
            F.coalesce(after_hours_select, F.lit(False)).alias("after_hours"),
            names.alias("names"),
        )
        # outer: of the inner form Spark infers a filter on names, which parses JSON text once more
        .select("*", F.posexplode_outer("names").alias("place", "table_name"))
        .filter("table_name is not null")
        .withColumn("first", first)
        .groupBy(DAY, *KEY)
        .agg(
            F.count("*").alias("mentions"),
            F.count_if("first").alias("queries"),
            F.count_if(F.col("read_write") & F.col("first")).alias("read_write_queries"),
            F.count_if(F.col("after_hours") & F.col("first")).alias("after_hours_selects"),
            F.max("start_time").alias("last_accessed"),
            F.max(F.when(F.col("read_write"), start)).alias("last_read_write"),
        )
    )


class StoredFacts:
    """The facts in ``path`` of the log in ``log``; ``count`` makes facts of a log's rows.

    A partition is a day and the number of the last load it takes account of. A day is
    covered if no later load has rows of it.
    """

    def __init__(self, spark: SparkSession, log: str, path: str, count):
        self.spark, self.log, self.path, self.count = spark, log, path, count

    def _partitions(self) -> dict[date, list[int]]:
        found: dict[date, list[int]] = {}
        for name in Folder(self.spark, self.path).folders(f"{DAY}=*/{UP_TO}=*"):
            day, load = (part.partition("=")[2] for part in name.split("/"))
            found.setdefault(date.fromisoformat(day), []).append(int(load))
        return found

    def _loaded(self) -> dict[date, int]:
        return {day: max(loads) for day, loads in loads_by_day(self.spark, self.log).items() if day is not None}

    def covered(self) -> dict[date, int]:
        """The days whose facts are complete, with the number of the partition that has them."""
        loaded = self._loaded()
        newest = {day: max(numbers) for day, numbers in self._partitions().items()}
        return {day: number for day, number in newest.items() if number >= loaded.get(day, 0)}

    def refresh(self) -> list[date]:
        """Renew the facts of days that have had a load since; returns these days.

        The new facts of a day stand beside the old ones until they are complete: a crash
        leaves both, and the newer ones count.
        """
        loaded, covered = self._loaded(), self.covered()
        stale = sorted(day for day in loaded if day not in covered)
        if not stale:
            return []
        number = max(loaded.values())
        log = read_query_history(self.spark, self.log).filter(F.col(DAY).isin(stale))
        (
            self.count(log)
            .withColumn(UP_TO, F.lit(number))
            .hint("rebalance", DAY)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DAY, UP_TO)
            .parquet(self.path)
        )
        folder, found = Folder(self.spark, self.path), self._partitions()
        for day in stale:
            for older in found.get(day, []):
                if older < number:
                    folder.remove(f"{DAY}={day.isoformat()}/{UP_TO}={older}")
        return stale

    def between(self, start: datetime | None, end: datetime | None, rest: DataFrame) -> DataFrame:
        """Facts of the time from ``start`` to ``end``, both included; ``rest`` is the log of that time.

        Whole covered days come from the stored facts, everything else from ``rest``, with
        the days it is not needed for as a filter that prunes its partitions.
        """
        whole = {
            day: number
            for day, number in self.covered().items()
            if (start is None or datetime.combine(day, datetime.min.time()) >= start)
            and (end is None or datetime.combine(day + timedelta(days=1), datetime.min.time()) <= end)
        }
        if not whole:
            return self.count(rest)
        older = [(day, n) for day, numbers in self._partitions().items() for n in numbers if day in whole and n < whole[day]]
        facts = self.spark.read.schema(FACTS).parquet(self.path).filter(F.col(DAY).isin(list(whole)))
        for day, number in older:  # what a crash left
            facts = facts.filter(~((F.col(DAY) == F.lit(day)) & (F.col(UP_TO) == number)))
        others = rest.filter(~F.coalesce(F.col(DAY).isin(list(whole)), F.lit(False)))
        return facts.drop(UP_TO).unionByName(self.count(others))
