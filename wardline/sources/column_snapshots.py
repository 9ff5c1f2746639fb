"""Snapshots of the column catalogue, compared branch by branch.

A snapshot has its columns in a folder per schema, and beside them a digest of every table
and every schema. Two snapshots are compared from the top: schemas with equal digests are
not looked at again, in the others tables with equal digests are left out, and only the
columns of the remaining tables meet. A digest is a count and two sums of hashes, so it does
not depend on the order of the rows, merges on the map side, and a schema's is the sum of
its tables'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.sources import schemas

SCHEMA = ["table_catalog", "table_schema"]
TABLE = [*SCHEMA, "table_name"]
COLUMN = [*TABLE, "column_name"]
DIGEST = ["columns", "digest_1", "digest_2"]
SUMS = "columns bigint, digest_1 decimal(38,0), digest_2 decimal(38,0)"
TABLE_DIGESTS = f"{', '.join(f'{c} string' for c in TABLE)}, {SUMS}"
SCHEMA_DIGESTS = f"{', '.join(f'{c} string' for c in SCHEMA)}, {SUMS}"
CHANGES = f"{', '.join(f'{c} string' for c in COLUMN)}, change string, earlier_name string, earlier_type string, data_type string"

ADDED, REMOVED, RETYPED, RENAMED = "ADDED", "REMOVED", "RETYPED", "RENAMED"


def write_column_snapshot(columns: DataFrame, path: str) -> None:
    """Write a snapshot, in place of one that is there. The schemas' digests come last: without them it is none.

    A column that is listed twice is one, of the lesser type. Rows that lack a name are no columns.
    """
    spark = columns.sparkSession
    named = reduce(Column.__and__, (F.col(c).isNotNull() & (F.col(c) != "") for c in COLUMN))
    each = columns.filter(named).groupBy(*COLUMN).agg(F.min("data_type").alias("data_type"))
    # ranges of names: a task has few schemas, and a schema of many columns has several tasks
    each.repartitionByRange(*COLUMN).write.mode("overwrite").partitionBy(*SCHEMA).parquet(f"{path}/columns")
    content = ["table_name", "column_name", "data_type", F.col("data_type").isNull()]
    tables = (
        _columns(spark, path)
        .groupBy(*TABLE)
        .agg(
            F.count("*").alias("columns"),
            *(
                F.sum(F.xxhash64(F.lit(n), *SCHEMA, *content).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"digest_{n}")
                for n in (1, 2)
            ),
        )
    )
    tables.write.mode("overwrite").partitionBy(*SCHEMA).parquet(f"{path}/tables")
    sums = _tables(spark, path).groupBy(*SCHEMA).agg(*(F.sum(c).alias(c) for c in DIGEST))
    sums.select(*SCHEMA, "columns", *(F.col(c).cast("decimal(38,0)").alias(c) for c in DIGEST[1:])).write.mode(
        "overwrite"
    ).parquet(f"{path}/schemas")


def _columns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COLUMNS).parquet(f"{path}/columns")


def _tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_DIGESTS).parquet(f"{path}/tables")


def _schemas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA_DIGESTS).parquet(f"{path}/schemas")


def _changed(earlier: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose digests differ, or that only one side has."""
    sides = [side.select(*key, F.struct(*DIGEST).alias(name)) for side, name in ((earlier, "before"), (later, "after"))]
    return sides[0].join(sides[1], key, "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select(*key)


def changed_schemas(spark: SparkSession, earlier: str, later: str) -> DataFrame:
    """``(table_catalog, table_schema)`` of the schemas that differ between two snapshots."""
    return _changed(_schemas(spark, earlier), _schemas(spark, later), SCHEMA)


def column_changes(spark: SparkSession, earlier: str, later: str) -> DataFrame:
    """Columns added, removed, of another type, or renamed between two snapshots.

    A column is renamed if, of its type, its table lost one column and got one; where there
    are more, they are added and removed. The changed schemas' names come to the driver, which
    lists their folders: folders of other schemas are not opened. Equal snapshots have no rows.
    """
    by_catalog: dict[str, list[str]] = {}
    for row in changed_schemas(spark, earlier, later).collect():
        by_catalog.setdefault(row.table_catalog, []).append(row.table_schema)
    if not by_catalog:
        return spark.createDataFrame([], CHANGES)
    within = reduce(
        Column.__or__,
        ((F.col(SCHEMA[0]) == c) & F.col(SCHEMA[1]).isin(names) for c, names in sorted(by_catalog.items())),
    )
    tables = _changed(*(_tables(spark, path).filter(within) for path in (earlier, later)), TABLE)
    before, after = (
        _columns(spark, path)
        .filter(within)
        .join(tables, TABLE, "left_semi")
        .select(*COLUMN, F.col("data_type").alias(kind), F.lit(True).alias(there))
        for path, kind, there in ((earlier, "earlier_type", "was"), (later, "data_type", "is"))
    )
    change = (
        F.when(F.col("was").isNull(), ADDED)
        .when(F.col("is").isNull(), REMOVED)
        .when(~F.col("earlier_type").eqNullSafe(F.col("data_type")), RETYPED)
    )
    found = before.join(after, COLUMN, "full").withColumn("change", change).filter("change IS NOT NULL")
    # at most the columns of one table, of one type, are together
    alike = Window.partitionBy(*TABLE, F.coalesce("data_type", "earlier_type"))
    added, removed = (F.col("change") == kind for kind in (ADDED, REMOVED))
    one_for_one = (F.count_if(added).over(alike) == 1) & (F.count_if(removed).over(alike) == 1) & (added | removed)
    lost = F.when(removed, F.struct("column_name", "earlier_type"))
    marked = found.withColumn("renamed", one_for_one).withColumn("lost", F.max(lost).over(alike))
    renamed = F.col("renamed")
    return marked.filter(~(renamed & removed)).select(
        *COLUMN,
        F.when(renamed, RENAMED).otherwise(F.col("change")).alias("change"),
        F.when(renamed, F.col("lost.column_name")).when(~added, F.col("column_name")).alias("earlier_name"),
        F.when(renamed, F.col("lost.earlier_type")).otherwise(F.col("earlier_type")).alias("earlier_type"),
        "data_type",
    )


def new_columns(spark: SparkSession, earlier: str, later: str) -> DataFrame:
    """Columns under a name that the earlier snapshot has not, as a catalogue."""
    changes = column_changes(spark, earlier, later).filter(F.col("change").isin(ADDED, RENAMED))
    return changes.select(*COLUMN, "data_type")
