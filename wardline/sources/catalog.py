"""Column and table catalogue of a live Spark session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.sources import schemas
from wardline.sources.registry import literal_table

_TABLE_TYPES = {"VIEW": "VIEW", "TEMPORARY": "VIEW"}


def catalog_tables(spark: SparkSession, catalog_name: str, databases: list[str]) -> DataFrame:
    """Tables and views of some databases. Metadata only: the session catalogue lists them on the driver."""
    rows = [
        (catalog_name, db.upper(), t.name.upper(), _TABLE_TYPES.get(t.tableType, "BASE TABLE"))
        for db in databases
        for t in spark.catalog.listTables(db)
        if not t.isTemporary
    ]
    return literal_table(spark, rows, schemas.TABLES)


def catalog_columns(spark: SparkSession, catalog_name: str, databases: list[str]) -> DataFrame:
    rows = [
        (catalog_name, db.upper(), t.name.upper(), c.name.upper(), c.dataType.upper())
        for db in databases
        for t in spark.catalog.listTables(db)
        if not t.isTemporary
        for c in spark.catalog.listColumns(f"{db}.{t.name}")
    ]
    return literal_table(spark, rows, schemas.COLUMNS)
