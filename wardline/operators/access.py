"""The query log: which objects queries touched, and which of those hold PII."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import BusinessHours
from wardline.sources import schemas
from wardline.sources.estate_tables import Governance
from wardline.sources.object_facts import StoredFacts, object_facts

READ_WRITE_TYPES = ("SELECT", "COPY", "INSERT", "UPDATE")
DAYS_IN_BITS = 63  # days a 64-bit number can mark, one bit each
METADATA_TYPES = ("SHOW", "DESCRIBE", "USE")


def object_names(history: DataFrame) -> Column:
    """Names of the objects a query accessed, as an array. Reads JSON text or a stored array of structs."""
    objects = F.col("objects_accessed")
    if isinstance(history.schema["objects_accessed"].dataType, T.StringType):
        objects = F.from_json(objects, schemas.OBJECTS_ACCESSED)
    return objects.getField("objectName")


def accessed_objects(history: DataFrame, once_per_query: bool = False) -> DataFrame:
    """One row per query and named object it accessed. Queries without any are dropped.

    ``once_per_query`` counts an object a query names twice only once; it is done inside
    the row, so no later count has to be distinct over queries.
    """
    names = object_names(history)
    if once_per_query:
        names = F.array_distinct(names)
    return (
        history.withColumn("table_name", F.explode(names))
        .drop("objects_accessed")
        .filter(F.col("table_name").isNotNull())
    )


def day_bit(gov: Governance) -> Column:
    """The day a query started, as one bit of a number: distinct days are then a bitwise OR."""
    first_day = gov.clock.as_of_date - timedelta(days=gov.clock.access_window_days)
    day = F.datediff(F.col("start_time").cast("date"), F.lit(first_day))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), day)


def days_fit_in_bits(gov: Governance) -> bool:
    return gov.clock.access_window_days < DAYS_IN_BITS


def access_facts(gov: Governance) -> DataFrame:
    """The access window's log, added up per user, role, database, schema and query type.

    One pass over the log feeds every report that only counts: access patterns, sensitive
    access by role, after-hours totals and success rates add these rows up further. All
    figures merge on the map side, so an account with a large part of the log leaves each
    task as a few rows.
    """
    start, message = F.col("start_time"), F.col("error_message")
    figures = {
        "queries": F.count("*"),
        "failed": F.count_if(F.col("error_code").isNotNull()),
        "access_denied": F.count_if(message.ilike("%access%denied%")),
        "policy_errors": F.count_if(message.ilike("%policy%")),
        "after_hours": F.count_if(is_after_hours(start)),
        "first_access": F.min(start),
        "last_access": F.max(start),
        "elapsed_ms": F.sum("total_elapsed_time"),
        "rows_produced": F.sum("rows_produced"),
    }
    if days_fit_in_bits(gov):
        figures["days"] = F.bit_or(day_bit(gov))
    return (
        gov.environment_history(gov.clock.access_window_days)
        .groupBy("user_name", "role_name", "database_name", "schema_name", "query_type")
        .agg(*(figure.alias(name) for name, figure in figures.items()))
    )


def facts_of(history: DataFrame) -> DataFrame:
    """A log added up per day, object, role and user."""
    after_hours_select = (F.col("query_type") == "SELECT") & is_after_hours(F.col("start_time"))
    return object_facts(history, object_names(history), F.col("query_type").isin(*READ_WRITE_TYPES), after_hours_select)


def stored_facts(spark: SparkSession, root: str) -> StoredFacts:
    """The facts kept beside the log of an estate stored under ``root``."""
    return StoredFacts(spark, f"{root}/query_history", f"{root}/object_facts", facts_of)


def window_object_facts(gov: Governance) -> DataFrame:
    """Facts on the objects that the environments' queries of the access window accessed."""
    days = gov.clock.access_window_days
    history = gov.history_since(days)
    if gov.stored_facts is None:
        facts = facts_of(history)
    else:
        facts = gov.stored_facts.between(gov.clock.as_of - timedelta(days=days), gov.clock.as_of, history)
    return facts.filter(F.col("database_name").isin(*gov.estate.environment_databases))


def last_accesses(gov: Governance) -> DataFrame:
    """When each object of the environments was last accessed, over the whole log."""
    if gov.stored_facts is None:
        used = accessed_objects(gov.query_history).withColumn("last_accessed", F.col("start_time"))
    else:
        used = gov.stored_facts.between(None, None, gov.query_history)
    return (
        used.filter(F.col("database_name").isin(*gov.estate.environment_databases))
        .groupBy("database_name", "schema_name", "table_name")
        .agg(F.max("last_accessed").alias("last_accessed"))
    )


def sensitive_tables(gov: Governance) -> DataFrame:
    """``(schema_name, table_name)`` with a PII tag on the table or one of its columns, in any database."""
    return (
        gov.live_tags()
        .filter((F.col("tag_name") == "CONTAINS_PII") & (F.col("tag_value") == "TRUE"))
        .select(F.col("object_schema").alias("schema_name"), F.col("object_name").alias("table_name"))
        .distinct()
    )


def is_after_hours(start: Column, hours: BusinessHours = BusinessHours()) -> Column:
    return (
        (F.hour(start) < hours.opens)
        | (F.hour(start) >= hours.closes)
        | F.weekday(start).isin(*hours.weekend)
    )
