"""Tag taxonomy, inheritance and tagging rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.detection import NO_SUGGESTION, UNKNOWN_TYPE, pii_type, suggested_policy
from wardline.sources import schemas
from wardline.sources.estate_tables import Governance
from wardline.sources.registry import (
    PII_COMPLIANCE,
    PII_SENSITIVITY,
    RETENTION_YEARS,
)

COLUMN_KEY = ["object_database", "object_schema", "object_name", "column_name"]
TABLE_KEY = COLUMN_KEY[:3]


def tag_taxonomy_usage(gov: Governance) -> DataFrame:
    """Every tag and allowed value, with the number of live assignments that use it."""
    used = gov.live_tags().groupBy("tag_name", F.col("tag_value").alias("allowed_value")).agg(
        F.count("*").alias("assignments")
    )
    return gov.tag_allowed_values.join(used, ["tag_name", "allowed_value"], "left").select(
        "tag_name", "allowed_value", F.coalesce("assignments", F.lit(0)).alias("assignments")
    )


def tag_invalid_values(gov: Governance) -> DataFrame:
    """Live assignments whose value the taxonomy does not allow."""
    allowed = gov.tag_allowed_values.select("tag_name", F.col("allowed_value").alias("tag_value"))
    return (
        gov.live_tags()
        .join(allowed, ["tag_name", "tag_value"], "left_anti")
        .select("tag_name", "tag_value", *COLUMN_KEY, "domain")
    )


def effective_tags(gov: Governance) -> DataFrame:
    """Tags in force on each catalogued column: its own, else those of its table.

    Tags stay rows, whatever their names are. Table tags meet the columns on the table,
    which AQE splits if one table has many; one aggregate on column and tag then lets the
    column's own value win. Several values of one tag on one object: the smallest.
    """
    tags = gov.live_tags()
    value = F.min("tag_value").alias("tag_value")
    own = tags.filter(F.col("column_name").isNotNull()).groupBy(*COLUMN_KEY, "tag_name").agg(value)
    inherited = tags.filter(F.col("column_name").isNull()).groupBy(*TABLE_KEY, "tag_name").agg(value)
    columns = gov.columns.select(
        F.col("table_catalog").alias("object_database"),
        F.col("table_schema").alias("object_schema"),
        F.col("table_name").alias("object_name"),
        "column_name",
    )
    names = [*COLUMN_KEY, "tag_name", "tag_value"]
    every = (
        own.join(columns, COLUMN_KEY, "left_semi").select(*names, F.lit(0).alias("level"))
        .unionByName(columns.join(inherited, TABLE_KEY).select(*names, F.lit(1).alias("level")))
    )
    nearest = F.min(F.struct("level", "tag_value"))
    return every.groupBy(*COLUMN_KEY, "tag_name").agg(nearest.alias("found")).select(
        *COLUMN_KEY,
        "tag_name",
        "found.tag_value",
        F.when(F.col("found.level") == 0, "COLUMN").otherwise("TABLE").alias("tag_level"),
    )


def pii_column_tag_rules(gov: Governance) -> DataFrame:
    """Columns tagged as PII whose sensitivity or compliance tag breaks the rule for PII columns."""
    value = lambda tag: F.min(F.when(F.col("tag_name") == tag, F.col("tag_value"))).alias(tag)
    per_column = (
        gov.live_tags()
        .filter(F.col("column_name").isNotNull())
        .groupBy(*COLUMN_KEY)
        .agg(value("CONTAINS_PII"), value("SENSITIVITY_LEVEL"), value("COMPLIANCE_TYPE"))
    )
    sensitivity, compliance = F.col("SENSITIVITY_LEVEL"), F.col("COMPLIANCE_TYPE")
    sensitivity_ok = F.coalesce(sensitivity.isin(*PII_SENSITIVITY), F.lit(False))
    compliance_ok = F.coalesce(compliance.isin(*PII_COMPLIANCE), F.lit(False))
    return per_column.filter(
        (F.col("CONTAINS_PII") == "TRUE") & ~(sensitivity_ok & compliance_ok)
    ).select(
        *COLUMN_KEY,
        sensitivity.alias("sensitivity_level"),
        compliance.alias("compliance_type"),
        sensitivity_ok.alias("sensitivity_ok"),
        compliance_ok.alias("compliance_ok"),
    )


def tag_consistency(gov: Governance) -> DataFrame:
    """Columns of one kind that carry different values of one tag.

    The kind is what the column's name points to; a column that points to nothing is
    compared with columns of its own name.
    """
    detected = pii_type(F.col("column_name"), F.lit(True))
    kind = F.when(detected == UNKNOWN_TYPE, F.lower("column_name")).otherwise(detected)
    return (
        gov.live_tags()
        .filter(F.col("column_name").isNotNull())
        .groupBy(kind.alias("column_kind"), "tag_name")
        .agg(
            F.count_distinct("tag_value").alias("distinct_values"),
            F.min("tag_value").alias("first_value"),
            F.max("tag_value").alias("last_value"),
            F.count("*").alias("assignments"),
        )
        .filter("distinct_values > 1")
    )


def _drift(gov: Governance, rows: DataFrame, database: str, key: list[str]) -> DataFrame:
    """Keys that do not stand in every environment, with the environments missing them."""
    everywhere = gov.estate.environment_databases
    present = [F.max(F.col(database) == db).alias(db) for db in everywhere]
    missing = F.concat_ws(", ", *(F.when(~F.col(db), db) for db in sorted(everywhere)))
    found = sum((F.col(db).cast("int") for db in everywhere), F.lit(0))
    return (
        rows.filter(F.col(database).isin(*everywhere))
        .groupBy(*key)
        .agg(*present)
        .select(*key, found.cast("bigint").alias("environments"), missing.alias("missing_in"))
        .filter(F.col("environments") < len(everywhere))
    )


def environment_drift(gov: Governance) -> DataFrame:
    """Masks and row policies that are not attached alike in every environment."""
    key = ["policy_kind", "policy_name", "ref_schema_name", "ref_entity_name", "ref_column_name", "ref_arg_column_names"]
    return _drift(gov, gov.policy_references, "ref_database_name", key)


def environment_tag_drift(gov: Governance) -> DataFrame:
    """Tag values that objects do not have in every environment."""
    key = ["tag_name", "tag_value", "object_schema", "object_name", "column_name"]
    return _drift(gov, gov.live_tags(), "object_database", key)


def tag_driven_masking(gov: Governance) -> DataFrame:
    """The policy each column ends up with: attached directly, else suggested for its PII tag."""
    key = ["ref_database_name", "ref_schema_name", "ref_entity_name", "ref_column_name"]
    direct = gov.masking_attachments().select(*key, "policy_name").distinct()
    by_tag = (
        gov.live_tags()
        .filter((F.col("tag_name") == "CONTAINS_PII") & (F.col("tag_value") == "TRUE") & F.col("column_name").isNotNull())
        .select(*(F.col(c).alias(k) for c, k in zip(COLUMN_KEY, key)))
        .distinct()
        .withColumn("policy_name", suggested_policy(F.col("ref_column_name")))
        .filter(F.col("policy_name") != NO_SUGGESTION)
        .join(direct, key, "left_anti")
    )
    return direct.withColumn("chosen_by", F.lit("ATTACHMENT")).unionByName(
        by_tag.withColumn("chosen_by", F.lit("TAG"))
    )


def tag_policy_references(gov: Governance) -> DataFrame:
    """``policy_references`` rows that make the tag-chosen masks effective."""
    estate = gov.estate
    chosen = tag_driven_masking(gov).filter("chosen_by = 'TAG'")
    return chosen.select(
        F.lit(estate.governance_database).alias("policy_db"),
        F.lit(estate.governance_schema).alias("policy_schema"),
        "policy_name",
        F.lit(schemas.MASKING_KIND).alias("policy_kind"),
        "ref_database_name",
        "ref_schema_name",
        "ref_entity_name",
        F.lit("TABLE").alias("ref_entity_domain"),
        "ref_column_name",
        F.lit(None).cast("string").alias("ref_arg_column_names"),
        F.lit("ACTIVE").alias("policy_status"),
        F.lit(estate.governance_database).alias("tag_database"),
        F.lit(estate.governance_schema).alias("tag_schema"),
        F.lit("CONTAINS_PII").alias("tag_name"),
    )


def retention_due(gov: Governance) -> DataFrame:
    """Tables with a retention tag: when they were last used and when they may go."""
    from wardline.operators.access import last_accesses

    retention = (
        gov.live_tags()
        .filter((F.col("tag_name") == "RETENTION_PERIOD") & F.col("column_name").isNull())
        .groupBy(*TABLE_KEY)
        .agg(F.min("tag_value").alias("retention_period"))
    )
    last_used = last_accesses(gov).select(
        F.col("database_name").alias("object_database"),
        F.col("schema_name").alias("object_schema"),
        F.col("table_name").alias("object_name"),
        "last_accessed",
    )
    years = F.create_map(*(F.lit(v) for pair in RETENTION_YEARS.items() for v in pair))
    due = F.add_months(F.col("last_accessed").cast("date"), F.try_element_at(years, F.col("retention_period")) * 12)
    return (
        retention.join(last_used, TABLE_KEY, "left")
        .withColumn("due_date", due)
        .withColumn(
            "retention_status",
            F.when(~F.col("retention_period").isin(*RETENTION_YEARS), "NEVER_DUE")
            .when(F.col("last_accessed").isNull(), "NO_RECORDED_USE")
            .when(F.col("due_date") <= F.lit(gov.clock.as_of_date), "DUE")
            .otherwise("RETAIN"),
        )
        .select(*TABLE_KEY, "retention_period", "last_accessed", "due_date", "retention_status")
    )
