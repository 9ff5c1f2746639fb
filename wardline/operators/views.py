"""Monitoring views over the governance tables.

Each view has an unsorted form, used by other views and audits, and is sorted only
where it is the final report. Groups are counted before they are joined, so no join
multiplies a table by the columns or queries of another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.detection import UNKNOWN_TYPE, on_review_list, pii_type, suggested_policy
from wardline.operators.access import METADATA_TYPES, accessed_objects, day_bit, days_fit_in_bits, window_object_facts
from wardline.sources import schemas
from wardline.sources.estate_tables import Governance

# Texts of the report columns.
NOT_MASKED = "NO - NEEDS REVIEW"
NOT_TAGGED = "NO - NEEDS TAGGING"
COMPLIANT, TAGGED_ONLY, NEEDS_REVIEW = "COMPLIANT", "TAGGED_ONLY", "NEEDS_REVIEW"
STATUS_ORDER = (NEEDS_REVIEW, TAGGED_ONLY, COMPLIANT)

TABLE = ["database_name", "schema_name", "table_name"]


def yes_no(condition: Column) -> Column:
    return F.when(condition, "YES").otherwise("NO")


def _names(df: DataFrame, *pairs: str) -> DataFrame:
    """Select and rename: ``old:new`` or a plain name."""
    return df.select(*(F.col(p.split(":")[0]).alias(p.split(":")[-1]) for p in pairs))


# -- attachments --------------------------------------------------------------

_ATTACHMENT = (
    "policy_db:policy_database",
    "policy_schema",
    "policy_name",
    "policy_kind",
    "ref_database_name:table_database",
    "ref_schema_name:table_schema",
    "ref_entity_name:table_name",
    "ref_entity_domain:entity_type",
)


def masking_policy_references(gov: Governance) -> DataFrame:
    return _names(
        gov.masking_attachments(),
        *_ATTACHMENT,
        "ref_column_name:column_name",
        "policy_status",
        "tag_database",
        "tag_schema",
        "tag_name",
    )


def v_masking_policy_references(gov: Governance) -> DataFrame:
    return masking_policy_references(gov).orderBy("table_schema", "table_name", "column_name")


def row_access_policy_references(gov: Governance) -> DataFrame:
    return _names(
        gov.row_access_attachments(), *_ATTACHMENT, "ref_arg_column_names:filter_columns", "policy_status"
    )


def v_row_access_policy_references(gov: Governance) -> DataFrame:
    return row_access_policy_references(gov).orderBy("table_schema", "table_name", "policy_name", "table_database")


_PER_POLICY = ["schema_name", "policy_name"]


def _policy_tables(attachments: DataFrame) -> DataFrame:
    return attachments.select(
        F.col("ref_schema_name").alias("schema_name"), "policy_name", F.col("ref_entity_name").alias("table_name")
    ).distinct()


def masking_policy_tables(gov: Governance) -> DataFrame:
    """The tables a mask is attached in, as rows: what the summary puts into one text, at any length."""
    return _policy_tables(gov.masking_attachments())


def row_policy_tables(gov: Governance) -> DataFrame:
    return _policy_tables(gov.row_access_attachments())


def _policy_summary(attachments: DataFrame, *counted: str) -> DataFrame:
    """Per schema and policy: distinct tables, more distinct counts, and the list of tables.

    Counts come from rows made distinct before; only the list itself is put together, one
    name per table, for it is the report.
    """
    listed = _policy_tables(attachments).groupBy(*_PER_POLICY).agg(
        F.count("table_name").alias("tables_count"),
        F.array_join(F.sort_array(F.collect_list("table_name")), ", ").alias("affected_tables"),
    )
    if not counted:
        return listed
    counts = attachments.groupBy(F.col("ref_schema_name").alias("schema_name"), "policy_name").agg(
        *(F.count_distinct(c).alias("columns_count") for c in counted)
    )
    return listed.join(counts, _PER_POLICY).select(*_PER_POLICY, "tables_count", "columns_count", "affected_tables")


def masking_policy_summary(gov: Governance) -> DataFrame:
    return _policy_summary(gov.masking_attachments(), "ref_column_name")


def v_masking_policy_summary(gov: Governance) -> DataFrame:
    return masking_policy_summary(gov).orderBy("schema_name", "policy_name")


def row_access_policy_summary(gov: Governance) -> DataFrame:
    return _policy_summary(gov.row_access_attachments())


def v_row_access_policy_summary(gov: Governance) -> DataFrame:
    return row_access_policy_summary(gov).orderBy("schema_name", "policy_name")


# -- tags ---------------------------------------------------------------------


def tagged_objects(gov: Governance) -> DataFrame:
    return _names(
        gov.live_tags(),
        "tag_database",
        "tag_schema",
        "tag_name",
        "tag_value",
        "object_database",
        "object_schema",
        "object_name",
        "column_name",
        "domain:object_type",
        "object_deleted:is_deleted",
    )


def v_tagged_objects(gov: Governance) -> DataFrame:
    return tagged_objects(gov).orderBy("object_schema", "object_name", "column_name", "tag_name")


def tag_coverage_summary(gov: Governance) -> DataFrame:
    """Per schema and tag: objects, column names, and objects tagged at either level.

    Each object is one row with two flags first, which gives three of the four counts.
    """
    key = ["schema_name", "tag_name"]
    tags = gov.live_tags().withColumnRenamed("object_schema", "schema_name")
    at_table_level = F.col("column_name").isNull()
    objects = tags.groupBy(*key, "object_name").agg(
        F.max(at_table_level).alias("at_table"), F.max(~at_table_level).alias("at_column")
    )
    per_tag = objects.groupBy(*key).agg(
        F.count("object_name").alias("tables_count"),
        F.count_if("at_table").alias("table_level_tags"),
        F.count_if("at_column").alias("column_level_tags"),
    )
    columns = tags.groupBy(*key).agg(F.count_distinct("column_name").alias("columns_count"))
    return per_tag.join(columns, key).select(
        *key, "tables_count", "columns_count", "table_level_tags", "column_level_tags"
    )


def v_tag_coverage_summary(gov: Governance) -> DataFrame:
    return tag_coverage_summary(gov).orderBy("schema_name", "tag_name")


def _marks_pii() -> Column:
    return (F.col("tag_name") == "CONTAINS_PII") & (F.col("tag_value") == "TRUE")


def pii_columns(gov: Governance) -> DataFrame:
    """PII-tagged columns with their own sensitivity and compliance tags.

    One aggregation per column replaces a lookup per tag: the log of assignments is
    read and shuffled once. Assignments on the same column by another database's tags
    count for the lookups, as long as the object exists. Several values of one tag: the
    smallest is reported.
    """
    column = ["object_database", "object_schema", "object_name", "column_name"]
    is_governed = (F.col("tag_database") == gov.estate.governance_database) & (
        F.col("tag_schema") == gov.estate.governance_schema
    )
    marks_pii = is_governed & _marks_pii()
    return (
        gov.tag_references.filter(F.col("object_deleted").isNull() & F.col("column_name").isNotNull())
        .groupBy(*column)
        .agg(
            F.count_if(marks_pii).alias("pii_marks"),
            F.min(F.when(F.col("tag_name") == "SENSITIVITY_LEVEL", F.col("tag_value"))).alias("sensitivity_level"),
            F.min(F.when(F.col("tag_name") == "COMPLIANCE_TYPE", F.col("tag_value"))).alias("compliance_type"),
        )
        .filter("pii_marks > 0")
        .select(
            F.col("object_database").alias("database_name"),
            F.col("object_schema").alias("schema_name"),
            F.col("object_name").alias("table_name"),
            "column_name",
            F.lit("TRUE").alias("contains_pii"),
            "sensitivity_level",
            "compliance_type",
        )
    )


def v_pii_columns(gov: Governance) -> DataFrame:
    return pii_columns(gov).orderBy("schema_name", "table_name", "column_name")


# -- detection ----------------------------------------------------------------


def _column_masks(gov: Governance, policy_schema: str | None) -> DataFrame:
    """Masking attachments by column. Attachments of any policy database count."""
    masks = gov.policy_references.filter(F.col("policy_kind") == schemas.MASKING_KIND)
    if policy_schema is not None:
        masks = masks.filter(F.col("policy_schema") == policy_schema)
    return _names(
        masks,
        "ref_database_name:table_catalog",
        "ref_schema_name:table_schema",
        "ref_entity_name:table_name",
        "ref_column_name:column_name",
        "policy_name",
    )


CATALOG_COLUMN = ["table_catalog", "table_schema", "table_name", "column_name"]


def columns_with_masks(gov: Governance, columns: DataFrame, policy_schema: str | None = None) -> DataFrame:
    """Catalogued columns with the policies on them: one row each, more if several are attached."""
    return columns.join(_column_masks(gov, policy_schema), CATALOG_COLUMN, "left")


def _sensitive_columns(gov: Governance, wide: bool) -> DataFrame:
    name = F.col("column_name")
    curated = F.col("table_schema").isin(*gov.estate.curated_layers)
    kind = pii_type(name, curated)
    listed = on_review_list(name, curated)
    # Names are classified in the scan: the sort at the end reads what follows it twice.
    candidates = (
        gov.production_columns(gov.estate.layers)
        .filter((kind != UNKNOWN_TYPE) | listed if wide else listed)
        .select(
            *CATALOG_COLUMN,
            "data_type",
            kind.alias("suggested_pii_type"),
            suggested_policy(name).alias("suggested_masking_policy"),
        )
    )
    pii_tags = _names(
        gov.tag_references.filter((F.col("tag_name") == "CONTAINS_PII") & F.col("object_deleted").isNull()),
        "object_database:table_catalog",
        "object_schema:table_schema",
        "object_name:table_name",
        "column_name",
        "tag_value",
    )
    return (
        columns_with_masks(gov, candidates, gov.estate.governance_schema)
        .join(pii_tags, CATALOG_COLUMN, "left")
        .select(
            F.col("table_catalog").alias("database_name"),
            F.col("table_schema").alias("schema_name"),
            "table_name",
            "column_name",
            "data_type",
            "suggested_pii_type",
            "suggested_masking_policy",
            F.coalesce(F.concat(F.lit("YES ("), "policy_name", F.lit(")")), F.lit(NOT_MASKED)).alias(
                "has_masking_policy"
            ),
            F.when(F.col("tag_value") == "TRUE", "YES").otherwise(NOT_TAGGED).alias("tagged_as_pii"),
        )
    )


def potential_sensitive_columns(gov: Governance) -> DataFrame:
    """Production columns whose name is on the review list, with their masking and tagging state."""
    return _sensitive_columns(gov, wide=False)


def potential_sensitive_columns_wide(gov: Governance) -> DataFrame:
    """As above, plus every column whose name points to a kind of sensitive data."""
    return _sensitive_columns(gov, wide=True)


def _unmasked_first(columns: DataFrame) -> DataFrame:
    return columns.orderBy(
        F.col("has_masking_policy") != NOT_MASKED, "schema_name", "table_name", "column_name"
    )


def v_potential_sensitive_columns(gov: Governance) -> DataFrame:
    return _unmasked_first(potential_sensitive_columns(gov))


def v_potential_sensitive_columns_wide(gov: Governance) -> DataFrame:
    return _unmasked_first(potential_sensitive_columns_wide(gov))


# -- access -------------------------------------------------------------------


USER = ["user_name", "role_name", "database_name", "schema_name"]


def recent_access_patterns(gov: Governance) -> DataFrame:
    """Per user, role, database and schema: queries, days, time and rows of the access window.

    Every figure merges on the map side, the distinct days too. A service account with a
    large part of the log leaves each task as a single row. Only a window of more than two
    months counts its days with a distinct count.
    """
    if days_fit_in_bits(gov):
        days_active = F.bit_count(F.bit_or(day_bit(gov))).cast("bigint")
    else:
        days_active = F.count_distinct(F.col("start_time").cast("date"))
    return (
        gov.environment_history(gov.clock.access_window_days, gov.estate.layers)
        .filter(~F.col("query_type").isin(*METADATA_TYPES))
        .groupBy(*USER)
        .agg(
            F.count("*").alias("query_count"),
            days_active.alias("days_active"),
            F.min("start_time").alias("first_access"),
            F.max("start_time").alias("last_access"),
            (F.sum("total_elapsed_time") / 1000).alias("total_seconds"),
            F.sum("rows_produced").alias("total_rows_returned"),
        )
    )


def access_patterns_of(gov: Governance, facts: DataFrame) -> DataFrame:
    """:func:`recent_access_patterns` from the added-up log, where its days fit in bits."""
    if not days_fit_in_bits(gov):
        return recent_access_patterns(gov)
    return (
        facts.filter(F.col("schema_name").isin(*gov.estate.layers) & ~F.col("query_type").isin(*METADATA_TYPES))
        .groupBy(*USER)
        .agg(
            F.sum("queries").alias("query_count"),
            F.bit_count(F.bit_or("days")).cast("bigint").alias("days_active"),
            F.min("first_access").alias("first_access"),
            F.max("last_access").alias("last_access"),
            (F.sum("elapsed_ms") / 1000).alias("total_seconds"),
            F.sum("rows_produced").alias("total_rows_returned"),
        )
    )


def v_recent_access_patterns(gov: Governance) -> DataFrame:
    # The names after the count keep the many users with equal counts from sorting into one partition.
    return recent_access_patterns(gov).orderBy(
        F.desc("query_count"), "user_name", "role_name", "database_name", "schema_name"
    )


def table_access_frequency(gov: Governance) -> DataFrame:
    """Per accessed table and role: accesses, users and latest access of the window."""
    if gov.stored_facts is not None:
        return access_frequency_of(gov, window_object_facts(gov))
    history = gov.environment_history(gov.clock.access_window_days, gov.estate.layers)
    return (
        accessed_objects(history)
        .groupBy("database_name", "schema_name", "table_name", "role_name")
        .agg(
            F.count("*").alias("access_count"),
            F.count_distinct("user_name").alias("unique_users"),
            F.max("start_time").alias("last_accessed"),
        )
    )


def access_frequency_of(gov: Governance, facts: DataFrame) -> DataFrame:
    """:func:`table_access_frequency` from facts on objects."""
    return (
        facts.filter(F.col("schema_name").isin(*gov.estate.layers))
        .groupBy("database_name", "schema_name", "table_name", "role_name")
        .agg(
            F.sum("mentions").alias("access_count"),
            F.count_distinct("user_name").alias("unique_users"),
            F.max("last_accessed").alias("last_accessed"),
        )
    )


def v_table_access_frequency(gov: Governance) -> DataFrame:
    return table_access_frequency(gov).orderBy(
        F.desc("access_count"), "database_name", "schema_name", "table_name", "role_name"
    )


# -- coverage -----------------------------------------------------------------


def governance_coverage_report(gov: Governance) -> DataFrame:
    """One row per curated production table: tags, masks, row policies and the resulting status.

    Every input is reduced to one row per table before the joins.
    """
    all_tables = (
        gov.production_columns(gov.estate.curated_layers)
        .groupBy(
            F.col("table_catalog").alias("database_name"),
            F.col("table_schema").alias("schema_name"),
            "table_name",
        )
        .agg(F.count("*").alias("column_count"))
    )
    tagged = _names(
        gov.live_tags(), "object_database:database_name", "object_schema:schema_name", "object_name:table_name"
    ).distinct()
    policy_table = (
        F.col("ref_database_name").alias("database_name"),
        F.col("ref_schema_name").alias("schema_name"),
        F.col("ref_entity_name").alias("table_name"),
    )
    # Masks and row policies come from the same rows: one aggregation serves both.
    kind = F.col("policy_kind")
    protected = (
        gov.masking_attachments()
        .unionByName(gov.row_access_attachments())
        .groupBy(*policy_table)
        .agg(
            F.count_if(kind == schemas.MASKING_KIND).alias("masks"),
            F.count_distinct(F.when(kind == schemas.MASKING_KIND, F.col("ref_column_name"))).alias("masked_columns"),
            F.count_if(kind == schemas.ROW_ACCESS_KIND).alias("row_policies"),
        )
    )
    has_tags = F.col("is_tagged").isNotNull()
    has_masking = F.coalesce(F.col("masks") > 0, F.lit(False))
    has_row_access = F.coalesce(F.col("row_policies") > 0, F.lit(False))
    return (
        all_tables.join(tagged.withColumn("is_tagged", F.lit(True)), TABLE, "left")
        .join(protected, TABLE, "left")
        .select(
            "schema_name",
            "table_name",
            "column_count",
            yes_no(has_tags).alias("has_tags"),
            yes_no(has_masking).alias("has_masking"),
            F.coalesce("masked_columns", F.lit(0)).alias("masked_column_count"),
            yes_no(has_row_access).alias("has_row_access"),
            F.when(~has_tags, NEEDS_REVIEW)
            .when(has_masking | has_row_access, COMPLIANT)
            .otherwise(TAGGED_ONLY)
            .alias("compliance_status"),
        )
    )


def v_governance_coverage_report(gov: Governance) -> DataFrame:
    rank = F.array_position(F.array(*(F.lit(s) for s in STATUS_ORDER)), F.col("compliance_status"))
    return governance_coverage_report(gov).orderBy(rank, "schema_name", "table_name")


def coverage_rollup(gov: Governance) -> DataFrame:
    return (
        governance_coverage_report(gov)
        .groupBy("schema_name", "compliance_status")
        .agg(F.count("*").alias("table_count"))
        .orderBy("schema_name", "compliance_status")
    )


# -- row counts and quick checks ----------------------------------------------

VIEWS = {
    "V_MASKING_POLICY_REFERENCES": masking_policy_references,
    "V_MASKING_POLICY_SUMMARY": masking_policy_summary,
    "V_ROW_ACCESS_POLICY_REFERENCES": row_access_policy_references,
    "V_ROW_ACCESS_POLICY_SUMMARY": row_access_policy_summary,
    "V_TAGGED_OBJECTS": tagged_objects,
    "V_TAG_COVERAGE_SUMMARY": tag_coverage_summary,
    "V_PII_COLUMNS": pii_columns,
    "V_POTENTIAL_SENSITIVE_COLUMNS": potential_sensitive_columns,
    "V_RECENT_ACCESS_PATTERNS": recent_access_patterns,
    "V_TABLE_ACCESS_FREQUENCY": table_access_frequency,
    "V_GOVERNANCE_COVERAGE_REPORT": governance_coverage_report,
}


def _attachment_counts(gov: Governance) -> DataFrame:
    """One row: the sizes of the four policy views, from one row per kind, schema and policy."""
    groups = gov.attachments().groupBy("policy_kind", "ref_schema_name", "policy_name").agg(F.count("*").alias("n"))
    masks, named = F.col("policy_kind") == schemas.MASKING_KIND, F.col("ref_schema_name").isNotNull() & F.col("policy_name").isNotNull()
    return groups.agg(
        F.sum(F.when(masks, F.col("n"))).alias("V_MASKING_POLICY_REFERENCES"),
        F.count_if(masks & named).alias("V_MASKING_POLICY_SUMMARY"),
        F.sum(F.when(~masks, F.col("n"))).alias("V_ROW_ACCESS_POLICY_REFERENCES"),
        F.count_if(~masks).alias("V_ROW_ACCESS_POLICY_SUMMARY"),
    )


def _tag_counts(gov: Governance) -> DataFrame:
    """One row: the sizes of the three tag views, from one row per object, column and tag."""
    marks = gov.live_tags().groupBy("object_database", "object_schema", "object_name", "column_name", "tag_name").agg(
        F.count("*").alias("n"), F.max(F.coalesce(_marks_pii(), F.lit(False))).alias("pii")
    )
    named = F.col("object_schema").isNotNull() & F.col("tag_name").isNotNull()
    return marks.agg(
        F.sum("n").alias("V_TAGGED_OBJECTS"),
        F.count_distinct(F.when(named, F.struct("object_schema", "tag_name"))).alias("V_TAG_COVERAGE_SUMMARY"),
        F.count_if(F.col("pii") & F.col("column_name").isNotNull()).alias("V_PII_COLUMNS"),
    )


def view_row_counts(gov: Governance) -> DataFrame:
    """Row count of every monitoring view.

    The views on attachments, and those on tags, are groupings of one table: its groups are
    made once and give all their sizes. The other views are counted each by itself.
    """
    shared = [_attachment_counts(gov), _tag_counts(gov)]
    alone = [name for name in VIEWS if not any(name in sizes.columns for sizes in shared)]
    size = lambda name, value: F.struct(F.lit(name).alias("view_name"), F.coalesce(value, F.lit(0)).alias("row_count"))
    counts = [sizes.select(F.inline(F.array(*[size(name, F.col(name)) for name in sizes.columns]))) for sizes in shared]
    counts += [VIEWS[name](gov).agg(F.count("*").alias("n")).select(F.inline(F.array(size(name, F.col("n"))))) for name in alone]
    return reduce(DataFrame.unionByName, counts)


def quick_check_unmasked(gov: Governance) -> DataFrame:
    return _unmasked_first(potential_sensitive_columns(gov).filter(F.col("has_masking_policy").like("NO%")))


def quick_check_needs_review(gov: Governance) -> DataFrame:
    return (
        governance_coverage_report(gov)
        .filter(F.col("compliance_status") == NEEDS_REVIEW)
        .orderBy("schema_name", "table_name")
    )


def quick_check_top_users(gov: Governance, n: int = 20) -> DataFrame:
    return (
        recent_access_patterns(gov)
        .orderBy(F.desc("query_count"), "user_name", "role_name", "database_name", "schema_name")
        .limit(n)
    )


def access_to_layer(gov: Governance, layer: str = "DISTRIBUTE") -> DataFrame:
    """Who used one layer, latest first."""
    return (
        recent_access_patterns(gov)
        .filter(F.col("schema_name") == layer)
        .select("user_name", "role_name", "query_count", "last_access")
        .orderBy(F.desc("last_access"), "user_name", "role_name")
    )


def masks_in_layer(gov: Governance, layer: str = "DISTRIBUTE") -> DataFrame:
    """Masking attachments of one layer."""
    return (
        masking_policy_references(gov)
        .filter(F.col("table_schema") == layer)
        .select("policy_name", "table_schema", "table_name", "column_name", "policy_status")
        .orderBy("table_name", "column_name")
    )


def row_policy_filters(gov: Governance) -> DataFrame:
    """Tables with row policies and the columns they filter on."""
    return (
        row_access_policy_references(gov)
        .select("table_schema", "table_name", "policy_name", "filter_columns")
        .orderBy("table_schema", "table_name", "policy_name")
    )
