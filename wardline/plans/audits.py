"""The compliance audits: a detail report and a one-row headline each.

A headline counts the audit's own findings before any top-k limit. Audits take the
views they share as arguments through :class:`AuditInputs`, so a full run computes
each view once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import AccessThresholds, BusinessHours
from wardline.functions.detection import name_like
from wardline.operators import views as V
from wardline.operators.access import (
    READ_WRITE_TYPES,
    access_facts,
    accessed_objects,
    is_after_hours,
    sensitive_tables,
    window_object_facts,
)
from wardline.sources import schemas
from wardline.sources.estate_tables import Governance, wall_clock
from wardline.sources.registry import REQUIRED_TABLE_TAGS

# Audit titles, status texts and priorities as the reports print them.
TITLES = {
    "audit_01": "🚨 UNMASKED PII COLUMNS",
    "audit_02": "⚠️ UNTAGGED PII COLUMNS",
    "audit_03": "📋 UNGOVERNED TABLES",
    "audit_04": "🏷️ TAGGED BUT UNPROTECTED",
    "audit_05": "🔍 HIGH VOLUME USERS",
    "audit_06": "🔐 SENSITIVE TABLE ACCESS",
    "audit_07": "🌙 AFTER-HOURS PII ACCESS",
    "audit_08": "🎓 FERPA COMPLIANCE STATUS",
    "audit_09": "🔒 SSN MASKING STATUS",
    "audit_10": "📧 EMAIL & DOB MASKING STATUS",
    "audit_11": "🏷️ REQUIRED TAG COVERAGE",
    "audit_12": "🎯 PII TAG ACCURACY",
    "audit_13": "📊 QUERY SUCCESS RATES BY ROLE",
    "audit_14": "📝 POLICY CHANGE HISTORY",
}
HIGH, MEDIUM, INFO = "HIGH", "MEDIUM", "INFO"
VERY_HIGH_VOLUME = "🚨 VERY HIGH"
HIGH_VOLUME = "⚠️ HIGH"
MODERATE_VOLUME = "📊 MODERATE"
NORMAL_VOLUME = "✓ NORMAL"
PROTECTED, NEEDS_PROTECTION = "✓ PROTECTED", "⚠️ NEEDS PROTECTION"
MASKED, UNMASKED_SSN, UNMASKED = "✓ MASKED", "🚨 UNMASKED", "⚠️ UNMASKED"
COMPLETE, INCOMPLETE = "✓ COMPLETE", "⚠️ INCOMPLETE"
TAGGED_NOT_MASKED = "⚠️ TAGGED BUT NOT MASKED"

# Kinds of PII in order of urgency, and the report sizes.
URGENCY = ("SSN", "DOB", "EMAIL", "PHONE", "FINANCIAL")
TOP_USERS = 20
LATEST_QUERIES = 50

# What a change of policies looks like in the log.
POLICY_CHANGE_TYPES = ("CREATE", "ALTER", "DROP")
POLICY_CHANGE_TEXTS = ("%MASKING%POLICY%", "%ROW%ACCESS%POLICY%", "%TAG%")


class AuditInputs:
    """Governance tables plus the views several audits read, each built when first asked for."""

    def __init__(self, gov: Governance, kept: bool = False):
        self.gov, self._kept = gov, kept

    @cached_property
    def sensitive_columns(self) -> DataFrame:
        return V.potential_sensitive_columns(self.gov)

    @cached_property
    def facts(self) -> DataFrame:
        return access_facts(self.gov)

    @cached_property
    def object_facts(self) -> DataFrame | None:
        """Facts on accessed objects, where they are stored or this run keeps them."""
        return window_object_facts(self.gov) if self.gov.stored_facts is not None or self._kept else None

    @cached_property
    def access(self) -> DataFrame:
        return V.access_patterns_of(self.gov, self.facts)

    @cached_property
    def coverage(self) -> DataFrame:
        return V.governance_coverage_report(self.gov)

    @cached_property
    def pii_columns(self) -> DataFrame:
        return V.pii_columns(self.gov)

    @classmethod
    @contextmanager
    def persisted(cls, gov: Governance) -> Iterator[AuditInputs]:
        """Inputs that are computed once and kept, on disk where memory is short.

        The log is added up in one pass per query and one per accessed object; only the
        reports that list single queries go back to it. Losing an executor only means that its part of a view is computed again.
        """
        inputs = cls(gov, kept=True)
        shared = (inputs.facts, inputs.object_facts, inputs.access, inputs.sensitive_columns, inputs.coverage, inputs.pii_columns)
        for view in shared:
            view.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield inputs
        finally:
            for view in shared:
                view.unpersist()


def _headline(key: str, findings: DataFrame, inputs: AuditInputs, priority: str | None, **counts: Column) -> DataFrame:
    clock = inputs.gov.clock
    return findings.agg(*(c.cast("bigint").alias(n) for n, c in counts.items())).select(
        F.lit(TITLES[key]).alias("audit_name"),
        *counts,
        *([F.lit(priority).alias("priority")] if priority else []),
        wall_clock(clock.as_of).alias("audit_timestamp"),
    )


def access_level(queries: Column, at: AccessThresholds = AccessThresholds()) -> Column:
    return (
        F.when(queries > at.very_high, VERY_HIGH_VOLUME)
        .when(queries > at.high, HIGH_VOLUME)
        .when(queries > at.moderate, MODERATE_VOLUME)
        .otherwise(NORMAL_VOLUME)
    )


# -- policy coverage ----------------------------------------------------------


def unmasked_columns(inputs: AuditInputs) -> DataFrame:
    return inputs.sensitive_columns.filter(F.col("has_masking_policy") == V.NOT_MASKED)


def audit_01(inputs: AuditInputs) -> DataFrame:
    """Sensitive columns without a mask, the most urgent kinds first."""
    position = F.array_position(F.array(*(F.lit(t) for t in URGENCY)), F.col("suggested_pii_type"))
    urgency = F.when(position > 0, position).otherwise(len(URGENCY) + 1)
    return (
        unmasked_columns(inputs)
        .orderBy(urgency, "schema_name", "table_name", "column_name")
        .select(
            "schema_name", "table_name", "column_name", "suggested_pii_type", "suggested_masking_policy", "data_type"
        )
    )


def audit_01_summary(inputs: AuditInputs) -> DataFrame:
    return _headline("audit_01", unmasked_columns(inputs), inputs, HIGH, issue_count=F.count("*"))


def untagged_columns(inputs: AuditInputs) -> DataFrame:
    return inputs.sensitive_columns.filter(F.col("tagged_as_pii") == V.NOT_TAGGED)


def audit_02(inputs: AuditInputs) -> DataFrame:
    """Sensitive columns that are not tagged as PII."""
    return (
        untagged_columns(inputs)
        .select(
            "schema_name", "table_name", "column_name", "suggested_pii_type", "has_masking_policy", "tagged_as_pii"
        )
        .orderBy("schema_name", "table_name", "column_name")
    )


def audit_02_summary(inputs: AuditInputs) -> DataFrame:
    return _headline("audit_02", untagged_columns(inputs), inputs, MEDIUM, issue_count=F.count("*"))


def tables_with_status(inputs: AuditInputs, status: str) -> DataFrame:
    return inputs.coverage.filter(F.col("compliance_status") == status)


def audit_03(inputs: AuditInputs) -> DataFrame:
    """Curated tables without governance."""
    return (
        tables_with_status(inputs, V.NEEDS_REVIEW)
        .select(
            "schema_name",
            "table_name",
            "column_count",
            "compliance_status",
            "has_tags",
            "has_masking",
            "masked_column_count",
            "has_row_access",
        )
        .orderBy("schema_name", "table_name")
    )


def audit_03_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_03", tables_with_status(inputs, V.NEEDS_REVIEW), inputs, MEDIUM, issue_count=F.count("*")
    )


def audit_04(inputs: AuditInputs) -> DataFrame:
    """Curated tables that are tagged but have neither mask nor row policy."""
    return (
        tables_with_status(inputs, V.TAGGED_ONLY)
        .select(
            "schema_name",
            "table_name",
            "column_count",
            "has_tags",
            "has_masking",
            "masked_column_count",
            "has_row_access",
        )
        .orderBy("schema_name", "table_name")
    )


def audit_04_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_04", tables_with_status(inputs, V.TAGGED_ONLY), inputs, MEDIUM, issue_count=F.count("*")
    )


# -- access patterns ----------------------------------------------------------


def curated_access(inputs: AuditInputs) -> DataFrame:
    return inputs.access.filter(F.col("schema_name").isin(*inputs.gov.estate.curated_layers))


def audit_05(inputs: AuditInputs, thresholds: AccessThresholds = AccessThresholds()) -> DataFrame:
    """The users with the most queries in the curated layers. Equal counts: by name."""
    return (
        curated_access(inputs)
        .orderBy(F.desc("query_count"), "user_name", "role_name", "database_name", "schema_name")
        .limit(TOP_USERS)
        .select(
            "user_name",
            "role_name",
            "schema_name",
            "query_count",
            "days_active",
            "total_rows_returned",
            "last_access",
            access_level(F.col("query_count"), thresholds).alias("access_level"),
        )
    )


def audit_05_summary(inputs: AuditInputs) -> DataFrame:
    return _headline("audit_05", curated_access(inputs), inputs, INFO, user_count=F.count("*"))


def _read_write_facts(inputs: AuditInputs) -> DataFrame:
    return inputs.facts.filter(F.col("query_type").isin(*READ_WRITE_TYPES))


def audit_06(inputs: AuditInputs) -> DataFrame:
    """Use of sensitive tables by role. A query counts for every sensitive table of its schema.

    All tables of a schema get the same figures, so the log is added up per schema and
    role and only the result is paired with the tables.
    """
    per_schema = (
        _read_write_facts(inputs)
        .groupBy("schema_name", "role_name")
        .agg(
            F.count_distinct("user_name").alias("user_count"),
            F.sum("queries").alias("query_count"),
            F.max("last_access").alias("last_access"),
        )
    )
    return (
        sensitive_tables(inputs.gov)
        .join(per_schema, "schema_name")
        .select("schema_name", "table_name", "role_name", "user_count", "query_count", "last_access")
        .orderBy(F.desc("query_count"), "schema_name", "table_name", "role_name")
    )


def _schemas_with_pii(gov: Governance) -> DataFrame:
    return sensitive_tables(gov).groupBy("schema_name").agg(F.count("*").alias("sensitive_tables"))


def audit_06_summary(inputs: AuditInputs) -> DataFrame:
    gov = inputs.gov
    return _headline(
        "audit_06",
        _read_write_facts(inputs).join(_schemas_with_pii(gov), "schema_name", "left_semi"),
        inputs,
        INFO,
        unique_users=F.count_distinct("user_name"),
        unique_roles=F.count_distinct("role_name"),
    )


def _read_write_objects(inputs: AuditInputs) -> DataFrame:
    """Per table, role and user of the window: queries that read or wrote it, and the last one."""
    gov = inputs.gov
    if inputs.object_facts is not None:
        return inputs.object_facts.filter("read_write_queries > 0").select(
            "schema_name",
            "table_name",
            "role_name",
            "user_name",
            F.col("read_write_queries").alias("queries"),
            F.col("last_read_write").alias("last"),
        )
    window = gov.environment_history(gov.clock.access_window_days).filter(F.col("query_type").isin(*READ_WRITE_TYPES))
    return accessed_objects(window, once_per_query=True).withColumns({"queries": F.lit(1), "last": F.col("start_time")})


def audit_06_by_object(inputs: AuditInputs) -> DataFrame:
    """Use of sensitive tables by role, counting only queries that accessed the table."""
    per_table = (
        _read_write_objects(inputs)
        .groupBy("schema_name", "table_name", "role_name")
        .agg(
            F.count_distinct("user_name").alias("user_count"),
            F.sum("queries").alias("query_count"),
            F.max("last").alias("last_access"),
        )
    )
    return per_table.join(sensitive_tables(inputs.gov), ["schema_name", "table_name"], "left_semi").orderBy(
        F.desc("query_count"), "schema_name", "table_name", "role_name"
    )


def _after_hours_selects(gov: Governance, hours: BusinessHours = BusinessHours()) -> DataFrame:
    return gov.environment_history(gov.clock.access_window_days).filter(
        (F.col("query_type") == "SELECT") & is_after_hours(F.col("start_time"), hours)
    )


def _after_hours_report(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("start_time"), "query_id", "table_name").limit(LATEST_QUERIES).select(
        "user_name",
        "role_name",
        "table_name",
        "start_time",
        F.hour("start_time").alias("access_hour"),
        F.dayname("start_time").alias("access_day"),
        "query_text",
    )


def audit_07(inputs: AuditInputs) -> DataFrame:
    """The latest after-hours SELECTs in schemas with sensitive tables, once per such table.

    Each query yields at least one row, so the first 50 rows come from the first 50
    queries: only those are paired with the tables.
    """
    gov = inputs.gov
    latest = (
        _after_hours_selects(gov)
        .join(_schemas_with_pii(gov), "schema_name", "left_semi")
        .orderBy(F.desc("start_time"), "query_id")
        .limit(LATEST_QUERIES)
    )
    return _after_hours_report(latest.join(sensitive_tables(gov), "schema_name"))


def audit_07_summary(inputs: AuditInputs) -> DataFrame:
    gov = inputs.gov
    per_schema = (
        inputs.facts.filter(F.col("query_type") == "SELECT")
        .groupBy("schema_name")
        .agg(F.sum("after_hours").alias("queries"))
    )
    return _headline(
        "audit_07",
        per_schema.join(_schemas_with_pii(gov), "schema_name"),
        inputs,
        MEDIUM,
        query_count=F.coalesce(F.sum(F.col("queries") * F.col("sensitive_tables")), F.lit(0)),
    )


def after_hours_accesses(history: DataFrame, tables: DataFrame) -> DataFrame:
    """After-hours SELECTs with each sensitive table they accessed. Also used on streams."""
    selects = history.filter((F.col("query_type") == "SELECT") & is_after_hours(F.col("start_time")))
    return accessed_objects(selects, once_per_query=True).join(tables, ["schema_name", "table_name"], "left_semi")


def _latest_days(inputs: AuditInputs, enough: int) -> DataFrame:
    """The latest days that together have ``enough`` after-hours SELECTs on sensitive tables, from the facts.

    One row per day of the window comes to the running sum.
    """
    per_day = (
        inputs.object_facts.filter("after_hours_selects > 0")
        .join(sensitive_tables(inputs.gov), ["schema_name", "table_name"], "left_semi")
        .groupBy(schemas.LOG_DATE)
        .agg(F.sum("after_hours_selects").alias("found"))
    )
    later = Window.orderBy(F.desc(schemas.LOG_DATE)).rowsBetween(Window.unboundedPreceding, -1)
    return per_day.withColumn("later", F.coalesce(F.sum("found").over(later), F.lit(0))).filter(F.col("later") < enough)


def audit_07_by_object(inputs: AuditInputs) -> DataFrame:
    """The latest after-hours SELECTs that accessed a sensitive table.

    Where there are facts on objects, they tell which days can have any of the latest 50, and
    only the queries of these days are taken apart; of a stored log no other day is read.
    """
    gov = inputs.gov
    window = gov.environment_history(gov.clock.access_window_days)
    if inputs.object_facts is not None:
        if schemas.LOG_DATE not in window.columns:
            window = window.withColumn(schemas.LOG_DATE, F.col("start_time").cast("date"))
        window = window.join(F.broadcast(_latest_days(inputs, LATEST_QUERIES).select(schemas.LOG_DATE)), schemas.LOG_DATE, "left_semi")
    return _after_hours_report(after_hours_accesses(window, sensitive_tables(gov)))


# -- compliance ---------------------------------------------------------------


def ferpa_tables(inputs: AuditInputs) -> DataFrame:
    tagged = (
        inputs.gov.live_tags()
        .filter((F.col("tag_name") == "COMPLIANCE_TYPE") & (F.col("tag_value") == "FERPA"))
        .select(F.col("object_schema").alias("schema_name"), F.col("object_name").alias("table_name"))
        .distinct()
    )
    return inputs.coverage.join(tagged, ["schema_name", "table_name"], "left_semi")


def _is_protected() -> Column:
    return (F.col("has_masking") == "YES") | (F.col("has_row_access") == "YES")


def audit_08(inputs: AuditInputs) -> DataFrame:
    """Tables with FERPA data and whether a mask or row policy protects them."""
    return (
        ferpa_tables(inputs)
        .select(
            "schema_name",
            "table_name",
            "has_masking",
            "masked_column_count",
            "has_row_access",
            "compliance_status",
            F.when(_is_protected(), PROTECTED).otherwise(NEEDS_PROTECTION).alias("ferpa_status"),
        )
        .orderBy("ferpa_status", "schema_name", "table_name")
    )


def audit_08_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_08",
        ferpa_tables(inputs),
        inputs,
        None,
        total_tables=F.count("*"),
        protected_tables=F.count_if(_is_protected()),
    )


# Names of the columns two audits look for.
SSN_NAMES = ("%ssn%", "%social%security%")
EMAIL_NAMES = ("%email%",)
DOB_NAMES = ("%dob%", "%birth%date%")


def ssn_columns(inputs: AuditInputs) -> DataFrame:
    gov = inputs.gov
    found = gov.production_columns(gov.estate.layers).filter(name_like(F.col("column_name"), SSN_NAMES))
    return V.columns_with_masks(gov, found)


def _has_ssn_mask() -> Column:
    return F.coalesce(F.col("policy_name") == "SSN_MASK", F.lit(False))


def audit_09(inputs: AuditInputs) -> DataFrame:
    """SSN columns and whether the SSN mask is on them."""
    return (
        ssn_columns(inputs)
        .select(
            F.col("table_schema").alias("schema_name"),
            "table_name",
            "column_name",
            F.when(_has_ssn_mask(), MASKED).otherwise(UNMASKED_SSN).alias("masking_status"),
            F.col("policy_name").alias("current_policy"),
        )
        .orderBy("masking_status", "schema_name", "table_name", "column_name")
    )


def audit_09_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_09",
        ssn_columns(inputs),
        inputs,
        None,
        ssn_columns_found=F.count("*"),
        ssn_columns_masked=F.count_if(_has_ssn_mask()),
    )


def email_and_dob_columns(inputs: AuditInputs) -> DataFrame:
    gov = inputs.gov
    found = gov.production_columns(gov.estate.curated_layers).filter(
        name_like(F.col("column_name"), EMAIL_NAMES + DOB_NAMES)
    )
    return V.columns_with_masks(gov, found)


def audit_10(inputs: AuditInputs) -> DataFrame:
    """E-mail and birth date columns of the curated layers and the masks on them."""
    return (
        email_and_dob_columns(inputs)
        .select(
            F.col("table_schema").alias("schema_name"),
            "table_name",
            "column_name",
            F.when(name_like(F.col("column_name"), EMAIL_NAMES), "EMAIL").otherwise("DOB").alias("pii_type"),
            F.when(F.col("policy_name").isNotNull(), MASKED).otherwise(UNMASKED).alias("masking_status"),
            F.col("policy_name").alias("current_policy"),
        )
        .orderBy("masking_status", "pii_type", "schema_name", "table_name", "column_name")
    )


def audit_10_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_10",
        email_and_dob_columns(inputs),
        inputs,
        None,
        total_columns=F.count("*"),
        masked_columns=F.count("policy_name"),
    )


# -- tag compliance -----------------------------------------------------------


def _curated_base_tables(gov: Governance) -> DataFrame:
    return (
        gov.production_base_tables(gov.estate.curated_layers)
        .select(F.col("table_schema").alias("schema_name"), "table_name")
        .distinct()
    )


def required_tag_state(inputs: AuditInputs) -> DataFrame:
    """Curated base tables with a YES or NO per required tag.

    Tags are reduced to one row per table name before the join. A tag counts if it is on
    the table or any of its columns, in any environment.
    """
    gov = inputs.gov
    flags = dict(zip(("has_sensitivity", "has_domain", "has_owner"), REQUIRED_TABLE_TAGS))
    tags = (
        gov.live_tags()
        .filter(F.col("tag_name").isin(*REQUIRED_TABLE_TAGS))
        .groupBy(F.col("object_schema").alias("schema_name"), F.col("object_name").alias("table_name"))
        .agg(*(F.max(F.col("tag_name") == tag).alias(flag) for flag, tag in flags.items()))
    )
    has = {flag: F.coalesce(flag, F.lit(False)) for flag in flags}
    complete = has["has_sensitivity"] & has["has_domain"] & has["has_owner"]
    return (
        _curated_base_tables(gov)
        .join(tags, ["schema_name", "table_name"], "left")
        .select(
            "schema_name",
            "table_name",
            *(V.yes_no(c).alias(flag) for flag, c in has.items()),
            F.when(complete, COMPLETE).otherwise(INCOMPLETE).alias("tag_status"),
        )
    )


def audit_11(inputs: AuditInputs) -> DataFrame:
    """Tables missing a required tag."""
    return (
        required_tag_state(inputs)
        .filter(F.col("tag_status") == INCOMPLETE)
        .orderBy("schema_name", "table_name")
    )


def audit_11_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_11", _curated_base_tables(inputs.gov), inputs, INFO, total_tables=F.count_distinct("table_name")
    )


def pii_columns_with_masks(inputs: AuditInputs) -> DataFrame:
    columns = inputs.pii_columns.withColumnsRenamed(
        {"database_name": "table_catalog", "schema_name": "table_schema"}
    )
    return V.columns_with_masks(inputs.gov, columns)


def audit_12(inputs: AuditInputs) -> DataFrame:
    """Columns tagged as PII and the masks on them."""
    return (
        pii_columns_with_masks(inputs)
        .select(
            F.col("table_schema").alias("schema_name"),
            "table_name",
            "column_name",
            "sensitivity_level",
            "compliance_type",
            F.when(F.col("policy_name").isNotNull(), MASKED).otherwise(TAGGED_NOT_MASKED).alias("protection_status"),
            F.col("policy_name").alias("applied_policy"),
        )
        .orderBy("protection_status", "schema_name", "table_name", "column_name")
    )


def audit_12_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_12",
        pii_columns_with_masks(inputs),
        inputs,
        None,
        pii_tagged_columns=F.count("*"),
        masked_columns=F.count("policy_name"),
    )


# -- policy effectiveness -----------------------------------------------------


def _curated_selects(inputs: AuditInputs) -> DataFrame:
    return inputs.facts.filter(
        F.col("schema_name").isin(*inputs.gov.estate.curated_layers) & (F.col("query_type") == "SELECT")
    )


def audit_13(inputs: AuditInputs) -> DataFrame:
    """Success rate of SELECTs per role and schema, with the errors access control causes."""
    total, failed = F.sum("queries"), F.sum("failed")
    return (
        _curated_selects(inputs)
        .groupBy("role_name", "schema_name")
        .agg(
            total.alias("total_queries"),
            (total - failed).alias("successful_queries"),
            failed.alias("failed_queries"),
            F.round(100.0 * (total - failed) / total, 2).alias("success_rate_pct"),
            F.sum("access_denied").alias("access_denied_errors"),
            F.sum("policy_errors").alias("policy_errors"),
        )
        .orderBy(F.desc("failed_queries"), "role_name", "schema_name")
    )


def audit_13_summary(inputs: AuditInputs) -> DataFrame:
    return _headline(
        "audit_13",
        _curated_selects(inputs),
        inputs,
        None,
        total_queries=F.coalesce(F.sum("queries"), F.lit(0)),
    )


def is_policy_change(gov: Governance) -> Column:
    """A query on the governance schema that changes, or speaks of, policies or tags."""
    databases = (*gov.estate.environment_databases, gov.estate.governance_database)
    text = F.col("query_text")
    changes = F.col("query_type").isin(*POLICY_CHANGE_TYPES)
    for pattern in POLICY_CHANGE_TEXTS:
        changes = changes | text.ilike(pattern)
    return (
        F.col("database_name").isin(*databases)
        & (F.col("schema_name") == gov.estate.governance_schema)
        & changes
    )


def policy_changes(gov: Governance) -> DataFrame:
    return gov.history_since(gov.clock.policy_window_days).filter(is_policy_change(gov))


def audit_14(inputs: AuditInputs) -> DataFrame:
    """Changes of policies and tags, newest first."""
    return (
        policy_changes(inputs.gov)
        .orderBy(F.desc("start_time"), "query_id")
        .select("query_type", "user_name", "role_name", "start_time", "query_text")
    )


def audit_14_summary(inputs: AuditInputs) -> DataFrame:
    return _headline("audit_14", policy_changes(inputs.gov), inputs, None, policy_count=F.count("*"))


DETAILS = {
    "audit_01": audit_01,
    "audit_02": audit_02,
    "audit_03": audit_03,
    "audit_04": audit_04,
    "audit_05": audit_05,
    "audit_06": audit_06,
    "audit_06_by_object": audit_06_by_object,
    "audit_07": audit_07,
    "audit_07_by_object": audit_07_by_object,
    "audit_08": audit_08,
    "audit_09": audit_09,
    "audit_10": audit_10,
    "audit_11": audit_11,
    "audit_12": audit_12,
    "audit_13": audit_13,
    "audit_14": audit_14,
}

SUMMARIES = {
    "audit_01_summary": audit_01_summary,
    "audit_02_summary": audit_02_summary,
    "audit_03_summary": audit_03_summary,
    "audit_04_summary": audit_04_summary,
    "audit_05_summary": audit_05_summary,
    "audit_06_summary": audit_06_summary,
    "audit_07_summary": audit_07_summary,
    "audit_08_summary": audit_08_summary,
    "audit_09_summary": audit_09_summary,
    "audit_10_summary": audit_10_summary,
    "audit_11_summary": audit_11_summary,
    "audit_12_summary": audit_12_summary,
    "audit_13_summary": audit_13_summary,
    "audit_14_summary": audit_14_summary,
}


def run_audits(inputs: AuditInputs) -> Iterator[tuple[str, DataFrame]]:
    """Headline and detail of every audit, in order, over shared inputs."""
    for key, audit in {**SUMMARIES, **DETAILS}.items():
        yield key, audit(inputs)
