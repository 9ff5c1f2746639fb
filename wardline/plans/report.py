"""The monthly governance report, its export and the daily check."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import views as V
from wardline.plans.audits import (
    AuditInputs,
    access_level,
    curated_access,
    HIGH_VOLUME,
    SUMMARIES,
    policy_changes,
    unmasked_columns,
    VERY_HIGH_VOLUME,
)
from wardline.sources import storage
from wardline.sources.column_snapshots import new_columns
from wardline.sources.estate_tables import Governance

# The report's wording.
PERIOD_TEXT = "Audit Period: Last 30 Days"
UNMASKED_ISSUE, UNGOVERNED_ISSUE, UNTAGGED_ISSUE = (
    "Unmasked PII Columns",
    "Ungoverned Tables",
    "Untagged PII Columns",
)
HIGH_PRIORITY, MEDIUM_PRIORITY = "🚨 HIGH", "⚠️ MEDIUM"
RECOMMENDATIONS = (
    "☐ Review and apply masking to unmasked PII columns",
    "☐ Apply tags to all ungoverned tables",
    "☐ Verify high-volume user access is legitimate",
    "☐ Update governance documentation",
    "☐ Schedule quarterly governance review",
)


def report_period(inputs: AuditInputs, auditor: str, auditor_role: str) -> DataFrame:
    """The period the report covers, who runs it, and the queries logged in it."""
    clock = inputs.gov.clock
    start = clock.as_of_date - timedelta(days=clock.access_window_days)
    logged = inputs.gov.history_since(clock.access_window_days)
    return logged.agg(
        F.count("*").alias("logged_queries"),
        F.min("start_time").alias("first_query"),
        F.max("start_time").alias("last_query"),
    ).select(
        F.lit(PERIOD_TEXT).alias("period"),
        F.lit(start.isoformat()).alias("start_date"),
        F.lit(clock.as_of_date.isoformat()).alias("end_date"),
        F.lit(auditor).alias("auditor"),
        F.lit(auditor_role).alias("auditor_role"),
        "logged_queries",
        "first_query",
        "last_query",
    )


def report_policy_coverage(inputs: AuditInputs) -> DataFrame:
    """Totals over the coverage report and the share of compliant tables."""
    totals = inputs.coverage.agg(
        F.count("*").alias("total_tables"),
        F.count_if(F.col("compliance_status") == V.COMPLIANT).alias("compliant_tables"),
        F.count_if(F.col("has_masking") == "YES").alias("tables_with_masking"),
        F.sum("masked_column_count").alias("total_masked_columns"),
        F.count_if(F.col("has_row_access") == "YES").alias("tables_with_row_access"),
        F.count_if(F.col("has_tags") == "YES").alias("tables_with_tags"),
    )
    rate = F.round(100.0 * F.col("compliant_tables") / F.nullif(F.col("total_tables"), F.lit(0)), 1)
    return totals.select(
        "total_tables",
        "compliant_tables",
        F.when(rate.isNotNull(), F.format_string("%.1f%%", rate)).alias("compliance_rate"),
        "tables_with_masking",
        "total_masked_columns",
        "tables_with_row_access",
        "tables_with_tags",
    )


def _lines(counts: DataFrame, entries: list[tuple[str, ...]], *names: str) -> DataFrame:
    """One row of counts as report lines: each entry is a count column followed by fixed texts."""
    return counts.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.col(entry[0]).alias(names[0]), *(F.lit(t).alias(n) for t, n in zip(entry[1:], names[1:])))
                    for entry in entries
                )
            )
        )
    )


def _column_counts(inputs: AuditInputs) -> DataFrame:
    return inputs.sensitive_columns.agg(
        F.count_if(F.col("has_masking_policy") == V.NOT_MASKED).alias("unmasked"),
        F.count_if(F.col("tagged_as_pii") == V.NOT_TAGGED).alias("untagged"),
    )


def _table_counts(inputs: AuditInputs) -> DataFrame:
    return inputs.coverage.agg(
        F.count_if(F.col("compliance_status") == V.NEEDS_REVIEW).alias("ungoverned"),
        F.count_if(F.col("compliance_status") != V.COMPLIANT).alias("not_compliant"),
    )


def report_issues(inputs: AuditInputs) -> DataFrame:
    """The three issue counts with their priority: one pass over each of the two views."""
    names = ("count", "issue_type", "priority")
    columns = _lines(
        _column_counts(inputs),
        [("unmasked", UNMASKED_ISSUE, HIGH_PRIORITY), ("untagged", UNTAGGED_ISSUE, MEDIUM_PRIORITY)],
        *names,
    )
    tables = _lines(_table_counts(inputs), [("ungoverned", UNGOVERNED_ISSUE, MEDIUM_PRIORITY)], *names)
    return columns.unionByName(tables).select("issue_type", "count", "priority")


def report_access(inputs: AuditInputs) -> DataFrame:
    """Users, roles, queries and rows of the access window."""
    return inputs.access.agg(
        F.count_distinct("user_name").alias("unique_users"),
        F.count_distinct("role_name").alias("unique_roles"),
        F.sum("query_count").alias("total_queries"),
        F.sum("total_rows_returned").alias("total_rows_accessed"),
    )


def report_recommendations(inputs: AuditInputs) -> DataFrame:
    """The standing recommendations, each with the number of open items behind it."""
    level = access_level(F.col("query_count"))
    mask, tag, volume, document, review = RECOMMENDATIONS
    names = ("open_items", "recommendation")
    columns = _lines(_column_counts(inputs), [("unmasked", mask)], *names)
    tables = _lines(_table_counts(inputs), [("ungoverned", tag), ("not_compliant", review)], *names)
    users = curated_access(inputs).agg(F.count_if(level.isin(VERY_HIGH_VOLUME, HIGH_VOLUME)).alias("users"))
    changes = policy_changes(inputs.gov).agg(F.count("*").alias("changes"))
    return (
        columns.unionByName(tables)
        .unionByName(_lines(users, [("users", volume)], *names))
        .unionByName(_lines(changes, [("changes", document)], *names))
        .select("recommendation", "open_items")
    )


def report_sections(inputs: AuditInputs, auditor: str, auditor_role: str) -> dict[str, DataFrame]:
    return {
        "period": report_period(inputs, auditor, auditor_role),
        "policy_coverage": report_policy_coverage(inputs),
        "issues": report_issues(inputs),
        "access": report_access(inputs),
        "recommendations": report_recommendations(inputs),
    }


EXPORTED = ("potential_sensitive_columns", "governance_coverage_report", "recent_access_patterns", "policy_coverage")


def exported(inputs: AuditInputs) -> dict[str, DataFrame]:
    frames = (inputs.sensitive_columns, inputs.coverage, inputs.access, report_policy_coverage(inputs))
    return dict(zip(EXPORTED, frames))


def export_reports(inputs: AuditInputs, root: str) -> dict[str, str]:
    """Write the recommended exports as CSV under ``root``; returns the path of each."""
    run_date = inputs.gov.clock.as_of_date
    return {name: storage.export_csv(df, root, name, run_date) for name, df in exported(inputs).items()}


def exported_row_counts(gov: Governance, paths: dict[str, str]) -> DataFrame:
    """Rows in each exported report, read back from the files."""
    frames, counts = exported(AuditInputs(gov)), None
    for name, path in paths.items():
        one = (
            storage.read_csv(gov.spark, path, frames[name].schema)
            .agg(F.count("*").alias("row_count"))
            .select(F.lit(name).alias("report"), "row_count")
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def daily_pii_check(inputs: AuditInputs) -> DataFrame:
    """``(audit_name, issue_count)`` of the daily check: sensitive columns without a mask."""
    return unmasked_columns(inputs).agg(F.count("*").alias("issue_count")).select(
        F.lit("daily_pii_check").alias("audit_name"), "issue_count"
    )


def daily_counts(gov: Governance) -> DataFrame:
    """Findings per day that can be told from the log itself, in the form of the audit log."""
    from wardline.operators.access import is_after_hours

    day = F.col("start_time").cast("date")
    findings = {
        "failed_queries": F.col("error_code").isNotNull(),
        "after_hours_selects": (F.col("query_type") == "SELECT") & is_after_hours(F.col("start_time")),
        "policy_texts": F.col("query_text").ilike("%policy%"),
    }
    per_day = (
        gov.query_history.filter(F.col("database_name").isin(*gov.estate.environment_databases))
        .groupBy(day.alias("audit_date"))
        .agg(*(F.count_if(condition).alias(name) for name, condition in findings.items()))
    )
    return per_day.unpivot(["audit_date"], list(findings), "audit_name", "issue_count")


def audit_trend(log: DataFrame) -> DataFrame:
    """Change of each audit since its previous run. The log has one row per audit and day."""
    runs = Window.partitionBy("audit_name").orderBy("audit_date")
    previous = F.lag("issue_count").over(runs)
    return log.select(
        "audit_name",
        "audit_date",
        "issue_count",
        previous.alias("previous_count"),
        (F.col("issue_count") - previous).alias("change"),
    )


def new_ungoverned_columns(gov: Governance, earlier_columns: DataFrame) -> DataFrame:
    """Sensitive columns that are new since an earlier catalogue and not yet masked and tagged."""
    key = V.CATALOG_COLUMN
    return _ungoverned(gov, gov.columns.join(earlier_columns.select(*key), key, "left_anti"))


def new_ungoverned_since(gov: Governance, earlier: str, later: str) -> DataFrame:
    """The same from two stored snapshots: catalogue rows of unchanged schemas are not read."""
    return _ungoverned(gov, new_columns(gov.spark, earlier, later))


def _ungoverned(gov: Governance, new: DataFrame) -> DataFrame:
    return V.potential_sensitive_columns(gov.with_(columns=new)).filter(
        (F.col("has_masking_policy") == V.NOT_MASKED) | (F.col("tagged_as_pii") == V.NOT_TAGGED)
    )


def audit_counts(inputs: AuditInputs) -> DataFrame:
    """``(audit_name, issue_count)`` of every audit, in the form of the audit log.

    A union, so the counts of all audits are one job whose stages run side by side.
    """
    counts = None
    for key, summary in SUMMARIES.items():
        headline = summary(inputs)
        first_count = headline.columns[1]
        one = headline.select(F.lit(key).alias("audit_name"), F.col(first_count).alias("issue_count"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def log_results(results: Iterable[DataFrame], path: str, run_date: date) -> None:
    """Append several audits' counts to the log in one write."""
    merged = None
    for df in results:
        merged = df if merged is None else merged.unionByName(df)
    if merged is not None:
        storage.append_audit_log(merged, path, run_date)
