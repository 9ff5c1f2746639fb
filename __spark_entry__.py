"""Queries over the given tables, and the SQL each one is checked against."""

from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline.config import Clock, TableId
from wardline.functions import masking as M
from wardline.functions import roles as R
from wardline.functions import rowaccess as A
from wardline.operators import access, policy_checks, privileges, secure, session_views, tags, views
from wardline.operators.entitlements import EntitlementPolicy
from wardline.plans import audits, report
from wardline.sources import column_snapshots, demo, registry, storage
from wardline.sources.estate_tables import Governance, read_governance
from wardline.sources.query_log import write_query_history
from wardline.streaming import alerts

try:  # the subpackage, or a library it needs, may be absent
    from wardline.llm import queries as LLM  # noqa: N812
except ImportError as absent:
    LLM = None
    warnings.warn(f"queries of wardline.llm are left out: {absent}", stacklevel=1)

Query = Callable[[SparkSession, str], DataFrame]

PERSON = TableId("ORG_PROD", *demo.PERSON_TABLE)
PERSON_POLICIES = {
    "enrollment_status": A.ENROLLMENT_ROW_ACCESS,
    "is_active": A.ACTIVE_RECORDS_ONLY,
    "academic_year": A.CURRENT_AY_ACCESS,
}
MASKED_COLUMNS = {
    "SSN_MASK": "ssn",
    "EMAIL_MASK": "email",
    "DOB_MASK": "birth_date",
    "PHONE_MASK": "phone",
    "ADDRESS_MASK": "address",
    "ADDRESS_MASK_STRICT": "address",
    "FINANCIAL_AMOUNT_MASK": "aid_amount",
    "STUDENT_ID_MASK": "student_id",
    "NAME_MASK": "student_name",
}
RETENTION_CLOCK = Clock(datetime(2025, 1, 20))


def _mask(policy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return policy_checks.mask_for_roles(
            demo.person(spark, sf_dir), "person_id", MASKED_COLUMNS[policy], M.MASKING_POLICIES[policy], R.MATRIX_ROLES
        )

    return run


def _rows(policies: dict[str, A.RowPolicy], *extra_roles: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return policy_checks.visible_by_role(
            demo.person(spark, sf_dir), "person_id", policies, R.MATRIX_ROLES + extra_roles, demo.AS_OF_DATE
        )

    return run


def _entitled(policy: str, column: str, form: Callable[[Column], Column]) -> Query:
    """Rows by role, where roles and codes stand in tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = registry.standard_entitlements(spark), registry.standard_codes(spark)
        return EntitlementPolicy(policy, *tables, form).visible_by_role(demo.person(spark, sf_dir), "person_id", column)

    return run


def _person(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """The person table as ``role`` reads it, through its attachments in the registry."""
    gov = demo.governance(spark, sf_dir)
    attached = registry.attach(gov.policy_references, demo.person_attachments(spark))
    return secure.secured(demo.person(spark, sf_dir), PERSON, role, demo.AS_OF_DATE, attached)


def _masked_person(role: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        attached = registry.attach(demo.governance(spark, sf_dir).policy_references, demo.person_attachments(spark))
        return secure.masked(demo.person(spark, sf_dir), PERSON, role, attached)

    return run


def _secured_person(role: str) -> Query:
    return lambda spark, sf_dir: _person(spark, sf_dir, role)


def _governed(build: Callable[[Governance], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(demo.governance(spark, sf_dir))


def _audit(build: Callable[[audits.AuditInputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(audits.AuditInputs(demo.governance(spark, sf_dir)))


def _row_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    gov = demo.governance(spark, sf_dir)
    standard = registry.row_policy_attachments(
        spark, registry.STANDARD_ROW_POLICIES, gov.estate.environments, gov.estate
    )
    return views.v_row_access_policy_references(
        gov.with_(policy_references=registry.attach(gov.policy_references, standard))
    )


def _inherited_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the tree of roles that the parts make; no privilege adds a role to it."""
    gov = demo.governance(spark, sf_dir)
    return privileges.inherited_roles(gov.with_(role_grants=demo.role_tree(spark, sf_dir), grants=gov.grants.limit(0)))


def _row_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    gov = demo.governance(spark, sf_dir)
    references = registry.detach_row_policy(gov.policy_references, TableId("ORG_PROD", "DETERGE", "T1"))
    references = registry.detach_row_policy(
        references, TableId("ORG_PROD", "DISTRIBUTE", "T6"), "CURRENT_TERM_ACCESS"
    )
    return views.v_row_access_policy_references(gov.with_(policy_references=references))


def _masks(change: Callable[[Governance], DataFrame]) -> Query:
    """Masks as the view shows them after a change of the attachments."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gov = demo.governance(spark, sf_dir)
        return views.v_masking_policy_references(gov.with_(policy_references=change(gov)))

    return run


def _session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person table as a SQL user sees it after ``SET VAR cur_role``."""
    session_views.declare_role(spark)
    attached = registry.attach(demo.governance(spark, sf_dir).policy_references, demo.person_attachments(spark))
    session_views.create_governed_view(demo.person(spark, sf_dir), "governed_person", PERSON, demo.AS_OF_DATE, attached)
    spark.sql(f"SET VAR {session_views.ROLE_VARIABLE} = '{R.REGISTRAR_ANALYST}'")
    return spark.sql("SELECT * FROM governed_person")


def _stored_estate(spark: SparkSession, sf_dir: str) -> Governance:
    """An estate that was stored and is read again.

    Its log came in two overlapping loads, its facts on objects were kept after the first.
    """
    gov = demo.governance(spark, sf_dir)
    root = storage.fresh_dir(spark, "estate")
    for name in ("policy_references", "tag_references", "columns", "tables"):
        getattr(gov, name).write.parquet(f"{root}/{name}")
    facts = access.stored_facts(spark, root)
    write_query_history(gov.query_history.filter("start_time < '2024-01-25' OR query_id % 3 = 1"), f"{root}/query_history")
    facts.refresh()
    write_query_history(gov.query_history.filter("start_time >= '2024-01-25' AND query_id % 5 <> 1 OR query_id % 3 = 2"), f"{root}/query_history")
    write_query_history(gov.query_history.filter("start_time >= '2024-01-25' AND query_id % 5 = 1"), f"{root}/query_history")
    facts.refresh()
    return read_governance(spark, root, gov.clock, stored_facts=facts)


def _stored(build: Callable[[Governance], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_stored_estate(spark, sf_dir))


def _row_droppable(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = registry.literal_table(spark, [(name,) for name in A.ROW_POLICIES], "policy_name string")
    return registry.droppable_policies(demo.governance(spark, sf_dir).policy_references, policies)


def _masked_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _person(spark, sf_dir, R.IR_ANALYST).agg(
        F.count("*").alias("student_count"), F.avg(F.year("birth_date")).alias("avg_birth_year")
    )


def _masked_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and sums see the rounded amounts, never the exact ones."""
    return (
        _person(spark, sf_dir, R.REGISTRAR_ANALYST)
        .filter("aid_amount > 100000")
        .groupBy("enrollment_status")
        .agg(F.count("*").alias("persons"), F.sum("aid_amount").alias("aid_total"))
    )


def _status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _person(spark, sf_dir, R.ENROLLMENT_ANALYST)
        .groupBy("enrollment_status")
        .agg(F.count("*").alias("persons"))
    )


def _role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_checks.row_role_counts(
        demo.person(spark, sf_dir), "enrollment_status", PERSON_POLICIES, R.MATRIX_ROLES, demo.AS_OF_DATE
    )


def _report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    gov = demo.governance(spark, sf_dir)
    paths = report.export_reports(audits.AuditInputs(gov), storage.fresh_dir(spark, "export"))
    return report.exported_row_counts(gov, paths)


def _exported_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage report as it stands in the exported files."""
    coverage = audits.AuditInputs(demo.governance(spark, sf_dir)).coverage
    path = storage.export_csv(coverage, storage.fresh_dir(spark, "export"), "coverage", demo.AS_OF.date())
    return storage.read_csv(spark, path, coverage.schema)


def _daily_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    gov = demo.governance(spark, sf_dir)
    path = storage.fresh_dir(spark, "audit-log")
    report.log_results([report.daily_pii_check(audits.AuditInputs(gov))], path, gov.clock.as_of_date)
    return storage.read_audit_log(spark, path)


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_trend(report.daily_counts(demo.governance(spark, sf_dir)))


def _new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.new_ungoverned_columns(demo.governance(spark, sf_dir), demo.earlier_columns(spark, sf_dir))


def _snapshots(spark: SparkSession, *catalogues: DataFrame) -> list[str]:
    paths = [storage.fresh_dir(spark, "columns") for _ in catalogues]
    for columns, path in zip(catalogues, paths):
        column_snapshots.write_column_snapshot(columns, path)
    return paths


def _stored_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gov = demo.governance(spark, sf_dir)
    return report.new_ungoverned_since(gov, *_snapshots(spark, demo.earlier_columns(spark, sf_dir), gov.columns))


def _column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = demo.governance(spark, sf_dir).columns
    return column_snapshots.column_changes(spark, *_snapshots(spark, demo.former_columns(spark, sf_dir), present))


def _history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return demo.query_history_of(events)


ONCE = {"availableNow": True}


def _stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = storage.fresh_dir(spark, "after-hours")
    alerts.start_after_hours_alerts(
        lambda: demo.governance(spark, sf_dir),
        _history_stream(spark, sf_dir),
        f"{root}/alerts",
        f"{root}/checkpoint",
        ONCE,
    ).awaitTermination()
    return alerts.read_alerts(spark, f"{root}/alerts")


def _stream_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = storage.fresh_dir(spark, "volume")
    alerts.start_access_volume(
        demo.governance(spark, sf_dir),
        _history_stream(spark, sf_dir),
        f"{root}/volume",
        f"{root}/checkpoint",
        ONCE,
    ).awaitTermination()
    return alerts.read_access_volume(spark, f"{root}/volume")


def _stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = storage.fresh_dir(spark, "changes")
    alerts.start_policy_change_alerts(
        demo.governance(spark, sf_dir),
        _history_stream(spark, sf_dir),
        f"{root}/changes",
        f"{root}/checkpoint",
        ONCE,
    ).awaitTermination()
    return spark.read.parquet(f"{root}/changes")


def _role_key(role: str) -> str:
    return role.removesuffix("_ROLE").lower()


def entry(spark: SparkSession) -> DataFrame:
    """Persons an enrolment analyst may see, by enrolment status."""
    return _status_counts(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    masks = {
        "mask_ssn": "SSN_MASK",
        "mask_email": "EMAIL_MASK",
        "mask_dob": "DOB_MASK",
        "mask_phone": "PHONE_MASK",
        "mask_address": "ADDRESS_MASK",
        "mask_address_strict": "ADDRESS_MASK_STRICT",
        "mask_financial_amount": "FINANCIAL_AMOUNT_MASK",
        "mask_student_id": "STUDENT_ID_MASK",
        "mask_name": "NAME_MASK",
    }
    found: dict[str, Query] = {key: _mask(policy) for key, policy in masks.items()}
    for role in R.MATRIX_ROLES:
        found[f"secured_person_{_role_key(role)}"] = _masked_person(role)
        found[f"secured_table_{_role_key(role)}"] = _secured_person(role)
    found |= {
        "secured_status_counts": _status_counts,
        "masked_aggregate": _masked_aggregate,
        "masked_predicate": _masked_predicate,
        "mask_matrix": lambda spark, sf_dir: policy_checks.mask_matrix(
            demo.person(spark, sf_dir), MASKED_COLUMNS, R.MATRIX_ROLES
        ),
        "policy_value_audit": lambda spark, sf_dir: policy_checks.policy_value_audit(
            demo.person(spark, sf_dir), MASKED_COLUMNS, R.MATRIX_ROLES
        ),
        "row_enrollment": _rows({"enrollment_status": A.ENROLLMENT_ROW_ACCESS}),
        "row_active": _rows({"is_active": A.ACTIVE_RECORDS_ONLY}),
        "row_academic_year": _rows({"academic_year": A.CURRENT_AY_ACCESS}),
        "row_term": _rows({"term_code": A.CURRENT_TERM_ACCESS}),
        "row_department": _entitled(A.DEPARTMENT_ACCESS, "department_code", lambda code: code),
        "row_ferpa_consent": _rows({"ferpa_consent": A.FERPA_CONSENT_ACCESS}),
        "row_program_type": _entitled(A.PROGRAM_TYPE_ACCESS, "program_type", F.upper),
        "row_combined": _rows(PERSON_POLICIES),
        "row_role_counts": _role_counts,
        "row_policy_attach": _row_attach,
        "row_detach": _row_detach,
        "row_droppable_policies": _row_droppable,
        "mask_policy_attach": _masks(
            lambda gov: registry.attach(
                gov.policy_references,
                registry.mask_attachments(gov.spark, registry.STANDARD_MASKS, gov.estate.environments, gov.estate),
            )
        ),
        "mask_detach": _masks(
            lambda gov: registry.detach_mask(gov.policy_references, TableId("ORG_PROD", "DISTRIBUTE", "T2"))
        ),
        "mask_replace": _masks(
            lambda gov: registry.replace_policy(gov.policy_references, "ADDRESS_MASK", "ADDRESS_MASK_STRICT")
        ),
        "session_view": _session_view,
        "stored_access_frequency": _stored(views.v_table_access_frequency),
        "stored_access_by_object": _stored(lambda gov: audits.audit_06_by_object(audits.AuditInputs(gov))),
        "stored_after_hours_by_object": _stored(lambda gov: audits.audit_07_by_object(audits.AuditInputs(gov))),
        "stored_retention_due": _stored(lambda gov: tags.retention_due(gov.with_(clock=RETENTION_CLOCK))),
        # tags
        "tag_taxonomy": _governed(tags.tag_taxonomy_usage),
        "tag_invalid_values": _governed(tags.tag_invalid_values),
        "effective_tags": _governed(tags.effective_tags),
        "required_table_tags": _audit(audits.required_tag_state),
        "pii_column_tag_rules": _governed(tags.pii_column_tag_rules),
        "tag_consistency": _governed(tags.tag_consistency),
        "environment_drift": lambda spark, sf_dir: tags.environment_drift(demo.with_environments(spark, sf_dir)),
        "environment_tag_drift": lambda spark, sf_dir: tags.environment_tag_drift(demo.with_environments(spark, sf_dir)),
        "tag_driven_masking": _governed(tags.tag_driven_masking),
        "tag_policy_references": _governed(tags.tag_policy_references),
        "retention_due": lambda spark, sf_dir: tags.retention_due(
            demo.governance(spark, sf_dir).with_(clock=RETENTION_CLOCK)
        ),
        # privileges
        "role_closure": _governed(privileges.role_closure_usage),
        "effective_privileges": _governed(privileges.effective_privileges),
        "role_access_matrix": _governed(privileges.role_access_matrix),
        "unexpected_access": _governed(privileges.unexpected_access),
        "future_grant_gaps": _governed(privileges.future_grant_gaps),
        "user_roles": _governed(privileges.user_roles),
        "users_per_role": _governed(privileges.users_per_role),
        "granted_unused": _governed(privileges.granted_unused),
        "used_not_granted": _governed(privileges.used_not_granted),
        "inherited_roles": _inherited_roles,
        # views
        "v_masking_policy_references": _governed(views.v_masking_policy_references),
        "v_masking_policy_summary": _governed(views.v_masking_policy_summary),
        "masking_policy_tables": _governed(views.masking_policy_tables),
        "row_policy_tables": _governed(views.row_policy_tables),
        "v_row_access_policy_references": _governed(views.v_row_access_policy_references),
        "v_row_access_policy_summary": _governed(views.v_row_access_policy_summary),
        "v_tagged_objects": _governed(views.v_tagged_objects),
        "v_tag_coverage_summary": _governed(views.v_tag_coverage_summary),
        "v_pii_columns": _governed(views.v_pii_columns),
        "v_potential_sensitive_columns": _governed(views.v_potential_sensitive_columns),
        "v_potential_sensitive_columns_wide": _governed(views.v_potential_sensitive_columns_wide),
        "v_recent_access_patterns": _governed(views.v_recent_access_patterns),
        "v_table_access_frequency": _governed(views.v_table_access_frequency),
        "v_governance_coverage_report": _governed(views.v_governance_coverage_report),
        "view_row_counts": _governed(views.view_row_counts),
        "coverage_rollup": _governed(views.coverage_rollup),
        "quick_check_unmasked": _governed(views.quick_check_unmasked),
        "quick_check_needs_review": _governed(views.quick_check_needs_review),
        "quick_check_top_users": _governed(views.quick_check_top_users),
        "access_to_layer": _governed(views.access_to_layer),
        "masks_in_layer": _governed(views.masks_in_layer),
        "row_policy_filters": _governed(views.row_policy_filters),
    }
    # audits
    found |= {key: _audit(build) for key, build in {**audits.DETAILS, **audits.SUMMARIES}.items()}
    found |= {
        # report
        "report_period": _audit(lambda inputs: report.report_period(inputs, "AUDITOR", R.GOVERNANCE_ADMIN)),
        "report_policy_coverage": _audit(report.report_policy_coverage),
        "report_issues": _audit(report.report_issues),
        "report_access": _audit(report.report_access),
        "report_recommendations": _audit(report.report_recommendations),
        "audit_counts": _audit(report.audit_counts),
        "report_export": _report_export,
        "exported_coverage": _exported_coverage,
        "daily_pii_check": _daily_check,
        "audit_trend": _trend,
        "new_ungoverned_columns": _new_columns,
        "stored_new_ungoverned_columns": _stored_new_columns,
        "column_changes": _column_changes,
        # streams
        "stream_after_hours_alerts": _stream_alerts,
        "stream_access_volume": _stream_volume,
        "stream_policy_changes": _stream_changes,
    }
    return found | (LLM.queries() if LLM else {})


def oracle_sql() -> dict[str, str]:
    from sql_checks import oracle_sql as sql

    return sql() | (LLM.oracle_sql() if LLM else {})
