"""The same results in plain SQL, for checking the Spark queries with another engine.

Written against the results' meaning, not against the DataFrame code. Only the
derivation of the input tables is shared.
"""

from __future__ import annotations

from sql_checks import history, metadata, policies


def _counts(summaries: dict[str, str]) -> str:
    """First count of every headline, from the headlines' own SQL."""
    first = {
        "audit_05_summary": "user_count",
        "audit_06_summary": "unique_users",
        "audit_07_summary": "query_count",
        "audit_08_summary": "total_tables",
        "audit_09_summary": "ssn_columns_found",
        "audit_10_summary": "total_columns",
        "audit_11_summary": "total_tables",
        "audit_12_summary": "pii_tagged_columns",
        "audit_13_summary": "total_queries",
        "audit_14_summary": "policy_count",
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{key}' AS audit_name, {first.get(key, 'issue_count')} AS issue_count FROM ({text})"
        for key, text in summaries.items()
    )


def oracle_sql() -> dict[str, str]:
    found = {**policies.SQL, **metadata.SQL, **history.SQL}
    found["audit_counts"] = _counts({k: v for k, v in found.items() if k.endswith("_summary") and k.startswith("audit")})
    found["exported_coverage"] = found["v_governance_coverage_report"]
    found["session_view"] = found["secured_table_registrar_analyst"]
    found["stored_access_frequency"] = found["v_table_access_frequency"]
    found["stored_new_ungoverned_columns"] = found["new_ungoverned_columns"]
    found["stored_access_by_object"] = found["audit_06_by_object"]
    found["stored_after_hours_by_object"] = found["audit_07_by_object"]
    found["stored_retention_due"] = found["retention_due"]
    return found
