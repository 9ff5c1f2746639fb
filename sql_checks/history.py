"""Access patterns, access audits and the reports on them in SQL."""

from __future__ import annotations

from sql_checks import metadata
from sql_checks.fixtures import sql
from sql_checks.metadata import AT

LAYERS = "('DEPOSIT', 'DETERGE', 'DISTRIBUTE')"
CURATED = "('DETERGE', 'DISTRIBUTE')"

V9 = dict(
    v9=f"""
    SELECT user_name, role_name, database_name, schema_name, count(*) AS query_count,
      count(DISTINCT CAST(start_time AS DATE)) AS days_active, min(start_time) AS first_access, max(start_time) AS last_access,
      CAST(sum(total_elapsed_time) AS BIGINT) / 1000 AS total_seconds, CAST(sum(rows_produced) AS BIGINT) AS total_rows_returned
    FROM recent WHERE schema_name IN {LAYERS} AND query_type NOT IN ('SHOW', 'DESCRIBE', 'USE') GROUP BY ALL
    """
)
_NAMES = "unnest(regexp_extract_all(objects_accessed, '\"objectName\":\"([^\"]*)\"', 1))"
V10 = dict(
    v10=f"""
    SELECT database_name, schema_name, table_name, role_name, count(*) AS access_count,
      count(DISTINCT user_name) AS unique_users, max(start_time) AS last_accessed
    FROM (SELECT *, {_NAMES} AS table_name FROM recent WHERE schema_name IN {LAYERS}) GROUP BY ALL
    """
)
SENSITIVE = dict(
    sensitive="""SELECT DISTINCT object_schema AS schema_name, object_name AS table_name FROM live_tags
    WHERE tag_name = 'CONTAINS_PII' AND tag_value = 'TRUE'"""
)
READS = ("recent", "live_tags")
_TYPES = "('SELECT', 'COPY', 'INSERT', 'UPDATE')"
A6 = dict(SENSITIVE, joined=f"SELECT * FROM recent JOIN sensitive USING (schema_name) WHERE query_type IN {_TYPES}")
A6_OBJECT = dict(
    SENSITIVE,
    joined=f"""SELECT r.* FROM (SELECT DISTINCT query_id, user_name, role_name, schema_name, start_time, {_NAMES} AS table_name
      FROM recent WHERE query_type IN {_TYPES}) r SEMI JOIN sensitive USING (schema_name, table_name)""",
)
_A6_REPORT = """SELECT schema_name, table_name, role_name, count(DISTINCT user_name) AS user_count, count(*) AS query_count,
  max(start_time) AS last_access FROM joined GROUP BY ALL"""
_OFF = "query_type = 'SELECT' AND (hour(start_time) NOT BETWEEN 6 AND 21 OR isodow(start_time) >= 6)"
A7 = dict(SENSITIVE, joined=f"SELECT * FROM recent JOIN sensitive USING (schema_name) WHERE {_OFF}")
A7_OBJECT = dict(
    SENSITIVE,
    joined=f"""SELECT r.* FROM (SELECT DISTINCT query_id, user_name, role_name, schema_name, start_time, query_text, {_NAMES} AS table_name
      FROM recent WHERE {_OFF}) r SEMI JOIN sensitive USING (schema_name, table_name)""",
)
_A7_REPORT = """SELECT user_name, role_name, table_name, start_time, CAST(hour(start_time) AS INTEGER) AS access_hour,
  left(dayname(start_time), 3) AS access_day, query_text
FROM joined ORDER BY start_time DESC, query_id, table_name LIMIT 50"""
_STREAM_ALERTS = dict(
    SENSITIVE,
    joined=f"""SELECT r.* FROM (SELECT DISTINCT query_id, user_name, role_name, schema_name, start_time, query_text, {_NAMES} AS table_name
      FROM query_history WHERE database_name IN ('ORG_DEV', 'ORG_TEST', 'ORG_PROD') AND {_OFF}) r
      SEMI JOIN sensitive USING (schema_name, table_name)""",
)
_LEVEL = """CASE WHEN query_count > 1000 THEN '🚨 VERY HIGH' WHEN query_count > 500 THEN '⚠️ HIGH'
  WHEN query_count > 100 THEN '📊 MODERATE' ELSE '✓ NORMAL' END"""
_CHANGE = """schema_name = 'GOVERNANCE' AND database_name IN ('ORG_DEV', 'ORG_TEST', 'ORG_PROD', 'GOV_DB')
  AND (coalesce(query_type IN ('CREATE', 'ALTER', 'DROP'), FALSE)
       OR regexp_matches(lower(query_text), 'masking.*policy|row.*access.*policy|tag'))"""
CHANGES = dict(
    changes=f"SELECT * FROM query_history WHERE start_time >= TIMESTAMP '2023-11-12 00:00:00' AND {_CHANGE}"
)
A13 = dict(
    selects=f"SELECT * FROM recent WHERE query_type = 'SELECT' AND schema_name IN {CURATED}",
    rates="""
    SELECT role_name, schema_name, count(*) AS total_queries, count(*) - count(error_code) AS successful_queries,
      count(error_code) AS failed_queries,
      count(*) FILTER (WHERE regexp_matches(lower(error_message), 'access.*denied')) AS access_denied_errors,
      count(*) FILTER (WHERE contains(lower(error_message), 'policy')) AS policy_errors
    FROM selects GROUP BY ALL
    """,
)


def _row_counts() -> str:
    steps = {**metadata.V7, **metadata.V8, **V9, **V10, **metadata.V11}
    steps.update(
        v1=metadata._MASK_REFS,
        v2=metadata._MASK_SUMMARY,
        v3=metadata._ROW_REFS,
        v4=metadata._ROW_SUMMARY,
        v6=metadata._TAG_COVERAGE,
    )
    counted = {
        "V_MASKING_POLICY_REFERENCES": "v1",
        "V_MASKING_POLICY_SUMMARY": "v2",
        "V_ROW_ACCESS_POLICY_REFERENCES": "v3",
        "V_ROW_ACCESS_POLICY_SUMMARY": "v4",
        "V_TAGGED_OBJECTS": "live_tags",
        "V_TAG_COVERAGE_SUMMARY": "v6",
        "V_PII_COLUMNS": "v7",
        "V_POTENTIAL_SENSITIVE_COLUMNS": "v8",
        "V_RECENT_ACCESS_PATTERNS": "v9",
        "V_TABLE_ACCESS_FREQUENCY": "v10",
        "V_GOVERNANCE_COVERAGE_REPORT": "v11",
    }
    select = " UNION ALL ".join(
        f"SELECT '{name}' AS view_name, count(*) AS row_count FROM {step}" for name, step in counted.items()
    )
    return sql(select, "governed", "live_tags", "columns", "recent", **steps)


_POLICY_COVERAGE_READS = dict(metadata.V8, **V9, **metadata.V11, **CHANGES)
_ALL_READS = (*metadata.V8_READS, *metadata.V11_READS, "recent")

SQL: dict[str, str] = {
    "v_recent_access_patterns": sql("SELECT * FROM v9", "recent", **V9),
    "v_table_access_frequency": sql("SELECT * FROM v10", "recent", **V10),
    "view_row_counts": _row_counts(),
    "quick_check_top_users": sql(
        "SELECT * FROM v9 ORDER BY query_count DESC, user_name, role_name, database_name, schema_name LIMIT 20",
        "recent",
        **V9,
    ),
    "access_to_layer": sql(
        "SELECT user_name, role_name, query_count, last_access FROM v9 WHERE schema_name = 'DISTRIBUTE'", "recent", **V9
    ),
    "audit_05": sql(
        f"""SELECT user_name, role_name, schema_name, query_count, days_active, total_rows_returned, last_access, {_LEVEL} AS access_level
        FROM v9 WHERE schema_name IN {CURATED}
        ORDER BY query_count DESC, user_name, role_name, database_name, schema_name LIMIT 20""",
        "recent",
        **V9,
    ),
    "audit_05_summary": sql(
        f"SELECT '🔍 HIGH VOLUME USERS' AS audit_name, count(*) AS user_count, 'INFO' AS priority, {AT} FROM v9 WHERE schema_name IN {CURATED}",
        "recent",
        **V9,
    ),
    "audit_06": sql(_A6_REPORT, *READS, **A6),
    "audit_06_by_object": sql(_A6_REPORT, *READS, **A6_OBJECT),
    "audit_06_summary": sql(
        f"SELECT '🔐 SENSITIVE TABLE ACCESS' AS audit_name, count(DISTINCT user_name) AS unique_users, "
        f"count(DISTINCT role_name) AS unique_roles, 'INFO' AS priority, {AT} FROM joined",
        *READS,
        **A6,
    ),
    "audit_07": sql(_A7_REPORT, *READS, **A7),
    "audit_07_by_object": sql(_A7_REPORT, *READS, **A7_OBJECT),
    "audit_07_summary": sql(
        f"SELECT '🌙 AFTER-HOURS PII ACCESS' AS audit_name, count(*) AS query_count, 'MEDIUM' AS priority, {AT} FROM joined",
        *READS,
        **A7,
    ),
    "audit_13": sql(
        """SELECT *, ((20000 * successful_queries + total_queries) // (2 * total_queries)) / 100.0 AS success_rate_pct FROM rates""",
        "recent",
        **A13,
    ),
    "audit_13_summary": sql(
        f"SELECT '📊 QUERY SUCCESS RATES BY ROLE' AS audit_name, count(*) AS total_queries, {AT} FROM selects",
        "recent",
        **A13,
    ),
    "audit_14": sql(
        "SELECT query_type, user_name, role_name, start_time, query_text FROM changes", "query_history", **CHANGES
    ),
    "audit_14_summary": sql(
        f"SELECT '📝 POLICY CHANGE HISTORY' AS audit_name, count(*) AS policy_count, {AT} FROM changes",
        "query_history",
        **CHANGES,
    ),
    "report_period": sql(
        """SELECT 'Audit Period: Last 30 Days' AS period, '2024-01-11' AS start_date, '2024-02-10' AS end_date,
          'AUDITOR' AS auditor, 'GOVERNANCE_ADMIN_ROLE' AS auditor_role, count(*) AS logged_queries,
          min(start_time) AS first_query, max(start_time) AS last_query
        FROM query_history WHERE start_time >= TIMESTAMP '2024-01-11 00:00:00'""",
        "query_history",
    ),
    "report_access": sql(
        """SELECT count(DISTINCT user_name) AS unique_users, count(DISTINCT role_name) AS unique_roles,
          CAST(sum(query_count) AS BIGINT) AS total_queries, CAST(sum(total_rows_returned) AS BIGINT) AS total_rows_accessed FROM v9""",
        "recent",
        **V9,
    ),
    "report_recommendations": sql(
        f"""SELECT '☐ Review and apply masking to unmasked PII columns' AS recommendation,
          (SELECT count(*) FROM v8 WHERE {metadata._UNMASKED}) AS open_items
        UNION ALL SELECT '☐ Apply tags to all ungoverned tables', (SELECT count(*) FROM v11 WHERE compliance_status = 'NEEDS_REVIEW')
        UNION ALL SELECT '☐ Verify high-volume user access is legitimate',
          (SELECT count(*) FROM v9 WHERE schema_name IN {CURATED} AND query_count > 500)
        UNION ALL SELECT '☐ Update governance documentation', (SELECT count(*) FROM changes)
        UNION ALL SELECT '☐ Schedule quarterly governance review', (SELECT count(*) FROM v11 WHERE compliance_status <> 'COMPLIANT')""",
        *_ALL_READS,
        **_POLICY_COVERAGE_READS,
    ),
    "report_export": sql(
        """SELECT 'potential_sensitive_columns' AS report, count(*) AS row_count FROM v8
        UNION ALL SELECT 'governance_coverage_report', count(*) FROM v11
        UNION ALL SELECT 'recent_access_patterns', count(*) FROM v9
        UNION ALL SELECT 'policy_coverage', 1""",
        *_ALL_READS,
        **metadata.V8,
        **V9,
        **metadata.V11,
    ),
    "audit_trend": sql(
        """SELECT audit_name, audit_date, issue_count, lag(issue_count) OVER w AS previous_count,
          issue_count - lag(issue_count) OVER w AS change FROM log WINDOW w AS (PARTITION BY audit_name ORDER BY audit_date)""",
        "query_history",
        log=f"""
        SELECT CAST(start_time AS DATE) AS audit_date, unnest(['failed_queries', 'after_hours_selects', 'policy_texts']) AS audit_name,
          unnest([count(error_code), count(*) FILTER (WHERE {_OFF}), count(*) FILTER (WHERE query_text ILIKE '%policy%')]) AS issue_count
        FROM query_history WHERE database_name IN ('ORG_DEV', 'ORG_TEST', 'ORG_PROD') GROUP BY CAST(start_time AS DATE)
        """,
    ),
    "stream_after_hours_alerts": sql(
        "SELECT query_id, user_name, role_name, schema_name, table_name, start_time, query_text FROM joined",
        "query_history",
        "live_tags",
        **_STREAM_ALERTS,
    ),
    "stream_access_volume": sql(
        f"""SELECT *, {_LEVEL} AS access_level FROM (
          SELECT CAST(start_time AS DATE) AS day, user_name, role_name, count(*) AS query_count,
            CAST(sum(rows_produced) AS BIGINT) AS rows_returned
          FROM query_history WHERE database_name IN ('ORG_DEV', 'ORG_TEST', 'ORG_PROD') AND schema_name IN {LAYERS}
            AND query_type NOT IN ('SHOW', 'DESCRIBE', 'USE') GROUP BY ALL)""",
        "query_history",
    ),
    "stream_policy_changes": sql(
        f"SELECT query_id, query_type, user_name, role_name, start_time, query_text FROM query_history WHERE {_CHANGE}",
        "query_history",
    ),
}
