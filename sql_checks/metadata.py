"""Tags, privileges, attachments, detection and coverage in SQL."""

from __future__ import annotations

from sql_checks.fixtures import sql

COLUMN = "object_database, object_schema, object_name, column_name"
AT = "TIMESTAMP '2024-02-10 00:00:00' AS audit_timestamp"

# Patterns in order of precedence; the lowest number that matches decides.
TYPE_RULES = """
SELECT * FROM (VALUES
  (1, '%ssn%', 'SSN'), (1, '%social%security%', 'SSN'),
  (2, '%email%', 'EMAIL'),
  (3, '%dob%', 'DOB'), (3, '%birth%date%', 'DOB'),
  (4, '%phone%', 'PHONE'), (4, '%mobile%', 'PHONE'),
  (5, '%address%', 'ADDRESS'), (5, '%street%', 'ADDRESS'), (5, '%addr%', 'ADDRESS'),
  (6, '%salary%', 'FINANCIAL'), (6, '%wage%', 'FINANCIAL'), (6, '%income%', 'FINANCIAL'), (6, '%amount%', 'FINANCIAL'),
  (7, '%student%id%', 'STUDENT_ID'),
  (8, '%password%', 'PASSWORD'), (8, '%pwd%', 'PASSWORD'),
  (9, '%name%', 'NAME')) AS v(precedence, pattern, label)
"""
POLICY_RULES = """
SELECT * FROM (VALUES
  (1, '%ssn%', 'SSN_MASK'), (2, '%email%', 'EMAIL_MASK'), (3, '%dob%', 'DOB_MASK'), (3, '%birth%', 'DOB_MASK'),
  (4, '%phone%', 'PHONE_MASK'), (5, '%address%', 'ADDRESS_MASK'), (6, '%amount%', 'FINANCIAL_AMOUNT_MASK'),
  (7, '%student%id%', 'STUDENT_ID_MASK'), (8, '%name%', 'NAME_MASK')) AS v(precedence, pattern, label)
"""
LISTED = """
SELECT * FROM (VALUES ('%ssn%'), ('%social%'), ('%email%'), ('%dob%'), ('%birth%'), ('%phone%'), ('%address%'),
  ('%salary%'), ('%amount%'), ('%student%id%'), ('%password%'), ('%name%')) AS v(pattern)
"""
PROD_COLUMNS = """
SELECT *, lower(column_name) AS low, table_schema IN ('DETERGE', 'DISTRIBUTE') AS curated
FROM columns WHERE table_catalog = 'ORG_PROD' AND table_schema IN ('DEPOSIT', 'DETERGE', 'DISTRIBUTE')
"""
TYPED = """
SELECT c.column_id, arg_min(r.label, r.precedence) AS kind
FROM prod_columns c JOIN type_rules r ON c.low LIKE r.pattern AND (c.curated OR r.label <> 'NAME') GROUP BY ALL
"""
SUGGESTED = """
SELECT c.column_id, arg_min(r.label, r.precedence) AS policy
FROM prod_columns c JOIN policy_rules r ON c.low LIKE r.pattern GROUP BY ALL
"""
ON_LIST = """
SELECT DISTINCT c.column_id FROM prod_columns c JOIN listed l
  ON c.low LIKE l.pattern AND (c.curated OR l.pattern <> '%name%')
"""
_DETECTION = dict(
    prod_columns=PROD_COLUMNS,
    type_rules=TYPE_RULES,
    policy_rules=POLICY_RULES,
    listed=LISTED,
    typed=TYPED,
    suggested=SUGGESTED,
    on_list=ON_LIST,
)


def _v8(candidates: str) -> str:
    return f"""
    SELECT c.table_catalog AS database_name, c.table_schema AS schema_name, c.table_name, c.column_name, c.data_type,
      coalesce(t.kind, 'REVIEW') AS suggested_pii_type, coalesce(s.policy, 'REVIEW_NEEDED') AS suggested_masking_policy,
      coalesce('YES (' || m.policy_name || ')', 'NO - NEEDS REVIEW') AS has_masking_policy,
      CASE WHEN g.tag_value = 'TRUE' THEN 'YES' ELSE 'NO - NEEDS TAGGING' END AS tagged_as_pii
    FROM ({candidates}) c
    LEFT JOIN typed t USING (column_id)
    LEFT JOIN suggested s USING (column_id)
    LEFT JOIN (SELECT * FROM policy_references WHERE policy_kind = 'MASKING_POLICY' AND policy_schema = 'GOVERNANCE') m
      ON (m.ref_database_name, m.ref_schema_name, m.ref_entity_name, m.ref_column_name)
       = (c.table_catalog, c.table_schema, c.table_name, c.column_name)
    LEFT JOIN (SELECT * FROM tag_references WHERE tag_name = 'CONTAINS_PII' AND object_deleted IS NULL) g
      ON (g.object_database, g.object_schema, g.object_name, g.column_name)
       = (c.table_catalog, c.table_schema, c.table_name, c.column_name)
    """


V8 = dict(_DETECTION, v8=_v8("SELECT * FROM prod_columns SEMI JOIN on_list USING (column_id)"))
V8_WIDE = dict(
    _DETECTION,
    v8=_v8(
        "SELECT * FROM prod_columns WHERE column_id IN (SELECT column_id FROM on_list UNION SELECT column_id FROM typed)"
    ),
)
V8_READS = ("columns", "policy_references", "tag_references")

V7 = dict(
    v7="""
    SELECT g.object_database AS database_name, g.object_schema AS schema_name, g.object_name AS table_name, g.column_name,
      g.tag_value AS contains_pii,
      (SELECT min(s.tag_value) FROM tag_references s WHERE s.tag_name = 'SENSITIVITY_LEVEL' AND s.object_deleted IS NULL
        AND s.object_database = g.object_database AND s.object_schema = g.object_schema
        AND s.object_name = g.object_name AND s.column_name = g.column_name) AS sensitivity_level,
      (SELECT min(s.tag_value) FROM tag_references s WHERE s.tag_name = 'COMPLIANCE_TYPE' AND s.object_deleted IS NULL
        AND s.object_database = g.object_database AND s.object_schema = g.object_schema
        AND s.object_name = g.object_name AND s.column_name = g.column_name) AS compliance_type
    FROM live_tags g WHERE g.tag_name = 'CONTAINS_PII' AND g.tag_value = 'TRUE' AND g.column_name IS NOT NULL
    """
)
V7_READS = ("live_tags",)

V11 = dict(
    v11="""
    SELECT schema_name, table_name, column_count,
      CASE WHEN tags > 0 THEN 'YES' ELSE 'NO' END AS has_tags,
      CASE WHEN masks > 0 THEN 'YES' ELSE 'NO' END AS has_masking,
      masked AS masked_column_count,
      CASE WHEN row_policies > 0 THEN 'YES' ELSE 'NO' END AS has_row_access,
      CASE WHEN tags = 0 THEN 'NEEDS_REVIEW' WHEN masks + row_policies > 0 THEN 'COMPLIANT' ELSE 'TAGGED_ONLY' END AS compliance_status
    FROM (
      SELECT t.*,
        (SELECT count(*) FROM live_tags g WHERE g.object_database = t.db AND g.object_schema = t.schema_name
           AND g.object_name = t.table_name) AS tags,
        (SELECT count(*) FROM governed p WHERE p.policy_kind = 'MASKING_POLICY' AND p.ref_database_name = t.db
           AND p.ref_schema_name = t.schema_name AND p.ref_entity_name = t.table_name) AS masks,
        (SELECT count(DISTINCT p.ref_column_name) FROM governed p WHERE p.policy_kind = 'MASKING_POLICY'
           AND p.ref_database_name = t.db AND p.ref_schema_name = t.schema_name AND p.ref_entity_name = t.table_name) AS masked,
        (SELECT count(*) FROM governed p WHERE p.policy_kind = 'ROW_ACCESS_POLICY' AND p.ref_database_name = t.db
           AND p.ref_schema_name = t.schema_name AND p.ref_entity_name = t.table_name) AS row_policies
      FROM (SELECT table_catalog AS db, table_schema AS schema_name, table_name, count(*) AS column_count FROM columns
            WHERE table_catalog = 'ORG_PROD' AND table_schema IN ('DETERGE', 'DISTRIBUTE') GROUP BY ALL) t)
    """
)
V11_READS = ("columns", "live_tags", "governed")

_MASK_ON = """
LEFT JOIN (SELECT * FROM policy_references WHERE policy_kind = 'MASKING_POLICY') m
  ON (m.ref_database_name, m.ref_schema_name, m.ref_entity_name, m.ref_column_name)
   = (c.table_catalog, c.table_schema, c.table_name, c.column_name)
"""
A9 = dict(
    found=f"""SELECT c.table_schema AS schema_name, c.table_name, c.column_name,
      CASE m.policy_name WHEN 'SSN_MASK' THEN '✓ MASKED' ELSE '🚨 UNMASKED' END AS masking_status,
      m.policy_name AS current_policy
    FROM columns c {_MASK_ON}
    WHERE c.table_catalog = 'ORG_PROD' AND c.table_schema <> 'SCRATCH'
      AND regexp_matches(lower(c.column_name), 'ssn|social.*security')"""
)
A10 = dict(
    found=f"""SELECT c.table_schema AS schema_name, c.table_name, c.column_name,
      CASE WHEN c.column_name ILIKE '%email%' THEN 'EMAIL' ELSE 'DOB' END AS pii_type,
      CASE WHEN m.policy_name IS NULL THEN '⚠️ UNMASKED' ELSE '✓ MASKED' END AS masking_status,
      m.policy_name AS current_policy
    FROM columns c {_MASK_ON}
    WHERE c.table_catalog = 'ORG_PROD' AND c.table_schema IN ('DETERGE', 'DISTRIBUTE')
      AND regexp_matches(lower(c.column_name), 'email|dob|birth.*date')"""
)
A11 = dict(
    state="""
    SELECT t.schema_name, t.table_name,
      CASE WHEN list_contains(tags, 'SENSITIVITY_LEVEL') THEN 'YES' ELSE 'NO' END AS has_sensitivity,
      CASE WHEN list_contains(tags, 'DATA_DOMAIN') THEN 'YES' ELSE 'NO' END AS has_domain,
      CASE WHEN list_contains(tags, 'DATA_OWNER') THEN 'YES' ELSE 'NO' END AS has_owner
    FROM (SELECT DISTINCT table_schema AS schema_name, table_name FROM tables
          WHERE table_catalog = 'ORG_PROD' AND table_type = 'BASE TABLE' AND table_schema IN ('DETERGE', 'DISTRIBUTE')) t
    LEFT JOIN (SELECT object_schema AS schema_name, object_name AS table_name, list(DISTINCT tag_name) AS tags
               FROM live_tags GROUP BY ALL) g USING (schema_name, table_name)
    """,
    incomplete="""
    SELECT *, '⚠️ INCOMPLETE' AS tag_status FROM state
    WHERE 'NO' IN (has_sensitivity, has_domain, has_owner)
    """,
)
A12 = dict(
    V7,
    found="""
    SELECT p.schema_name, p.table_name, p.column_name, p.sensitivity_level, p.compliance_type,
      CASE WHEN m.policy_name IS NULL THEN '⚠️ TAGGED BUT NOT MASKED' ELSE '✓ MASKED' END AS protection_status,
      m.policy_name AS applied_policy
    FROM v7 p LEFT JOIN (SELECT * FROM policy_references WHERE policy_kind = 'MASKING_POLICY') m
      ON (m.ref_database_name, m.ref_schema_name, m.ref_entity_name, m.ref_column_name)
       = (p.database_name, p.schema_name, p.table_name, p.column_name)
    """,
)
FERPA = dict(
    V11,
    found="""
    SELECT v.*, 'YES' IN (has_masking, has_row_access) AS protected FROM v11 v
    WHERE (schema_name, table_name) IN (SELECT (object_schema, object_name) FROM live_tags
      WHERE tag_name = 'COMPLIANCE_TYPE' AND tag_value = 'FERPA')
    """,
)

PER_TABLE_ATTACHMENT = """
policy_db AS policy_database, policy_schema, policy_name, policy_kind, ref_database_name AS table_database,
ref_schema_name AS table_schema, ref_entity_name AS table_name, ref_entity_domain AS entity_type
"""

CLOSURE = dict(
    held="""
    SELECT role_name, role_name AS inherited_role FROM
      (SELECT child AS role_name FROM role_grants UNION SELECT parent FROM role_grants UNION SELECT role_name FROM grants)
    UNION SELECT h.role_name, g.child FROM held h JOIN role_grants g ON g.parent = h.inherited_role
    """,
    effective="""
    SELECT h.role_name, g.privilege, g.database_name, g.schema_name, g.object_type, g.scope,
      bool_or(h.role_name = h.inherited_role) AS is_direct
    FROM held h JOIN grants g ON g.role_name = h.inherited_role GROUP BY ALL
    """,
    layer_rank="""
    SELECT role_name, database_name, schema_name,
      max(CASE WHEN privilege = 'SELECT' THEN 1 WHEN privilege IN ('INSERT', 'UPDATE', 'DELETE', 'ALL') THEN 2 END) AS access
    FROM effective WHERE object_type IN ('TABLE', 'VIEW') AND scope = 'ALL'
      AND schema_name IN ('DEPOSIT', 'DETERGE', 'DISTRIBUTE')
      AND database_name IN ('ORG_DEV', 'ORG_TEST', 'ORG_PROD') GROUP BY ALL HAVING access IS NOT NULL
    """,
    usage="""
    SELECT role_name, count(DISTINCT user_name) AS users, count(*) AS queries FROM query_history GROUP BY ALL
    """,
)
CLOSURE_READS = ("role_grants", "grants", "query_history")

TAG_DRIVEN = dict(
    direct="""
    SELECT DISTINCT ref_database_name, ref_schema_name, ref_entity_name, ref_column_name, policy_name
    FROM governed WHERE policy_kind = 'MASKING_POLICY'
    """,
    tagged="""
    SELECT DISTINCT object_database AS ref_database_name, object_schema AS ref_schema_name, object_name AS ref_entity_name,
      column_name AS ref_column_name
    FROM live_tags WHERE tag_name = 'CONTAINS_PII' AND tag_value = 'TRUE' AND column_name IS NOT NULL
    """,
    policy_rules=POLICY_RULES,
    by_tag="""
    SELECT t.*, arg_min(r.label, r.precedence) AS policy_name
    FROM tagged t JOIN policy_rules r ON lower(t.ref_column_name) LIKE r.pattern
    WHERE NOT EXISTS (SELECT 1 FROM direct d
      WHERE (d.ref_database_name, d.ref_schema_name, d.ref_entity_name, d.ref_column_name)
          = (t.ref_database_name, t.ref_schema_name, t.ref_entity_name, t.ref_column_name))
    GROUP BY ALL
    """,
)

ATTACHED = """
SELECT 'GOV_DB' AS policy_database, 'GOVERNANCE' AS policy_schema, a.policy AS policy_name,
  'ROW_ACCESS_POLICY' AS policy_kind, 'ORG_' || e.env AS table_database, a.layer AS table_schema, a.tbl AS table_name,
  'TABLE' AS entity_type, '[ "' || a.col || '" ]' AS filter_columns, 'ACTIVE' AS policy_status
FROM (VALUES ('DEV'), ('TEST'), ('PROD')) e(env)
CROSS JOIN (VALUES
  ('DISTRIBUTE', 'DIM_STUDENT', 'ENROLLMENT_ROW_ACCESS', 'ENROLLMENT_STATUS'),
  ('DISTRIBUTE', 'DIM_STUDENT', 'ACTIVE_RECORDS_ONLY', 'IS_ACTIVE'),
  ('DISTRIBUTE', 'DIM_STUDENT', 'CURRENT_AY_ACCESS', 'CURRENT_ACADEMIC_YEAR'),
  ('DISTRIBUTE', 'FACT_ENROLLMENT', 'CURRENT_AY_ACCESS', 'ACADEMIC_YEAR'),
  ('DISTRIBUTE', 'FACT_ENROLLMENT', 'CURRENT_TERM_ACCESS', 'TERM_CODE'),
  ('DETERGE', 'INT_COURSE_REGISTRATIONS', 'CURRENT_TERM_ACCESS', 'TERM_CODE')) a(layer, tbl, policy, col)
"""

ATTACHED_MASKS = """
SELECT 'GOV_DB' AS policy_database, 'GOVERNANCE' AS policy_schema, a.policy AS policy_name, 'MASKING_POLICY' AS policy_kind,
  'ORG_' || e.env AS table_database, 'DISTRIBUTE' AS table_schema, a.tbl AS table_name, 'TABLE' AS entity_type,
  a.col AS column_name, 'ACTIVE' AS policy_status
FROM (VALUES ('DEV'), ('TEST'), ('PROD')) e(env)
CROSS JOIN (VALUES
  ('DIM_STUDENT', 'SSN', 'SSN_MASK'), ('DIM_STUDENT', 'EMAIL', 'EMAIL_MASK'), ('DIM_STUDENT', 'BIRTH_DATE', 'DOB_MASK'),
  ('DIM_STUDENT', 'PHONE_NUMBER', 'PHONE_MASK'), ('DIM_STUDENT', 'HOME_ADDRESS', 'ADDRESS_MASK'),
  ('FACT_FINANCIAL_AID', 'AID_AMOUNT', 'FINANCIAL_AMOUNT_MASK'), ('FACT_FINANCIAL_AID', 'EFC_AMOUNT', 'FINANCIAL_AMOUNT_MASK')) a(tbl, col, policy)
"""

_MASK_REFS = f"""SELECT {PER_TABLE_ATTACHMENT}, ref_column_name AS column_name, policy_status, tag_database, tag_schema, tag_name
FROM governed WHERE policy_kind = 'MASKING_POLICY'"""
_ROW_REFS = f"""SELECT {PER_TABLE_ATTACHMENT}, ref_arg_column_names AS filter_columns, policy_status
FROM governed WHERE policy_kind = 'ROW_ACCESS_POLICY'"""
_MASK_SUMMARY = """SELECT ref_schema_name AS schema_name, policy_name, count(DISTINCT ref_entity_name) AS tables_count,
  count(DISTINCT ref_column_name) AS columns_count,
  string_agg(DISTINCT ref_entity_name, ', ' ORDER BY ref_entity_name) AS affected_tables
FROM governed WHERE policy_kind = 'MASKING_POLICY' GROUP BY ALL"""
_ROW_SUMMARY = """SELECT ref_schema_name AS schema_name, policy_name, count(DISTINCT ref_entity_name) AS tables_count,
  string_agg(DISTINCT ref_entity_name, ', ' ORDER BY ref_entity_name) AS affected_tables
FROM governed WHERE policy_kind = 'ROW_ACCESS_POLICY' GROUP BY ALL"""
_POLICY_TABLES = (
    "SELECT DISTINCT ref_schema_name AS schema_name, policy_name, ref_entity_name AS table_name FROM governed WHERE policy_kind = "
)
_TAG_COVERAGE = """SELECT object_schema AS schema_name, tag_name, count(DISTINCT object_name) AS tables_count,
  count(DISTINCT column_name) AS columns_count,
  count(DISTINCT object_name) FILTER (WHERE column_name IS NULL) AS table_level_tags,
  count(DISTINCT object_name) FILTER (WHERE column_name IS NOT NULL) AS column_level_tags
FROM live_tags GROUP BY ALL"""


def _v8_report(where: str, columns: str = "*", **ctes: str) -> str:
    return sql(f"SELECT {columns} FROM v8 WHERE {where}", *V8_READS, **(ctes or V8))


def _count(title: str, name: str, priority: str, source: str) -> str:
    return f"SELECT '{title}' AS audit_name, count(*) AS {name}, '{priority}' AS priority, {AT} FROM {source}"


def _drift(table: str, database: str, key: str) -> str:
    return sql(
        f"""SELECT * EXCLUDE (missing), (3 - len(missing))::BIGINT AS environments, array_to_string(missing, ', ') AS missing_in
        FROM (SELECT {key}, list_filter(['ORG_DEV', 'ORG_PROD', 'ORG_TEST'], lambda db : NOT list_contains(list({database}), db)) AS missing
              FROM {table} GROUP BY ALL)
        WHERE len(missing) > 0""",
        table,
    )


_UNMASKED = "has_masking_policy = 'NO - NEEDS REVIEW'"
_UNTAGGED = "tagged_as_pii = 'NO - NEEDS TAGGING'"

SQL: dict[str, str] = {
    # tags
    "tag_taxonomy": sql(
        """SELECT tag_name, tag_value AS allowed_value, count(column1) AS assignments
        FROM allowed LEFT JOIN (SELECT tag_name, tag_value, 1 AS column1 FROM live_tags) USING (tag_name, tag_value)
        GROUP BY ALL""",
        "allowed",
        "live_tags",
    ),
    "tag_invalid_values": sql(
        f"""SELECT tag_name, tag_value, {COLUMN}, domain FROM live_tags
        WHERE (tag_name, tag_value) NOT IN (SELECT (tag_name, tag_value) FROM allowed)""",
        "allowed",
        "live_tags",
    ),
    "effective_tags": sql(
        """SELECT c.table_catalog AS object_database, c.table_schema AS object_schema, c.table_name AS object_name,
          c.column_name, n.tag_name, coalesce(own.tag_value, up.tag_value) AS tag_value,
          CASE WHEN own.tag_value IS NULL THEN 'TABLE' ELSE 'COLUMN' END AS tag_level
        FROM columns c CROSS JOIN (SELECT DISTINCT tag_name FROM live_tags) n
        LEFT JOIN (SELECT object_database d, object_schema s, object_name t, column_name c, tag_name n, min(tag_value) AS tag_value
                   FROM live_tags WHERE column_name IS NOT NULL GROUP BY ALL) own
          ON own.d = c.table_catalog AND own.s = c.table_schema AND own.t = c.table_name AND own.c = c.column_name AND own.n = n.tag_name
        LEFT JOIN (SELECT object_database d, object_schema s, object_name t, tag_name n, min(tag_value) AS tag_value
                   FROM live_tags WHERE column_name IS NULL GROUP BY ALL) up
          ON up.d = c.table_catalog AND up.s = c.table_schema AND up.t = c.table_name AND up.n = n.tag_name
        WHERE coalesce(own.tag_value, up.tag_value) IS NOT NULL""",
        "columns",
        "allowed",
        "live_tags",
    ),
    "pii_column_tag_rules": sql(
        f"""SELECT *, coalesce(sensitivity_level IN ('RESTRICTED', 'CONFIDENTIAL'), FALSE) AS sensitivity_ok,
          coalesce(compliance_type IN ('FERPA', 'PII'), FALSE) AS compliance_ok
        FROM (SELECT {COLUMN},
            min(tag_value) FILTER (WHERE tag_name = 'SENSITIVITY_LEVEL') AS sensitivity_level,
            min(tag_value) FILTER (WHERE tag_name = 'COMPLIANCE_TYPE') AS compliance_type
          FROM live_tags WHERE column_name IS NOT NULL GROUP BY ALL
          HAVING min(tag_value) FILTER (WHERE tag_name = 'CONTAINS_PII') = 'TRUE')
        WHERE NOT (sensitivity_ok AND compliance_ok)""",
        "live_tags",
    ),
    "tag_consistency": sql(
        """SELECT kind AS column_kind, tag_name, count(DISTINCT tag_value) AS distinct_values, min(tag_value) AS first_value,
          max(tag_value) AS last_value, count(*) AS assignments
        FROM (SELECT g.*, coalesce((SELECT arg_min(r.label, r.precedence) FROM type_rules r WHERE lower(g.column_name) LIKE r.pattern),
                lower(g.column_name)) AS kind FROM live_tags g WHERE column_name IS NOT NULL)
        GROUP BY ALL HAVING count(DISTINCT tag_value) > 1""",
        "live_tags",
        type_rules=TYPE_RULES,
    ),
    "environment_drift": _drift("env_policy_references", "ref_database_name", "policy_kind, policy_name, ref_schema_name, ref_entity_name, ref_column_name, ref_arg_column_names"),
    "environment_tag_drift": _drift("env_tag_references", "object_database", "tag_name, tag_value, object_schema, object_name, column_name"),
    "tag_driven_masking": sql(
        "SELECT *, 'ATTACHMENT' AS chosen_by FROM direct UNION ALL BY NAME SELECT *, 'TAG' AS chosen_by FROM by_tag",
        "governed",
        "live_tags",
        **TAG_DRIVEN,
    ),
    "tag_policy_references": sql(
        """SELECT 'GOV_DB' AS policy_db, 'GOVERNANCE' AS policy_schema, policy_name, 'MASKING_POLICY' AS policy_kind,
          ref_database_name, ref_schema_name, ref_entity_name, 'TABLE' AS ref_entity_domain, ref_column_name,
          CAST(NULL AS VARCHAR) AS ref_arg_column_names, 'ACTIVE' AS policy_status, 'GOV_DB' AS tag_database,
          'GOVERNANCE' AS tag_schema, 'CONTAINS_PII' AS tag_name FROM by_tag""",
        "governed",
        "live_tags",
        **TAG_DRIVEN,
    ),
    "retention_due": sql(
        """SELECT *, CAST(last_accessed + INTERVAL 1 YEAR AS DATE) AS due_date,
          CASE WHEN last_accessed IS NULL THEN 'NO_RECORDED_USE'
               WHEN CAST(last_accessed + INTERVAL 1 YEAR AS DATE) <= DATE '2025-01-20' THEN 'DUE' ELSE 'RETAIN' END AS retention_status
        FROM (SELECT g.object_database, g.object_schema, g.object_name, g.retention_period,
            (SELECT max(h.start_time) FROM query_history h
             WHERE h.database_name = g.object_database AND h.schema_name = g.object_schema
               AND contains(h.objects_accessed, '"objectName":"' || g.object_name || '"')) AS last_accessed
          FROM (SELECT object_database, object_schema, object_name, min(tag_value) AS retention_period FROM live_tags
                WHERE tag_name = 'RETENTION_PERIOD' AND column_name IS NULL GROUP BY ALL) g)""",
        "live_tags",
        "query_history",
    ),
    # privileges
    "role_closure": sql(
        """SELECT role_name, inherited_role, coalesce(users, 0) AS users, coalesce(queries, 0) AS queries
        FROM held LEFT JOIN usage USING (role_name)""",
        *CLOSURE_READS,
        **CLOSURE,
    ),
    "effective_privileges": sql(
        """SELECT e.*, coalesce(o.n, 0) AS object_count FROM effective e
        LEFT JOIN (SELECT table_catalog AS d, table_schema AS s,
            CASE table_type WHEN 'VIEW' THEN 'VIEW' ELSE 'TABLE' END AS k, count(*) AS n FROM tables GROUP BY ALL) o
          ON o.d = e.database_name AND o.s = e.schema_name AND o.k = e.object_type""",
        *CLOSURE_READS,
        "tables",
        **CLOSURE,
    ),
    "role_access_matrix": sql(
        "SELECT r.role_name, "
        + ", ".join(
            f"coalesce((SELECT CASE access WHEN 2 THEN 'WRITE' ELSE 'READ' END FROM layer_rank l WHERE l.role_name = r.role_name "
            f"AND database_name = 'ORG_{env}' AND schema_name = '{layer}'), 'NONE') AS {env.lower()}_{layer.lower()}"
            for env in ("DEV", "TEST", "PROD")
            for layer in ("DEPOSIT", "DETERGE", "DISTRIBUTE")
        )
        + ", coalesce(users, 0) AS users, coalesce(queries, 0) AS queries "
        "FROM (SELECT DISTINCT role_name FROM held) r LEFT JOIN usage USING (role_name)",
        *CLOSURE_READS,
        **CLOSURE,
    ),
    "unexpected_access": sql(
        """SELECT h.role_name, h.database_name, h.schema_name, h.needed_access, count(*) AS query_count,
          count(DISTINCT h.user_name) AS user_count, max(h.start_time) AS last_access
        FROM (SELECT *, CASE WHEN query_type IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE', 'COPY', 'CREATE', 'ALTER', 'DROP')
                THEN 'WRITE' ELSE 'READ' END AS needed_access FROM recent
              WHERE schema_name IN ('DEPOSIT', 'DETERGE', 'DISTRIBUTE') AND query_type NOT IN ('SHOW', 'DESCRIBE', 'USE')) h
        WHERE NOT EXISTS (SELECT 1 FROM layer_rank l WHERE l.role_name = h.role_name AND l.database_name = h.database_name
          AND l.schema_name = h.schema_name AND (l.access = 2 OR h.needed_access = 'READ'))
        GROUP BY ALL""",
        *CLOSURE_READS,
        "recent",
        **CLOSURE,
    ),
    "future_grant_gaps": sql(
        """SELECT g.role_name, g.privilege, g.database_name, g.schema_name, g.object_type,
          (SELECT count(DISTINCT table_name) FROM columns c WHERE c.table_catalog = g.database_name AND c.table_schema = g.schema_name) AS tables,
          (SELECT count(*) FROM columns c WHERE c.table_catalog = g.database_name AND c.table_schema = g.schema_name) AS columns
        FROM (SELECT role_name, privilege, database_name, schema_name, object_type FROM grants
                WHERE scope = 'ALL' AND object_type IN ('TABLE', 'VIEW')
              EXCEPT
              SELECT role_name, privilege, database_name, schema_name, object_type FROM grants WHERE scope = 'FUTURE') g""",
        "grants",
        "columns",
    ),
    "user_roles": sql(
        "SELECT role_name, user_name, count(*) AS queries, max(start_time) AS last_used FROM query_history GROUP BY ALL",
        "query_history",
    ),
    "users_per_role": sql(
        """SELECT role_name, count(DISTINCT user_name) AS user_count, min(user_name) AS first_user, max(user_name) AS last_user,
          (SELECT count(*) FROM query_history h WHERE h.role_name = g.role_name) AS queries,
          (SELECT max(start_time) FROM query_history h WHERE h.role_name = g.role_name) AS last_used
        FROM user_grants g GROUP BY role_name""",
        "user_grants",
        "query_history",
    ),
    "granted_unused": sql(
        """SELECT DISTINCT user_name, role_name FROM user_grants
        WHERE (user_name, role_name) NOT IN (SELECT (user_name, role_name) FROM query_history)""",
        "user_grants",
        "query_history",
    ),
    "used_not_granted": sql(
        """SELECT role_name, user_name, count(*) AS queries, max(start_time) AS last_used FROM query_history h
        WHERE NOT EXISTS (SELECT 1 FROM user_grants g WHERE g.user_name = h.user_name AND g.role_name = h.role_name)
        GROUP BY ALL""",
        "user_grants",
        "query_history",
    ),
    "inherited_roles": sql(
        """SELECT h.role_name, (SELECT count(*) FROM role_tree t WHERE t.parent = h.role_name AND t.child <> t.parent) AS direct_roles,
          count(*) - 1 AS inherited_roles FROM held h GROUP BY h.role_name""",
        "role_tree",
        held="""
        SELECT role_name, role_name AS inherited_role FROM (SELECT child AS role_name FROM role_tree UNION SELECT parent FROM role_tree)
        UNION SELECT h.role_name, t.child FROM held h JOIN role_tree t ON t.parent = h.inherited_role
        """,
    ),
    # attachments
    "row_policy_attach": sql(f"{_ROW_REFS} UNION ALL BY NAME {ATTACHED}", "governed"),
    "row_detach": sql(
        f"{_ROW_REFS} AND ref_entity_name <> 'T1' AND NOT (ref_entity_name = 'T6' AND policy_name = 'CURRENT_TERM_ACCESS')",
        "governed",
    ),
    "mask_policy_attach": sql(f"{_MASK_REFS} UNION ALL BY NAME {ATTACHED_MASKS}", "governed"),
    "mask_detach": sql(
        f"{_MASK_REFS} AND NOT (ref_database_name = 'ORG_PROD' AND ref_schema_name = 'DISTRIBUTE' AND ref_entity_name = 'T2')",
        "governed",
    ),
    "mask_replace": sql(
        f"SELECT * REPLACE (CASE policy_name WHEN 'ADDRESS_MASK' THEN 'ADDRESS_MASK_STRICT' ELSE policy_name END AS policy_name) FROM ({_MASK_REFS})",
        "governed",
    ),
    "row_droppable_policies": sql(
        """SELECT policy_name FROM (SELECT unnest(['ENROLLMENT_ROW_ACCESS', 'ACTIVE_RECORDS_ONLY', 'CURRENT_AY_ACCESS',
          'CURRENT_TERM_ACCESS', 'DEPARTMENT_ACCESS', 'FERPA_CONSENT_ACCESS', 'PROGRAM_TYPE_ACCESS']) AS policy_name)
        WHERE policy_name NOT IN (SELECT policy_name FROM policy_references)""",
        "policy_references",
    ),
    # views
    "v_masking_policy_references": sql(_MASK_REFS, "governed"),
    "v_masking_policy_summary": sql(_MASK_SUMMARY, "governed"),
    "masking_policy_tables": sql(_POLICY_TABLES + "'MASKING_POLICY'", "governed"),
    "row_policy_tables": sql(_POLICY_TABLES + "'ROW_ACCESS_POLICY'", "governed"),
    "v_row_access_policy_references": sql(_ROW_REFS, "governed"),
    "v_row_access_policy_summary": sql(_ROW_SUMMARY, "governed"),
    "v_tagged_objects": sql(
        f"SELECT tag_database, tag_schema, tag_name, tag_value, {COLUMN}, domain AS object_type, object_deleted AS is_deleted FROM live_tags",
        "live_tags",
    ),
    "v_tag_coverage_summary": sql(_TAG_COVERAGE, "live_tags"),
    "v_pii_columns": sql("SELECT * FROM v7", *V7_READS, **V7),
    "v_potential_sensitive_columns": _v8_report("TRUE"),
    "v_potential_sensitive_columns_wide": _v8_report("TRUE", **V8_WIDE),
    "v_governance_coverage_report": sql("SELECT * FROM v11", *V11_READS, **V11),
    "coverage_rollup": sql(
        "SELECT schema_name, compliance_status, count(*) AS table_count FROM v11 GROUP BY ALL", *V11_READS, **V11
    ),
    "quick_check_unmasked": _v8_report("has_masking_policy LIKE 'NO%'"),
    "quick_check_needs_review": sql(
        "SELECT * FROM v11 WHERE compliance_status = 'NEEDS_REVIEW'", *V11_READS, **V11
    ),
    "masks_in_layer": sql(
        "SELECT policy_name, ref_schema_name AS table_schema, ref_entity_name AS table_name, ref_column_name AS column_name, policy_status "
        "FROM governed WHERE policy_kind = 'MASKING_POLICY' AND ref_schema_name = 'DISTRIBUTE'",
        "governed",
    ),
    "row_policy_filters": sql(
        "SELECT ref_schema_name AS table_schema, ref_entity_name AS table_name, policy_name, ref_arg_column_names AS filter_columns "
        "FROM governed WHERE policy_kind = 'ROW_ACCESS_POLICY'",
        "governed",
    ),
    # audits
    "audit_01": _v8_report(
        _UNMASKED, "schema_name, table_name, column_name, suggested_pii_type, suggested_masking_policy, data_type"
    ),
    "audit_01_summary": sql(
        _count("🚨 UNMASKED PII COLUMNS", "issue_count", "HIGH", f"v8 WHERE {_UNMASKED}"), *V8_READS, **V8
    ),
    "audit_02": _v8_report(
        _UNTAGGED, "schema_name, table_name, column_name, suggested_pii_type, has_masking_policy, tagged_as_pii"
    ),
    "audit_02_summary": sql(
        _count("⚠️ UNTAGGED PII COLUMNS", "issue_count", "MEDIUM", f"v8 WHERE {_UNTAGGED}"), *V8_READS, **V8
    ),
    "audit_03": sql("SELECT * FROM v11 WHERE compliance_status = 'NEEDS_REVIEW'", *V11_READS, **V11),
    "audit_03_summary": sql(
        _count("📋 UNGOVERNED TABLES", "issue_count", "MEDIUM", "v11 WHERE compliance_status = 'NEEDS_REVIEW'"),
        *V11_READS,
        **V11,
    ),
    "audit_04": sql(
        "SELECT * EXCLUDE (compliance_status) FROM v11 WHERE compliance_status = 'TAGGED_ONLY'", *V11_READS, **V11
    ),
    "audit_04_summary": sql(
        _count("🏷️ TAGGED BUT UNPROTECTED", "issue_count", "MEDIUM", "v11 WHERE compliance_status = 'TAGGED_ONLY'"),
        *V11_READS,
        **V11,
    ),
    "audit_08": sql(
        """SELECT schema_name, table_name, has_masking, masked_column_count, has_row_access, compliance_status,
          CASE WHEN protected THEN '✓ PROTECTED' ELSE '⚠️ NEEDS PROTECTION' END AS ferpa_status FROM found""",
        *V11_READS,
        **FERPA,
    ),
    "audit_08_summary": sql(
        f"SELECT '🎓 FERPA COMPLIANCE STATUS' AS audit_name, count(*) AS total_tables, count(*) FILTER (WHERE protected) AS protected_tables, {AT} FROM found",
        *V11_READS,
        **FERPA,
    ),
    "audit_09": sql("SELECT * FROM found", "columns", "policy_references", **A9),
    "audit_09_summary": sql(
        f"SELECT '🔒 SSN MASKING STATUS' AS audit_name, count(*) AS ssn_columns_found, "
        f"count(*) FILTER (WHERE current_policy = 'SSN_MASK') AS ssn_columns_masked, {AT} FROM found",
        "columns",
        "policy_references",
        **A9,
    ),
    "audit_10": sql("SELECT * FROM found", "columns", "policy_references", **A10),
    "audit_10_summary": sql(
        f"SELECT '📧 EMAIL & DOB MASKING STATUS' AS audit_name, count(*) AS total_columns, count(current_policy) AS masked_columns, {AT} FROM found",
        "columns",
        "policy_references",
        **A10,
    ),
    "audit_11": sql("SELECT * FROM incomplete", "tables", "live_tags", **A11),
    "required_table_tags": sql(
        """SELECT *, CASE WHEN 'NO' IN (has_sensitivity, has_domain, has_owner) THEN '⚠️ INCOMPLETE' ELSE '✓ COMPLETE' END AS tag_status
        FROM state""",
        "tables",
        "live_tags",
        **A11,
    ),
    "audit_11_summary": sql(
        f"SELECT '🏷️ REQUIRED TAG COVERAGE' AS audit_name, count(DISTINCT table_name) AS total_tables, 'INFO' AS priority, {AT} FROM state",
        "tables",
        "live_tags",
        **A11,
    ),
    "audit_12": sql("SELECT * FROM found", *V7_READS, "policy_references", **A12),
    "audit_12_summary": sql(
        f"SELECT '🎯 PII TAG ACCURACY' AS audit_name, count(*) AS pii_tagged_columns, count(applied_policy) AS masked_columns, {AT} FROM found",
        *V7_READS,
        "policy_references",
        **A12,
    ),
    # report
    "report_policy_coverage": sql(
        """SELECT n AS total_tables, ok AS compliant_tables, printf('%.1f%%', ((2000 * ok + n) // (2 * n)) / 10.0) AS compliance_rate,
          masked AS tables_with_masking, cols AS total_masked_columns, filtered AS tables_with_row_access, tagged AS tables_with_tags
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS ok,
            count(*) FILTER (WHERE has_masking = 'YES') AS masked, CAST(sum(masked_column_count) AS BIGINT) AS cols,
            count(*) FILTER (WHERE has_row_access = 'YES') AS filtered, count(*) FILTER (WHERE has_tags = 'YES') AS tagged
          FROM v11)""",
        *V11_READS,
        **V11,
    ),
    "report_issues": sql(
        f"""SELECT 'Unmasked PII Columns' AS issue_type, (SELECT count(*) FROM v8 WHERE {_UNMASKED}) AS count, '🚨 HIGH' AS priority
        UNION ALL SELECT 'Ungoverned Tables', (SELECT count(*) FROM v11 WHERE compliance_status = 'NEEDS_REVIEW'), '⚠️ MEDIUM'
        UNION ALL SELECT 'Untagged PII Columns', (SELECT count(*) FROM v8 WHERE {_UNTAGGED}), '⚠️ MEDIUM'""",
        *V8_READS,
        *V11_READS,
        **V8,
        **V11,
    ),
    "daily_pii_check": sql(
        f"SELECT 'daily_pii_check' AS audit_name, count(*) AS issue_count, DATE '2024-02-10' AS audit_date FROM v8 WHERE {_UNMASKED}",
        *V8_READS,
        **V8,
    ),
    "column_changes": sql(
        """SELECT b.cat AS table_catalog, b.sch AS table_schema, b.tab AS table_name, coalesce(b.now, b.was) AS column_name,
             CASE WHEN p.new_name IS NOT NULL THEN 'RENAMED' ELSE b.change END AS change,
             coalesce(p.old_name, b.was) AS earlier_name,
             CASE WHEN p.new_name IS NOT NULL THEN b.new_type ELSE b.old_type END AS earlier_type, b.new_type AS data_type
           FROM changed b LEFT JOIN pairs p ON p.cat = b.cat AND p.sch = b.sch AND p.tab = b.tab AND b.change = 'ADDED' AND p.new_name = b.now
           WHERE NOT (b.change = 'REMOVED' AND EXISTS (SELECT 1 FROM pairs q
             WHERE q.cat = b.cat AND q.sch = b.sch AND q.tab = b.tab AND q.old_name = b.was))""",
        "columns",
        "former_columns",
        changed="""SELECT *, CASE WHEN was IS NULL THEN 'ADDED' WHEN now IS NULL THEN 'REMOVED' ELSE 'RETYPED' END AS change FROM (
             SELECT coalesce(c.table_catalog, f.table_catalog) AS cat, coalesce(c.table_schema, f.table_schema) AS sch,
               coalesce(c.table_name, f.table_name) AS tab, f.column_name AS was, c.column_name AS now,
               f.data_type AS old_type, c.data_type AS new_type
             FROM columns c FULL JOIN former_columns f ON c.table_catalog = f.table_catalog AND c.table_schema = f.table_schema
               AND c.table_name = f.table_name AND c.column_name = f.column_name)
           WHERE was IS NULL OR now IS NULL OR old_type <> new_type""",
        pairs="""SELECT cat, sch, tab, coalesce(new_type, old_type) AS kind, max(was) AS old_name, max(now) AS new_name
           FROM changed WHERE change <> 'RETYPED' GROUP BY ALL
           HAVING count(was) = 1 AND count(now) = 1""",
    ),
    "new_ungoverned_columns": sql(
        f"SELECT v8.* FROM v8 JOIN columns c ON c.table_catalog = v8.database_name AND c.table_schema = v8.schema_name "
        f"AND c.table_name = v8.table_name AND c.column_name = v8.column_name "
        f"WHERE c.column_id % 10 = 0 AND ({_UNMASKED} OR {_UNTAGGED})",
        *V8_READS,
        **V8,
    ),
}
