"""Input tables as common table expressions."""

from __future__ import annotations

from wardline.sources import demo, registry


def _columns_of(named: dict[str, str]) -> str:
    return ", ".join(demo.projection(named))


def _values(rows, names: str) -> str:
    def literal(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


_TAG_REFERENCES = f"""
SELECT 'GOV_DB' AS tag_database, 'GOVERNANCE' AS tag_schema, t.tag_name AS tag_name,
  CASE t.tag_name WHEN 'CONTAINS_PII' THEN CASE WHEN column_id % 11 = 0 THEN 'FALSE' ELSE 'TRUE' END
       WHEN 'SENSITIVITY_LEVEL' THEN CASE WHEN column_id % 5 = 0 THEN 'SECRET' WHEN column_id % 5 < 3 THEN 'RESTRICTED' ELSE 'INTERNAL' END
       ELSE CASE WHEN column_id % 3 = 0 THEN 'FERPA' ELSE 'PII' END END AS tag_value,
  table_catalog AS object_database, table_schema AS object_schema, table_name AS object_name, column_name AS column_name,
  'COLUMN' AS domain, CASE WHEN column_id % 37 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE NULL END AS object_deleted
FROM columns CROSS JOIN (SELECT 'CONTAINS_PII' AS tag_name, 2 AS m UNION ALL SELECT 'SENSITIVITY_LEVEL', 4 UNION ALL SELECT 'COMPLIANCE_TYPE', 6) t
WHERE column_id % t.m = 0 AND column_id % 23 <= 19 AND column_id % 100 < 80
UNION ALL
SELECT 'GOV_DB', 'GOVERNANCE', t.tag_name, t.tag_value, table_catalog, table_schema, table_name, NULL, 'TABLE', NULL
FROM columns CROSS JOIN (SELECT 'SENSITIVITY_LEVEL' AS tag_name, 'CONFIDENTIAL' AS tag_value, 2 AS m UNION ALL SELECT 'DATA_DOMAIN', 'ACADEMIC', 3
  UNION ALL SELECT 'DATA_OWNER', 'REGISTRAR', 1 UNION ALL SELECT 'RETENTION_PERIOD', '1_YEAR', 5) t
WHERE {demo.FIRST_OF_TABLE} AND {demo.TABLE_OF_COLUMN} % 10 < 7 AND {demo.TABLE_OF_COLUMN} % t.m = 0
"""

_EACH_ENVIRONMENT = f"""
FROM columns CROSS JOIN (SELECT 'DEV' AS env, 7 AS m UNION ALL SELECT 'TEST', 11 UNION ALL SELECT 'PROD', 13) e
WHERE {demo.ENVIRONMENTS_WHERE}
"""

_ROLES = [
    ("GOVERNANCE_ADMIN_ROLE", "ADMIN"),
    ("DATA_ADMIN", "ADMIN"),
    ("DATA_ENGINEER_ROLE", "ENGINEER"),
    ("DBT_CLOUD_PROD_ROLE", "ENGINEER"),
    ("DBT_CLOUD_DEV_ROLE", "ENGINEER"),
    ("DATA_ANALYST_ROLE", "DA"),
    ("IR_ANALYST_ROLE", "IR"),
    ("REGISTRAR_ANALYST_ROLE", "REG"),
    ("ENROLLMENT_ANALYST_ROLE", "ENR"),
    ("FINANCIAL_AID_ANALYST_ROLE", "FA"),
    ("PUBLIC", "OTHER"),
]
ROLE_GROUP = dict(_ROLES)

# name -> (tables it reads, definition)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "person": ((), f"SELECT {_columns_of(demo.PERSON)} FROM orders"),
    "columns": ((), f"SELECT {_columns_of(demo.COLUMNS)} FROM part"),
    "policy_references": (
        ("columns",),
        f"SELECT {_columns_of(demo.MASKING_ATTACHMENTS)} FROM columns WHERE {demo.MASKING_ATTACHMENTS_WHERE} "
        f"UNION ALL SELECT {_columns_of(demo.ROW_ATTACHMENTS)} FROM columns WHERE {demo.ROW_ATTACHMENTS_WHERE}",
    ),
    "tag_references": (("columns",), _TAG_REFERENCES),
    "query_history": ((), f"SELECT {_columns_of(demo.QUERY_HISTORY)} FROM events"),
    "tables": (
        ("columns",),
        "SELECT DISTINCT table_catalog, table_schema, table_name, "
        "CASE WHEN CAST(substr(table_name, 2) AS INT) % 10 = 3 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type "
        "FROM columns",
    ),
    "former_columns": (
        ("columns",),
        f"SELECT {_columns_of(demo.FORMER_COLUMNS)} FROM columns, (VALUES ('', 0), ('_GONE', 1)) AS g(gone, n) "
        f"WHERE {demo.FORMER_COLUMNS_WHERE}",
    ),
    "user_grants": ((), f"SELECT {_columns_of(demo.USER_GRANTS)} FROM customer WHERE {demo.USER_GRANTS_WHERE}"),
    "role_tree": ((), f"SELECT {_columns_of(demo.ROLE_TREE)} FROM part"),
    "env_policy_references": (
        ("columns", "policy_references"),
        f"SELECT * FROM policy_references UNION ALL BY NAME SELECT {_columns_of(demo.ENVIRONMENT_ATTACHMENTS)} {_EACH_ENVIRONMENT}",
    ),
    "env_tag_references": (
        ("columns", "live_tags"),
        f"SELECT * FROM live_tags UNION ALL BY NAME SELECT * FROM (SELECT {_columns_of(demo.ENVIRONMENT_TAGS).replace('TIMESTAMP_NTZ', 'TIMESTAMP')} {_EACH_ENVIRONMENT}) WHERE object_deleted IS NULL",
    ),
    "roles": ((), _values(_ROLES, "role, grp")),
    "role_grants": ((), _values(registry.ROLE_GRANTS, "child, parent")),
    "grants": (
        (),
        _values(
            [row for rule in registry.grant_rules() for row in rule.rows()],
            "role_name, privilege, object_type, database_name, schema_name, scope",
        ),
    ),
    "allowed": (
        (),
        _values([(t, v) for t, values in registry.TAG_VALUES.items() for v in values], "tag_name, tag_value"),
    ),
    "live_tags": (
        ("tag_references",),
        "SELECT * FROM tag_references WHERE tag_database = 'GOV_DB' AND tag_schema = 'GOVERNANCE' AND object_deleted IS NULL",
    ),
    "governed": (
        ("policy_references",),
        "SELECT * FROM policy_references WHERE policy_db = 'GOV_DB' AND policy_schema = 'GOVERNANCE'",
    ),
    "recent": (
        ("query_history",),
        "SELECT * FROM query_history WHERE start_time >= TIMESTAMP '2024-01-11 00:00:00' "
        "AND database_name IN ('ORG_DEV', 'ORG_TEST', 'ORG_PROD')",
    ),
}


def sql(select: str, *reads: str, **ctes: str) -> str:
    """``select`` over the input tables it ``reads``, with further named steps."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in TABLES[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for name in reads:
        need(name)
    steps = [f"{n} AS ({TABLES[n][1]})" for n in needed] + [f"{n} AS ({body})" for n, body in ctes.items()]
    head = "WITH RECURSIVE " + ",\n".join(steps) + "\n" if steps else ""
    return head + select
