"""Schemas of the governance tables."""

from __future__ import annotations

POLICY_REFERENCES = """
    policy_db string, policy_schema string, policy_name string, policy_kind string,
    ref_database_name string, ref_schema_name string, ref_entity_name string, ref_entity_domain string,
    ref_column_name string, ref_arg_column_names string, policy_status string,
    tag_database string, tag_schema string, tag_name string
"""

TAG_REFERENCES = """
    tag_database string, tag_schema string, tag_name string, tag_value string,
    object_database string, object_schema string, object_name string, column_name string,
    domain string, object_deleted timestamp_ntz
"""

COLUMNS = "table_catalog string, table_schema string, table_name string, column_name string, data_type string"

TABLES = "table_catalog string, table_schema string, table_name string, table_type string"

# Partition columns of a stored log: the day of start_time, and the load a row came with.
LOG_DATE, LOAD = "log_date", "load_id"
OBJECTS_ACCESSED = "array<struct<objectName: string>>"

_QUERY = """
    query_id bigint, user_name string, role_name string, database_name string, schema_name string,
    query_type string, start_time timestamp_ntz, total_elapsed_time bigint, rows_produced bigint,
    error_code string, error_message string, query_text string
"""
QUERY_HISTORY = f"{_QUERY}, objects_accessed string"  # as logged: JSON text
STORED_QUERY_HISTORY = f"{_QUERY}, objects_accessed {OBJECTS_ACCESSED}, {LOG_DATE} date, {LOAD} int"

TAG_ALLOWED_VALUES = "tag_name string, allowed_value string"

ROLE_GRANTS = "child string, parent string"

USER_GRANTS = "user_name string, role_name string"

ENTITLEMENTS = "policy_name string, role_name string, code string"  # a null code: every value, a missing one too
CODES = "policy_name string, code string, parent string"

GRANTS = """
    role_name string, privilege string, object_type string,
    database_name string, schema_name string, scope string
"""

AUDIT_LOG = "audit_name string, issue_count bigint, audit_date date"

MASKING_KIND = "MASKING_POLICY"
ROW_ACCESS_KIND = "ROW_ACCESS_POLICY"
