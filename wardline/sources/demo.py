"""A governed estate derived from a star-schema data set (orders, part, events).

Every order becomes a person record, every part a catalogued column, every event
a logged query. All of it is computed by Spark from the given tables, so it
grows with them.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import Clock, Estate
from wardline.sources import registry
from wardline.sources.estate_tables import Governance

AS_OF = datetime(2024, 2, 10)
AS_OF_DATE = date(2000, 6, 30)

PERSON_TABLE = ("DISTRIBUTE", "DIM_PERSON")
PERSON_MASKS = {
    PERSON_TABLE: {
        "student_name": "NAME_MASK",
        "ssn": "SSN_MASK",
        "email": "EMAIL_MASK",
        "birth_date": "DOB_MASK",
        "phone": "PHONE_MASK",
        "address": "ADDRESS_MASK",
        "aid_amount": "FINANCIAL_AMOUNT_MASK",
    }
}
PERSON_ROW_POLICIES = {
    PERSON_TABLE: {
        "ENROLLMENT_ROW_ACCESS": "enrollment_status",
        "ACTIVE_RECORDS_ONLY": "is_active",
        "CURRENT_AY_ACCESS": "academic_year",
    }
}

# Projections whose text also runs in the SQL check of the results.
PERSON = {
    "person_id": "o_orderkey",
    "student_id": "'S' || lpad(CAST(o_orderkey AS STRING), 8, '0')",
    "student_name": """
        CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'Cher'
        WHEN o_orderkey % 11 = 0 THEN 'Mary Ann Lee' WHEN o_orderkey % 7 = 0 THEN 'J  D'
        ELSE 'First' || CAST(o_custkey AS STRING) || ' Last' || CAST(o_orderkey % 100 AS STRING) END
    """,
    "ssn": """
        CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN '12' WHEN o_orderkey % 29 = 0 THEN ''
        ELSE CAST(100 + o_orderkey % 900 AS STRING) || '-' || CAST(10 + o_orderkey % 90 AS STRING) || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') END
    """,
    "email": """
        CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '@x' WHEN o_orderkey % 31 = 0 THEN 'noat' WHEN o_orderkey % 43 = 0 THEN ''
        ELSE 'u' || CAST(o_orderkey AS STRING) || '@dept' || CAST(o_custkey % 7 AS STRING) || '.example.edu' END
    """,
    "birth_date": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "phone": """
        CASE o_orderkey % 7 WHEN 0 THEN '555-123-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')
        WHEN 1 THEN '(555) 123-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')
        WHEN 2 THEN '(555)' WHEN 3 THEN '5551234567' WHEN 4 THEN 'x 555-123-4567' WHEN 5 THEN '(555)123-4567' ELSE NULL END
    """,
    "address": """
        CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS STRING) || ' Main St, Springfield, IL 62701'
        WHEN 1 THEN CAST(o_orderkey AS STRING) || ' Oak Ave,Chicago' WHEN 2 THEN 'PO Box 9' WHEN 3 THEN ',x,y'
        WHEN 4 THEN '' WHEN 5 THEN 'A, B, C, D' ELSE NULL END
    """,
    "aid_amount": "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END",
    "enrollment_status": """
        CASE o_orderkey % 13 WHEN 0 THEN 'PROSPECTIVE' WHEN 1 THEN 'APPLIED' WHEN 2 THEN 'ADMITTED' WHEN 3 THEN 'DEPOSITED'
        WHEN 4 THEN 'ENROLLED' WHEN 5 THEN 'enrolled' WHEN 6 THEN 'GRADUATED' WHEN 7 THEN 'WITHDRAWN' WHEN 8 THEN 'LEAVE_OF_ABSENCE'
        WHEN 9 THEN 'COMPLETED' WHEN 10 THEN 'DEFERRED' WHEN 11 THEN 'DENIED' ELSE NULL END
    """,
    "is_active": "CASE o_orderkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END",
    "academic_year": "CAST(year(o_orderdate) AS STRING)",
    "term_code": "CAST(year(o_orderdate) AS STRING) || lpad(CAST(month(o_orderdate) AS STRING), 2, '0')",
    "department_code": """
        CASE o_orderkey % 6 WHEN 0 THEN 'ACCT' WHEN 1 THEN 'FIN' WHEN 2 THEN 'MATH' WHEN 3 THEN 'ENG' WHEN 4 THEN 'BIOL' ELSE NULL END
    """,
    "ferpa_consent": "CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "program_type": """
        CASE o_orderkey % 4 WHEN 0 THEN 'UNDERGRADUATE' WHEN 1 THEN 'Graduate' WHEN 2 THEN 'DOCTORAL' ELSE NULL END
    """,
}

# Twenty columns to a table; one column in eight belongs to table 2, which is hot.
TABLE_OF_PART = "(CASE WHEN p_partkey % 8 = 0 THEN 2 ELSE CAST(floor(p_partkey / 20) AS BIGINT) END)"
TABLE_OF_COLUMN = "CAST(floor(column_id / 20) AS BIGINT)"  # of a table's second column, which is never in table 2 by the rule above
FIRST_OF_TABLE = "column_id % 20 = 1"
TABLE_OF_EVENT = "CAST(floor(event_id / 100) AS BIGINT)"

COLUMNS = {
    "table_catalog": f"CASE WHEN {TABLE_OF_PART} % 10 = 9 THEN 'ORG_TEST' ELSE 'ORG_PROD' END",
    "table_schema": f"""
        CASE {TABLE_OF_PART} % 4 WHEN 0 THEN 'DEPOSIT' WHEN 1 THEN 'DETERGE' WHEN 2 THEN 'DISTRIBUTE' ELSE 'SCRATCH' END
    """,
    "table_name": f"'T' || CAST({TABLE_OF_PART} AS STRING)",
    "column_name": """
        CASE p_partkey % 23 WHEN 0 THEN 'SSN' WHEN 1 THEN 'Social_Security_No' WHEN 2 THEN 'SOCIAL_HANDLE' WHEN 3 THEN 'EMAIL'
        WHEN 4 THEN 'DOB' WHEN 5 THEN 'BIRTH_DATE' WHEN 6 THEN 'BIRTH_PLACE' WHEN 7 THEN 'PHONE' WHEN 8 THEN 'MOBILE'
        WHEN 9 THEN 'HOME_ADDRESS' WHEN 10 THEN 'STREET' WHEN 11 THEN 'SALARY' WHEN 12 THEN 'WAGE' WHEN 13 THEN 'AID_AMOUNT'
        WHEN 14 THEN 'STUDENT_ID' WHEN 15 THEN 'PASSWORD' WHEN 16 THEN 'PWD' WHEN 17 THEN 'LAST_NAME' WHEN 18 THEN 'CLASSNAME'
        WHEN 19 THEN 'EMAIL_ADDRESS' WHEN 20 THEN 'COURSE_CODE' WHEN 21 THEN 'CREDITS' ELSE 'UPDATED_AT' END
        || '_' || CAST(p_partkey AS STRING)
    """,
    "data_type": """
        CASE WHEN p_partkey % 23 IN (4, 5) THEN 'DATE' WHEN p_partkey % 23 IN (11, 12, 13) THEN 'NUMBER' ELSE 'TEXT' END
    """,
    "column_id": "p_partkey",
}

# The catalogue before some columns came, went, were renamed or got another type.
FORMER_COLUMNS = {
    "table_catalog": "table_catalog",
    "table_schema": "table_schema",
    "table_name": "table_name",
    "column_name": "column_name || gone || CASE WHEN column_id % 40 = 2 THEN '_OLD' ELSE '' END",
    "data_type": "CASE WHEN column_id % 7 = 1 THEN 'NUMBER' ELSE data_type END",
}
FORMER_COLUMNS_WHERE = "(n = 0 AND column_id % 60 <> 0) OR (n = 1 AND column_id % 50 = 3)"

MASKING_ATTACHMENTS = {
    "policy_db": "'GOV_DB'",
    "policy_schema": "CASE WHEN column_id % 33 = 0 THEN 'OTHER' ELSE 'GOVERNANCE' END",
    "policy_name": """
        CASE column_id % 23 WHEN 0 THEN 'SSN_MASK' WHEN 1 THEN 'NAME_MASK' WHEN 3 THEN 'EMAIL_MASK' WHEN 4 THEN 'DOB_MASK' WHEN 5 THEN 'DOB_MASK'
        WHEN 7 THEN 'PHONE_MASK' WHEN 9 THEN 'ADDRESS_MASK' WHEN 13 THEN 'FINANCIAL_AMOUNT_MASK' WHEN 14 THEN 'STUDENT_ID_MASK' ELSE 'NAME_MASK' END
    """,
    "policy_kind": "'MASKING_POLICY'",
    "ref_database_name": "table_catalog",
    "ref_schema_name": "table_schema",
    "ref_entity_name": "table_name",
    "ref_entity_domain": "'TABLE'",
    "ref_column_name": "column_name",
    "ref_arg_column_names": "CAST(NULL AS STRING)",
    "policy_status": "'ACTIVE'",
    "tag_database": "CAST(NULL AS STRING)",
    "tag_schema": "CAST(NULL AS STRING)",
    "tag_name": "CAST(NULL AS STRING)",
}
MASKING_ATTACHMENTS_WHERE = "column_id % 3 = 0 AND column_id % 23 <= 19 AND column_id % 100 < 60"

ROW_ATTACHMENTS = {
    "policy_db": "'GOV_DB'",
    "policy_schema": "'GOVERNANCE'",
    "policy_name": f"CASE WHEN {TABLE_OF_COLUMN} % 8 = 1 THEN 'ENROLLMENT_ROW_ACCESS' ELSE 'CURRENT_TERM_ACCESS' END",
    "policy_kind": "'ROW_ACCESS_POLICY'",
    "ref_database_name": "table_catalog",
    "ref_schema_name": "table_schema",
    "ref_entity_name": "table_name",
    "ref_entity_domain": "'TABLE'",
    "ref_column_name": "CAST(NULL AS STRING)",
    "ref_arg_column_names": "'[ \"STATUS\" ]'",
    "policy_status": "'ACTIVE'",
    "tag_database": "CAST(NULL AS STRING)",
    "tag_schema": "CAST(NULL AS STRING)",
    "tag_name": "CAST(NULL AS STRING)",
}
ROW_ATTACHMENTS_WHERE = f"{FIRST_OF_TABLE} AND {TABLE_OF_COLUMN} % 5 = 1"

QUERY_HISTORY = {
    "query_id": "event_id",
    "user_name": "'USER_' || CAST(user_id AS STRING)",
    "role_name": """
        CASE user_id % 8 WHEN 0 THEN 'GOVERNANCE_ADMIN_ROLE' WHEN 1 THEN 'DATA_ENGINEER_ROLE' WHEN 2 THEN 'IR_ANALYST_ROLE' WHEN 3 THEN 'REGISTRAR_ANALYST_ROLE'
        WHEN 4 THEN 'ENROLLMENT_ANALYST_ROLE' WHEN 5 THEN 'FINANCIAL_AID_ANALYST_ROLE' WHEN 6 THEN 'DATA_ANALYST_ROLE' ELSE 'DBT_CLOUD_PROD_ROLE' END
    """,
    "database_name": """
        CASE event_id % 5 WHEN 0 THEN 'ORG_DEV' WHEN 1 THEN 'ORG_TEST' WHEN 2 THEN 'OTHER_DB' ELSE 'ORG_PROD' END
    """,
    "schema_name": """
        CASE event_id % 7 WHEN 0 THEN 'DEPOSIT' WHEN 1 THEN 'DETERGE' WHEN 2 THEN 'DISTRIBUTE' WHEN 3 THEN 'GOVERNANCE' WHEN 4 THEN 'SCRATCH' WHEN 5 THEN 'DISTRIBUTE' ELSE 'DETERGE' END
    """,
    "query_type": """
        CASE WHEN event_id % 13 = 0 THEN 'SHOW' WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'INSERT'
        WHEN event_type = 'signup' THEN 'CREATE' ELSE 'SELECT' END
    """,
    "start_time": "ts",
    "total_elapsed_time": "CAST(round(value * 100) AS BIGINT)",
    "rows_produced": "event_id % 1000",
    "error_code": "CASE WHEN event_type = 'error' THEN '3001' ELSE NULL END",
    "error_message": """
        CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'Access was DENIED' WHEN event_id % 3 = 1 THEN 'violates Policy P1' ELSE 'syntax error' END
    """,
    "query_text": """
        CASE event_id % 6 WHEN 0 THEN 'create masking policy p' WHEN 1 THEN 'ALTER ROW ACCESS POLICY r' WHEN 2 THEN 'put file @stage' ELSE 'select 1' END
    """,
    "objects_accessed": f"""
        CASE WHEN event_id % 11 = 0 THEN '[]' WHEN event_id % 19 = 0 THEN NULL
        WHEN event_id % 3 = 0 THEN '[{{"objectName":"T2"}},{{"objectDomain":"Stage"}}]'
        WHEN event_id % 2 = 0 THEN '[{{"objectName":"T' || CAST({TABLE_OF_EVENT} AS STRING) || '"}},{{"objectName":"T' || CAST({TABLE_OF_EVENT} + 1 AS STRING) || '"}}]'
        ELSE '[{{"objectName":"T' || CAST({TABLE_OF_EVENT} AS STRING) || '"}},{{"objectDomain":"Stage"}}]' END
    """,
}


USER_GRANTS = {
    "user_name": "'USER_' || CAST(c_custkey AS STRING)",
    "role_name": QUERY_HISTORY["role_name"].replace("user_id", "c_custkey"),
}
USER_GRANTS_WHERE = "c_custkey % 10 <> 0"

ROLE_TREE = {
    "child": "'ROLE_' || CAST(p_partkey AS STRING)",
    "parent": "'ROLE_' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)",
}

TAG_REFERENCES = {
    "tag_database": "'GOV_DB'",
    "tag_schema": "'GOVERNANCE'",
    "tag_name": "tag",
    "tag_value": """
        CASE tag WHEN 'CONTAINS_PII' THEN CASE WHEN column_id % 11 = 0 THEN 'FALSE' ELSE 'TRUE' END
        WHEN 'SENSITIVITY_LEVEL' THEN CASE WHEN column_id % 5 = 0 THEN 'SECRET' WHEN column_id % 5 < 3 THEN 'RESTRICTED' ELSE 'INTERNAL' END
        ELSE CASE WHEN column_id % 3 = 0 THEN 'FERPA' ELSE 'PII' END END
    """,
    "object_database": "table_catalog",
    "object_schema": "table_schema",
    "object_name": "table_name",
    "column_name": "column_name",
    "domain": "'COLUMN'",
    "object_deleted": "CASE WHEN column_id % 37 = 0 THEN TIMESTAMP_NTZ '2024-01-15 00:00:00' END",
}
TABLE_TAG_REFERENCES = TAG_REFERENCES | {
    "tag_value": "value",
    "column_name": "CAST(NULL AS STRING)",
    "domain": "'TABLE'",
    "object_deleted": "CAST(NULL AS TIMESTAMP_NTZ)",
}

TABLE_TAGS_WHERE = f"{FIRST_OF_TABLE} AND {TABLE_OF_COLUMN} % 10 < 7 AND {TABLE_OF_COLUMN} % m = 0"

# The same masks in three environments, some of them missing; tags likewise.
ENVIRONMENT_ATTACHMENTS = MASKING_ATTACHMENTS | {"policy_schema": "'GOVERNANCE'", "policy_name": "'NAME_MASK'", "ref_database_name": "'ORG_' || env"}
ENVIRONMENT_TAGS = TAG_REFERENCES | {
    "tag_name": "'DATA_QUALITY_TIER'",
    "tag_value": "CASE WHEN column_id % 4 = 0 AND env = 'DEV' THEN 'BRONZE' ELSE 'GOLD' END",
    "object_database": "'ORG_' || env",
}
ENVIRONMENTS_WHERE = "column_id % 3 = 0 AND column_id % m <> 0"


def projection(named: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in named.items()]


def _select(df: DataFrame, named: dict[str, str], where: str | None = None) -> DataFrame:
    return (df if where is None else df.filter(where)).selectExpr(*projection(named))


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/orders.parquet"), PERSON)


def query_history_of(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as logged queries."""
    return _select(events, QUERY_HISTORY)


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark.read.parquet(f"{sf_dir}/part.parquet"), COLUMNS)


def _tables(columns: DataFrame) -> DataFrame:
    number = F.substring("table_name", 2, 10).cast("int")
    return columns.select(
        "table_catalog",
        "table_schema",
        "table_name",
        F.when(number % 10 == 3, "VIEW").otherwise("BASE TABLE").alias("table_type"),
    ).distinct()


def _with_each(df: DataFrame, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """Every row once per entry of a short literal list."""
    entries = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return df.select("*", F.inline(F.array(*entries)))


def _tag_references(columns: DataFrame) -> DataFrame:
    column_tags = _with_each(
        columns, ("tag", "m"), [("CONTAINS_PII", 2), ("SENSITIVITY_LEVEL", 4), ("COMPLIANCE_TYPE", 6)]
    )
    table_tags = _with_each(
        columns,
        ("tag", "value", "m"),
        [
            ("SENSITIVITY_LEVEL", "CONFIDENTIAL", 2),
            ("DATA_DOMAIN", "ACADEMIC", 3),
            ("DATA_OWNER", "REGISTRAR", 1),
            ("RETENTION_PERIOD", "1_YEAR", 5),
        ],
    )
    return _select(
        column_tags, TAG_REFERENCES, "column_id % m = 0 AND column_id % 23 <= 19 AND column_id % 100 < 80"
    ).unionByName(_select(table_tags, TABLE_TAG_REFERENCES, TABLE_TAGS_WHERE))


def _environments(spark: SparkSession, sf_dir: str, named: dict[str, str]) -> DataFrame:
    each = _with_each(_columns(spark, sf_dir), ("env", "m"), [("DEV", 7), ("TEST", 11), ("PROD", 13)])
    return _select(each, named, ENVIRONMENTS_WHERE)


def with_environments(spark: SparkSession, sf_dir: str) -> Governance:
    """The estate with masks and tags that are to be alike in three environments, and are not."""
    gov = governance(spark, sf_dir)
    return gov.with_(
        policy_references=gov.policy_references.unionByName(_environments(spark, sf_dir, ENVIRONMENT_ATTACHMENTS)),
        tag_references=gov.tag_references.unionByName(_environments(spark, sf_dir, ENVIRONMENT_TAGS)),
    )


def earlier_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column catalogue as an earlier snapshot saw it."""
    return _columns(spark, sf_dir).filter("column_id % 10 <> 0").drop("column_id")


def former_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier column catalogue that differs from the present one in every way."""
    each = _with_each(_columns(spark, sf_dir), ("gone", "n"), [("", 0), ("_GONE", 1)])
    return _select(each, FORMER_COLUMNS, FORMER_COLUMNS_WHERE)


def _policy_references(columns: DataFrame) -> DataFrame:
    return _select(columns, MASKING_ATTACHMENTS, MASKING_ATTACHMENTS_WHERE).unionByName(
        _select(columns, ROW_ATTACHMENTS, ROW_ATTACHMENTS_WHERE)
    )


def governance(spark: SparkSession, sf_dir: str) -> Governance:
    return Governance(
        spark,
        Clock(AS_OF),
        policy_references=lambda: _policy_references(_columns(spark, sf_dir)),
        tag_references=lambda: _tag_references(_columns(spark, sf_dir)),
        columns=lambda: _columns(spark, sf_dir).drop("column_id"),
        tables=lambda: _tables(_columns(spark, sf_dir)),
        query_history=lambda: query_history_of(spark.read.parquet(f"{sf_dir}/events.parquet")),
        user_grants=lambda: _select(spark.read.parquet(f"{sf_dir}/customer.parquet"), USER_GRANTS, USER_GRANTS_WHERE),
    )


def role_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants between roles: each part's role holds those of the parts of twice its number."""
    return _select(spark.read.parquet(f"{sf_dir}/part.parquet"), ROLE_TREE)


def person_attachments(spark: SparkSession, estate: Estate = Estate()) -> DataFrame:
    """Masks and row policies of the person table in every environment."""
    return registry.mask_attachments(spark, PERSON_MASKS, estate.environments, estate).unionByName(
        registry.row_policy_attachments(spark, PERSON_ROW_POLICIES, estate.environments, estate)
    )
