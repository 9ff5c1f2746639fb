"""Governance objects kept as rows: tags, attachments, roles and privileges.

Attaching a policy, detaching it and dropping it are changes to the
``policy_references`` table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import Estate, TableId
from wardline.functions import roles as R
from wardline.functions import rowaccess as A
from wardline.sources import schemas

# The tag taxonomy.
TAG_VALUES: dict[str, tuple[str, ...]] = {
    "SENSITIVITY_LEVEL": ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"),
    "COMPLIANCE_TYPE": ("FERPA", "PII", "FINANCIAL", "PHI", "NONE"),
    "CONTAINS_PII": ("TRUE", "FALSE"),
    "DATA_DOMAIN": (
        "ENROLLMENT",
        "ACADEMIC",
        "FINANCIAL_AID",
        "HR",
        "INSTITUTIONAL_RESEARCH",
        "FINANCE",
        "ADVANCEMENT",
        "GENERAL",
    ),
    "DATA_OWNER": (
        "REGISTRAR",
        "FINANCIAL_AID",
        "ADMISSIONS",
        "IR",
        "FINANCE",
        "HR",
        "IT",
        "ADVANCEMENT",
        "MULTIPLE",
    ),
    "RETENTION_PERIOD": ("1_YEAR", "3_YEARS", "5_YEARS", "7_YEARS", "PERMANENT", "INDEFINITE"),
    "DATA_QUALITY_TIER": ("GOLD", "SILVER", "BRONZE", "UNVERIFIED"),
}

# Tags every table must carry, and what the tags of a PII column must say.
REQUIRED_TABLE_TAGS = ("SENSITIVITY_LEVEL", "DATA_DOMAIN", "DATA_OWNER")
PII_SENSITIVITY = ("RESTRICTED", "CONFIDENTIAL")
PII_COMPLIANCE = ("FERPA", "PII")

# Years to keep data after its last use. Other retention values never fall due.
RETENTION_YEARS = {"1_YEAR": 1, "3_YEARS": 3, "5_YEARS": 5, "7_YEARS": 7}

# Who inherits whom (child role granted to parent role).
ROLE_GRANTS: tuple[tuple[str, str], ...] = (
    (R.DATA_ANALYST, R.DATA_ADMIN),
    (R.IR_ANALYST, R.DATA_ADMIN),
    (R.REGISTRAR_ANALYST, R.DATA_ADMIN),
    (R.ENROLLMENT_ANALYST, R.DATA_ADMIN),
    (R.FINANCIAL_AID_ANALYST, R.DATA_ADMIN),
    (R.DATA_ENGINEER, R.DATA_ADMIN),
    (R.GOVERNANCE_ADMIN, R.DATA_ADMIN),
    (R.DATA_ANALYST, R.DATA_ENGINEER),
    (R.DATA_ADMIN, R.SYSADMIN),
    (R.GOVERNANCE_ADMIN, R.SYSADMIN),
)

# Masking attachments of the standard tables (column -> policy).
STANDARD_MASKS: dict[tuple[str, str], dict[str, str]] = {
    ("DISTRIBUTE", "DIM_STUDENT"): {
        "SSN": "SSN_MASK",
        "EMAIL": "EMAIL_MASK",
        "BIRTH_DATE": "DOB_MASK",
        "PHONE_NUMBER": "PHONE_MASK",
        "HOME_ADDRESS": "ADDRESS_MASK",
    },
    ("DISTRIBUTE", "FACT_FINANCIAL_AID"): {
        "AID_AMOUNT": "FINANCIAL_AMOUNT_MASK",
        "EFC_AMOUNT": "FINANCIAL_AMOUNT_MASK",
    },
}

# Row policy attachments of the standard tables (policy -> filtered column).
STANDARD_ROW_POLICIES: dict[tuple[str, str], dict[str, str]] = {
    ("DISTRIBUTE", "DIM_STUDENT"): {
        "ENROLLMENT_ROW_ACCESS": "ENROLLMENT_STATUS",
        "ACTIVE_RECORDS_ONLY": "IS_ACTIVE",
        "CURRENT_AY_ACCESS": "CURRENT_ACADEMIC_YEAR",
    },
    ("DISTRIBUTE", "FACT_ENROLLMENT"): {
        "CURRENT_AY_ACCESS": "ACADEMIC_YEAR",
        "CURRENT_TERM_ACCESS": "TERM_CODE",
    },
    ("DETERGE", "INT_COURSE_REGISTRATIONS"): {
        "CURRENT_TERM_ACCESS": "TERM_CODE",
    },
}


BUSINESS_SCHOOL = "BUSINESS_SCHOOL"  # the branch its departments hang below


def literal_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A short table of texts known when the plan is built.

    Arrow data becomes a local relation: Catalyst knows its exact size and broadcasts it by
    its own threshold.
    """
    names = T.StructType.fromDDL(ddl).fieldNames()
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, columns)}))


def tag_taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(tag, value) for tag, values in TAG_VALUES.items() for value in values]
    return literal_table(spark, rows, schemas.TAG_ALLOWED_VALUES)


def standard_role_grants(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ROLE_GRANTS, schemas.ROLE_GRANTS)


def standard_entitlements(spark: SparkSession) -> DataFrame:
    """Who sees which departments and programme types; a null code is every one."""
    policies = (A.DEPARTMENT_ACCESS, A.PROGRAM_TYPE_ACCESS)
    everyone = [(policy, role, None) for policy in policies for role in R.ADMINS + R.ENGINEERS + R.ANALYSTS]
    limited = [
        (A.DEPARTMENT_ACCESS, R.BUSINESS_SCHOOL_ANALYST, BUSINESS_SCHOOL),
        (A.PROGRAM_TYPE_ACCESS, R.UNDERGRAD_ANALYST, "UNDERGRADUATE"),
        (A.PROGRAM_TYPE_ACCESS, R.GRADUATE_ANALYST, "GRADUATE"),
    ]
    return literal_table(spark, everyone + limited, schemas.ENTITLEMENTS)


def standard_codes(spark: SparkSession) -> DataFrame:
    """What departments and programme types are parts of."""
    departments = [(A.DEPARTMENT_ACCESS, code, BUSINESS_SCHOOL) for code in A.EXAMPLE_DEPARTMENTS[R.BUSINESS_SCHOOL_ANALYST]]
    return literal_table(spark, [*departments, (A.PROGRAM_TYPE_ACCESS, "DOCTORAL", "GRADUATE")], schemas.CODES)


# -- attachments --------------------------------------------------------------


def mask_attachments(
    spark: SparkSession,
    masks: Mapping[tuple[str, str], Mapping[str, str]],
    environments: Iterable[str],
    estate: Estate = Estate(),
) -> DataFrame:
    """``policy_references`` rows that put masks on columns, in each environment."""
    rows = [
        _attachment(estate, policy, schemas.MASKING_KIND, TableId(estate.database(env), schema, table), column, None)
        for env in environments
        for (schema, table), columns in masks.items()
        for column, policy in columns.items()
    ]
    return literal_table(spark, rows, schemas.POLICY_REFERENCES)


def row_policy_attachments(
    spark: SparkSession,
    policies: Mapping[tuple[str, str], Mapping[str, str]],
    environments: Iterable[str],
    estate: Estate = Estate(),
) -> DataFrame:
    """``policy_references`` rows that put row policies on tables, in each environment."""
    rows = [
        _attachment(
            estate,
            policy,
            schemas.ROW_ACCESS_KIND,
            TableId(estate.database(env), schema, table),
            None,
            f'[ "{column}" ]',
        )
        for env in environments
        for (schema, table), attached in policies.items()
        for policy, column in attached.items()
    ]
    return literal_table(spark, rows, schemas.POLICY_REFERENCES)


def _attachment(estate, policy, kind, table: TableId, column, arguments):
    return (
        estate.governance_database,
        estate.governance_schema,
        policy,
        kind,
        table.database,
        table.schema,
        table.name,
        "TABLE",
        column,
        arguments,
        "ACTIVE",
        None,
        None,
        None,
    )


def attach(policy_references: DataFrame, attachments: DataFrame) -> DataFrame:
    return policy_references.unionByName(attachments)


def _on(table: TableId) -> Column:
    return (
        (F.col("ref_database_name") == table.database)
        & (F.col("ref_schema_name") == table.schema)
        & (F.col("ref_entity_name") == table.name)
    )


def detach_row_policy(policy_references: DataFrame, table: TableId, policy: str | None = None) -> DataFrame:
    """Remove one row policy, or all of them, from a table."""
    gone = _on(table) & (F.col("policy_kind") == schemas.ROW_ACCESS_KIND)
    if policy is not None:
        gone &= F.col("policy_name") == policy
    return policy_references.filter(~gone)


def detach_mask(policy_references: DataFrame, table: TableId, column: str | None = None) -> DataFrame:
    """Remove the mask of one column, or all masks, from a table."""
    gone = _on(table) & (F.col("policy_kind") == schemas.MASKING_KIND)
    if column is not None:
        gone &= F.col("ref_column_name") == column
    return policy_references.filter(~gone)


def replace_policy(policy_references: DataFrame, old: str, new: str) -> DataFrame:
    """Put policy ``new`` wherever ``old`` is attached."""
    name = F.col("policy_name")
    return policy_references.withColumn("policy_name", F.when(name == old, new).otherwise(name))


def droppable_policies(policy_references: DataFrame, policies: DataFrame) -> DataFrame:
    """Of ``policies(policy_name)``, those attached nowhere: only these may be dropped."""
    return policies.join(policy_references.select("policy_name").distinct(), "policy_name", "left_anti")


# -- privileges ---------------------------------------------------------------


class GrantRule(NamedTuple):
    """Privileges on a kind of object, for each database and schema, per scope."""

    role: str
    privileges: tuple[str, ...]
    object_types: tuple[str, ...]
    databases: tuple[str, ...]
    schemas: tuple[str | None, ...]
    scopes: tuple[str, ...]

    def rows(self):
        for privilege, kind, database, schema, scope in product(
            self.privileges, self.object_types, self.databases, self.schemas, self.scopes
        ):
            yield (self.role, privilege, kind, database, schema, scope)


READ = ("SELECT",)
READ_WRITE = ("SELECT", "INSERT", "UPDATE", "DELETE")
USAGE = ("USAGE",)
EVERYTHING = ("ALL",)

EXISTING = ("ALL",)
EXISTING_AND_FUTURE = ("ALL", "FUTURE")
OBJECT = ("OBJECT",)  # granted on the named object itself

ACCOUNT = "ACCOUNT"
HOST_METADATA = "ACCOUNT_METADATA"  # database of the host's own usage views


def grant_rules(estate: Estate = Estate()) -> list[GrantRule]:
    """The standard privileges, stated as rules over environments and layers."""
    env = estate.database
    every_env = estate.environment_databases
    layers = estate.layers
    curated = estate.curated_layers
    gov_db, gov_schema = (estate.governance_database,), (estate.governance_schema,)
    rules: list[GrantRule] = []

    def grant(role, privileges, kinds, databases, in_schemas=(None,), scopes=OBJECT):
        rules.append(GrantRule(role, privileges, kinds, databases, in_schemas, scopes))

    # Governance: runs the governance schema, reads every layer.
    grant(R.GOVERNANCE_ADMIN, USAGE, ("DATABASE",), gov_db + every_env)
    grant(
        R.GOVERNANCE_ADMIN,
        ("ALL", "CREATE TAG", "CREATE MASKING POLICY", "CREATE ROW ACCESS POLICY", "CREATE VIEW", "CREATE TABLE"),
        ("SCHEMA",),
        gov_db,
        gov_schema,
    )
    grant(
        R.GOVERNANCE_ADMIN,
        ("APPLY MASKING POLICY", "APPLY ROW ACCESS POLICY", "APPLY TAG"),
        ("ACCOUNT",),
        (ACCOUNT,),
    )
    grant(R.GOVERNANCE_ADMIN, ("IMPORTED PRIVILEGES",), ("DATABASE",), (HOST_METADATA,))
    grant(R.GOVERNANCE_ADMIN, USAGE, ("SCHEMA",), every_env, layers)
    grant(R.GOVERNANCE_ADMIN, READ, ("TABLE",), every_env, layers, EXISTING_AND_FUTURE)

    # Engineers: read and write every layer.
    grant(R.DATA_ENGINEER, USAGE, ("DATABASE",), every_env)
    grant(R.DATA_ENGINEER, USAGE, ("SCHEMA",), every_env, (None,), EXISTING)
    grant(R.DATA_ENGINEER, READ_WRITE, ("TABLE",), every_env, layers, EXISTING_AND_FUTURE)
    grant(R.DATA_ENGINEER, READ, ("VIEW",), every_env, curated, EXISTING_AND_FUTURE)

    # Transformation service accounts: read raw, build the curated layers.
    for role, databases in (
        (R.DBT_CLOUD_DEV, (env("DEV"),)),
        (R.DBT_CLOUD_PROD, (env("TEST"), env("PROD"))),
    ):
        grant(role, USAGE, ("DATABASE",), databases)
        grant(role, USAGE, ("SCHEMA",), databases, (None,), EXISTING)
        grant(role, READ, ("TABLE",), databases, ("DEPOSIT",), EXISTING)
        grant(role, EVERYTHING, ("SCHEMA",), databases, curated)
        grant(role, EVERYTHING, ("TABLE",), databases, curated, EXISTING_AND_FUTURE)
        grant(role, EVERYTHING, ("VIEW",), databases, curated, ("FUTURE",))

    # Analysts: read the marts, in production; two of them in the other environments too.
    for role in R.ANALYSTS:
        databases = every_env if role in (R.DATA_ANALYST, R.IR_ANALYST) else (env("PROD"),)
        grant(role, USAGE, ("DATABASE",), databases)
        grant(role, USAGE, ("SCHEMA",), databases, ("DISTRIBUTE",))
        grant(role, READ, ("TABLE", "VIEW"), databases, ("DISTRIBUTE",), EXISTING_AND_FUTURE)
    grant(R.IR_ANALYST, USAGE, ("SCHEMA",), every_env, ("DETERGE",))
    grant(R.IR_ANALYST, READ, ("TABLE", "VIEW"), every_env, ("DETERGE",), EXISTING_AND_FUTURE)

    # Monitoring views are open to engineers and institutional research.
    for role in (R.DATA_ENGINEER, R.IR_ANALYST):
        grant(role, READ, ("VIEW",), gov_db, gov_schema, EXISTING_AND_FUTURE)
    return rules


def standard_grants(spark: SparkSession, estate: Estate = Estate()) -> DataFrame:
    rows = [row for rule in grant_rules(estate) for row in rule.rows()]
    return literal_table(spark, rows, schemas.GRANTS)
