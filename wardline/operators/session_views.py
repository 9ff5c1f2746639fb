"""Governed tables for SQL users: one view whose rows follow a session variable."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wardline.config import TableId
from wardline.functions.roles import LISTED_ROLES, UNLISTED_ROLE
from wardline.operators.secure import secured, table_attachments

ROLE_VARIABLE = "cur_role"


def declare_role(spark: SparkSession, role: str = UNLISTED_ROLE) -> None:
    """Create the session variable. ``SET VAR cur_role = '...'`` then switches roles."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {ROLE_VARIABLE} STRING DEFAULT NULL")
    spark.sql(f"SET VAR {ROLE_VARIABLE} = :role", args={"role": role})


def create_governed_view(
    df: DataFrame,
    name: str,
    table: TableId,
    as_of: date,
    policy_references: DataFrame,
    roles: Sequence[str] = LISTED_ROLES,
) -> None:
    """Temporary view ``name`` that shows ``df`` as the current role may read it.

    Each role has its own secured branch behind a test of the variable. The test is a
    constant when a query is planned, so every other branch is removed from the plan. A
    role in no branch gets what an unlisted role sees; no role at all sees nothing.
    """
    spark = df.sparkSession
    attached = table_attachments(policy_references, table, df)
    branches = []
    for i, role in enumerate((*roles, UNLISTED_ROLE)):
        secured(df, table, role, as_of, attached).createOrReplaceTempView(f"{name}__{i}")
        listed = ", ".join(f"'{r}'" for r in roles)
        test = f"{ROLE_VARIABLE} NOT IN ({listed})" if role == UNLISTED_ROLE else f"{ROLE_VARIABLE} = '{role}'"
        branches.append(f"SELECT * FROM {name}__{i} WHERE {test}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS " + " UNION ALL ".join(branches))
