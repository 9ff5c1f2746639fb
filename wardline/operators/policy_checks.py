"""Testing policies: what every role sees of every row, in one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.masking import MASKING_POLICIES, MaskingPolicy
from wardline.functions.rowaccess import RowPolicy


def _views(df: DataFrame, column: str, policy: MaskingPolicy, *keep: str) -> DataFrame:
    """``keep`` and one column per distinct view of ``column``: ``view_0``, ``view_1`` and so on."""
    dtype = df.schema[column].dataType
    return df.select(
        *keep,
        *(view.expr(F.col(column), dtype).alias(f"view_{i}") for i, view in enumerate(policy.views)),
    )


def mask_for_roles(
    df: DataFrame, key: str, column: str, policy: MaskingPolicy, roles: Sequence[str]
) -> DataFrame:
    """``(key, role, masked)`` for each row and role: one scan, each distinct view computed once."""
    per_role = [
        F.struct(F.lit(role).alias("role"), F.col(f"view_{policy.view_index(role)}").alias("masked"))
        for role in roles
    ]
    return _views(df, column, policy, key).select(key, F.inline(F.array(*per_role)))


def _per_role(counts: DataFrame, policy: MaskingPolicy, roles: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Spread one row of ``<field>_<view>`` counts over the roles."""
    entries = [
        f"named_struct('policy', '{policy.name}', 'role', '{role}', "
        + ", ".join(f"'{field}', {field}_{policy.view_index(role)}" for field in fields)
        + ")"
        for role in roles
    ]
    return counts.selectExpr(f"inline(array({', '.join(entries)}))")


def _for_each_policy(columns: Mapping[str, str], check) -> DataFrame:
    """Union of a check over the policies.

    Each reads its one column. In a columnar file that is no more than reading all
    columns together, and the generated code stays small enough to be compiled.
    """
    return reduce(DataFrame.unionByName, (check(MASKING_POLICIES[name], c) for name, c in columns.items()))


def mask_matrix(df: DataFrame, columns: Mapping[str, str], roles: Sequence[str]) -> DataFrame:
    """Every policy with every role: how many values come out raw, partial, constant or null.

    Counted per distinct view in a global aggregate, so rows are neither multiplied by the
    roles nor shuffled; only the counts are given to each role.
    """

    def check(policy: MaskingPolicy, column: str) -> DataFrame:
        constants = ", ".join(f"'{c}'" for c in policy.constants)
        counts = []
        for i in range(len(policy.views)):
            out = f"view_{i}"
            constant = f"{out} IN ({constants}) AND NOT {out} <=> {column}" if constants else "FALSE"
            counts += [
                f"count({out}) AS present_{i}",
                f"count(*) - count({out}) AS null_rows_{i}",
                f"count_if({out} = {column}) AS raw_rows_{i}",
                f"count_if({constant}) AS constant_rows_{i}",
            ]
        counted = _views(df, column, policy, column).selectExpr(*counts)
        return _per_role(counted, policy, roles, ("present", "raw_rows", "constant_rows", "null_rows"))

    return _for_each_policy(columns, check).selectExpr(
        "policy",
        "role",
        "raw_rows",
        "present - raw_rows - constant_rows AS partial_rows",
        "constant_rows",
        "null_rows",
    )


def policy_value_audit(df: DataFrame, columns: Mapping[str, str], roles: Sequence[str]) -> DataFrame:
    """Per policy and role: values present, and values a masking view let through unchanged."""

    def check(policy: MaskingPolicy, column: str) -> DataFrame:
        counts = []
        for i, view in enumerate(policy.views):
            leaked = "FALSE" if view.raw else f"view_{i} = {column}"
            counts += [
                f"count(*) AS total_rows_{i}",
                f"count({column}) AS present_rows_{i}",
                f"count_if({leaked}) AS leaked_rows_{i}",
            ]
        counted = _views(df, column, policy, column).selectExpr(*counts)
        return _per_role(counted, policy, roles, ("total_rows", "present_rows", "leaked_rows"))

    return _for_each_policy(columns, check)


def _allowed(policies: Mapping[str, RowPolicy], role: str, as_of: date) -> Column:
    allowed = F.lit(True)
    for column, policy in policies.items():
        allowed = allowed & policy.allows(F.col(column), role, as_of)
    return allowed


def visible_by_role(
    df: DataFrame, key: str, policies: Mapping[str, RowPolicy], roles: Sequence[str], as_of: date
) -> DataFrame:
    """``(key, role)`` of every row each role may see under all ``policies`` (column -> policy)."""
    viewers = F.array_compact(
        F.array(*(F.when(_allowed(policies, role, as_of), F.lit(role)) for role in roles))
    )
    return df.select(key, F.explode(viewers).alias("role"))


def row_role_counts(
    df: DataFrame, status: str, policies: Mapping[str, RowPolicy], roles: Sequence[str], as_of: date
) -> DataFrame:
    """Rows visible per role and status. Each row adds to all roles' counts at once."""
    counts = df.groupBy(status).agg(*(F.count_if(_allowed(policies, r, as_of)).alias(r) for r in roles))
    return counts.unpivot([status], list(roles), "role", "visible_rows").filter("visible_rows > 0")
