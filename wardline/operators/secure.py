"""Governed reads: row policies, then masks, for one role."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import Estate, TableId
from wardline.functions.masking import MASKING_POLICIES, MaskingPolicy
from wardline.functions.rowaccess import ROW_POLICIES, RowPolicy
from wardline.sources import schemas


ACTIVE = "ACTIVE"


class UnknownPolicy(LookupError):
    """An attached policy has no definition, or is not in force. The read is refused rather than left open."""


@dataclass(frozen=True)
class Attached:
    """Masks by column, and row policies with the columns they look at, of one table."""

    masks: Mapping[str, str]
    row_policies: tuple[tuple[str, tuple[str, ...]], ...]


def table_attachments(
    policy_references: DataFrame, table: TableId, df: DataFrame, estate: Estate = Estate()
) -> Attached:
    """What is attached to a table, looked up once; pass it on to read the table for several roles.

    Policies are those of the governance schema. An attachment of a policy of another
    schema, or one that is not active, cannot be applied, so it refuses the read. The rows
    fetched are those of one table and its own columns, so they are bounded by the table's
    width.
    """
    known = {c.lower(): c for c in df.columns}
    rows = (
        policy_references.filter(
            (F.col("ref_database_name") == table.database)
            & (F.col("ref_schema_name") == table.schema)
            & (F.col("ref_entity_name") == table.name)
            & (
                (F.col("policy_kind") == schemas.ROW_ACCESS_KIND)
                | F.lower("ref_column_name").isin(*known)
            )
        )
        .select(
            "policy_db",
            "policy_schema",
            "policy_name",
            "policy_kind",
            "policy_status",
            "ref_column_name",
            "ref_arg_column_names",
        )
        .distinct()
        .collect()
    )
    masks: dict[str, str] = {}
    row_policies: list[tuple[str, tuple[str, ...]]] = []
    for row in rows:
        home = (row.policy_db, row.policy_schema)
        if home != (estate.governance_database, estate.governance_schema) or row.policy_status != ACTIVE:
            raise UnknownPolicy(f"{'.'.join(map(str, home))}.{row.policy_name} ({row.policy_status})")
        if row.policy_kind == schemas.MASKING_KIND:
            column = known[row.ref_column_name.lower()]
            if masks.setdefault(column, row.policy_name) != row.policy_name:
                raise ValueError(f"two masking policies on {table.name}.{column}")
        elif row.policy_kind == schemas.ROW_ACCESS_KIND:
            arguments = tuple(known[a.lower()] for a in json.loads(row.ref_arg_column_names))
            row_policies.append((row.policy_name, arguments))
    return Attached(masks, tuple(row_policies))


def _attached(found: DataFrame | Attached, table: TableId, df: DataFrame) -> Attached:
    return found if isinstance(found, Attached) else table_attachments(found, table, df)


def _defined(policies: Mapping, name: str):
    try:
        return policies[name]
    except KeyError:
        raise UnknownPolicy(name) from None


def apply_row_policies(
    df: DataFrame,
    attached: Iterable[tuple[str, tuple[str, ...]]],
    role: str,
    as_of: date,
    policies: Mapping[str, RowPolicy] = ROW_POLICIES,
) -> DataFrame:
    """Keep the rows every attached policy allows. Catalyst merges the filters.

    A policy is a :class:`RowPolicy`, or an ``EntitlementPolicy`` whose roles stand in a table.
    """
    for name, (column,) in sorted(attached):
        df = _defined(policies, name).apply(df, column, role, as_of)
    return df


def masked_columns(
    df: DataFrame,
    masks: Mapping[str, str],
    role: str,
    policies: Mapping[str, MaskingPolicy] = MASKING_POLICIES,
) -> list[Column]:
    """All columns of ``df``, the attached ones through their mask."""
    return [
        _defined(policies, masks[f.name]).mask(F.col(f.name), role, f.dataType).alias(f.name)
        if f.name in masks
        else F.col(f.name)
        for f in df.schema
    ]


def masked(df: DataFrame, table: TableId, role: str, policy_references: DataFrame | Attached) -> DataFrame:
    return df.select(masked_columns(df, _attached(policy_references, table, df).masks, role))


def secured(
    df: DataFrame,
    table: TableId,
    role: str,
    as_of: date,
    policy_references: DataFrame | Attached,
    masking: Mapping[str, MaskingPolicy] = MASKING_POLICIES,
    row_access: Mapping[str, RowPolicy] = ROW_POLICIES,
) -> DataFrame:
    """The table as ``role`` may read it.

    Row policies look at the raw values and come first; whatever the caller adds on top
    sees masked values only, filters and joins included. One scan, no shuffle, no Python
    worker. Policies attached but not defined raise :class:`UnknownPolicy`.
    """
    attached = _attached(policy_references, table, df)
    visible = apply_row_policies(df, attached.row_policies, role, as_of, row_access)
    return visible.select(masked_columns(df, attached.masks, role, masking))
