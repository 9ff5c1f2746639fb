"""Role inheritance and privileges, computed from grant tables and set against actual use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.access import METADATA_TYPES
from wardline.sources.estate_tables import Governance
from wardline.sources.storage import discard, written

OBJECT = ["database_name", "schema_name", "object_type"]

WRITE_PRIVILEGES = ("INSERT", "UPDATE", "DELETE", "ALL")
READ_PRIVILEGES = ("SELECT",)
WRITE_QUERIES = ("INSERT", "UPDATE", "DELETE", "MERGE", "COPY", "CREATE", "ALTER", "DROP")


def closure(pairs: DataFrame) -> DataFrame:
    """The transitive closure of ``(role_name, inherited_role)``.

    After round k the frame has every pair whose shortest path has at most 2^k steps; ``far``
    marks those of exactly 2^k. A round joins the far pairs alone with all pairs, so a longer
    pair is found once for each role that stands 2^k steps along a shortest path: in a tree
    once, whatever its depth. What also has a shorter path is not far. It ends, in cycles as
    well, when no pair is far. Rounds are written to the shared folder; a round's files go
    once the next one is written.
    """
    other = ~F.col("role_name").eqNullSafe(F.col("inherited_role"))
    held = written(pairs.distinct().withColumn("far", other))
    while held.filter("far").count():
        first = held.filter("far").select("role_name", "inherited_role")
        onward = held.filter(other).select(F.col("role_name").alias("inherited_role"), F.col("inherited_role").alias("further"), "far")
        before, held = held, written(
            first.join(onward, "inherited_role")
            .select("role_name", F.col("further").alias("inherited_role"), "far")
            .union(held.withColumn("far", F.lit(False)))
            .groupBy("role_name", "inherited_role")
            .agg(F.min("far").alias("far"))
            .withColumn("far", F.col("far") & other)
        )
        discard(before)
    return held.drop("far")


def role_closure(gov: Governance) -> DataFrame:
    """``(role_name, inherited_role)``: every role with all the roles it holds, itself included."""
    named = (
        gov.role_grants.select(F.col("child").alias("role_name"))
        .unionByName(gov.role_grants.select(F.col("parent").alias("role_name")))
        .unionByName(gov.grants.select("role_name"))
        .select("role_name", F.col("role_name").alias("inherited_role"))
    )
    granted = gov.role_grants.select(F.col("parent").alias("role_name"), F.col("child").alias("inherited_role"))
    return closure(named.union(granted))


def inherited_roles(gov: Governance) -> DataFrame:
    """Every role with the number of roles it holds beside itself, directly and in all."""
    direct = gov.role_grants.filter("child <> parent").distinct().groupBy(F.col("parent").alias("role_name")).agg(F.count("*").alias("direct_roles"))
    every = role_closure(gov).groupBy("role_name").agg((F.count("*") - 1).alias("inherited_roles"))
    return every.join(direct, "role_name", "left").select(
        "role_name", F.coalesce("direct_roles", F.lit(0)).alias("direct_roles"), "inherited_roles"
    )


def role_usage(gov: Governance) -> DataFrame:
    """Users and queries per session role over the whole log."""
    return gov.query_history.groupBy("role_name").agg(
        F.count_distinct("user_name").alias("users"), F.count("*").alias("queries")
    )


def role_closure_usage(gov: Governance) -> DataFrame:
    """The closure, with how much each role that holds another is used."""
    return (
        role_closure(gov)
        .join(role_usage(gov), "role_name", "left")
        .select(
            "role_name",
            "inherited_role",
            F.coalesce("users", F.lit(0)).alias("users"),
            F.coalesce("queries", F.lit(0)).alias("queries"),
        )
    )


def effective_grants(gov: Governance, held: DataFrame | None = None) -> DataFrame:
    """Direct and inherited privileges of every role; ``held`` is the closure, if it is there already."""
    grants = gov.grants.withColumnRenamed("role_name", "inherited_role")
    held = role_closure(gov) if held is None else held
    return (
        held.join(grants, "inherited_role")
        .groupBy("role_name", "privilege", *OBJECT, "scope")
        .agg(F.max(F.col("inherited_role") == F.col("role_name")).alias("is_direct"))
    )


def effective_privileges(gov: Governance) -> DataFrame:
    """Effective privileges, with the number of catalogued objects each one reaches."""
    objects = (
        gov.tables.withColumn("object_type", F.when(F.col("table_type") == "VIEW", "VIEW").otherwise("TABLE"))
        .groupBy(
            F.col("table_catalog").alias("database_name"), F.col("table_schema").alias("schema_name"), "object_type"
        )
        .agg(F.count("*").alias("object_count"))
    )
    return (
        effective_grants(gov)
        .join(objects, OBJECT, "left")
        .select(
            "role_name",
            "privilege",
            *OBJECT,
            "scope",
            "is_direct",
            F.coalesce("object_count", F.lit(0)).alias("object_count"),
        )
    )


def layer_access(gov: Governance, held: DataFrame | None = None) -> DataFrame:
    """Per role, database and layer: 2 = write, 1 = read. Absent = none."""
    estate = gov.estate
    rank = F.when(F.col("privilege").isin(*WRITE_PRIVILEGES), 2).when(F.col("privilege").isin(*READ_PRIVILEGES), 1)
    return (
        effective_grants(gov, held)
        .filter(
            F.col("object_type").isin("TABLE", "VIEW")
            & (F.col("scope") == "ALL")
            & F.col("database_name").isin(*estate.environment_databases)
            & F.col("schema_name").isin(*estate.layers)
        )
        .groupBy("role_name", "database_name", "schema_name")
        .agg(F.max(rank).alias("access"))
        .filter(F.col("access").isNotNull())
    )


def role_access_matrix(gov: Governance) -> DataFrame:
    """Role by environment and layer: NONE, READ or WRITE, beside the role's actual use."""
    estate = gov.estate
    cells = [f"{env}_{layer}" for env in estate.environments for layer in estate.layers]
    cell = F.concat_ws("_", F.element_at(F.split("database_name", "_"), -1), "schema_name")
    held = role_closure(gov)
    matrix = layer_access(gov, held).withColumn("cell", cell).groupBy("role_name").pivot("cell", cells).agg(F.max("access"))
    words = [
        F.when(F.col(c) == 2, "WRITE").when(F.col(c) == 1, "READ").otherwise("NONE").alias(c.lower()) for c in cells
    ]
    # every role holds itself
    roles = held.filter(F.col("role_name").eqNullSafe(F.col("inherited_role"))).select("role_name")
    return (
        roles.join(matrix, "role_name", "left")
        .join(role_usage(gov), "role_name", "left")
        .select(
            "role_name",
            *words,
            F.coalesce("users", F.lit(0)).alias("users"),
            F.coalesce("queries", F.lit(0)).alias("queries"),
        )
    )


def unexpected_access(gov: Governance) -> DataFrame:
    """Queries of a role on a layer it holds no privilege for.

    The log is counted per role, layer and kind of access before it meets the
    privileges, so the join sees a few hundred rows however long the log is.
    """
    needed = F.when(F.col("query_type").isin(*WRITE_QUERIES), 2).otherwise(1)
    used = (
        gov.environment_history(gov.clock.access_window_days, gov.estate.layers)
        .filter(~F.col("query_type").isin(*METADATA_TYPES))
        .groupBy("role_name", "database_name", "schema_name", needed.alias("needed"))
        .agg(
            F.count("*").alias("query_count"),
            F.count_distinct("user_name").alias("user_count"),
            F.max("start_time").alias("last_access"),
        )
    )
    key = ["role_name", "database_name", "schema_name"]
    return (
        used.join(layer_access(gov), key, "left")
        .filter(F.col("needed") > F.coalesce("access", F.lit(0)))
        .select(
            *key,
            F.when(F.col("needed") == 2, "WRITE").otherwise("READ").alias("needed_access"),
            "query_count",
            "user_count",
            "last_access",
        )
    )


def future_grant_gaps(gov: Governance) -> DataFrame:
    """Privileges on all existing objects without the same on future ones, and the objects at stake."""
    grants = gov.grants.filter(F.col("object_type").isin("TABLE", "VIEW"))
    key = ["role_name", "privilege", *OBJECT]
    existing = grants.filter(F.col("scope") == "ALL").select(*key)
    future = grants.filter(F.col("scope") == "FUTURE").select(*key)
    columns = gov.columns.groupBy(
        F.col("table_catalog").alias("database_name"), F.col("table_schema").alias("schema_name")
    ).agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("columns"))
    return (
        existing.join(future, key, "left_anti")
        .join(columns, ["database_name", "schema_name"], "left")
        .select(
            *key, F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("columns", F.lit(0)).alias("columns")
        )
    )


def user_roles(gov: Governance) -> DataFrame:
    """Role assignments as the log shows them: one row per user and role."""
    return gov.query_history.groupBy("role_name", "user_name").agg(
        F.count("*").alias("queries"), F.max("start_time").alias("last_used")
    )


def users_per_role(gov: Governance) -> DataFrame:
    """Users a role is granted to, and its use in the log. The users themselves stay rows (``user_grants``)."""
    granted = (
        gov.user_grants.distinct()
        .groupBy("role_name")
        .agg(F.count("*").alias("user_count"), F.min("user_name").alias("first_user"), F.max("user_name").alias("last_user"))
    )
    used = gov.query_history.groupBy("role_name").agg(F.count("*").alias("queries"), F.max("start_time").alias("last_used"))
    return granted.join(used, "role_name", "left").select(
        *granted.columns, F.coalesce("queries", F.lit(0)).alias("queries"), "last_used"
    )


def granted_unused(gov: Governance) -> DataFrame:
    """Roles granted to users who have run no query with them."""
    return gov.user_grants.distinct().join(user_roles(gov), ["user_name", "role_name"], "left_anti")


def used_not_granted(gov: Governance) -> DataFrame:
    """Roles users have run queries with and are not granted (any more)."""
    return user_roles(gov).join(gov.user_grants, ["user_name", "role_name"], "left_anti")
