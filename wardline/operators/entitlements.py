"""Row access from tables: which role may see which codes, with hierarchies of codes.

A new role, code or grant is a new row; no policy is written anew. Codes form trees
(a school and its departments). A code and everything below it is an interval of
positions, so an entitlement to a whole branch is one row whatever hangs below it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.sources.storage import fresh_dir, remove_dir

NODE = ["policy_name", "code"]


def code_intervals(codes: DataFrame) -> DataFrame:
    """(policy_name, code, first, last): positions such that what is below a code lies between its two.

    A code has one parent; of several the least. The path from the root grows by one level
    a round; rounds are written, and removed once the intervals are. Codes on a cycle have no root and no interval; null codes
    are left out. Codes of one policy are numbered in one task: they are a dictionary,
    their number does not depend on the rows they stand in.
    """
    spark, rounds = codes.sparkSession, fresh_dir(codes.sparkSession, "code-levels")
    kept = fresh_dir(spark, "code-intervals")

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    tree = codes.filter("code is not null").groupBy(*NODE).agg(F.min("parent").alias("parent"))
    parents = codes.filter("parent is not null").select("policy_name", F.col("parent").alias("code"))
    roots = parents.join(tree, NODE, "left_anti").distinct().withColumn("parent", F.lit(None).cast("string"))
    tree = stored(tree.unionByName(roots), f"{rounds}/tree")
    levels = [stored(tree.filter("parent is null").select(*NODE, F.array("code").alias("path")), f"{rounds}/level0")]
    while not levels[-1].isEmpty():
        above = levels[-1].select("policy_name", F.col("code").alias("parent"), "path")
        longer = tree.join(above, ["policy_name", "parent"]).select(*NODE, F.concat("path", F.array("code")).alias("path"))
        levels.append(stored(longer, f"{rounds}/level{len(levels)}"))
    paths = spark.read.schema(levels[0].schema).parquet(*(f"{rounds}/level{n}" for n in range(len(levels))))
    below = paths.select("policy_name", F.explode("path").alias("code")).groupBy(*NODE).agg(F.count("*").alias("nodes"))
    place = F.row_number().over(Window.partitionBy("policy_name").orderBy("path"))
    intervals = (
        paths.withColumn("first", place)
        .join(below, NODE)
        .select(*NODE, "first", (F.col("first") + F.col("nodes") - 1).cast("int").alias("last"))
    )
    found = stored(intervals, kept)
    remove_dir(spark, rounds)
    return found


def allowed_codes(entitlements: DataFrame, intervals: DataFrame) -> DataFrame:
    """(policy_name, role_name, code) of every code each role may see: those granted and all below them.

    Overlapping intervals of a role are merged first, so that a code is met once; then
    positions are looked up by equality, not by comparing ranges. A granted code without an
    interval stands for itself.
    """
    granted = entitlements.filter("code is not null")
    known = granted.join(intervals, NODE).select("policy_name", "role_name", "first", "last")
    by_role = Window.partitionBy("policy_name", "role_name").orderBy("first", "last")
    reach = F.max("last").over(by_role.rowsBetween(Window.unboundedPreceding, -1))
    outer = known.withColumn("reach", reach).filter("reach is null or first > reach")  # intervals nest or are apart
    position = F.explode(F.sequence("first", "last")).alias("first")
    below = outer.select("policy_name", "role_name", position).join(intervals.select(*NODE, "first"), ["policy_name", "first"])
    return below.select("policy_name", "role_name", "code").unionByName(granted.select("policy_name", "role_name", "code")).distinct()


@dataclass(frozen=True)
class EntitlementPolicy:
    """A row policy whose roles and codes stand in tables (``schemas.ENTITLEMENTS``, ``schemas.CODES``).

    ``form`` brings a value into the form of codes.
    """

    name: str
    entitlements: DataFrame
    codes: DataFrame
    form: Callable[[Column], Column] = lambda value: value

    def _granted(self) -> DataFrame:
        return self.entitlements.filter(F.col("policy_name") == self.name)

    def _allowed(self, granted: DataFrame) -> DataFrame:
        return allowed_codes(granted, code_intervals(self.codes.filter(F.col("policy_name") == self.name)))

    def apply(self, df: DataFrame, column: str, role: str, as_of: date) -> DataFrame:
        """The rows ``role`` may see.

        The role is folded in first: one that sees everything gets the table as it is, one
        without a grant an empty one. Another's codes, each once, are a left semi join,
        from which Spark derives runtime filters on the table's scan.
        """
        granted = self._granted().filter(F.col("role_name") == role)
        said = granted.agg(F.count("*").alias("grants"), F.count_if(F.col("code").isNull()).alias("everything")).first()
        if said["everything"]:
            return df
        if not said["grants"]:
            return df.filter(F.lit(False))
        allowed = self._allowed(granted).select(F.col("code").alias("allowed_code"))
        return df.join(allowed, self.form(F.col(column)) == F.col("allowed_code"), "left_semi")

    def visible_by_role(self, df: DataFrame, key: str, column: str) -> DataFrame:
        """``(key, role)`` of every row each role may see: one join with the codes, whatever roles there are.

        Roles are gathered per code, so the table meets one row for each of its codes;
        roles that see everything are one row, the same for all of them.
        """
        granted = self._granted()
        roles = (
            self._allowed(granted)
            .join(granted.filter("code is null").select("role_name").distinct(), "role_name", "left_anti")
            .groupBy(F.col("code").alias("allowed_code"))
            .agg(F.collect_set("role_name").alias("roles"))
        )
        everything = granted.filter("code is null").groupBy("policy_name").agg(F.collect_set("role_name").alias("of_all"))
        none = F.array().cast("array<string>")
        either = F.concat(F.coalesce("of_all", none), F.coalesce("roles", none))
        return (
            df.select(F.col(key), F.lit(self.name).alias("policy_name"), self.form(F.col(column)).alias("own_code"))
            .join(roles, F.col("own_code") == F.col("allowed_code"), "left")
            .join(F.broadcast(everything), "policy_name", "left")  # one row
            .select(key, F.explode(either).alias("role"))
        )
