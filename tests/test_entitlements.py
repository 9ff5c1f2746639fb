"""Row access whose roles and codes stand in tables."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from wardline.functions import roles as R
from wardline.functions import rowaccess as A
from wardline.operators.entitlements import EntitlementPolicy, allowed_codes, code_intervals
from wardline.operators.secure import apply_row_policies
from wardline.sources import demo, registry, schemas

DAY = date(2000, 6, 30)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def plain_below(codes, code):
    found, todo = set(), [code]
    while todo:
        now = todo.pop()
        if now not in found:
            found.add(now)
            todo += [c for c, parent in codes if parent == now]
    return found


def test_intervals_hold_what_is_below(spark):
    rng = random.Random(4)
    tree = [(f"c{i}", f"c{rng.randrange(i)}") for i in range(1, 120)] + [("x", "r2"), ("y", "x"), ("loop1", "loop2"), ("loop2", "loop1")]
    codes = frame(spark, [("P", c, p) for c, p in tree] + [("Q", "c1", "z"), ("P", None, "c1")], schemas.CODES)
    found = {(r.policy_name, r.code): (r["first"], r["last"]) for r in code_intervals(codes).collect()}
    nodes = {c for c, _ in tree} | {"c0", "r2"}
    assert {c for p, c in found if p == "P"} == nodes - {"loop1", "loop2"} and ("Q", "z") in found
    for code in ("c0", "c1", "c7", "x", "r2", "c119"):
        first, last = found["P", code]
        assert {c for (p, c), (at, _) in found.items() if p == "P" and first <= at <= last} == plain_below(tree, code)


def test_nested_and_unknown_grants(spark):
    codes = frame(spark, [("P", "b", "a"), ("P", "c", "b"), ("P", "d", "a"), ("P", "e", "r")], schemas.CODES)
    grants = [("P", "R1", "a"), ("P", "R1", "c"), ("P", "R1", "c"), ("P", "R2", "b"), ("P", "R2", "e"), ("P", "R3", "free"), ("P", "R4", None)]
    allowed = allowed_codes(frame(spark, grants, schemas.ENTITLEMENTS), code_intervals(codes)).collect()
    assert sorted((r.role_name, r.code) for r in allowed) == sorted(
        [("R1", c) for c in "abcd"] + [("R2", c) for c in "bce"] + [("R3", "free")]
    )


@pytest.fixture
def person(spark, sf_dir):
    return demo.person(spark, sf_dir)


def policies(spark):
    tables = registry.standard_entitlements(spark), registry.standard_codes(spark)
    return {
        A.DEPARTMENT_ACCESS: ("department_code", EntitlementPolicy(A.DEPARTMENT_ACCESS, *tables), A.department_access(A.EXAMPLE_DEPARTMENTS)),
        A.PROGRAM_TYPE_ACCESS: ("program_type", EntitlementPolicy(A.PROGRAM_TYPE_ACCESS, *tables, F.upper), A.program_type_access(A.EXAMPLE_PROGRAMS)),
    }


@pytest.mark.parametrize("name", [A.DEPARTMENT_ACCESS, A.PROGRAM_TYPE_ACCESS])
def test_a_governed_read_equals_the_written_policy(spark, person, name):
    column, entitled, written_policy = policies(spark)[name]
    for role in (R.BUSINESS_SCHOOL_ANALYST, R.UNDERGRAD_ANALYST, R.GRADUATE_ANALYST, R.DATA_ANALYST, R.UNLISTED_ROLE):
        read = [
            sorted(r.person_id for r in apply_row_policies(person, [(name, (column,))], role, DAY, {name: p}).select("person_id").collect())
            for p in (entitled, written_policy)
        ]
        assert read[0] == read[1]


def test_roles_are_folded_first(spark, person):
    column, policy, _ = policies(spark)[A.DEPARTMENT_ACCESS]
    plan = lambda role: policy.apply(person, column, role, DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(R.DATA_ANALYST) and "Filter" not in plan(R.DATA_ANALYST)
    assert "LeftSemi" in plan(R.BUSINESS_SCHOOL_ANALYST)
    assert "LocalRelation <empty>" in plan(R.UNLISTED_ROLE)


def test_a_new_role_is_a_new_row(spark, person):
    tables = registry.standard_entitlements(spark), registry.standard_codes(spark)
    more = tables[0].unionByName(frame(spark, [(A.DEPARTMENT_ACCESS, "MATHS_ROLE", "MATH"), (A.DEPARTMENT_ACCESS, "DEAN_ROLE", None)], schemas.ENTITLEMENTS))
    seen = EntitlementPolicy(A.DEPARTMENT_ACCESS, more, tables[1]).visible_by_role(person, "person_id", "department_code")
    count = {r.role: r["count"] for r in seen.groupBy("role").count().collect()}
    assert count["MATHS_ROLE"] == person.filter("department_code = 'MATH'").count() and count["DEAN_ROLE"] == person.count()


def test_ten_thousand_entitlements(spark):
    """A tree of 11,111 codes, 10,000 grants to 500 roles, and a table in which one code has a third of the rows."""
    codes = spark.range(1, 11111).select(
        F.lit("P").alias("policy_name"), F.concat(F.lit("n"), "id").alias("code"), F.concat(F.lit("n"), F.floor((F.col("id") - 1) / 10)).alias("parent")
    )
    grants = spark.range(10000).select(
        F.lit("P").alias("policy_name"),
        F.concat(F.lit("role"), F.col("id") % 500).alias("role_name"),
        F.concat(F.lit("n"), F.pmod(F.hash("id"), F.lit(11000)) + 11).alias("code"),
    )
    code = F.when(F.col("id") % 3 == 0, F.lit("n5000")).otherwise(F.concat(F.lit("n"), F.pmod(F.hash("id"), F.lit(11111))))
    table = spark.range(3000).select("id", code.alias("own"))
    policy = EntitlementPolicy("P", grants, codes)
    seen = {(r.id, r.role) for r in policy.visible_by_role(table, "id", "own").collect()}
    by_role = {}
    for r in grants.collect():
        by_role.setdefault(r.role_name, set()).add(int(r.code[1:]))
    want = set()
    for r in table.collect():
        n, above = int(r.own[1:]), set()
        while True:
            above.add(n)
            if n == 0:
                break
            n = (n - 1) // 10
        want |= {(r.id, role) for role, held in by_role.items() if held & above}
    assert seen == want and len(want) > 5000
    one = policy.apply(table, "own", "role7", DAY)
    assert {r.id for r in one.collect()} == {i for i, role in want if role == "role7"}


def test_missing_values_and_empty_tables(spark):
    codes, none = frame(spark, [], schemas.CODES), frame(spark, [], schemas.ENTITLEMENTS)
    table = frame(spark, [(1, None), (2, "a")], "id int, own string")
    grants = frame(spark, [("P", "ALL", None), ("P", "A", "a"), ("P", "A", None), ("P", "B", "a")], schemas.ENTITLEMENTS)
    policy = EntitlementPolicy("P", grants, codes)
    seen = sorted(map(tuple, policy.visible_by_role(table, "id", "own").collect()))
    assert seen == [(1, "A"), (1, "ALL"), (2, "A"), (2, "ALL"), (2, "B")]
    assert EntitlementPolicy("P", none, codes).visible_by_role(table, "id", "own").count() == 0
    assert EntitlementPolicy("P", none, codes).apply(table, "own", "B", DAY).count() == 0
