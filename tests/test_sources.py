"""Registry, catalogue, sinks and the session-variable view."""

import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline.config import TableId
from wardline.functions import roles as R
from wardline.operators import privileges, secure, session_views, tags, views
from wardline.plans import audits, report
from wardline.sources import catalog, demo, registry, storage
from wardline.sources.estate_tables import read_governance
from wardline.sources.query_log import read_query_history, write_query_history


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_standard_attachments(spark):
    masks = registry.mask_attachments(spark, registry.STANDARD_MASKS, ["DEV", "TEST", "PROD"])
    assert masks.count() == 21
    policies = registry.row_policy_attachments(spark, registry.STANDARD_ROW_POLICIES, ["DEV", "TEST", "PROD"])
    assert policies.count() == 18
    gov_like = registry.attach(masks, policies)
    student = TableId("ORG_PROD", "DISTRIBUTE", "DIM_STUDENT")
    assert registry.detach_row_policy(gov_like, student, "ACTIVE_RECORDS_ONLY").count() == 38
    assert registry.detach_row_policy(gov_like, student).count() == 36
    assert registry.detach_mask(gov_like, student, "SSN").count() == 38
    assert registry.detach_mask(gov_like, student).count() == 34
    swapped = registry.replace_policy(gov_like, "ADDRESS_MASK", "ADDRESS_MASK_STRICT")
    assert swapped.filter("policy_name = 'ADDRESS_MASK_STRICT'").count() == 3
    wanted = registry.literal_table(spark, [("ADDRESS_MASK",), ("SSN_MASK",)], "policy_name string")
    assert rows(registry.droppable_policies(swapped, wanted)) == [("ADDRESS_MASK",)]


def test_taxonomy_sizes():
    assert {t: len(v) for t, v in registry.TAG_VALUES.items()} == {
        "SENSITIVITY_LEVEL": 4,
        "COMPLIANCE_TYPE": 5,
        "CONTAINS_PII": 2,
        "DATA_DOMAIN": 8,
        "DATA_OWNER": 9,
        "RETENTION_PERIOD": 6,
        "DATA_QUALITY_TIER": 4,
    }


def test_role_closure(spark, sf_dir):
    held = {}
    for role, inherited in privileges.role_closure(demo.governance(spark, sf_dir)).collect():
        held.setdefault(role, set()).add(inherited)
    assert held[R.DATA_ADMIN] == {R.DATA_ADMIN, R.DATA_ENGINEER, R.GOVERNANCE_ADMIN, *R.ANALYSTS}
    assert held[R.SYSADMIN] == held[R.DATA_ADMIN] | {R.SYSADMIN}
    assert held[R.DATA_ENGINEER] == {R.DATA_ENGINEER, R.DATA_ANALYST}
    assert held[R.IR_ANALYST] == {R.IR_ANALYST}


def closure_of(spark, pairs):
    return set(map(tuple, privileges.closure(spark.createDataFrame(pairs, "role_name string, inherited_role string")).collect()))


def test_closure_of_a_long_chain(spark):
    found = closure_of(spark, [(f"r{i}", f"r{i + 1}") for i in range(300)])
    assert found == {(f"r{i}", f"r{j}") for i in range(300) for j in range(i + 1, 301)}


def checkpoints(spark):
    root = spark.sparkContext.getCheckpointDir()
    if root is None:
        return set()
    path = Path(root.removeprefix("file:"))
    return {found.name for found in path.iterdir() if found.name.startswith("rdd-")}


def test_closure_leaves_its_last_round_only(spark):
    pairs = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(20)], "role_name string, inherited_role string")
    before = checkpoints(spark)
    held = privileges.closure(pairs)
    assert len(checkpoints(spark) - before) == 1 and held.count() == 20 * 21 // 2


def test_matrix_takes_one_closure(spark, sf_dir, monkeypatch):
    taken = []
    inner = privileges.closure
    monkeypatch.setattr(privileges, "closure", lambda pairs: taken.append(1) or inner(pairs))
    assert privileges.role_access_matrix(demo.governance(spark, sf_dir)).count() > 0 and taken == [1]


def test_closure_of_diamonds(spark):
    """Two to the twentieth paths, few pairs."""
    edges = [(f"t{i}", f"{side}{i}") for i in range(20) for side in "ab"] + [(f"{side}{i}", f"t{i + 1}") for i in range(20) for side in "ab"]
    found = closure_of(spark, edges)
    want = {("t0", x) for i in range(20) for x in (f"a{i}", f"b{i}", f"t{i + 1}")}
    assert {p for p in found if p[0] == "t0"} == want and ("t20", "t0") not in found


def test_closure_of_a_cycle(spark):
    assert closure_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == {(x, y) for x in "abc" for y in "abcd"}


def test_closure_joins_a_pair_of_a_tree_once(spark, monkeypatch):
    pairs = spark.createDataFrame([(f"r{i // 2}", f"r{i}") for i in range(2, 256)], "role_name string, inherited_role string")
    joined, join = [], type(pairs).join

    def counted(*args):
        joined.append((found := join(*args)).count())
        return found

    monkeypatch.setattr(type(pairs), "join", counted)
    held = privileges.closure(pairs)
    monkeypatch.undo()
    assert held.count() == sum(i.bit_length() - 1 for i in range(2, 256)) and sum(joined) == held.count() - 254


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_any_graph(spark, seed):
    """Chords, cycles, loops and parts that do not meet."""
    draw = random.Random(seed)
    edges = {(f"r{i}", f"r{i + 1}") for i in range(0, 40) if i != 25} | {("r9", "r9"), ("r30", "r26")}
    edges |= {(f"r{draw.randrange(25)}", f"r{draw.randrange(25)}") for _ in range(2 + 4 * seed)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert closure_of(spark, sorted(edges)) == want


def test_access_matrix(spark, sf_dir):
    matrix = {r.role_name: r for r in privileges.role_access_matrix(demo.governance(spark, sf_dir)).collect()}
    assert matrix[R.DATA_ENGINEER].prod_deposit == "WRITE"
    assert matrix[R.DBT_CLOUD_DEV].dev_deterge == "WRITE"
    assert matrix[R.DBT_CLOUD_DEV].dev_deposit == "READ" and matrix[R.DBT_CLOUD_DEV].prod_deposit == "NONE"
    assert matrix[R.IR_ANALYST].test_deterge == "READ" and matrix[R.IR_ANALYST].prod_deposit == "NONE"
    assert matrix[R.REGISTRAR_ANALYST].prod_distribute == "READ" and matrix[R.REGISTRAR_ANALYST].dev_distribute == "NONE"


def test_tag_chosen_masks_become_effective(spark, sf_dir):
    gov = demo.governance(spark, sf_dir)
    before = views.masking_policy_references(gov).count()
    chosen = tags.tag_policy_references(gov)
    after = gov.with_(policy_references=registry.attach(gov.policy_references, chosen))
    assert views.masking_policy_references(after).count() == before + chosen.count()
    assert tags.tag_policy_references(after).count() == 0


def test_catalogue_of_a_session(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS distribute")
    try:
        spark.range(1).select(F.lit("x").alias("ssn"), F.col("id").alias("amount")).write.mode("overwrite").saveAsTable(
            "distribute.dim_student"
        )
        spark.sql("CREATE OR REPLACE VIEW distribute.v_student AS SELECT amount FROM distribute.dim_student")
        columns = catalog.catalog_columns(spark, "ORG_PROD", ["distribute"])
        assert ("ORG_PROD", "DISTRIBUTE", "DIM_STUDENT", "SSN", "STRING") in rows(columns)
        tables = catalog.catalog_tables(spark, "ORG_PROD", ["distribute"])
        assert rows(tables) == [
            ("ORG_PROD", "DISTRIBUTE", "DIM_STUDENT", "BASE TABLE"),
            ("ORG_PROD", "DISTRIBUTE", "V_STUDENT", "VIEW"),
        ]
    finally:
        spark.sql("DROP DATABASE distribute CASCADE")


def test_a_tag_outside_the_taxonomy_is_effective(spark, sf_dir):
    gov = demo.governance(spark, sf_dir)
    column = gov.columns.filter("table_name = 'T1'").orderBy("column_name").first()
    one = gov.tag_references.filter("object_deleted IS NULL").limit(1)
    name = lambda c, v: one.withColumns({k: F.lit(x).cast("string") for k, x in {
        "tag_name": "OWN_TAG", "tag_value": v, "object_database": column.table_catalog, "object_schema": column.table_schema,
        "object_name": "T1", "column_name": c}.items()})
    tagged = gov.tag_references.unionByName(name(column.column_name, "mine")).unionByName(name(None, "theirs"))
    found = tags.effective_tags(gov.with_(tag_references=tagged)).filter("tag_name = 'OWN_TAG'").collect()
    levels = {r.column_name: (r.tag_value, r.tag_level) for r in found}
    assert levels.pop(column.column_name) == ("mine", "COLUMN")
    assert levels and set(levels.values()) == {("theirs", "TABLE")}


@pytest.mark.parametrize("change", [{"policy_schema": "SANDBOX"}, {"policy_db": "OTHER_DB"}, {"policy_status": "INACTIVE"}])
def test_foreign_and_inactive_policies_refuse_the_read(spark, sf_dir, change):
    table = TableId("ORG_PROD", *demo.PERSON_TABLE)
    attached = demo.person_attachments(spark).withColumns({k: F.lit(v) for k, v in change.items()})
    with pytest.raises(secure.UnknownPolicy):
        secure.secured(demo.person(spark, sf_dir), table, R.IR_ANALYST, demo.AS_OF_DATE, attached)


def test_a_governed_view_looks_its_policies_up_once(spark, sf_dir, monkeypatch):
    calls = []
    real = session_views.table_attachments
    monkeypatch.setattr(session_views, "table_attachments", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(secure, "table_attachments", lambda *a: calls.append(1) or real(*a))
    session_views.declare_role(spark, "it's")
    table = TableId("ORG_PROD", *demo.PERSON_TABLE)
    session_views.create_governed_view(demo.person(spark, sf_dir), "one_lookup", table, demo.AS_OF_DATE, demo.person_attachments(spark))
    assert len(calls) == 1 and spark.sql("SELECT cur_role").first()[0] == "it's"


def test_a_log_loaded_twice_counts_once(spark, sf_dir, tmp_path):
    log = demo.governance(spark, sf_dir).query_history
    for _ in range(2):
        write_query_history(log, str(tmp_path))
    assert read_query_history(spark, str(tmp_path)).count() == log.count()


def test_grants_and_use(spark, sf_dir):
    gov = demo.governance(spark, sf_dir).with_(
        user_grants=spark.createDataFrame([("A", "R1"), ("A", "R1"), ("B", "R1"), ("B", "R2")], "user_name string, role_name string"),
        query_history=demo.governance(spark, sf_dir).query_history.limit(2).withColumns({"user_name": F.lit("B"), "role_name": F.lit("R3")}),
    )
    assert rows(privileges.users_per_role(gov)) == [("R1", 2, "A", "B", 0, None), ("R2", 1, "B", "B", 0, None)]
    assert rows(privileges.granted_unused(gov)) == [("A", "R1"), ("B", "R1"), ("B", "R2")]
    assert [r[:2] for r in rows(privileges.used_not_granted(gov))] == [("B", "R3")]


def test_governance_read_from_parquet(spark, sf_dir, tmp_path):
    gov = demo.governance(spark, sf_dir)
    for name in ("policy_references", "tag_references", "columns", "tables"):
        getattr(gov, name).write.parquet(str(tmp_path / name))
    write_query_history(gov.query_history, str(tmp_path / "query_history"))
    stored = read_governance(spark, str(tmp_path), gov.clock)
    assert rows(views.governance_coverage_report(stored)) == rows(views.governance_coverage_report(gov))
    assert rows(views.recent_access_patterns(stored)) == rows(views.recent_access_patterns(gov))
    assert rows(views.table_access_frequency(stored)) == rows(views.table_access_frequency(gov))


def test_persisted_run_equals_single_audits(spark, sf_dir):
    gov = demo.governance(spark, sf_dir)
    alone = {key: rows(df) for key, df in audits.run_audits(audits.AuditInputs(gov)) if "summary" in key}
    with audits.AuditInputs.persisted(gov) as inputs:
        assert inputs.coverage.is_cached
        together = {key: rows(df) for key, df in audits.run_audits(inputs) if "summary" in key}
    assert not inputs.coverage.is_cached
    assert alone == together


def test_all_counts_in_one_job(spark, sf_dir):
    inputs = audits.AuditInputs(demo.governance(spark, sf_dir))
    counts = {r.audit_name: r.issue_count for r in report.audit_counts(inputs).collect()}
    assert counts == {key: summary(inputs).first()[1] for key, summary in audits.SUMMARIES.items()}


def test_csv_export_reads_back(spark, sf_dir, tmp_path):
    inputs = audits.AuditInputs(demo.governance(spark, sf_dir))
    paths = report.export_reports(inputs, str(tmp_path))
    assert all("run_date=2024-02-10" in p for p in paths.values())
    back = spark.read.option("header", True).csv(paths["governance_coverage_report"])
    assert rows(back) == rows(inputs.coverage.select(*(F.col(c).cast("string") for c in inputs.coverage.columns)))


def test_exported_cells_keep_line_feeds_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b"\nc, d', 1), ("plain", 2)], "text string, n long")
    path = storage.export_csv(df, str(tmp_path), "cells", date(2024, 2, 1))
    assert rows(storage.read_csv(spark, path, df.schema)) == rows(df)


def test_audit_log_keeps_days_and_replaces_a_repeated_run(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    log = lambda name, n, day: storage.append_audit_log(
        spark.createDataFrame([(name, n)], "audit_name string, issue_count bigint"), path, day
    )
    log("audit_01", 5, date(2024, 2, 1))
    log("audit_02", 7, date(2024, 2, 1))
    log("audit_01", 4, date(2024, 2, 2))
    log("audit_01", 3, date(2024, 2, 2))  # the same run again
    trend = rows(report.audit_trend(storage.read_audit_log(spark, path)))
    assert trend == [
        ("audit_01", date(2024, 2, 1), 5, None, None),
        ("audit_01", date(2024, 2, 2), 3, 5, -2),
        ("audit_02", date(2024, 2, 1), 7, None, None),
    ]


def test_shared_dir_follows_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("role", [R.DATA_ADMIN, R.REGISTRAR_ANALYST, R.DATA_ANALYST, "SOMEONE_ELSE"])
def test_session_variable_view(spark, sf_dir, role):
    table = TableId("ORG_PROD", *demo.PERSON_TABLE)
    attached = demo.person_attachments(spark)
    person = demo.person(spark, sf_dir)
    session_views.declare_role(spark)
    session_views.create_governed_view(person, "dim_person", table, demo.AS_OF_DATE, attached)
    spark.sql(f"SET VAR cur_role = '{role}'")
    seen = spark.sql("SELECT * FROM dim_person")
    assert rows(seen) == rows(secure.secured(person, table, role, demo.AS_OF_DATE, attached))
    assert seen._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
