"""Behaviour that matters on long tables: no broadcast needed, hot keys, bounded broadcasts."""

import re
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, differences
from wardline.config import Clock
from wardline.operators import views
from wardline.plans import audits
from wardline.sources import demo
from wardline.sources.query_log import read_query_history, write_query_history

# Queries with a join that is a broadcast join on small data.
JOINING = [
    "effective_tags",
    "tag_driven_masking",
    "v_potential_sensitive_columns",
    "v_governance_coverage_report",
    "unexpected_access",
    "retention_due",
    "audit_06",
    "audit_06_by_object",
    "audit_07",
    "audit_07_by_object",
    "audit_07_summary",
    "audit_08",
    "audit_11",
    "audit_12",
    "new_ungoverned_columns",
    "stored_new_ungoverned_columns",
    "column_changes",
]


@pytest.fixture
def shuffle_joins(spark):
    """As beyond every broadcast bound: joins must shuffle."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("key", JOINING)
def test_results_do_not_depend_on_broadcasts(spark, sf_dir, shuffle_joins, key):
    result = entry.queries()[key](spark, sf_dir)
    assert "BroadcastHashJoin" not in result._jdf.queryExecution().executedPlan().toString()
    assert differences(result.toArrow(), connect(sf_dir).execute(entry.oracle_sql()[key]).to_arrow_table()) == []


@pytest.mark.parametrize("key", ["effective_tags", "audit_07", "audit_07_by_object", "v_governance_coverage_report"])
def test_no_job_before_an_action(spark, sf_dir, key):
    demo.governance(spark, sf_dir).query_history.schema, demo.governance(spark, sf_dir).columns.schema  # tables opened
    started = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = started()
    entry.queries()[key](spark, sf_dir)
    opened = 4  # reading a table's schema is a job of its own
    assert started() - before <= opened


def test_the_estate_grows_with_the_tables(spark):
    """Ten times the parts: about ten times the tables, row policies and table tags."""
    small, large = (demo.governance(spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    counts = lambda gov: (
        gov.tables.count(),
        gov.row_access_attachments().count(),
        gov.live_tags().filter("column_name IS NULL").count(),
    )
    for few, many in zip(counts(small), counts(large)):
        assert 6 * few <= many <= 14 * few
    parts = large.columns.count()
    assert large.columns.filter("table_name = 'T2'").count() >= parts / 8


@pytest.fixture
def hot_log(spark, sf_dir):
    """A log in which one service account runs far more than a third of all queries."""
    gov = demo.governance(spark, sf_dir)
    start = datetime(2024, 2, 1)
    hot = spark.range(60_000).select(
        (F.col("id") + 10_000_000).alias("query_id"),
        F.lit("SERVICE").alias("user_name"),
        F.lit("DBT_CLOUD_PROD_ROLE").alias("role_name"),
        F.lit("ORG_PROD").alias("database_name"),
        F.lit("DISTRIBUTE").alias("schema_name"),
        F.lit("SELECT").alias("query_type"),
        (F.lit(start) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("start_time"),
        F.lit(10).cast("bigint").alias("total_elapsed_time"),
        F.lit(1).cast("bigint").alias("rows_produced"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit("select 1").alias("query_text"),
        F.lit('[{"objectName":"T2"},{"objectName":"T2"}]').alias("objects_accessed"),
    )
    return gov.with_(query_history=gov.query_history.unionByName(hot))


def _shuffled_rows(df):
    """Rows written by the first shuffle of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    node = df._jdf.queryExecution().executedPlan()
    most = 0
    stack = [node]
    while stack:
        n = stack.pop()
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(n.executedPlan())
            continue
        if name in ("ShuffleQueryStage", "BroadcastQueryStage"):
            stack.append(n.plan())
            continue
        if name == "Exchange":
            most = max(most, n.metrics().apply("shuffleRecordsWritten").value())
        children = n.children()
        stack += [children.apply(i) for i in range(children.size())]
    return most


def test_a_hot_account_is_counted_before_the_shuffle(spark, hot_log):
    result = views.recent_access_patterns(hot_log)
    hot = result.filter("user_name = 'SERVICE'").collect()
    assert [(r.query_count, r.days_active, r.total_rows_returned) for r in hot] == [(60_000, 1, 60_000)]
    # The account's 60,000 queries must not travel: only per-day sums do.
    assert _shuffled_rows(views.recent_access_patterns(hot_log)) < 20_000


def test_facts_of_a_hot_account_are_a_few_rows(hot_log):
    inputs = audits.AuditInputs(hot_log)
    assert inputs.facts.filter("user_name = 'SERVICE'").count() == 1
    assert _shuffled_rows(audits.AuditInputs(hot_log).facts) < 20_000
    direct = views.recent_access_patterns(hot_log)
    assert sorted(map(tuple, inputs.access.collect())) == sorted(map(tuple, direct.select(*inputs.access.columns).collect()))


def test_an_object_named_twice_counts_once_per_query(hot_log):
    row = audits.audit_06_by_object(audits.AuditInputs(hot_log)).filter(
        "role_name = 'DBT_CLOUD_PROD_ROLE' AND table_name = 'T2'"
    )
    before = 60_000
    assert [r.query_count >= before and r.query_count < 2 * before for r in row.collect()] == [True]
    view = views.table_access_frequency(hot_log).filter(
        "role_name = 'DBT_CLOUD_PROD_ROLE' AND table_name = 'T2' AND schema_name = 'DISTRIBUTE' AND database_name = 'ORG_PROD'"
    )
    assert view.first().access_count >= 2 * before


def test_history_window_is_pushed_to_the_log(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    demo.governance(spark, sf_dir).query_history.write.parquet(path)
    gov = demo.governance(spark, sf_dir).with_(query_history=spark.read.parquet(path))
    text = views.recent_access_patterns(gov)._jdf.queryExecution().executedPlan().toString()
    pushed = text[text.index("PushedFilters") : text.index("ReadSchema")]
    assert "start_time" in text[text.index("DataFilters") : text.index("Format")]
    assert "In(database_name" in pushed and "IsNotNull(start_time)" in pushed
    assert "query_text" not in text[text.index("ReadSchema") :]


def test_window_bounds(spark, sf_dir):
    gov = demo.governance(spark, sf_dir)
    backdated = gov.with_(clock=Clock(datetime(2024, 1, 10)))
    assert views.recent_access_patterns(backdated).agg(F.max("last_access")).first()[0] <= datetime(2024, 1, 10)
    earliest = views.recent_access_patterns(gov).agg(F.min("first_access")).first()[0]
    assert earliest >= demo.AS_OF - timedelta(days=30)
    none = gov.with_(clock=Clock(datetime(2030, 1, 1)))
    assert views.recent_access_patterns(none).count() == 0


def test_stored_log_is_pruned_by_day(spark, sf_dir, tmp_path):
    gov = demo.governance(spark, sf_dir)
    path = str(tmp_path / "log")
    write_query_history(gov.query_history, path)
    stored = gov.with_(query_history=read_query_history(spark, path))
    recent = views.recent_access_patterns(stored)
    text = recent._jdf.queryExecution().executedPlan().toString()
    partitions = text[text.index("PartitionFilters") : text.index("PushedFilters")]
    assert "log_date" in partitions and "2024-01-11" in partitions
    assert sorted(map(tuple, recent.collect())) == sorted(map(tuple, views.recent_access_patterns(gov).collect()))


def test_days_of_a_long_window_are_counted_the_same(spark, sf_dir):
    gov = demo.governance(spark, sf_dir)
    at = datetime(2024, 1, 31)
    short = gov.with_(clock=Clock(at, access_window_days=40))
    long = gov.with_(clock=Clock(at, access_window_days=400))
    rows = lambda g: sorted(map(tuple, views.recent_access_patterns(g).collect()))
    assert rows(short) == rows(long)
    assert rows(long) == sorted(map(tuple, audits.AuditInputs(long).access.collect()))


@pytest.mark.parametrize("key", ["audit_05", "audit_07", "audit_07_summary", "audit_14", "report_period", "audit_trend", "stream_access_volume"])
def test_results_do_not_depend_on_the_session_time_zone(spark, sf_dir, key):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        result = entry.queries()[key](spark, sf_dir).toArrow()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert differences(result, connect(sf_dir).execute(entry.oracle_sql()[key]).to_arrow_table()) == []


def leaves(df):
    return len(re.findall(r"(?:FileScan|Scan ExistingRDD|LocalTableScan|InMemoryTableScan|Range) ", df._jdf.queryExecution().sparkPlan().toString()))


@pytest.mark.parametrize("shape", ["nulls", "empty"])
def test_view_counts_are_those_of_the_views(spark, sf_dir, shape):
    gov = demo.governance(spark, sf_dir)

    def changed(df, *blanked):
        if shape == "empty":
            return df.limit(0)
        nulls = [df.withColumn(c, F.lit(None).cast(df.schema[c].dataType)) for c in blanked]
        return reduce(DataFrame.unionByName, nulls, df.unionByName(df))

    gov = gov.with_(
        policy_references=changed(gov.policy_references, "ref_schema_name", "policy_name", "policy_kind", "ref_column_name"),
        tag_references=changed(gov.tag_references, "object_schema", "tag_name", "column_name", "tag_value", "object_name"),
    )
    got = {r.view_name: r.row_count for r in views.view_row_counts(gov).collect()}
    assert got == {name: view(gov).count() for name, view in views.VIEWS.items()}


def test_shared_counts_read_their_table_once(spark, sf_dir):
    gov = demo.governance(spark, sf_dir)
    assert leaves(views._attachment_counts(gov)) == leaves(gov.policy_references)
    assert leaves(views._tag_counts(gov)) == leaves(gov.tag_references)
