"""A log loaded in parts reads as if it had come at once."""

import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardline.config import Clock
from wardline.operators import views
from wardline.sources import demo, query_log
from wardline.sources.query_log import loads_by_day, read_query_history, settle_query_history, write_query_history
from wardline.sources.storage import Folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def log(spark, sf_dir):
    return demo.governance(spark, sf_dir).query_history


def in_three(log, path):
    """Every query in one load, most in two, some in three."""
    for part in ("query_id % 4 <> 0", "query_id % 3 <> 1", "query_id % 5 <> 2 or query_id % 12 = 4"):
        write_query_history(log.filter(part), path)


def test_overlapping_loads_equal_one(spark, log, tmp_path):
    one, three = str(tmp_path / "one"), str(tmp_path / "three")
    write_query_history(log, one)
    in_three(log, three)
    assert set(map(tuple, loads_by_day(spark, three).values())) == {(1, 2, 3)}
    want = rows(read_query_history(spark, one))
    assert len(want) == log.count() and rows(read_query_history(spark, three)) == want


def test_the_last_load_counts(spark, log, tmp_path):
    path = str(tmp_path)
    write_query_history(log, path)
    write_query_history(log.filter("query_id < 50").withColumn("error_code", F.lit("corrected")), path)
    read = read_query_history(spark, path)
    assert read.count() == log.count()
    assert read.filter("error_code = 'corrected'").count() == log.filter("query_id < 50").count()


def test_a_load_written_again_replaces_itself(spark, log, tmp_path):
    path = str(tmp_path)
    assert [write_query_history(log, path, load=n) for n in (1, 1)] == [1, 1]
    assert set(map(tuple, loads_by_day(spark, path).values())) == {(1,)}
    assert read_query_history(spark, path).count() == log.count()


def test_repeated_and_numberless_rows(spark, log, tmp_path):
    """Twice within a load is once; rows without a query id are not taken for one another."""
    path = str(tmp_path)
    some = log.filter("query_id < 20")
    nameless = some.withColumn("query_id", F.lit(None).cast("bigint"))
    write_query_history(some, path)
    write_query_history(some.unionByName(some).unionByName(nameless), path)
    read = read_query_history(spark, path)
    assert read.filter("query_id is null").count() == some.count()
    assert read.filter("query_id is not null").count() == some.count()


def scans(df):
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", df._jdf.queryExecution().executedPlan().toString(), re.S)


def test_days_outside_the_window_are_not_read(spark, sf_dir, log, tmp_path):
    """Every scan, of settled days and of open ones, of whole rows and of ids, has the window as partition filter."""
    path = str(tmp_path)
    in_three(log.filter("start_time >= '2024-01-15'"), path)
    write_query_history(log.filter("start_time < '2024-01-15'"), path)
    gov = demo.governance(spark, sf_dir).with_(
        clock=Clock(datetime(2024, 1, 20), access_window_days=10), query_history=read_query_history(spark, path)
    )
    recent = gov.history_since(10)
    found = scans(recent)
    assert len(found) >= 4 and all("2024-01-10" in f and "2024-01-20" in f for f in found)
    for day in (date(2024, 1, 5), date(2024, 1, 28)):  # their files may even be unreadable
        for name in Folder(spark, path).folders(f"log_date={day}/load_id=*/*.parquet"):
            (tmp_path / name.removeprefix(path.lstrip("/"))).write_bytes(b"no parquet")
    want = log.filter("start_time between '2024-01-10' and '2024-01-20'").count()
    assert recent.count() == want


def test_settled_days_are_single_loads(spark, sf_dir, log, tmp_path):
    path = str(tmp_path)
    in_three(log, path)
    before = rows(read_query_history(spark, path))
    assert settle_query_history(spark, path) == len(loads_by_day(spark, path))
    assert set(map(tuple, loads_by_day(spark, path).values())) == {(4,)}
    settled = read_query_history(spark, path)
    assert rows(settled) == before and len(scans(settled)) == 1
    assert settle_query_history(spark, path) == 0
    assert write_query_history(log.limit(1), path) == 5
    gov = demo.governance(spark, sf_dir)
    stored = gov.with_(query_history=settled)
    assert rows(views.table_access_frequency(stored)) == rows(views.table_access_frequency(gov))


def test_a_crash_while_settling_changes_nothing(spark, log, tmp_path, monkeypatch):
    path = str(tmp_path)
    in_three(log, path)
    before = rows(read_query_history(spark, path))

    def crash(self, name):
        if "load_id=2" in name:
            raise RuntimeError("crash")
        remove(self, name)

    remove = query_log.Folder.remove
    monkeypatch.setattr(query_log.Folder, "remove", crash)
    with pytest.raises(RuntimeError):
        settle_query_history(spark, path)
    monkeypatch.undo()
    assert rows(read_query_history(spark, path)) == before
    assert settle_query_history(spark, path) > 0
    assert rows(read_query_history(spark, path)) == before


def test_few_repetitions_are_broadcast(spark, log, tmp_path):
    """Whole rows of an open day are not shuffled to find the few that stand twice."""
    path = str(tmp_path)
    write_query_history(log, path)
    write_query_history(log.filter("query_id % 100 = 0"), path)
    read = read_query_history(spark, path)
    read.write.format("noop").mode("overwrite").save()
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "BroadcastHashJoin" in final and "LeftAnti" in final and "SortMergeJoin" not in final


def test_any_repetitions(spark, log, tmp_path):
    """Queries in one to three loads, some several times in one, against a plain search."""
    path, draw, want = str(tmp_path), random.Random(7), {}
    base = log.filter("query_id < 60")
    ids = sorted(r.query_id for r in base.select("query_id").collect())
    for load in (1, 2, 3):
        times = {i: draw.choice([0, 0, 1, 1, 1, 2, 3]) for i in ids}
        want |= {i: load for i, n in times.items() if n}
        counts = spark.createDataFrame(list(times.items()), "query_id bigint, n int")
        each = base.join(counts, "query_id").select(base["*"], F.explode(F.array_repeat(F.lit(load), F.col("n"))).alias("load"))
        write_query_history(each.withColumn("error_code", F.col("load").cast("string")).drop("load"), path)
    found = [(r.query_id, int(r.error_code)) for r in read_query_history(spark, path).collect()]
    assert sorted(found) == sorted(want.items())


def test_ids_are_shuffled_once(spark, log, tmp_path):
    """The list of repeated queries meets the rows where it was made, also without broadcasts."""
    path = str(tmp_path)
    in_three(log, path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = read_query_history(spark, path)
        assert read.count() == log.count()
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and all(keys.count("#") == 2 for keys in dealt)


def test_json_is_parsed_behind_the_shuffle(spark, log, tmp_path, monkeypatch):
    """A compressed log has few splits; the dearest step is not to run in them."""
    plans, write = [], query_log._write
    monkeypatch.setattr(query_log, "_write", lambda rows, *to: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, *to))
    write_query_history(log, str(tmp_path))
    assert plans[0].index("from_json") < plans[0].index("RebalancePartitions")
