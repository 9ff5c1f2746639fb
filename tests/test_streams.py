"""Alert streams over several files equal the batch checks, also when restarted."""

from contextlib import nullcontext

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wardline.plans import audits
from wardline.sources import demo
from wardline.streaming import alerts

ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def log_files(spark, sf_dir, tmp_path_factory):
    """The log in four files, in order of time."""
    path = tmp_path_factory.mktemp("log")
    history = demo.governance(spark, sf_dir).query_history
    history.repartitionByRange(4, "start_time").write.mode("overwrite").parquet(str(path / "all"))
    return str(path / "all")


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_after_hours_alerts(spark, sf_dir, log_files, tmp_path):
    load = lambda: demo.governance(spark, sf_dir)
    sink, checkpoint = str(tmp_path / "alerts"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second start finds nothing new
        run(alerts.start_after_hours_alerts(load, stream(spark, log_files), sink, checkpoint, ONCE))
    parts = alerts.alert_sink(spark, sink).manifest().parts
    assert sorted(n for p in parts for n in range(p.first, p.last + 1)) == [0, 1, 2, 3]
    assert rows(alerts.read_alerts(spark, sink)) == rows(alerts.after_hours_alerts(load(), load().query_history))


def test_access_volume(spark, sf_dir, log_files, tmp_path):
    gov = demo.governance(spark, sf_dir)
    sink, checkpoint = str(tmp_path / "volume"), str(tmp_path / "checkpoint")
    run(alerts.start_access_volume(gov, stream(spark, log_files), sink, checkpoint, ONCE))
    seen = alerts.read_access_volume(spark, sink)
    batch = alerts.access_volume(gov, gov.query_history)
    assert rows(seen) == rows(batch.select(*seen.columns))


def test_policy_changes(spark, sf_dir, log_files, tmp_path):
    gov = demo.governance(spark, sf_dir)
    sink, checkpoint = str(tmp_path / "changes"), str(tmp_path / "checkpoint")
    run(alerts.start_policy_change_alerts(gov, stream(spark, log_files), sink, checkpoint, ONCE))
    detail = audits.audit_14(audits.AuditInputs(gov))
    assert rows(spark.read.parquet(sink).select(*detail.columns)) == rows(detail)


def test_late_rows_count(spark, sf_dir, tmp_path):
    """Files that arrive newest first, with default arguments; a batch that is repeated counts once."""
    gov = demo.governance(spark, sf_dir)
    days = gov.query_history.withColumn("day", F.col("start_time").cast("date"))
    folder = str(tmp_path / "log")
    sink, checkpoint = str(tmp_path / "volume"), str(tmp_path / "checkpoint")
    for part in ("day >= '2024-01-20'", "day >= '2024-01-08' AND day < '2024-01-20'", "day < '2024-01-08'"):
        days.filter(part).drop("day").coalesce(1).write.mode("append").parquet(folder)
        run(alerts.start_access_volume(gov, stream(spark, folder), sink, checkpoint, ONCE))
    batch = alerts.access_volume(gov, gov.query_history)
    seen = alerts.read_access_volume(spark, sink)
    assert rows(seen) == rows(batch.select(*seen.columns))
    levels = alerts.volume_sink(spark, sink)
    levels.commit(levels.read(), 2)
    assert rows(alerts.read_access_volume(spark, sink)) == rows(batch.select(*seen.columns))


def test_a_file_delivered_twice_counts_once(spark, sf_dir, tmp_path):
    """Also when the second delivery overlaps the first in part, and after a restart."""
    gov = demo.governance(spark, sf_dir)
    folder = str(tmp_path / "log")
    sink, checkpoint = str(tmp_path / "volume"), str(tmp_path / "checkpoint")
    for part in ("query_id % 3 = 0", "query_id % 2 = 0", "true", "query_id % 3 = 0"):
        gov.query_history.filter(part).coalesce(1).write.mode("append").parquet(folder)
        run(alerts.start_access_volume(gov, stream(spark, folder), sink, checkpoint, ONCE))
    seen = alerts.read_access_volume(spark, sink)
    assert rows(seen) == rows(alerts.access_volume(gov, gov.query_history).select(*seen.columns))


def test_rows_without_a_query_id(spark, sf_dir, tmp_path):
    """They are not taken for one another, but a repetition in all counted columns is dropped."""
    gov = demo.governance(spark, sf_dir)
    log = gov.query_history.withColumn("query_id", F.lit(None).cast("bigint"))
    distinct = log.dropDuplicates(["start_time", "user_name", "role_name", "rows_produced"])
    folder = str(tmp_path / "log")
    for _ in range(2):
        distinct.coalesce(1).write.mode("append").parquet(folder)
    sink = str(tmp_path / "volume")
    run(alerts.start_access_volume(gov, stream(spark, folder), sink, str(tmp_path / "checkpoint"), ONCE))
    seen = alerts.read_access_volume(spark, sink)
    assert rows(seen) == rows(alerts.access_volume(gov, distinct).select(*seen.columns))


class Fails(Exception):
    pass


def test_a_batch_that_fails_is_taken_up_again(spark, sf_dir, log_files, tmp_path, monkeypatch):
    """The sink fails before and after it has written; the restarted query repeats that batch."""
    gov = demo.governance(spark, sf_dir)
    sink, checkpoint = str(tmp_path / "volume"), str(tmp_path / "checkpoint")
    real = alerts.LevelledSink.commit
    failing = {1: "before", 2: "after"}

    def commit(self, df, batch_id):
        how = failing.pop(batch_id, None)
        if how != "before":
            real(self, df, batch_id)
        if how:
            raise Fails

    monkeypatch.setattr(alerts.LevelledSink, "commit", commit)
    for fails in (True, True, False):
        query = alerts.start_access_volume(gov, stream(spark, log_files), sink, checkpoint, ONCE)
        with pytest.raises(StreamingQueryException) if fails else nullcontext():
            query.awaitTermination()
    assert failing == {}
    seen = alerts.read_access_volume(spark, sink)
    assert rows(seen) == rows(alerts.access_volume(gov, gov.query_history).select(*seen.columns))


def test_state_holds_what_came_of_late(spark, sf_dir, tmp_path):
    """Ten days of arrival, two days remembered: ids and sums of the other days leave the state, not the sink."""
    gov = demo.governance(spark, sf_dir)
    arrival = F.timestamp_add("DAY", F.pmod(F.hash("query_id"), F.lit(10)), F.lit("2030-01-01 12:00:00").cast("timestamp"))
    log = gov.query_history.withColumn("came", arrival)
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("log", "volume", "checkpoint"))
    counted, states = [], []
    for day in range(10):
        log.filter(F.col("came") == F.timestamp_add("DAY", F.lit(day), F.lit("2030-01-01 12:00:00").cast("timestamp"))).coalesce(
            1
        ).write.mode("append").parquet(folder)
        query = alerts.start_access_volume(
            gov, stream(spark, folder), sink, checkpoint, ONCE, remember="2 days", arrived=F.col("came")
        )
        run(query)
        operators = {o["operatorName"]: o["numRowsTotal"] for o in query.lastProgress["stateOperators"]}
        states.append(operators)
        counted.append(log.filter(F.col("came") <= F.timestamp_add("DAY", F.lit(day), F.lit("2030-01-01 12:00:00").cast("timestamp"))).count())
    assert max(s["dedupeWithinWatermark"] for s in states) <= 0.5 * counted[-1]
    assert states[-1]["dedupeWithinWatermark"] < counted[-1] / 2 and states[-1]["stateStoreSave"] <= 2 * max(s["stateStoreSave"] for s in states[:4])
    seen = alerts.read_access_volume(spark, sink)
    assert rows(seen) == rows(alerts.access_volume(gov, gov.query_history).select(*seen.columns))


def test_state_is_kept_as_changes_in_rocksdb(spark, sf_dir, log_files, tmp_path):
    gov = demo.governance(spark, sf_dir)
    checkpoint = tmp_path / "checkpoint"
    run(alerts.start_access_volume(gov, stream(spark, log_files), str(tmp_path / "volume"), str(checkpoint), ONCE))
    assert list(checkpoint.glob("state/*/*/*.changelog"))
    assert spark.conf.get(next(iter(alerts.STATE_STORE)), "").endswith("RocksDBStateStoreProvider") is False
