"""Facts kept beside a stored log: same reports, less work."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardline.config import Clock
from wardline.operators import access, tags, views
from wardline.plans import audits
from wardline.sources import demo, object_facts
from wardline.sources.estate_tables import Governance
from wardline.sources.query_log import read_query_history, settle_query_history, write_query_history
from wardline.sources.storage import Folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def gov(spark, sf_dir):
    return demo.governance(spark, sf_dir)


def stored(gov, root, clock=None) -> Governance:
    facts = access.stored_facts(gov.spark, root)
    log = read_query_history(gov.spark, f"{root}/query_history")
    tables = {n: (lambda n=n: getattr(gov, n)) for n in ("policy_references", "tag_references", "columns", "tables")}
    return Governance(gov.spark, clock or gov.clock, gov.estate, facts, query_history=lambda: log, **tables)


def reports(gov):
    inputs = audits.AuditInputs(gov)
    return [
        rows(views.table_access_frequency(gov)),
        rows(audits.audit_06_by_object(inputs)),
        rows(audits.audit_07_by_object(inputs)),
        rows(tags.retention_due(gov)),
    ]


CLOCKS = [None, Clock(datetime(2024, 1, 20, 9, 30)), Clock(datetime(2024, 1, 12, 23, 59), access_window_days=3), Clock(datetime(2030, 1, 1))]


def test_reports_do_not_depend_on_the_facts(gov, tmp_path):
    """Without facts, with facts of some loads, with complete facts; windows that begin and end within a day."""
    root = str(tmp_path)
    write_query_history(gov.query_history.filter("query_id % 2 = 0"), f"{root}/query_history")
    access.stored_facts(gov.spark, root).refresh()
    write_query_history(gov.query_history.filter("query_id % 2 = 1 OR start_time < '2024-01-10'"), f"{root}/query_history")
    want = [reports(gov.with_(clock=clock)) for clock in CLOCKS]
    assert [reports(stored(gov, root, clock)) for clock in CLOCKS] == want
    assert access.stored_facts(gov.spark, root).refresh()
    assert [reports(stored(gov, root, clock)) for clock in CLOCKS] == want


def test_only_changed_days_are_renewed(spark, gov, tmp_path):
    root = str(tmp_path)
    facts = access.stored_facts(spark, root)
    write_query_history(gov.query_history, f"{root}/query_history")
    days = facts.refresh()
    assert len(days) > 20 and facts.refresh() == []
    write_query_history(gov.query_history.filter("start_time between '2024-01-05' and '2024-01-06 12:00:00'"), f"{root}/query_history")
    assert facts.refresh() == [date(2024, 1, 5), date(2024, 1, 6)]
    settle_query_history(spark, f"{root}/query_history")
    assert facts.refresh() == [date(2024, 1, 5), date(2024, 1, 6)]  # a settled day has a new load
    assert len(Folder(spark, f"{root}/object_facts").folders("log_date=*/up_to_load=*")) == len(days)


def test_what_a_crash_leaves_does_not_count(spark, gov, tmp_path, monkeypatch):
    root = str(tmp_path)
    facts = access.stored_facts(spark, root)
    for part in ("query_id % 3 = 0", "query_id % 3 > 0"):
        write_query_history(gov.query_history.filter(part), f"{root}/query_history")
        monkeypatch.setattr(object_facts.Folder, "remove", lambda self, name: None)
        facts.refresh()
    monkeypatch.undo()
    assert any(len(n) > 1 for n in facts._partitions().values())
    assert reports(stored(gov, root)) == reports(gov)


def test_whole_days_do_not_open_the_log(spark, gov, tmp_path):
    """With complete facts and a window of whole days no file of the log need even be readable."""
    root = str(tmp_path)
    write_query_history(gov.query_history, f"{root}/query_history")
    access.stored_facts(spark, root).refresh()
    for name in Folder(spark, f"{root}/query_history").folders("log_date=*/load_id=*/*.parquet"):
        (tmp_path / "query_history" / name).write_bytes(b"no parquet")
    assert rows(views.table_access_frequency(stored(gov, root))) == rows(views.table_access_frequency(gov))


def test_an_object_named_twice(spark, gov):
    """Mentions count, queries count once; null names and empty lists do not."""
    text = '[{"objectName":"T1"},{"objectName":"T2"},{"objectName":"T1"},{"objectName":null}]'
    one = gov.query_history.limit(1)
    log = one.withColumn("objects_accessed", F.lit(text)).unionByName(one.withColumn("objects_accessed", F.lit("[]")))
    log = log.unionByName(one.withColumn("objects_accessed", F.lit(None).cast("string")))
    found = {r.table_name: (r.mentions, r.queries) for r in access.facts_of(log).collect()}
    assert found == {"T1": (2, 1), "T2": (1, 1)}


def test_objects_are_parsed_once_and_counted_without_lambdas(gov):
    plan = access.facts_of(gov.query_history)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "lambda" not in plan


def test_a_persisted_run_takes_objects_apart_once(gov):
    alone = [rows(f(audits.AuditInputs(gov))) for f in (audits.audit_06_by_object, audits.audit_07_by_object)]
    with audits.AuditInputs.persisted(gov) as inputs:
        assert [rows(f(inputs)) for f in (audits.audit_06_by_object, audits.audit_07_by_object)] == alone
        plan = audits.audit_06_by_object(inputs)._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan.split("InMemoryRelation")[0]
