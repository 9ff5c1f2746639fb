"""Sinks of numbered batches: nothing lost, nothing doubled, few files."""

import pytest
from pyspark.sql import functions as F

from wardline.sources.levels import LevelledSink, Manifest
from wardline.sources.storage import Folder


class Crash(Exception):
    pass


def batch(spark, n):
    return spark.createDataFrame([(n, f"row {n}.{i}") for i in range(2)], "n long, text string").coalesce(1)


def rows(sink, **how):
    return sorted(map(tuple, sink.read(**how).collect()))


def expected(spark, numbers):
    return sorted(tuple(r) for n in numbers for r in batch(spark, n).collect())


@pytest.fixture
def no_write(monkeypatch):
    """Parts without files: what the manifests say does not depend on the rows."""

    def made(self, rows, first, last, level):
        from wardline.sources.levels import Part

        return Part(f"{first}-{last}-{level}", first, last, level)

    monkeypatch.setattr(LevelledSink, "_write", made)
    monkeypatch.setattr(LevelledSink, "_rows", lambda self, parts: None)


def test_five_hundred_batches_are_few_parts(spark, tmp_path, no_write):
    sink = LevelledSink(spark, str(tmp_path), fan=8, kept=4)
    for n in range(500):
        sink.commit(None, n)
    parts = sink.manifest().parts
    assert len(parts) <= 7 * 3 and len(list((tmp_path / "manifests").glob("*.json"))) <= 4 + 8
    covered = sorted(n for p in parts for n in range(p.first, p.last + 1))
    assert covered == list(range(500))


def test_files_stay_few_and_rows_whole(spark, tmp_path):
    sink = LevelledSink(spark, str(tmp_path), fan=3, kept=2)
    for n in range(14):
        sink.commit(batch(spark, n), n)
    assert rows(sink) == expected(spark, range(14))
    assert len(sink.read().inputFiles()) <= 2 * 4
    assert len(Folder(spark, f"{tmp_path}/data").names()) <= 2 * 2 * 4  # of the kept manifests


def test_a_repeated_batch_counts_once(spark, tmp_path):
    sink = LevelledSink(spark, str(tmp_path), fan=3)
    for n in (0, 1, 1, 2, 0, 3, 2):
        sink.commit(batch(spark, n), n)
    assert rows(sink) == expected(spark, range(4))


@pytest.mark.parametrize("crash_at", ["_swap", "_write", "vacuum"])
def test_a_crash_anywhere_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, crash_at):
    """Every single call of a step fails once; the batch is then repeated, as a streaming query does."""
    sink = LevelledSink(spark, str(tmp_path), fan=2, kept=1)
    real, calls = getattr(LevelledSink, crash_at), []

    def failing(self, *args):
        calls.append(args)
        if len(calls) % 2:
            if crash_at == "_write":
                real(self, *args)  # the folder is written but never named
            raise Crash
        return real(self, *args)

    monkeypatch.setattr(LevelledSink, crash_at, failing)
    for n in range(5):
        for _ in range(20):
            try:
                sink.commit(batch(spark, n), n)
                break
            except Crash:
                seen = rows(sink) if sink.manifest().parts else []
                assert seen in (expected(spark, range(n)), expected(spark, range(n + 1)))
        else:
            raise AssertionError("the sink does not recover")
    assert rows(sink) == expected(spark, range(5))


def test_a_reader_keeps_to_its_manifest(spark, tmp_path):
    sink = LevelledSink(spark, str(tmp_path), fan=2, kept=8)
    for n in range(3):
        sink.commit(batch(spark, n), n)
    before, open_read = sink.manifest(), sink.read()
    for n in range(3, 6):
        sink.commit(batch(spark, n), n)
    assert rows(sink, pinned=before) == expected(spark, range(3))
    assert sorted(map(tuple, open_read.collect())) == expected(spark, range(3))


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    sink = LevelledSink(spark, str(tmp_path))
    sink.commit(batch(spark, 0), 0)
    with pytest.raises(Exception, match="exists"):
        sink._swap([], Manifest(0, ()))
    assert rows(sink) == expected(spark, [0])
    assert [n for n in Folder(spark, f"{tmp_path}/manifests").names() if n.startswith(".") and not n.endswith(".crc")] == []


def test_merged_rows(spark, tmp_path):
    sums = lambda df: df.groupBy("text").agg(F.sum("n").alias("n")).select("n", "text")
    sink = LevelledSink(spark, str(tmp_path), sums, fan=2)
    for n in range(9):
        sink.commit(spark.createDataFrame([(n, "a"), (1, "b")], "n long, text string"), n)
    assert rows(sink) == [(9, "b"), (36, "a")]


def test_an_unwritten_sink(spark, tmp_path):
    assert LevelledSink(spark, f"{tmp_path}/none").read("n long").collect() == []
    with pytest.raises(ValueError):
        LevelledSink(spark, str(tmp_path), fan=1)
