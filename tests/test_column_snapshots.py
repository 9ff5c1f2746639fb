"""Snapshots of the column catalogue and what changed between them."""

import pytest

from wardline.plans import report
from wardline.sources import column_snapshots as S
from wardline.sources import demo, schemas
from wardline.sources.storage import Folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def snapshot(spark, tmp_path):
    def write(name, *columns):
        path = str(tmp_path / name)
        S.write_column_snapshot(spark.createDataFrame([tuple(c.split()) if isinstance(c, str) else c for c in columns], schemas.COLUMNS), path)
        return path

    return write


EARLIER = [
    "P A T1 SSN TEXT", "P A T1 AMOUNT NUMBER", "P A T1 OLD_NAME TEXT", "P A T1 SAME TEXT",
    "P A T2 X TEXT", "P A T2 Y TEXT", "P A GONE C TEXT", "P B T C TEXT", "Q A T C TEXT", "Q OLD T C TEXT",
]
LATER = [
    "P A T1 SSN NUMBER", "P A T1 AMOUNT NUMBER", "P A T1 NEW_NAME TEXT", "P A T1 SAME TEXT",
    "P A T2 X TEXT", "P A T2 Z TEXT", "P A T2 W TEXT", "P A T2 V DATE", "P B T C TEXT", "Q A T C TEXT", "Q NEW T C TEXT",
]
CHANGES = [
    ("P", "A", "GONE", "C", "REMOVED", "C", "TEXT", None),
    ("P", "A", "T1", "NEW_NAME", "RENAMED", "OLD_NAME", "TEXT", "TEXT"),
    ("P", "A", "T1", "SSN", "RETYPED", "SSN", "TEXT", "NUMBER"),
    ("P", "A", "T2", "V", "ADDED", None, None, "DATE"),
    ("P", "A", "T2", "W", "ADDED", None, None, "TEXT"),
    ("P", "A", "T2", "Y", "REMOVED", "Y", "TEXT", None),
    ("P", "A", "T2", "Z", "ADDED", None, None, "TEXT"),
    ("Q", "NEW", "T", "C", "ADDED", None, None, "TEXT"),
    ("Q", "OLD", "T", "C", "REMOVED", "C", "TEXT", None),
]


def test_changes_are_told_apart(spark, snapshot):
    earlier, later = snapshot("earlier", *EARLIER), snapshot("later", *LATER)
    assert rows(S.column_changes(spark, earlier, later)) == CHANGES
    assert rows(S.changed_schemas(spark, earlier, later)) == [("P", "A"), ("Q", "NEW"), ("Q", "OLD")]
    new = [("P", "A", "T1", "NEW_NAME"), ("P", "A", "T2", "V"), ("P", "A", "T2", "W"), ("P", "A", "T2", "Z"), ("Q", "NEW", "T", "C")]
    assert [r[:4] for r in rows(S.new_columns(spark, earlier, later))] == new


def test_unchanged_schemas_are_not_read(spark, snapshot):
    earlier, later = snapshot("earlier", *EARLIER), snapshot("later", *LATER)
    for path in (earlier, later):
        for level in ("columns", "tables"):
            Folder(spark, path).remove(f"{level}/table_catalog=P/table_schema=B")
            Folder(spark, path).remove(f"{level}/table_catalog=Q/table_schema=A")
    assert rows(S.column_changes(spark, earlier, later)) == CHANGES


def test_equal_snapshots(spark, snapshot):
    """In another order, with rows that repeat and rows without a name; no rows of columns are read."""
    earlier = snapshot("earlier", *EARLIER)
    later = snapshot("later", *EARLIER[::-1], EARLIER[0], ("P", None, "T", "C", "TEXT"), ("P", "A", "", "C", "TEXT"), (None,) * 5)
    for path in (earlier, later):
        Folder(spark, path).remove("columns")
        Folder(spark, path).remove("tables")
    assert S.column_changes(spark, earlier, later).count() == 0


def test_types_that_are_missing_and_empty_catalogues(spark, snapshot):
    none, empty = snapshot("none", ("P", "A", "T", "C", None), ("P", "1", "T", "C", "X")), snapshot("empty")
    typed = snapshot("typed", "P A T C TEXT", "P 1 T C X")
    assert rows(S.column_changes(spark, none, typed)) == [("P", "A", "T", "C", "RETYPED", "C", None, "TEXT")]
    assert [r[1:5] for r in rows(S.column_changes(spark, empty, none))] == [("1", "T", "C", "ADDED"), ("A", "T", "C", "ADDED")]
    assert [r[4] for r in rows(S.column_changes(spark, none, empty))] == ["REMOVED"] * 2
    assert S.column_changes(spark, empty, empty).count() == 0


def test_new_columns_as_by_comparing_catalogues(spark, sf_dir, tmp_path):
    gov, earlier = demo.governance(spark, sf_dir), demo.earlier_columns(spark, sf_dir)
    paths = [str(tmp_path / n) for n in ("earlier", "later")]
    for columns, path in zip((earlier, gov.columns), paths):
        S.write_column_snapshot(columns, path)
    assert rows(report.new_ungoverned_since(gov, *paths)) == rows(report.new_ungoverned_columns(gov, earlier))
    assert {r.change for r in S.column_changes(spark, *paths).collect()} == {"ADDED"}
