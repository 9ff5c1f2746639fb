from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import whitening as W


@pytest.mark.parametrize("low, high", [(-100, 100), (-(2**63), 2**63 - 1), (5, 6), (-3, -2), (-1, 2**40)])
@pytest.mark.parametrize("rows", [1, 63, 64, 65, 200])
def test_block_sums_are_exact(low, high, rows):
    x = np.random.default_rng(rows).integers(low, high, (rows, 5), dtype=np.int64)
    sums, products = W.block_sums(x)
    plain = x.astype(object)
    assert (sums == plain.sum(axis=0)).all() and (products == plain.T @ plain).all()


def plain_whitening(vectors):
    """Numpy over all rows at once."""
    x = np.floor(256 * vectors).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((x - sums / n) @ axes) / np.sqrt(values), values / np.trace(covariance)


def result(df):
    rows = df.collect()
    return {(r.vec_id, r.component): r for r in rows}, rows


def test_equals_numpy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got, rows = result(W.op13_whitening(table.repartition(5)))
    given = sorted(table.collect())
    n, deviation, white, explained = plain_whitening(np.array([r.embedding for r in given]))
    mine = np.array([[got[r.vec_id, k].whitened for k in range(1, 5)] for r in given])
    assert len(rows) == 4 * len(given)
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-9
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9  # one sign for all rows
    assert [got[r.vec_id, 1].deviation for r in given] == deviation.tolist()
    assert {r.n for r in rows} == {n}
    assert all(abs(got[given[0].vec_id, k + 1].explained - e) < 1e-9 for k, e in enumerate(explained))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id int, embedding array<{kind}>, n int, x string")


def test_copies_count_once(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 3))
    rows = [(i, v.tolist(), 0, "a") for i, v in enumerate(base)]
    hot = rows + [(100 + i, base[0].tolist(), 0, "a") for i in range(200)]
    alone, _ = result(W.op13_whitening(frame(spark, rows, "double")))
    got, _ = result(W.op13_whitening(frame(spark, hot, "double").repartition(7)))
    for key, r in alone.items():
        assert got[key].n == 30 and abs(got[key].whitened - r.whitened) < 1e-12 and got[key].deviation == r.deviation
    assert {got[100 + i, 1].whitened for i in range(200)} == {got[0, 1].whitened}  # equal to the last bit


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 1, ""), (1, [0.5, 1.0], 1, ""), (None, [0.25, 0.0], 1, ""), (3, [-1.0, 2.0], None, None), (4, None, 1, "")]
    rows += [(5, [], 1, ""), (6, [1.0, None], 1, ""), (7, [nan, 1.0], 1, ""), (8, [inf, 1.0], 1, ""), (9, [1.0, -inf], 1, ""), (10, [1.0], 1, "")]
    got, found = result(W.op13_whitening(frame(spark, rows)))
    assert sorted({r.vec_id or 0 for r in found}) == [0, 1, 3] and len(found) == 8 and {r.n for r in found} == {3}
    assert sum(got[1, k].explained for k in (1, 2)) == pytest.approx(1)


def test_no_spread(spark):
    one = W.op13_whitening(frame(spark, [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    flat = W.op13_whitening(frame(spark, [(1, [1.0, 2.0], 0, ""), (2, [3.0, 2.0], 0, "")])).collect()
    by = {(r.vec_id, r.component): r for r in flat}
    assert by[1, 2].whitened is None and by[1, 2].explained == 0 and abs(by[1, 1].whitened) == 1 and by[1, 1].identity_error < 1e-12


def test_large_entries(spark):
    """Beyond 64 bits nothing wraps around."""
    got = W.op13_whitening(frame(spark, [(1, [1e15, 0.0], 0, ""), (2, [-1e15, 1.0], 0, ""), (3, [1e30, 3.0], 0, "")], "double")).collect()
    x = [[256 * 10**15, 0], [-256 * 10**15, 256], [2**63 - 1, 768]]
    sums = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((3 * v - s) ** 2 for v, s in zip(x[r.vec_id - 1], sums))
        assert r.deviation_exact == (Decimal(exact) if exact < 10**38 else None) and r.deviation is None


def test_empty(spark):
    empty = W.op13_whitening(frame(spark, []))
    assert empty.count() == 0 and empty.columns == list(W._RESULT)
    assert W.op13_whitening(frame(spark, [(1, None, 0, "")])).count() == 0


def test_no_file_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "fresh_dir", lambda spark, purpose: str(tmp_path / "fit"))
    assert W.op13_whitening(frame(spark, [(1, [1.0, 2.0], 0, ""), (2, [2.0, 2.0], 0, "")])).count() == 4
    assert list(tmp_path.iterdir()) == []


def test_wider_types_are_no_matter(spark):
    rows = [(1, [0.1, 2.0], 0, ""), (2, [3.0, 2.5], 0, ""), (3, [1.0, -2.5], 0, "")]
    narrow = W.op13_whitening(frame(spark, rows).withColumn("vec_id", F.col("vec_id").cast("long"))).count()
    assert narrow == 6
