import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import filter_audit as A


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert A.positional_popcount(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_change_nothing(block):
    rng = random.Random(block)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t\x0b\x0c\r\x1c é") for _ in range(rng.randrange(30)))
        assert A.word_counts(text, block) == A.word_counts(text)


def test_words_end_at_six_signs():
    assert A.word_counts("a b\x1cc d\x0be\x0cf\rg\th\na") == (7, 7)


def plain_fails(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        f
        for f, bad in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * capitals > 2 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)),
        )
        if bad
    }


def plain_audit(docs, labels):
    """Order by order, document by document."""
    first, said = {}, {}
    for r in docs:
        if r["doc_id"] is not None:
            text = r["text"] or ""
            first[text] = min(first.get(text, r["doc_id"]), r["doc_id"])
    for r in labels:
        if r["doc_id"] is not None:
            good, toxic = said.get(r["doc_id"], (False, False))
            said[r["doc_id"]] = good or r["quality"] == 1, toxic or r["toxic"] == 1
    fails = []
    for r in docs:
        text = r["text"] or ""
        own = plain_fails(text) | ({"E"} if r["doc_id"] is not None and r["doc_id"] > first[text] else set())
        fails.append((r["source"] or "", own, *said.get(r["doc_id"], (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        here = [f[1:] for f in fails if f[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [h for h in left if f in h[0]]
                left = [h for h in left if f not in h[0]]
                share[f] += len(gone)
                failing = sum(f in h[0] for h in here)
                only = sum(h[0] == {f} for h in here)
                figures = [len(left), len(gone), failing - len(gone), only, sum(h[1] for h in gone), sum(h[2] for h in gone)]
                out[part, "".join(order), step] = figures
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(share[order[step - 1]])
    return out


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(found) == len(rows)
    return found


LONG = " ".join(f"w{i}" for i in range(250))


def test_odd_rows_equal_plain_counting(spark):
    docs = [
        (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (1, LONG, "a"), (None, LONG, "a"), (3, None, None), (4, "", ""), (5, " ", "a"),
        (6, LONG + " $", "b"), (7, "Ab " * 300, "b"), (8, "x " * 100_000, "b"), (0, LONG.upper(), "c"), (9, "É" * 300, "c"), (None, None, None),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id int, text string, source string, failed int, digest string")
    labels = spark.createDataFrame([(*r, "y") for r in labels], "doc_id int, quality int, toxic int, text string")
    want = plain_audit([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert got(A.op12_filter_audit(docs.repartition(4), labels)) == want
    # copies are sought table-wide, and the same whatever the partitions
    assert got(A.op12_filter_audit(docs.coalesce(1), labels.repartition(3))) == want


def test_given_table_equals_plain_counting(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_audit([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert got(A.op12_filter_audit(docs, labels)) == want


def test_many_parts_pass_on_their_sums(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.col("id") % 150).alias("source"))
    monkeypatch.setattr(A, "PARTS_AT_ONCE", 10)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = A.op12_filter_audit(docs.coalesce(1), labels).filter("filter_order = 'EABCD' and step = 1").collect()
    assert len(rows) == 150 and sum(r.kept for r in rows) == 1 and sum(r.removed for r in rows) == 299


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.op12_filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
