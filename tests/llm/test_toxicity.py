import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_slope_of_the_noisy_or():
    rng = np.random.default_rng(1)
    z, owner, toxic = rng.normal(-1, 1, 12), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3, 3, 4, 4]), np.array([1, 0, 1, 0, 1])
    _, slope = T.loss_and_slope(z, owner, toxic)
    for i in range(len(z)):
        up, down = z.copy(), z.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert (T.loss_and_slope(up, owner, toxic)[0] - T.loss_and_slope(down, owner, toxic)[0]) / 2e-5 == pytest.approx(slope[i], abs=1e-6)


def test_score_is_the_noisy_or_of_sentences():
    model = T.Model({"=bad": 4.0, "=worse": 6.0, "=fine": -3.0}, -5.0)
    text = "all is fine. a bad one! bad and worse\nfine fine bad. Worse?"
    background = 1 / (1 + math.exp(5))
    spared = 1.0
    for evidence in (4, 10, 6):  # the other two sentences have none
        spared *= (1 - 1 / (1 + math.exp(5 - evidence))) / (1 - background)
    score, count, found = T.Reader(model).read(text)
    assert score == pytest.approx(1 - spared) and count == 5
    assert [text[s:e].strip() for s, e, _ in found] == ["bad and worse", "Worse"]
    assert all(p >= 0.5 for _, _, p in found)


def test_length_alone_is_not_toxic():
    model = T.Model({"=bad": 4.0}, -5.0)
    assert T.Reader(model).read("nothing here. " * 100_000)[0] == 0


def test_texts_without_a_stop_are_cut_after_words():
    text = "word " * 3000 + "x" * 5000
    spans = list(T.sentences(text))
    assert all(e - s <= 1000 for s, e in spans)
    assert "".join(text[s:e] for s, e in spans) == text
    assert all(text[e - 1 : e + 1].isalpha() is False for s, e in spans if e < 15000)
    assert list(T.sentences("12. ?! \n 3")) == [] and list(T.sentences("")) == []


def auc(positive, negative):
    negative = np.sort(negative)
    below = np.searchsorted(negative, positive, "left") + np.searchsorted(negative, positive, "right")
    return below.sum() / 2 / len(positive) / len(negative)


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = T.op11_toxicity(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = [(rows[r.doc_id], r.toxic) for r in labels.collect()]
    held = [(r.score, toxic) for r, toxic in truth if r.held_out]
    positive, negative = (np.array([s for s, t in held if t == label]) for label in (1, 0))
    assert auc(positive, negative) >= 0.94 and (positive >= 0.5).mean() >= 0.85 and (negative >= 0.5).mean() <= 0.02


# -- planted: only sentences with one of three words offend, which no label says


def planted(n=600):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["zorg", "quxly", "vlam"]
    docs = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary, 8)) for _ in range(int(rng.integers(1, 25)))]
        toxic = int(i % 4 == 0)
        hit = int(rng.integers(len(lines)))
        if toxic:
            lines[hit] += " " + bad[i % 3] + ["", "en", "s"][i % 7 % 3]
        docs.append((i, ". ".join(lines) + ".", toxic, hit))
    return docs


def frames(spark, docs):
    return (
        spark.createDataFrame([(i, t, "en", "toxic") for i, t, _, _ in docs], "doc_id int, text string, lang string, score string"),
        spark.createDataFrame([(i, 1, y) for i, _, y, _ in docs], "doc_id int, quality int, toxic int"),
    )


def test_offending_sentences_are_found(spark):
    docs = planted()
    rows = {r.doc_id: r for r in T.op11_toxicity(*frames(spark, docs)).collect()}
    located = 0
    for i, text, toxic, hit in docs:
        assert rows[i].predicted == toxic
        if toxic:
            located += [text[s.start : s.end].strip() for s in rows[i].offending] == [text.split(". ")[hit].strip(". ")]
        else:
            assert rows[i].offending == []
    assert located >= 0.98 * sum(d[2] for d in docs)


def test_held_out_labels_and_other_columns_are_not_used(spark):
    docs, labels = frames(spark, planted(200))
    changed = labels.withColumn("toxic", F.when(T.crc_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    want = sorted(T.op11_toxicity(docs, labels).collect())
    assert sorted(T.op11_toxicity(docs.withColumn("lang", F.lit("xx")), changed).collect()) == want
    assert sorted(T.op11_toxicity(docs.repartition(7), labels.repartition(3)).collect()) == want


def test_sample_is_bounded_whatever_repeats(spark):
    """A third of the rows one text, toxic or not: drawn once, and the others are drawn, too."""
    docs = planted(300)
    copies = [(1000 + i, docs[0][1], docs[0][2], 0) for i in range(300)] + [(2000 + i, docs[1][1], docs[1][2], 0) for i in range(300)]
    frame, labels = frames(spark, docs + copies)
    settings = T.Settings(toxic_docs=40, clean_docs=70, train_chars=300)
    drawn = T.labelled_texts(frame, labels, settings)
    assert sum(y for _, y in drawn) == 40 and len(drawn) == 110 and len(set(drawn)) == 110
    assert max(len(t) for t, _ in drawn) <= 300
    everything = T.labelled_texts(frame, labels, T.Settings())
    assert len(everything) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in docs[2:]) + 2


def test_odd_rows(spark):
    docs, labels = frames(spark, planted(200))
    odd = [(None, "zorg zorg", None, None), (5000, None, None, None), (5001, "", None, None), (5002, "12 ?!", None, None)]
    odd += [(5003, "wa " * 400_000 + "zorg.", None, None), (5004, "zorg", None, None), (5004, "zorg", None, None)]
    more = docs.union(spark.createDataFrame(odd, docs.schema))
    said = labels.union(spark.createDataFrame([(None, 1, 1), (5001, 1, None), (5002, 1, 7), (6000, 1, 1)], labels.schema))
    rows = T.op11_toxicity(more, said).collect()
    assert len(rows) == 207
    by = {r.doc_id: r for r in rows}
    assert by[None].held_out is False and by[None].predicted == 1
    assert all(by[i].score == 0 and by[i].predicted == 0 for i in (5000, 5001, 5002))
    assert by[5003].predicted == 1 and len(by[5003].offending) == 1 and by[5003].n_sentences > 1000
    assert len({r.score for r in rows if r.doc_id == 5004}) == 1


def test_nothing_to_learn_from(spark):
    docs, labels = frames(spark, planted(40))
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score for r in T.op11_toxicity(docs, few).collect()} == {0.0}
    assert T.op11_toxicity(docs.limit(0), labels).count() == 0
