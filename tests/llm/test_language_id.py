import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import language_id as L


def plain_states(cell, text, h):
    state, states = np.zeros(h), []
    for b in text:
        x, u = cell.x[b].astype(float), state @ cell.u.astype(float)
        soft = lambda v: v / (1 + np.abs(v))
        gate = 0.5 + 0.5 * soft(x[: 2 * h] + u[: 2 * h])
        n = soft(x[2 * h :] + gate[h:] * u[2 * h :])
        state = n + gate[:h] * (state - n)
        states.append(state)
    return np.array(states)


def plain_probabilities(net, text, window):
    """Byte by byte, one text at a time."""
    total = np.zeros(len(net.languages))
    h = net.forward.u.shape[0]
    for at in range(0, len(text), window):
        part = text[at : at + window]
        both = np.concatenate([plain_states(net.forward, part, h), plain_states(net.backward, part[::-1], h)[::-1]], axis=1)
        e = np.exp(both @ net.out + net.bias)
        total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
    return total / max(1, len(text))


def tiny():
    return L.train([(b"the and of", "en"), ("été à la".encode(), "fr"), (b"th", "en"), (b"", "xx")], L.Settings(updates=2, hidden=3))


def test_windows_equal_plain_reading():
    net, settings = tiny(), L.Settings(window=16, windows_at_once=4)
    texts = [b"", b"a", b"the cat sat on the mat", b"x" * 16, b"y" * 33, "ß über".encode() * 20]
    offsets = np.cumsum([0, *map(len, texts)])
    got = L.document_probabilities(net, np.frombuffer(b"".join(texts), np.uint8), offsets, settings)
    for row, text in zip(got, texts):
        assert np.allclose(row, plain_probabilities(net, text, 16), atol=1e-5)


def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    cell = L.Cell(rng.normal(0, 1, (256, 6)), rng.normal(0, 1, (2, 6)))
    data, on = rng.integers(0, 5, (7, 3)), np.ones((7, 3), bool)
    on[5:, 1] = False
    want = rng.normal(0, 1, (7, 3, 2))

    def loss():
        return float((L._run(cell, data, on)[0] * want).sum())

    states, tape = L._run(cell, data, on)
    dx, du = L._back(cell, tape, want)
    for array, grad in ((cell.x, dx), (cell.u, du)):
        for at in [(0, 0), (1, 3), (1, 5)]:
            old = array[at]
            array[at] = old + 1e-3
            up = loss()
            array[at] = old - 1e-3
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op8_language_id(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    right = 0
    held = 0
    for d in docs.select("doc_id", "lang").collect():
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        held += r.held_out
        right += r.held_out and r.lang_pred == d.lang
    assert len(rows) == docs.count() and right / held >= 0.97


def test_few_labels_are_enough(spark):
    """Two hundred documents: nearly all are told, with a clear probability."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = L.op8_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert L.language_stage(docs).count() >= 0.98 * len(rows)


def test_labels_of_held_out_documents_are_not_used(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(L.op8_language_id(docs).collect()) == sorted(L.op8_language_id(other).collect())


ROWS = [(1, "the and of the", "en", 1), (2, None, "en", 2), (3, "12 !?", None, 3), (4, "der und die", "de", 4), (4, "der und die", "de", 4), (None, "le la les", None, 5), (6, "the of to " * 30000, "en", 6), (7, "", "de", 7)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string, lang string, score int")
    got = sorted(L.op8_language_id(docs).collect(), key=str)
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 7))
    assert by[4].lang_pred in ("en", "de") and by[None].held_out is False
    assert L.op8_language_id(docs.limit(0)).count() == 0
    bare = L.op8_language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in bare.collect()} == {"und"}


@pytest.mark.parametrize("labelled", [True, False])
def test_stage(spark, labelled):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string, lang string, score int")
    if not labelled:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    got = L.language_stage(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 4, 4, 6]


def test_a_text_that_repeats_is_one_sample(spark):
    """A third of all rows one text, and one language of that text alone: every language is learned, within the bound."""
    spanish = [(i, f"el perro y la casa numero {'aeiou'[i % 5] * (i % 7)} del señor {i}", "es") for i in range(400)]
    english = [(1000 + i, "the quick brown fox and the lazy dog", "en") for i in range(4000)]
    french = [(9000 + i, f"le chat et la maison {'xyz'[i % 3] * (i % 11)} du monsieur {i}", "fr") for i in range(30)]
    docs = spark.createDataFrame(spanish + english + french, "doc_id int, text string, lang string")
    windows = L.labelled_windows(docs, L.Settings(per_language=50))
    texts = {}
    for text, lang in windows:
        texts.setdefault(lang, []).append(text)
    assert set(texts) == {"es", "en", "fr"} and 30 <= len(set(map(bytes.lower, texts["es"]))) <= 80 and len(texts["en"]) <= 2 and 30 <= len(texts["fr"]) <= 60
    assert sorted(windows) == sorted(L.labelled_windows(docs.repartition(5), L.Settings(per_language=50)))
    found = {r.doc_id: r.lang_pred for r in L.op8_language_id(docs).collect()}
    assert all(found[i] == "en" for i, *_ in english) and sum(found[i] == "fr" for i, *_ in french) >= 27


def test_least_score_is_between_chance_and_certainty():
    for n in (2, 4, 100):
        assert L.least_score(n, 0.0) == pytest.approx(1 / n) and L.least_score(n, 1.0) == pytest.approx(1.0)
        assert 1 / n < L.least_score(n, 0.05) < 1 / n + 0.05


def test_one_language_only_rejects_nothing_lettered(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(30)] + [(30, "12 34", "en"), (31, None, "en")], "doc_id int, text string, lang string")
    assert sorted(r.doc_id for r in L.language_stage(docs).collect()) == list(range(30))
