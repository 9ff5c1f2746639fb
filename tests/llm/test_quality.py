import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import differences

from wardline.llm import quality as Q


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(Q.SYMBOLS, text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z w x y z", "1 2 3 4 1 2 3 9 2 3 4", "l\nl\n\n \nl\r\nl", "#$ %& <b> |", "\x0b\x0c\t", "über 😀 ñ q", " the of\nand " * 60, "word " * 40000]


def test_measures(spark):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(0, "", "z"), (None, "the of and", "z")]
    got = Q.op7_quality_rules(spark.createDataFrame(rows, "doc_id int, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "the of and" if r.doc_id is None else TEXTS[r.doc_id]
        want = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert Q.op7_quality_rules(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = Q.op7_quality_rules(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((0, True), 0) <= 0.02 * (n.get((0, True), 0) + n[0, False])
    assert n.get((1, False), 0) <= 0.01 * n[1, True]


@pytest.mark.parametrize("change", [{"least": 3.0}, {"most": 1.0}])
def test_rules_are_data(spark, change):
    docs = spark.createDataFrame([(1, "ab cd " * 30)], "doc_id int, text string")
    row = Q.op7_quality_rules(docs, (Q.Rule("mean", "word_chars", "n_words", **change),)).first()
    assert row.failed_rules == "repeats,mean" and not row.kept


def test_plan_is_one_projection(spark, sf_dir):
    plan = Q.op7_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stop_words_by_language(spark):
    russian = " ".join(f"слово{chr(1072 + i % 32)}{chr(1072 + i // 32)}" for i in range(300))
    latin = " ".join(f"qar{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    german = latin + " und" * 1 + " der die das ist mit nicht sich"
    rows = [(1, russian, None), (2, russian, "ru"), (3, latin, None), (4, latin, "fi"), (5, latin, "en"), (6, german, "de"), (7, german, "en"), (8, german, None), (9, russian, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in Q.op7_quality_rules(docs).collect()}
    assert [i for i in got if got[i].kept] == [1, 2, 4, 6, 8] and {r.failed_rules for r in got.values()} == {"", "stop_words"}
    assert [r.kept for r in Q.op7_quality_rules(docs.drop("lang")).orderBy("doc_id").collect()] == [True, True, False, False, False, True, True, True, True]
    only = Q.op7_quality_rules(docs, stop_words={"fi": ["qaraa"]}).filter("doc_id = 4").first()
    assert only.n_stop_words == 1 and not only.kept
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert differences(Q.op7_quality_rules(docs).toArrow(), con.sql(Q.op7_sql()).to_arrow_table()) == []


def test_length_alone_is_no_fault(spark):
    docs = spark.createDataFrame([(1,)], "doc_id int").select("doc_id", F.expr("concat_ws(' ', transform(sequence(1, 1100000), i -> if(i % 9 = 0, 'the', concat('w', i))))").alias("text"))
    row = Q.op7_quality_rules(docs).first()
    assert row.kept and row.n_words == 1100000
