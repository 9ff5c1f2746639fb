import re

import duckdb
import pytest

from compare import differences

from wardline.llm import licenses as L

ROWS = [
    (1, None), (2, ""), (3, "CC"), (4, "cc-by CC BY ccby cc  BY"), (5, "GNU General Public license. General-public LICENSE"),
    (6, "All rights\nreserved all rights all rights reserved"), (7, "Released under the MIT license."), (8, "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files"),
    (9, "of the in the to the " * 50), (9, "of the in the to the " * 50), (None, "cc by"), (10, "K cc by İ É"),
    (11, "x " * 30000 + "all rights reserved"), (12, "Licensed under CC BY-NC 4.0."), (13, "general public general public license"),
]


def plain_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for label, p in L.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def check(docs):
    want = sorted(((r.doc_id, *plain_base(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    rows = L.op6_license_scan(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    return {r.doc_id: r for r in rows}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, "q") for r in ROWS], "doc_id int, text string, label string")
    got = check(docs)
    assert got[7].labels == "mit" and got[7].score == 1.0
    assert got[8].labels == "mit" and 0.9 < got[8].score < 1  # a word put in: two diagonals
    assert got[12].labels == "cc-by,cc-by-nc" and got[9].labels == ""
    assert L.op6_license_scan(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string")
    want = sorted(map(str, L.op6_license_scan(docs).collect()))
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, L.op6_license_scan(docs).collect())) == want


def test_short_templates_are_refused(spark):
    for settings in (L.Settings(phrases=(("x", "word"),)), L.Settings(notices=(("x", "three words only"),))):
        with pytest.raises(ValueError):
            L.templates(spark, settings)


def test_words_are_verified(spark):
    mit = [text for label, text in L.NOTICES if label == "mit"][-1].split()
    texts = {
        "released under the released under the table": "",
        "under the terms of the gnu general public license": "gpl",
        "released under the terms of the released under the": "",
        " ".join(mit): "mit",
        "About us. " + " ".join(mit[:60] + ["very"] + mit[60:100] + mit[102:]) + " The end.": "mit",
        " ".join(mit[60:]): "",
        " ".join(reversed(mit)): "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in L.op6_license_scan(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())
    longest = {r.doc_id: r for r in L.spans(docs).filter("past - first > 100").collect()}
    assert sorted(longest) == [3, 4] and (longest[3].first, longest[3].past, longest[3].score) == (0, got[3].n_words, 1.0)
    assert longest[4].first == 2 and 0.95 < longest[4].score < 1  # a word put in, two left out


def test_sql_agrees_on_the_odd_rows(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None] + [(20 + i, text) for i, (_, text) in enumerate(L.NOTICES)], "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert differences(L.op6_license_scan(docs).toArrow(), con.sql(L.op6_sql()).to_arrow_table()) == []
