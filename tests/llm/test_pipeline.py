import pytest

import corpus_pipeline as P
from test_decontaminate import held
from test_packing import check
from test_secret_scan import plain
from test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    """What each stage returns, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, sf_dir, written):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    assert all(stage.dtypes == own for stage in written[:-1])
    assert [name for name, _ in P.STAGES] == ["language_id", "near_copies", "decontamination", "secrets", "packing"]


def test_each_stage_against_brute_force(spark, sf_dir, written):
    language, copies, clean, secret, packed = (w.collect() for w in written)
    before = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(before[r.doc_id] == r for r in language) and len(language) >= 0.98 * len(before)
    components = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in language])
    assert sorted(r.doc_id for r in copies) == sorted({c for _, _, c in components})
    assert all(before[r.doc_id] == r for r in copies)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    gone = {d for d, _ in held(copies, items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in copies} - gone
    assert sorted(r.doc_id for r in secret) == sorted(r.doc_id for r in clean)
    for r in secret:
        assert (r.text == before[r.doc_id].text) == (plain(before[r.doc_id].text)[2] == "") and r.n_chars == len(r.text)
        assert plain(r.text)[2] == ""
    check([(r.doc_id, r.text) for r in secret], packed)


def test_run_gives_the_last_stage(spark, sf_dir, written):
    got = P.run(spark, sf_dir)
    assert got.columns == written[-1].columns
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, written[-1].select(*keys).collect()))
