import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardline.llm import simhash as S
from wardline.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """component by brute force over all pairs of fingerprints."""
    prints = sorted({fp for _, fp in rows})
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for doc, fp in rows:
        if doc is not None:
            r = root(fp)
            least[r] = min(doc, least.get(r, doc))
    return sorted(((d, f"{fp:016x}", least.get(root(fp))) for d, fp in rows), key=str)


@pytest.mark.parametrize("text", ["", " \n", "One", "one  TWO", "a b c", "É À ß\x0bB c D", "x " * 500, "a\x00b c\x1cd e f", "w " * 70000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [1, 2, 7, 30])
@pytest.mark.parametrize("text", ["", "a", " a b ", "a b c", "one two three four five six seven", "x\n\ny  z w" * 9, "longword " * 5 + "end"])
def test_blocks_change_nothing(monkeypatch, block, text):
    monkeypatch.setattr(S, "BLOCK", block)
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_code_is_perfect():
    own, near = S.golay_indices()
    assert len(set(own)) == 2048 and own.max() < 4096
    assert (near >= 0).sum(axis=1).max() <= 6
    rng = np.random.default_rng(1)
    for s in rng.integers(0, 1 << 16, 200):
        for b in range(16):
            assert own[s ^ (1 << b)] in near[s]


def test_keys_meet_for_all_differences():
    rng = random.Random(3)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        probe = set(S.probe_keys(np.array([y], np.uint64))[0].tolist()) - {-1}
        assert S.all_keys(x) & probe


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (9, 9), (10, 11), (None, 4), *[(100 + i, 101 + i) for i in range(60)], *[(500, 501 + i) for i in range(50)]]
    found = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(61)} | {500 + i: 500 for i in range(51)}
    assert found == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_prints():
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in prints[:20]:
        x = base
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            prints.append(x)
    return prints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_classes_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 10**6), fp) for fp in near_prints() for _ in range(rng.randint(1, 3))]
    rows += [(None, rows[0][1]), (None, 12345)]
    members = spark.createDataFrame([(d, signed(fp)) for d, fp in rows], "doc_id bigint, fp bigint")
    got = members.join(S.classes(members), "fp").select("doc_id", S.hex_print(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
    assert sorted(map(tuple, S.op10_simhash(docs).collect()), key=str) == plain_components(rows)


EDGES = [(1, None, "x"), (2, "", "x"), (3, "same words here now", "x"), (3, "same words here now", "x"), (None, "same words here now", "y"), (4, "Same WORDS here now", None), (5, "other text of its own", "z"), (3, "different with the same number", "q")]


def test_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, "doc_id int, text string, fp string")
    got = S.op10_simhash(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (4, 3), (5, 5), (3, 3)], key=str
    )
    assert S.op10_simhash(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each(spark):
    docs = spark.createDataFrame(EDGES, "doc_id int, text string, fp string")
    got = S.dedup_stage(docs)
    assert got.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, None), (3, "different with the same number"), (3, "same words here now"), (5, "other text of its own")]
    assert S.dedup_stage(docs.limit(0)).count() == 0
