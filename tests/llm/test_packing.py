import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardline.llm import packing as P

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENS = P.Tokens()


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(text):
    return np.frombuffer(TOKENS.encode(text), "<u4").tolist()


PARTS = [" ", "\n", "\t", "\r\n", "a", "the", "don't", ".", ",!", "été", "中文", "\x1c", " ", "　", "ʼ", "<|endoftext|>", "<|", "12", "x" * 30, "­"]


@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_of_odd_texts(text):
    assert encoded(text) == ids(text)


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(text):
    assert encoded(text) == ids(text)


def test_full_memo_changes_nothing():
    small = P.Tokens(memo=3)
    text = "one two three. four five, six seven\neight one two"
    assert np.frombuffer(small.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("total", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut(total):
    parts = P.cut(total, 1024)
    assert [s for s, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
    assert sum(n for _, n in parts) == total and all(n == 1024 for _, n in parts[1:]) and 0 < parts[0][1] <= 1024
    assert total > 1024 or len(parts) == 1


def used(plan):
    found = {}
    for pattern, n in plan:
        for v in pattern:
            found[v] = found.get(v, 0) + n
    return found


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(257, np.int64)
    np.add.at(histogram, rng.integers(1, 257, 6000) if seed % 2 else np.clip(rng.geometric(0.02, 6000), 1, 256), 1)
    plan = P.make_plan(histogram, 256)
    assert used(plan) == {i: int(n) for i, n in enumerate(histogram) if n}
    assert all(sum(p) <= 256 and n > 0 for p, n in plan)
    least = -(-int(histogram @ np.arange(257)) // 256)
    long_ones = int(histogram[129:].sum())
    assert sum(n for _, n in plan) <= 1.02 * max(least, long_ones)


def test_plan_of_nothing_and_of_one_length():
    assert P.make_plan(np.zeros(1025, np.int64), 1024) == []
    one = np.zeros(1025, np.int64)
    one[300] = 100_000
    assert sum(n for _, n in P.make_plan(one, 1024)) == -(-100_000 // 3)


def test_least_squares_reach_an_exact_cover():
    patterns = np.array([[6, 4, 0], [5, 5, 0], [5, 3, 2], [6, 2, 2]])
    want = np.array([7.0, 0, 3, 2])
    histogram = np.zeros(11)
    for p, n in zip(patterns, want):
        for v in p[p > 0]:
            histogram[v] += n
    got = P.fit_counts(patterns, histogram)
    back = np.zeros(11)
    for p, n in zip(patterns, got):
        for v in p[p > 0]:
            back[v] += n
    assert np.allclose(back, histogram, atol=1e-3) and (got >= 0).all()


def check(docs, rows):
    """The contract, by reading every text again."""
    want = []
    for d, t in docs:
        body = [*ids(t or ""), 2]
        want += [(d, n, s, k, zlib.crc32(np.array(body[s : s + k], "<u4").tobytes())) for n, (s, k) in enumerate(P.cut(len(body), 1024))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= 1024
    return len(filled), sum(filled.values())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, total = check([(r.doc_id, r.text) for r in docs.collect()], P.op1_best_fit_packing(docs).collect())
    assert n <= 1.05 * -(-total // 1024)


ROWS = [(1, None, 5), (2, "", 6), (3, "a b", 7), (3, "a b", 7), (None, "x y z", 8), (4, "long text here " * 4000, 9), (5, "\n\n  \t", 1)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string, length int")
    check([(r[0], r[1]) for r in ROWS], P.op1_best_fit_packing(docs).collect())
    assert P.op1_best_fit_packing(docs.limit(0)).count() == 0


def test_small_groups_number_every_piece_once(spark):
    docs = spark.createDataFrame([(i, "same text of one length") for i in range(500)], "doc_id long, text string")
    rows = P.op1_best_fit_packing(docs, P.Settings(group_rows=5)).collect()
    check([(i, "same text of one length") for i in range(500)], rows)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(40)], "doc_id long, text string")
    rows = P.sequences(P.pack(P.pieces(docs, with_ids=True))).collect()
    text = sorted(LIBRARY.decode(part) for r in rows for part in _split(r.ids))
    assert text == sorted(f"text number {i} " * (i % 7) for i in range(40))


def _split(found):
    part = []
    for i in found:
        if i == 2:
            yield part
            part = []
        else:
            part.append(i)
