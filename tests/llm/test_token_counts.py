import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import token_counts as C

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
COUNTER = C.Counter()
PARTS = [" ", "  ", "\n", "\t", "▁", "a", "the", "there.", "<s>", "</s>", "<unk>", "<0x0A>", "été", "中文", "\x00", " ", "12", "!" * 9, "q" * 40]


@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_odd_texts(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_proved_tokens():
    fresh = C.Counter(memo=0)
    assert fresh.cuts and fresh.lines and len(fresh.spaced) > 10_000
    for word in sorted(fresh.spaced)[1::50]:
        assert len(LIBRARY.encode(word)) == 1


def test_full_memo_changes_nothing():
    small, text = C.Counter(memo=2), "some zzxxyy words qqwwee\nand zzxxyy qqwwee vvbbnn"
    assert small.count(text) == len(LIBRARY.encode(text))


def rows_of(docs):
    return sorted(
        ((r.doc_id, len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "")), n > 4096) for r in docs.collect()), key=str
    )


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, C.op2_token_counts(docs).collect()), key=str) == rows_of(docs)


@pytest.mark.parametrize("empty", [False, True])
def test_edge_cases(spark, empty):
    rows = [(1, None, 1), (2, "", 2), (3, "a b", 3), (3, "a b", 3), (None, " ", 4), (5, "wörter und " * 20000, 5)]
    docs = spark.createDataFrame(rows[: 0 if empty else None], "doc_id int, text string, n_tokens int")
    assert sorted(map(tuple, C.op2_token_counts(docs).collect()), key=str) == rows_of(docs)
