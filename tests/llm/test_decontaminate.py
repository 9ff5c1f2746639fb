import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", low)


@pytest.mark.parametrize("texts", [[""], ["", "Ab c", "", "!"], ["é-x", "y1 Y1", "z" * 200 + " " + "z" * 200], ["a", "b"], [" \n ", "last"]])
def test_hashed_words(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes, owner, place = D.hashed_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert owner.tolist() == [i for i, _ in want] and len(place) == len(want)
    assert len(set(hashes.tolist())) == len({w for _, w in want})
    for h, (_, w) in zip(hashes, want):
        assert h == D.hashed_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]


def plain_lcs(a, b, weight):
    best = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (weight[a[i]] if a[i] == b[j] else 0))
    return best[-1, -1] / sum(weight[x] for x in a)


def test_common_share_equals_plain():
    rng = np.random.default_rng(3)
    for _ in range(60):
        weight = rng.uniform(0.1, 3, 8)
        a, b = rng.integers(0, 8, rng.integers(1, 9)), rng.integers(-1, 8, rng.integers(0, 14))
        share, used = D.common_share(a, b, weight)
        assert abs(share - plain_lcs(a, b, weight)) < 1e-9
        assert abs(sum(weight[b[i]] for i in used) / weight[a].sum() - share) < 1e-9 and list(used) == sorted(set(used))


def test_sketch_is_the_product():
    """The one pass sums what the whole matrix would give."""
    bench = D.prepare([(1, "alpha beta gamma delta"), (2, "beta epsilon zeta")], D.Settings(common=2.0))
    settings = D.Settings(sketch=4, window=3)
    rng = np.random.default_rng(1)
    size = len(bench.vocabulary)
    omega = rng.normal(size=(size, 4)).astype(np.float32)
    terms, passage = rng.integers(0, size, 50), np.sort(rng.integers(0, 9, 50))
    df, g = np.zeros(size, np.int64), np.zeros((size, 4))
    D._sketched(terms, passage, bench, omega, df, g)
    matrix = np.zeros((9, size))
    np.add.at(matrix, (passage, terms), 1)
    weighted = np.where(matrix > 0, 1 + np.log(np.maximum(matrix, 1)), 0)
    assert df.tolist() == (matrix > 0).sum(axis=0).tolist()
    assert np.allclose(g, weighted.T @ weighted @ omega, atol=1e-3) and settings.sketch == 4


def held(docs, items):
    """Documents and items that stand in them word by word."""
    found = set()
    for d in docs:
        text = f" {' '.join(words(d.text))} "
        found |= {(d.doc_id, i.item_id) for i in items if words(i.text) and f" {' '.join(words(i.text))} " in text}
    return found


@pytest.mark.parametrize("block", [2000, 7])
def test_query_finds_what_brute_force_finds(spark, block):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = D.op4_decontamination(docs, items, D.Settings(block=block)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == held(docs.collect(), items.collect())
    text = {r.doc_id: words(r.text) for r in docs.collect()}
    item = {r.item_id: words(r.text) for r in items.collect()}
    for r in rows:
        assert text[r.doc_id][r.first_word : r.past_word] == item[r.item_id] and 0.99 < r.common_share <= 1


def test_paraphrases_are_found_and_others_are_not(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rng = random.Random(8)
    known = held(docs.collect(), items.collect())
    clean = [d for d in docs.filter("length(text) > 800").collect() if d.doc_id not in {x for x, _ in known}]
    made, want = [], set()
    for n, item in enumerate(i for i in items.collect() if len(words(i.text)) >= 25):
        own = words(item.text)
        kept = [w for w in own if rng.random() > 0.15]  # words lost
        at = rng.randrange(1, len(kept))
        kept[at:at] = ["something", "else"]  # words put in
        body = clean[n].text.split(" ")
        cut = rng.randrange(len(body))
        made.append((10_000 + n, " ".join([*body[:cut], *kept, *body[cut:]])))
        want.add((10_000 + n, item.item_id))
    rows = D.op4_decontamination(docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")), items).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got & want) >= 0.9 * len(want) and got - want == known


ROWS = [(1, None), (2, ""), (3, "?!"), (4, "Alpha beta, gamma DELTA epsilon zeta."), (4, "Alpha beta, gamma DELTA epsilon zeta."), (None, "say alpha beta gamma delta epsilon zeta now"), (5, "word " * 30000 + "alpha beta gamma delta epsilon zeta" + " word" * 30000), (6, "nothing of this")]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id int, text string, item_id int")
    items = spark.createDataFrame([(1, "alpha beta gamma. Delta epsilon zeta"), (2, None), (None, "alpha"), (3, "...")], "item_id int, text string")
    rows = D.op4_decontamination(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == sorted([(4, 1), (4, 1), (5, 1), (None, 1)], key=str)
    assert {r.first_word for r in rows if r.doc_id == 5} == {30000}
    assert D.op4_decontamination(docs.limit(0), items).count() == 0
    assert D.op4_decontamination(docs, items.limit(0)).count() == 0
    stay = D.decontamination_stage(docs, items)
    assert stay.dtypes == docs.dtypes and sorted(r.doc_id for r in stay.collect()) == [1, 2, 3, 6]


def test_long_items_are_searched_in_parts(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    docs = spark.createDataFrame([(1, f"x y {long} z"), (2, "x y z"), (3, " ".join(long.split()[100:260]))], "doc_id int, text string")
    got = D.op4_decontamination(docs, spark.createDataFrame([(9, long)], "item_id int, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


@pytest.mark.parametrize("size", [64, 65, 66, 68, 70, 129])
def test_the_end_of_a_long_item_is_no_item(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    own = [word() for _ in range(size)]
    assert all(len(p.words) == 64 for p in D.prepare([(9, " ".join(own))]).parts)
    tail = own[size - (size % 64 or 6) :]
    other = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{other(90)} {' '.join(own)} {other(90)}", f"{other(90)} {' '.join(tail)} {other(90)}", " ".join(tail), f"{other(30)} {tail[-1]} {other(30)}", " ".join(own)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = D.op4_decontamination(docs, spark.createDataFrame([(9, " ".join(own))], "item_id int, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 4]


def test_items_of_common_words_only(spark):
    """Every item is wholly of words that all items have, and is found word for word wherever it stands."""
    rng = random.Random(4)
    numbers = "one two three four five six".split()
    items = sorted({f"what is {a} {o} {b}" for a in numbers for b in numbers for o in ("plus", "times")})
    bench = D.prepare(list(enumerate(items)))
    assert all(bench.spans[p.words].any() for p in bench.parts)
    every = [f"{' '.join(rng.sample(items[0].split() + numbers, 5))} x{n} {i}" for n, i in enumerate(items)]
    made = [f"a{n} " * rng.randrange(90) + f"{i}? " + f"b{n} " * rng.randrange(90) for n, i in enumerate(items)] + every
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*made, "what one is", "plain words", None])], "doc_id int, text string")
    rows = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in D.op4_decontamination(docs, rows).collect()}
    assert got >= held([d for d in docs.collect() if d.text], rows.collect())
    assert {d for d, _ in got} == set(range(len(made)))
    assert sorted(r.doc_id for r in D.decontamination_stage(docs, rows).collect()) == [len(made), len(made) + 1, len(made) + 2]


def test_items_that_share_all_their_words(spark):
    """One set of words in other orders: no word is in few items."""
    rng = random.Random(6)
    orders = list({tuple(rng.sample("ab cd ef gh ij kl mn".split(), 7)) for _ in range(30)})
    bench = D.prepare([(n, " ".join(o)) for n, o in enumerate(orders)])
    assert all(bench.spans[p.words].any() for p in bench.parts)
    docs = spark.createDataFrame([(n, "filler " * 40 + " ".join(o) + " filler" * 40) for n, o in enumerate(orders)], "doc_id int, text string")
    rows = spark.createDataFrame([(n, " ".join(o)) for n, o in enumerate(orders)], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in D.op4_decontamination(docs, rows).collect()}
    assert got >= {(n, n) for n in range(len(orders))}


def test_lookup_equals_plain():
    rng = np.random.default_rng(9)
    for _ in range(200):
        terms, owner = rng.integers(-1, 4, 60), np.sort(rng.integers(0, 4, 60))
        parts = tuple(D.Part(n, rng.integers(0, 4, rng.integers(1, 7)), 0) for n in range(8))
        want = {}
        for p, part in enumerate(parts):
            for i in range(60 - len(part.words) + 1):
                whole = slice(i, i + len(part.words))
                if terms[whole].tolist() == part.words.tolist() and len(set(owner[whole])) == 1:
                    want.setdefault((int(owner[i]), p), i)
        assert {(d, p): i for d, i, p in D.Lookup(parts, 4).found(terms, owner)} == want


@pytest.mark.parametrize("at_once", [1, 2, 7, 64, 1000])
def test_words_of_pieces_are_the_words(at_once):
    rng = random.Random(at_once)
    texts = ["", "a", "?!", "x" * 700, f"{'y' * 130} {'z' * 64}", *("".join(rng.choice("aB é.") for _ in range(rng.randrange(300))) for _ in range(40))]
    for raw in (np.frombuffer(t.encode(), np.uint8) for t in texts):
        want = D.hashed_words(raw, np.array([0, len(raw)]))[0].tolist()
        assert [h for piece in D.hashed_pieces(raw, at_once) for h in piece.tolist()] == want


def test_segments_change_nothing(spark):
    """Items at, before and over the bounds of segments, verbatim and with words lost."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (5, 20, 40, 64, 90, 150)]
    segment = D.Settings(bytes_at_once=1).segment
    texts = []
    for n in range(18):
        own = items[n % 6] if n < 12 else [w for w in items[n % 6] if rng.random() > 0.12]
        text = [word() for _ in range(3 * segment + n)]
        for at in (segment - rng.randrange(len(own) + 20), 2 * segment - rng.randrange(40)):
            text[at : at + len(own)] = own
        texts.append(" ".join(text[: 2 * segment + len(own) // 2 if n % 3 == 0 else None]))
    docs = spark.createDataFrame(list(enumerate([*texts, "z" * 5000, "short", " ".join(items[0])])), "doc_id int, text string")
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id int, text string")
    results = [D.matches(docs, bench, D.Settings(bytes_at_once=b, products=p)).collect() for b, p in ((1 << 22, 1 << 23), (1, 1 << 23), (9000, 50))]
    keys = [sorted((r.doc_id, r.item_id, r.first_word, r.past_word, round(r.common_share, 6), r.answer_found) for r in rows) for rows in results]
    assert keys[0] == keys[1] == keys[2] and {(n, n % 6) for n in range(18)} <= {k[:2] for k in keys[0]}
