import random
import re
import time
from collections import Counter
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from wardline.llm import url_rules as U


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme/x", "http://", "http://org", "http://ORG/", "https://a.example.org/es/1", "https://example.org/es", "x://example.org/en/12?q=1#z",
    "http://notorg/x", "http://b.com/de/1", "http://com/fr/", "http://b.com?x=/de/", "http://É.COM/fr/2", "a://b://c.org/", "http://h.org#/es/", "http://u:p@x.org:80/a\nb",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[5], "x"), (5, URLS[5], "y")], "page_id int, url string, host string")
    labels = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    rows = U.op3_url_rules(pages, labels).collect()
    want = sorted(((p.page_id, *plain(p.url)[:3], plain(p.url)[3] or "allow") for p in pages.collect()), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=str) == want
    assert U.op3_url_rules(pages.limit(0), labels).count() == 0


def labelled_urls():
    rng = random.Random(4)
    rows = []
    for i in range(600):
        host = rng.choice(["spam-farm", "news", "shop-win", "blog"])
        lang = rng.choice(["en", "xx", "yy"])
        bad = (host == "spam-farm" and lang == "xx") or (host == "shop-win" and rng.random() < 0.9) or rng.random() < 0.05
        rows.append((i, f"http://{host}.example.net/{lang}/{i}?ref=1", int(bad)))
    return rows


def brute_rules(rows, settings):
    """All combinations of tokens by counting."""
    def items(url):
        host, path = plain(url)[:2]
        found = {f"host={x}" for x in host.split(".")} | {f"word={x}" for x in re.split("[.-]", host)} | {f"path={x}" for x in re.split("[/.]", path)} | {"query=ref"}
        return {t for t in found if not re.search(r"=\d*$", t)}

    every, bad = {}, {}
    for _, url, is_bad in rows:
        own = sorted(items(url))
        for n in range(1, len(own) + 1):
            for some in combinations(own, n):
                every[some] = every.get(some, 0) + 1
                bad[some] = bad.get(some, 0) + is_bad
    least = max(settings.least_count, settings.support * len(rows))
    return {some: bad[some] / n for some, n in every.items() if bad[some] >= least and bad[some] / n >= settings.confidence}, items


def expanded(rules):
    """Every choice of one token of each of a rule's alternatives."""
    return {tuple(sorted(some)): r.confidence for r in rules for some in product(*r.alternatives)}


@pytest.mark.parametrize("hint", [True, False])
def test_mined_rules_equal_counting(spark, monkeypatch, hint):
    if not hint:
        monkeypatch.setattr(U, "BROADCAST_TOKENS", -1)
    rows = labelled_urls()
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id int, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows], "doc_id int, quality int, toxic int")
    settings = U.Settings()
    every, items = brute_rules(rows, settings)
    want = {k: c for k, c in every.items() if not any(set(o) < set(k) for o in every)}
    found = expanded(U.mine(U.labelled_pages(pages, labels), settings).collect())
    assert any(len(k) > 1 for k in want) and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    for r, (_, url, _) in zip(sorted(U.op3_url_rules(pages, labels).collect()), rows):
        assert r.verdict == ("block" if any(set(k) <= items(url) for k in every) else "allow")


@pytest.mark.parametrize("seed", range(3))
def test_random_baskets(spark, seed):
    """Tokens that come together, often or always, and rules of up to four of them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        own = {t for t in "abcdefg" if rng.random() < 0.5}
        own |= {t + "2" for t in own if t in "abc"}  # always together with the other
        bad = ({"a", "b"} <= own and rng.random() < 0.9) or ({"c", "d", "e"} <= own and rng.random() < 0.95) or rng.random() < 0.1
        rows.append((sorted(own), bad))
    settings = U.Settings(least_count=8, confidence=0.75)
    every, bads = Counter(), Counter()
    for own, bad in rows:
        for n in range(1, 6):
            for some in combinations(own, n):
                every[some] += 1
                bads[some] += bad
    ruled = {k: bads[k] / n for k, n in every.items() if bads[k] >= 8 and bads[k] / n >= 0.75}
    want = {k: c for k, c in ruled.items() if not any(set(o) < set(k) for o in ruled)}
    found = expanded(U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), settings).collect())
    assert want and {k: round(c, 9) for k, c in found.items()} == {k: round(c, 9) for k, c in want.items()}


def test_forty_query_names(spark):
    """One shape of URL with forty names: a single item, not two to the forty combinations."""
    names = "&".join(f"name{chr(97 + i % 26)}{i // 26}=1" for i in range(40))
    urls = [f"http://a.net/p/{i}?{names}" for i in range(40)] + [f"http://b.net/p/{100 + i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)], "doc_id int, quality int, toxic int")
    start = time.perf_counter()
    verdicts = {r.page_id: r.verdict for r in U.op3_url_rules(pages, labels).collect()}
    assert time.perf_counter() - start < 60
    assert verdicts == {i: "block" if i < 40 else "allow" for i in range(80)}


def test_query(spark, sf_dir):
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    rows = U.op3_url_rules(pages, labels)
    want = sorted((p.page_id, *plain(p.url)[:3]) for p in pages.collect())
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in rows.collect()) == want
    assert rows.filter(~F.col("verdict").isin("allow", "block")).count() == 0
