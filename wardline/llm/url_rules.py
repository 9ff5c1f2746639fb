"""URL filters: a list of rules, and beyond it combinations of tokens mined from labels.

FP-growth finds the combinations of URL tokens that go with a bad label often enough and
surely enough. Each combination is filed under its rarest token; the tokens of a URL look
up what is filed under them, and the rest of the combination is compared. What a verdict
reports as confidence is that of the surest rule that holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import ascii_lower
from wardline.sources.storage import written

# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BLOCK, ALLOW = "block", "allow"
BROADCAST_TOKENS = 50_000  # of all rules together


@dataclass(frozen=True)
class Settings:
    """A combination needs ``least_count`` bad URLs and a share of ``support``, and ``confidence`` that it is bad."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    least_count: int = 10
    support: float = 0.001
    confidence: float = 0.7


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for what has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, parts, 1)), F.regexp_extract(whole, parts, 2)


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels of the host and their parts, words of the path, names in the query; no numbers."""
    of = lambda mark, text, at: F.transform(F.split(text, at), lambda t: F.concat(F.lit(mark), t))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda t: F.concat(F.lit("query="), F.regexp_extract(t, "^[^=]*", 0)))
    every = F.concat(of("host=", host, r"\."), of("word=", host, r"[.-]"), of("path=", path, "[/.]"), names)
    return F.array_distinct(F.filter(every, lambda t: ~t.rlike(r"=\d*$")))


_RULES = "rule bigint, alternatives array<array<string>>, rarest array<string>, confidence double"


def _containing(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of ``baskets`` (id, own) and ``sets`` (rule, needed, rarest) where the one holds the other.

    Sets are filed under their rarest item, which the items of a basket look up.
    """
    found = baskets.select("id", "own", F.explode("own").alias("item")).join(sets.withColumnRenamed("rarest", "item"), "item")
    return found.filter(F.forall("needed", lambda t: F.array_contains("own", t))).select("id", "rule")


def mine(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rules (rule, alternatives, rarest, confidence) from labelled URLs: ``tokens`` and ``bad`` of each.

    A rule holds for a URL that has one token at least of each of its ``alternatives``:
    tokens that stand in the very same labelled URLs are one item to FP-growth, since any of
    them says what all say, and forty names of one query would else be a million million
    combinations. Tokens that are rules by themselves are left out of longer ones, and the
    other rules are minimal, too: what contains a rule is judged by that rule already.
    FP-growth reads the bad URLs only; how many good ones hold a combination is counted
    through the index. Without enough labelled URLs there is no rule.
    """
    spark = labelled.sparkSession
    rows = written(labelled.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("id"), "tokens", "bad"))
    total = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(settings.least_count, settings.support * total["n"])
    if total["bad"] < least:
        return spark.createDataFrame([], _RULES)
    each = rows.select("id", "bad", F.explode("tokens").alias("token"))
    # two checksums of the URLs a token stands in, so that the same ones are known without listing them
    counted = written(
        each.groupBy("token")
        .agg(
            F.count("*").alias("n"),
            F.count_if("bad").alias("n_bad"),
            F.bit_xor(F.xxhash64("id")).alias("mark"),
            F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("mark2"),
        )
        .filter(F.col("n_bad") >= least)
    )
    sure = F.col("n_bad") / F.col("n") >= settings.confidence
    alone = counted.filter(sure).select(
        F.array("token").alias("needed"), F.array(F.array("token")).alias("alternatives"), F.array("token").alias("rarest"),
        (F.col("n_bad") / F.col("n")).alias("confidence"),
    )
    items = written(
        counted.filter(~sure).groupBy("n", "n_bad", "mark", "mark2").agg(F.min("token").alias("item"), F.collect_list("token").alias("members"))
    )
    member = items.select(F.explode("members").alias("token"), "item")
    baskets = written(
        each.join(member, "token").groupBy("id", "bad").agg(F.collect_set("item").alias("own")).filter(F.size("own") > 1)
    )
    bad = baskets.filter("bad").select(F.col("own").alias("items"))
    many = bad.count()
    if many < least:
        return written(alone.select(F.xxhash64("needed").alias("rule"), "alternatives", "rarest", "confidence"))
    model = FPGrowth(itemsCol="items", minSupport=least / many, minConfidence=1.0).fit(bad)
    sets = model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= least)).select(
        F.xxhash64(F.sort_array("items")).alias("rule"), F.col("items").alias("needed"), "freq"
    )
    rare = (
        sets.select("rule", F.explode("needed").alias("item")).join(items.select("item", "n"), "item")
        .groupBy("rule").agg(F.min_by("item", F.struct("n", "item")).alias("rarest"))
    )
    sets = written(sets.join(rare, "rule"))
    good = _containing(baskets.filter("not bad").select("id", "own"), sets.select("rule", "needed", "rarest")).groupBy("rule").agg(F.count("*").alias("good"))
    confidence = F.col("freq") / (F.col("freq") + F.coalesce("good", F.lit(0)))
    ruled = written(sets.join(good, "rule", "left").withColumn("confidence", confidence).filter(F.col("confidence") >= settings.confidence))
    parts = ruled.select("rule", "needed", "rarest")
    larger = _containing(parts.select(F.col("rule").alias("id"), F.col("needed").alias("own")), parts).filter("id <> rule")
    minimal = ruled.join(larger.select(F.col("id").alias("rule")).distinct(), "rule", "left_anti")
    named = (
        minimal.select("rule", "needed", "rarest", "confidence", F.explode("needed").alias("item")).join(items.select("item", "members"), "item")
        .groupBy("rule", "confidence").agg(F.collect_list("members").alias("alternatives"), F.first(F.when(F.col("item") == F.col("rarest"), F.col("members")), ignorenulls=True).alias("rarest"))
    )
    columns = ["rule", "alternatives", "rarest", "confidence"]
    return written(named.select(*columns).unionByName(alone.select(F.xxhash64("needed").alias("rule"), *columns[1:])))


def judge(pages: DataFrame, combinations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, listed = listed_rule(F.col("host"), F.col("path"), settings.rules)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row_id"), "page_id", "host", "path", rule.alias("rule"), listed.alias("listed"),
        tokens(F.col("host"), F.col("path"), F.col("url")).alias("own"),
    )
    index = combinations.select(F.explode("rarest").alias("token"), F.col("alternatives").alias("needed"), F.col("confidence").alias("sure"))
    if index.select(F.explode(F.flatten("needed"))).limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS:
        index = F.broadcast(index)
    # a page has at least one row, and the rows of a page meet again in its own task first
    looked_up = rows.select("row_id", "page_id", "host", "path", "rule", "listed", "own", F.explode_outer("own").alias("token")).join(index, "token", "left")
    matched = F.when(F.col("needed").isNotNull() & F.forall("needed", lambda t: F.arrays_overlap("own", t)), F.col("sure"))
    judged = looked_up.select("row_id", "page_id", "host", "path", "rule", "listed", matched.alias("sure")).groupBy("row_id").agg(
        *[F.first(c).alias(c) for c in ("page_id", "host", "path", "rule", "listed")], F.max("sure").alias("confidence")
    )
    mined = F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens of the pages whose URL has the number of a labelled document, bad if that one is toxic or of low quality."""
    host, path = host_and_path(F.col("url"))
    numbered = pages.select(tokens(host, path, F.col("url")).alias("tokens"), F.regexp_extract(path, r"/(\d{1,18})(?:[/.]|$)", 1).alias("number"))
    # an empty number is null, and nothing is read as a number that is none
    keyed = numbered.select("tokens", F.when(F.col("number") != "", F.col("number")).cast("bigint").alias("doc_id"))
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return keyed.join(marks, "doc_id").select("tokens", "bad")


def op3_url_rules(pages: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Verdict on every row of ``pages`` (page_id, url): the listed rule's, else that of the mined combinations.

    A null URL has empty host and path and no token, so it is allowed, as is everything if
    nothing was labelled. Rows that repeat are judged each by itself; an empty table gives
    no rows.
    """
    return judge(pages, mine(labelled_pages(pages, labels), settings), settings)
