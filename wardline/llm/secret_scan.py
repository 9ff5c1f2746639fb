"""Secrets in texts: fixed patterns, and strings that look random.

Two Markov models of characters, one of random strings and one of ordinary words, say how
likely a string is under each; the mean log-likelihood ratio of its bigrams decides. Both
are counted on a bounded sample of documents, in which the fixed patterns label what is
random. All work on texts is built-in functions over a row's own text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import doc_texts, hash_share

# The patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of these signs is one match, so shorter runs may be passed over at once
KINDS = ("assign", "access", "hex", "markov")
ANY_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,end:int,value:double>>"


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` bounds the fit: about so many distinct texts are counted.

    A candidate has ``least_signs`` characters, ``least_distinct`` of them different, and a
    mean ratio above ``threshold`` (natural logarithm, for each bigram).
    """

    sample_docs: int = 4000
    least_signs: int = 20
    least_distinct: int = 8
    threshold: float = 1.0
    word_signs: int = 6
    smooth_random: float = 2.0
    smooth_ordinary: float = 0.5


# ---------------------------------------------------------------- spans of a text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """Start, end and ``value`` (of the match) of all leftmost matches that do not overlap, in code points.

    What lies between the matches is as long as the parts of a split, so the places are
    sums over both.
    """
    none = F.array().cast(SPAN)
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))

    def walk(x: Column) -> Column:
        def step(found: Column, i: Column) -> Column:
            start = found["at"] + F.length(F.get(x["between"], i))
            match = F.get(x["match"], i)
            end = start + F.length(match)
            one = F.struct(start.alias("start"), end.alias("end"), value(match).cast("double").alias("value"))
            return F.struct(end.alias("at"), F.concat(found["spans"], F.array(one).cast(SPAN)).alias("spans"))

        first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        last = F.size(x["match"]) - 1
        return F.when(last >= 0, F.aggregate(F.sequence(F.lit(0), last), first, step, lambda found: found["spans"])).otherwise(none)

    return _let(both, walk)


def _base(text: Column) -> Column:
    """(assign, access, hex) spans of a text that keep the least lengths; most texts have none and are passed over."""
    kinds = (
        F.filter(_found(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))), lambda s: s["value"] >= 12),
        F.filter(_found(text, ACCESS, F.length), lambda s: s["value"] >= 18),
        _found(text, HEX, F.length),
    )
    some = text.rlike(ANY_BASE)
    none = F.array().cast(SPAN)
    return F.struct(*[F.when(some, k).otherwise(none).alias(name) for name, k in zip(KINDS, kinds)])


# ---------------------------------------------------------------- models


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratios of bigrams, row by row of the first sign."""

    table: tuple[float, ...]

    def of(self, signs: Column) -> Column:
        """Mean over the bigrams of a string that has two signs at least."""
        table = F.lit(list(self.table)).cast("array<double>") if self.table else F.array().cast("array<double>")
        places = F.transform(F.filter(F.split(signs, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SIGNS), c) - 1)
        return _let(
            places,
            lambda p: F.aggregate(
                F.sequence(F.lit(1), F.size(p) - 1),
                F.lit(0.0),
                lambda total, i: total + F.coalesce(F.get(table, F.get(p, i - 1) * len(SIGNS) + F.get(p, i)), F.lit(0.0)),
            )
            / (F.size(p) - 1),
        )


def _bigrams(strings: DataFrame) -> DataFrame:
    """(random, bigram) of the strings in ``s``."""
    each = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2)))
    return strings.filter(F.length("s") >= 2).select("random", F.explode(each).alias("bigram"))


def fit(texts: DataFrame, settings: Settings = Settings()) -> Ratios:
    """Ratios from (doc_id, text). Words of the sampled texts are ordinary, except those the patterns find.

    The sample is about ``sample_docs`` distinct texts, chosen by their hash: a text that many
    rows repeat is one of them or none.
    Words count as they stand and in capitals, so that shouting is not taken for random.
    At most the square of the number of signs reaches the driver, twice.
    """
    keyed = texts.select("text", F.xxhash64("text").alias("spread"))
    distinct = keyed.agg(F.approx_count_distinct("spread", 0.02)).first()[0]
    share = F.lit(settings.sample_docs / max(1.0, 0.9 * distinct))  # few texts, give or take the error of the count, are all taken
    sample = keyed.filter(hash_share(F.col("spread"), share)).groupBy("spread").agg(F.min("text").alias("text"))
    # value of an assignment, access keys, hex runs
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), 2), F.regexp_extract_all("text", F.lit(ACCESS), 0), F.regexp_extract_all("text", F.lit(HEX), 0))
    random = sample.filter(F.col("text").rlike(ANY_BASE)).select(F.explode(values).alias("s")).filter(F.length("s") >= 12)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select(F.explode(F.split(plain, r"[^A-Za-z0-9+/_=-]+")).alias("s")).filter(F.length("s") >= settings.word_signs)
    both = random.select(F.lit(True).alias("random"), "s").union(words.select(F.lit(False), F.explode(F.array("s", F.upper("s")))))
    counts: dict[tuple[bool, str], int] = {
        (r["random"], r["bigram"]): r["n"]
        for r in _bigrams(both).filter(F.col("bigram").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "bigram").agg(F.count("*").alias("n")).collect()
    }
    table = []
    for a in SIGNS:
        logs = []
        for random_, smooth in ((True, settings.smooth_random), (False, settings.smooth_ordinary)):
            row = [counts.get((random_, a + b), 0) + smooth for b in SIGNS]
            logs.append([math.log(n / sum(row)) for n in row])
        table += [x - y for x, y in zip(*logs)]
    return Ratios(tuple(table))


# ---------------------------------------------------------------- scan


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans; all other places stay."""

    def step(done: Column, s: Column) -> Column:
        begin = F.greatest(done["at"], s["start"])
        kept = F.substr(text, done["at"] + 1, begin - done["at"])
        blanks = F.repeat(F.lit(" "), F.greatest(s["end"] - begin, F.lit(0)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], kept, blanks).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.array_sort(spans), first, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _scan_rows(rows: DataFrame, settings: Settings, ratios: Ratios) -> DataFrame:
    """The columns of ``rows``, of which ``text`` is searched, and the spans of each kind."""
    run = rf"[A-Za-z0-9+/_=-]{{{settings.least_signs},}}"
    part = rf"[A-Za-z0-9+]{{{settings.least_signs},}}"
    signs = lambda m: F.size(F.array_distinct(F.split(m, "")))
    value = lambda m: F.when(signs(m) >= settings.least_distinct, ratios.of(m)).otherwise(-1e9)
    text = F.coalesce("text", F.lit(""))

    def spans(base: Column) -> Column:
        taken = F.concat(*[base[k] for k in KINDS[:3]])
        random = lambda rest, pattern: F.filter(_found(rest, pattern, value), lambda s: s["value"] > settings.threshold)

        def more(rest: Column) -> Column:
            """Runs between the other spans, and parts of the other runs between their / _ = - signs."""
            inside = lambda s, runs: F.exists(runs, lambda r: (r["start"] <= s["start"]) & (s["end"] <= r["end"]))
            return _let(random(rest, run), lambda runs: F.concat(runs, F.filter(random(rest, part), lambda s: ~inside(s, runs))))

        markov = F.when(text.rlike(run), _let(_blanked(text, taken), more)).otherwise(F.array().cast(SPAN))
        return F.struct(*[base[k].alias(k) for k in KINDS[:3]], markov.alias("markov"))

    return rows.select("*", F.inline(F.transform(F.array(_base(text)), spans)))


def scan(docs: DataFrame, settings: Settings = Settings(), ratios: Ratios | None = None) -> DataFrame:
    """(doc_id, text, assign, access, hex, markov): the spans of every kind of every row.

    ``markov`` has random strings that touch no other span: what a run of signs has between
    such spans, or its parts between / _ = - where the whole does not look random. The spans come out of
    ``inline``, so later columns and filters do not search the texts again.
    """
    texts = doc_texts(docs)
    return _scan_rows(texts, settings, ratios or fit(texts, settings))


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans, by start and then by kind, joined."""
    place = lambda n: lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))
    ranked = [F.transform(F.col(k), place(n)) for n, k in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(F.concat(*ranked)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_secret_scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Spans of secrets in every row of ``docs`` (doc_id, text).

    Null and empty texts have none. Rows that repeat are scanned each by itself; an empty
    table gives no rows.
    """
    found = scan(docs, settings)
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"),
    )


def redacted(mark: str = "[SECRET]") -> Column:
    """The text of a row of ``scan`` with ``mark`` in place of each span; overlapping spans are one."""
    edges = [F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]
    text = F.col("text")

    def step(done: Column, s: Column) -> Column:
        more = F.concat(done["out"], F.substr(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mark))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] < done["at"], done["out"]).otherwise(more).alias("out")
        )

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    spans = F.array_sort(F.concat(*edges))
    whole = F.aggregate(spans, first, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def secret_stage(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All rows, their secrets replaced by a mark; ``n_chars`` follows where the table has it.

    Null texts stay null, other columns stay as they are.
    """
    names, types = docs.columns, dict(docs.dtypes)
    kept = [F.col(n).alias(f"__{i}") for i, n in enumerate(names) if n not in ("text", "n_chars")]
    ratios = fit(doc_texts(docs), settings)
    carried = docs.select("text", F.struct(F.col("text").isNull().alias("null"), *kept).alias("__row"))
    # scan takes a number and a text; the row travels in place of the number
    found = _scan_rows(carried, settings, ratios).withColumn("__text", redacted())
    out = []
    for i, n in enumerate(names):
        if n == "text":
            out.append(F.when(~F.col("__row.null"), F.col("__text")).alias(n))
        elif n == "n_chars":
            out.append(F.when(~F.col("__row.null"), F.length("__text")).cast(types[n]).alias(n))
        else:
            out.append(F.col(f"__row.__{i}").alias(n))
    return found.select(*out)
