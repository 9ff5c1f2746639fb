"""Quality rules: a table of thresholds, compiled into one projection.

Everything is built-in functions over a row's own text: nothing is shuffled, and a text's
length is the only thing that a row's cost depends on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# Frequent words by language.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on this are from or an at have not he his but they she her".split(),
    "es": "la el de que y los las un una en no se por con para del al es lo como más su o pero sus le ha me si sin sobre".split(),
    "fr": "le la les un des du de et est une en que pour dans qui par sur au pas plus ne ce il elle son avec se sont mais ou".split(),
    "de": "der die das und ist den dem ein eine zu in von mit für auf im nicht sich auch als an es wie aus bei nach wird sind".split(),
}


@dataclass(frozen=True)
class Rule:
    """``numerator`` / ``denominator`` has to lie between ``least`` and ``most``, both included.

    A ratio over nothing is 0. ``denominator`` None takes the number as it is.
    """

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None


BASE = (
    Rule("short", "n_words", least=50),
    Rule("repeats", "n_repeat_words", "n_words", most=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2, most=15),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_known_words", least=0.02),
    Rule("capitals", "n_capitals", "word_chars", most=0.3),
    Rule("line_copies", "n_dup_lines", "n_lines", most=0.4),
)


def failed(rule: Rule) -> Column:
    """The rule as a comparison of products: no division, no rounding at the thresholds that are whole."""
    value = F.col(rule.numerator).cast("double")
    base = F.lit(1.0) if rule.denominator is None else F.col(rule.denominator).cast("double")
    sides = [value < base * rule.least] if rule.least is not None else []
    sides += [value > base * rule.most] if rule.most is not None else []
    return reduce(lambda a, b: a | b, sides, F.lit(False))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column) -> Column:
    """Words that lie in a window found twice or more; ``grams`` has a hash of each window of three words."""
    numbered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["g"] == x["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def step(found: Column, at: Column) -> Column:
        """Each window adds what the one before has not covered."""
        return F.struct((found["n"] + F.least(F.lit(3), at - found["last"])).alias("n"), at.cast("int").alias("last"))

    none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return _let(numbered, lambda pairs: F.aggregate(repeated(pairs), none, step, lambda found: found["n"]))


def _union(stop_words: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(w for listed in stop_words.values() for w in listed))


def _mostly_latin(text: Column) -> Column:
    """At least half of the letters are Latin; true for a text without letters."""
    letters, others = (F.length(F.regexp_replace(text, p, "")) for p in (r"\P{L}+", r"[\P{L}\p{IsLatin}]+"))
    return F.lit(2) * others <= letters


def measures(docs: DataFrame, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS) -> DataFrame:
    """(doc_id, the numbers that the rules compare) of every row; a null text has no word.

    ``n_known_words`` are the words of a text that ``stop_words`` can judge: all, if it has
    the text's ``lang``; none, if it has not. A row without ``lang`` is judged by the words
    of all languages if it is written in Latin letters, as all the lists are. The numbers come out of ``inline``, so a filter on them stays above and the words are
    split once.
    """
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, each).otherwise(F.array().cast("array<bigint>"))

    def by_language(known, unlisted: Column, untold: Column) -> Column:
        """``known`` of each listed language, ``unlisted`` for others, ``untold`` where none is named."""
        whens = reduce(lambda c, lang: c.when(F.col("lang") == lang, known(stop_words[lang])), stop_words, F.when(F.col("lang").isNull(), untold))
        return whens.otherwise(unlisted)

    def among(w: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(w, lambda x: F.lower(x).isin(list(listed))))

    def numbers(w: Column, ls: Column, g: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)),
            "n_symbols": without(SYMBOLS),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": F.when(F.size(g) > F.size(F.array_distinct(g)), _covered(g)).otherwise(0),
            "n_lines": F.size(ls),
            "n_stop_words": by_language(lambda listed: among(w, listed), F.lit(0), among(w, _union(stop_words))),
            "n_known_words": by_language(lambda listed: F.size(w), F.lit(0), F.when(_mostly_latin(F.col("text")), F.size(w)).otherwise(0)),
            "n_capitals": without(r"\p{Lu}+"),
        }
        return F.struct(*[v.cast("bigint").alias(k) for k, v in found.items()])

    row = F.transform(F.array(words), lambda w: _let(lines, lambda ls: _let(windows(w), lambda g: numbers(w, ls, g))))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    return given.select("doc_id", F.inline(row))


def op7_sql() -> str:
    """The same in SQL, with windows of words as texts instead of hashes."""
    quoted = lambda listed: ", ".join(f"'{w}'" for w in listed)
    lists = " ".join(f"WHEN lang = '{lang}' THEN [{quoted(listed)}]" for lang, listed in STOP_WORDS.items())
    return rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce("text", '') AS t,
        CASE WHEN lang IS NULL THEN [{quoted(_union(STOP_WORDS))}] {lists} END AS listed,
        CASE WHEN lang IS NULL THEN len(regexp_extract_all(t, '\p{{L}}')) <= 2 * len(regexp_extract_all(t, '\p{{Latin}}')) ELSE listed IS NOT NULL END AS known
    FROM documents),
parts AS (
    SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda w: w <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls
    FROM texts),
windows AS (
    SELECT row_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS g
    FROM parts, unnest(range(1, len(ws) - 1)) AS r(i)),
repeated AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM windows),
covered AS (
    SELECT row_id, count(DISTINCT i + d) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(d) WHERE n > 1 GROUP BY row_id),
measured AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        CASE WHEN listed IS NULL THEN 0 ELSE len(list_filter(ws, lambda w: list_contains(listed, lower(w)))) END AS n_stop_words,
        CASE WHEN known THEN len(ws) ELSE 0 END AS n_known_words,
        length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_capitals
    FROM parts LEFT JOIN covered AS c USING (row_id)),
judged AS (
    SELECT *, concat_ws(',',
        CASE WHEN n_words < 50 THEN 'short' END,
        CASE WHEN n_repeat_words > n_words * 0.5::DOUBLE THEN 'repeats' END,
        CASE WHEN word_chars < n_words * 2 OR word_chars > n_words * 15 THEN 'word_length' END,
        CASE WHEN n_symbols > n_words * 0.1::DOUBLE THEN 'symbols' END,
        CASE WHEN n_stop_words < n_known_words * 0.02::DOUBLE THEN 'stop_words' END,
        CASE WHEN n_capitals > word_chars * 0.3::DOUBLE THEN 'capitals' END,
        CASE WHEN n_dup_lines > n_lines * 0.4::DOUBLE THEN 'line_copies' END) AS failed_rules
    FROM measured)
SELECT *, n_words < 50 OR n_repeat_words > n_words * 0.5::DOUBLE AS base_failed, failed_rules = '' AS kept FROM judged
"""


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``measured`` with ``base_failed``, ``kept`` and the names of the rules that failed, joined."""
    any_of = lambda table: reduce(lambda a, b: a | b, map(failed, table), F.lit(False))
    names = F.array(*[F.when(failed(r), r.name) for r in (*base, *rules)])
    return measured.select(
        "*", any_of(base).alias("base_failed"), (~any_of((*base, *rules))).alias("kept"), F.array_join(names, ",").alias("failed_rules")
    )


def op7_quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS
) -> DataFrame:
    """Verdict on every row of ``docs`` (doc_id, text and, if there, lang).

    Null and empty texts have no word and fail. Rows that repeat are judged each by
    itself; an empty table gives no rows. No text fails for being long, nor by the stop
    words of a language that ``stop_words`` does not have.
    """
    return judge(measures(docs, stop_words), rules)
