"""Personal data replaced by surrogates of the same type.

A surrogate is a keyed permutation of the entity: signs are exchanged for signs of their
own kind (digit, small or capital letter of the same script), first names for first names
of the same script and gender, addresses of four bytes for such addresses. Because every
step can be undone with the key, two entities never get one surrogate, and an entity gets
the same one wherever it stands. The signs are moved on between the rounds and the rounds
undone, so no entity with a letter or digit stays as it is. Other words are permuted among
the words that are no listed first names: one that falls on a listed name is permuted on
until it leaves the list. Nothing of this depends on the texts, so no text has to be
searched before the one pass that replaces. Collisions are ruled out beforehand, for the
key and the lists alone (:func:`settle`).

Check digits of cards and accounts are computed anew; what was valid stays valid.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First names by script and gender, titles by gender.
FIRST_NAMES = {
    "latin male": "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul peter hans klaus jürgen pierre jean luc carlos juan pedro miguel",
    "latin female": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra anna julia ursula monika marie sophie claire camille maría carmen lucía elena",
    "cyrillic male": "иван пётр алексей дмитрий сергей андрей михаил николай владимир павел",
    "cyrillic female": "анна мария елена ольга наталья татьяна ирина светлана екатерина юлия",
    "greek male": "γιώργος δημήτρης κώστας γιάννης νίκος παναγιώτης",
    "greek female": "μαρία ελένη αικατερίνη βασιλική σοφία αγγελική",
}
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme)\.?"
SIGNS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ",
)

# The domain is one class of signs: a repeated group would take a frame of the stack for each label.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\dA-Za-z])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\dA-Za-z])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
# Words of names: Smith, McDonald, O'Brien, Smith-Jones, SMITH; up to four of them, all but the last may be initials.
# A title that another name follows is none of them.
NAME_WORD = rf"(?!{TITLES} \p{{Lu}})\p{{Lu}}[\p{{L}}\p{{M}}'’-]++"
NAME_WORDS = rf"(?:(?:{NAME_WORD}|\p{{Lu}}\.?) ){{0,3}}(?:{NAME_WORD}|\p{{Lu}}\.)"
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "name")


def _name_pattern() -> str:
    given = "|".join(n.capitalize() for names in FIRST_NAMES.values() for n in names.split())
    word = r"(?<![\p{L}\d])"
    return rf"{word}(?:{TITLES} {NAME_WORDS}|(?:{given}) (?:(?:{NAME_WORD}|\p{{Lu}}\.?) ){{0,2}}(?:{NAME_WORD}|\p{{Lu}}\.))(?![\p{{L}}\d])"


NAME = _name_pattern()
PATTERNS = dict(zip(KINDS, (EMAIL, IP, IBAN, CARD, SSN, PHONE, NAME)))
# All but the first begin with a digit, a capital or one of two signs, which most places of a
# text are not. The group of a card's separator is the only one.
ANY = rf"{EMAIL}|(?=[\d+(\p{{Lu}}])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in KINDS[1:])})"


@dataclass(frozen=True)
class Settings:
    """``key`` decides all surrogates; keep it secret, and keep it to get the same ones again."""

    key: str = "change me"
    rounds: int = 4


# ---------------------------------------------------------------- permutations


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _number(seed: Column, digits: int = 12) -> Column:
    return F.conv(F.substr(F.sha2(seed, 256), F.lit(1), F.lit(digits)), 16, 10).cast("bigint")


ALL_SIGNS = "".join(SIGNS)
# of each sign: where its kind begins, and how many signs the kind has
BEGINS = [ALL_SIGNS.index(kind) for kind in SIGNS for _ in kind]
SIZES = [len(kind) for kind in SIGNS for _ in kind]


def _other_letters() -> list[str]:
    """Capital and small letters beyond ``SIGNS`` by script, case and block of 256; where a block has only one, by case."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for letter in map(chr, range(128, sys.maxunicode + 1)):
        case = unicodedata.category(letter)
        if case in ("Lu", "Ll") and letter not in ALL_SIGNS:
            script = unicodedata.name(letter, "").split(" ")[0]
            groups.setdefault((case, script, f"{ord(letter) >> 8}"), []).append(letter)
    for key in [k for k, letters in groups.items() if len(letters) == 1]:
        groups.setdefault(key[:1], []).extend(groups.pop(key))
    return ["".join(letters) for letters in groups.values()]


OTHER = _other_letters()
OTHER_SIGNS = "".join(OTHER)
OTHER_MARKS = "".join(chr(0x4E00 + n) for n in range(len(OTHER)))  # one for each kind
OTHER_KINDS = "".join(mark * len(kind) for mark, kind in zip(OTHER_MARKS, OTHER))  # of each letter
OTHER_PLACES = "".join(f"{OTHER_SIGNS.index(kind):04}{len(kind):04}" for kind in OTHER)


def _shifted_other(sign: Column, by: Column) -> Column:
    """As ``_shifted``, for the letters that are not in ``SIGNS``."""

    def moved(at: Column) -> Column:
        kind = F.instr(F.lit(OTHER_MARKS), F.substr(F.lit(OTHER_KINDS), at + 1, F.lit(1))) - 1
        begin, size = (F.substr(F.lit(OTHER_PLACES), kind * 8 + n, F.lit(4)).cast("int") for n in (1, 5))
        return F.when(at < 0, sign).otherwise(F.substr(F.lit(OTHER_SIGNS), begin + F.pmod(at - begin + by, size) + 1, F.lit(1)))

    return F.when(sign <= "\x7f", sign).otherwise(_let(F.instr(F.lit(OTHER_SIGNS), sign) - 1, moved))


def _shifted(sign: Column, by: Column) -> Column:
    """``sign`` moved on by ``by`` places among the signs of its kind."""
    begins, sizes = F.lit(BEGINS).cast("array<int>"), F.lit(SIZES).cast("array<int>")

    def moved(at: Column) -> Column:
        begin = F.get(begins, at)
        return F.when(at < 0, _shifted_other(sign, by)).otherwise(
            F.substr(F.lit(ALL_SIGNS), begin + F.pmod(at - begin + by, F.get(sizes, at)) + 1, F.lit(1))
        )

    return _let(F.instr(F.lit(ALL_SIGNS), sign) - 1, moved)


def permuted(text: Column, seed: Column, rounds: int) -> Column:
    """A permutation of the strings that have the same kind of sign at each place.

    In turn each half is shifted by a stream that the other half and the seed decide, so
    each step can be undone. Then every sign is moved on by one, and the turns are undone:
    two strings that differ by one move are never one, so none stays that has a sign to
    move. Without rounds all stays.
    """

    def turn(sense: int) -> Callable[[Column, Column], Column]:
        def step(signs: Column, n: Column) -> Column:
            cut = F.size(signs).cast("int") - F.floor(F.size(signs) / 2).cast("int")
            first, rest = F.slice(signs, F.lit(1), cut), F.slice(signs, cut + 1, F.size(signs) - cut)
            odd = n % 2 == 1
            moving, still = F.when(odd, rest).otherwise(first), F.when(odd, first).otherwise(rest)
            blocks = F.sequence(F.lit(0), F.floor(F.size(moving) / 32).cast("int"))
            half = F.array_join(still, "")
            # a long half is hashed once, not once a block
            mark = F.concat_ws("|", seed, n.cast("string"), F.when(F.length(half) <= 64, half).otherwise(F.sha2(half, 256)))
            stream = _let(mark, lambda fixed: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", fixed, b.cast("string")), 256)))
            by = lambda bits, i: F.conv(F.substr(F.get(bits, F.floor(i / 32).cast("int")), i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            new = _let(stream, lambda bits: F.transform(moving, lambda c, i: _shifted(c, by(bits, i) * sense)))
            return F.when(odd, F.concat(first, new)).otherwise(F.concat(new, rest))

        return step

    out = F.filter(F.split(text, ""), lambda c: c != "")
    if rounds:
        turns = [F.lit(n) for n in range(rounds)]
        out = F.aggregate(F.array(*turns), out, turn(1))
        out = F.transform(out, lambda c: _shifted(c, F.lit(1)))
        out = F.aggregate(F.array(*reversed(turns)), out, turn(-1))
    return F.array_join(out, "")


def _ip(m: Column, seed: Column, rounds: int) -> Column:
    """Rounds over the two halves of the 32 bits, one added to the number they make, and the rounds undone: none stays."""
    part = lambda n: F.get(F.split(m, r"\."), F.lit(n)).cast("bigint")
    out = F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b"))
    mask = lambda tag, half: _number(F.concat_ws("|", seed, F.lit(tag), half.cast("string")), 4)

    def turn(tag: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["b"].alias("a"), x["a"].bitwiseXOR(mask(tag, x["b"])).alias("b"))

    def back(tag: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["b"].bitwiseXOR(mask(tag, x["a"])).alias("a"), x["a"].alias("b"))

    if rounds:
        for n in range(rounds):
            out = _let(out, turn(str(n)))
        one_more = lambda v: F.struct(F.floor(v / 65536).alias("a"), (v % 65536).alias("b"))
        out = _let(out, lambda x: _let((x["a"] * 65536 + x["b"] + 1) % (1 << 32), one_more))
        for n in reversed(range(rounds)):
            out = _let(out, back(str(n)))
    number = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return _let(out, lambda x: F.concat_ws(".", number(x["a"]), number(x["b"])))


def _given(word: Column, seed: Column) -> Column:
    """Another first name of the same list, by a rotation that the key decides; null for other words."""
    found = F.lit(None).cast("string")
    for group, names in FIRST_NAMES.items():
        listed = [n.capitalize() for n in names.split()]
        pool = F.array(*[F.lit(n) for n in listed])
        turn = _number(F.concat_ws("|", seed, F.lit(group))) % (len(listed) - 1) + 1
        at = F.array_position(pool, word)
        found = F.when(at > 0, F.get(pool, ((at - 1 + turn) % len(listed)).cast("int"))).otherwise(found)
    return found


LISTED = sorted({n.capitalize() for names in FIRST_NAMES.values() for n in names.split()})


def _sign_kinds(word: str) -> tuple:
    """What a permutation keeps of a word: the kind of sign at each place."""
    return tuple(next((n for n, kind in enumerate(SIGNS) if c in kind), c) for c in word)


# A walk leaves the list after as many steps as there are listed names of one form.
MOST_STEPS = max(Counter(map(_sign_kinds, LISTED)).values())


def _moved(text: Column, seed: Column, rounds: int, word: Column) -> Column:
    """``text`` permuted; a ``word`` of a name on and on until it is no listed first name.

    On the words that are not listed this is a permutation itself, because a way that comes
    back to a listed name began at one.
    """
    steps = F.sequence(F.lit(0), F.when(word, F.lit(MOST_STEPS)).otherwise(F.lit(0)))
    return F.aggregate(steps, text, lambda w, n: F.when((n == 0) | w.isin(LISTED), permuted(w, seed, rounds)).otherwise(w))


# ---------------------------------------------------------------- entities

_PART = "struct<text:string,seed:string,word:boolean,stays:boolean>"


def _part(text: Column, seed: Column, *more: Column) -> Column:
    return F.struct(
        text.alias("text"), F.concat_ws("|", seed, *more).alias("seed"), F.lit(False).alias("word"), F.lit(False).alias("stays")
    ).cast(_PART)


def _name_parts(m: Column, seed: Column) -> Column:
    """The title at the head stays, first names are exchanged, other words are permuted; a family name has one surrogate with all first names."""

    def part(w: Column, i: Column) -> Column:
        ready = F.when((i == 0) & w.rlike(f"^{TITLES}$"), w).otherwise(_given(w, seed))
        family = F.concat_ws("|", seed, F.lit("family"))
        return F.struct(
            F.coalesce(ready, w).alias("text"), family.alias("seed"), F.lit(True).alias("word"), ready.isNotNull().alias("stays")
        ).cast(_PART)

    return F.transform(F.split(m, " "), part)


# An address: what is before the sign, its domain without the ending, the ending.
LOCAL, HOST, ENDING = "^(.*)@", r"@(.*)\.[^.]*$", r"\.[^.]*$"
COUNTRY = r"^(?:\+\d{1,3}(?=[ .(-])|\+\d|)"  # of a phone number


def _parts(m: Column, kind: Column, seed: Column) -> Column:
    """What of an entity is permuted, with the seed of each part: a domain has one surrogate in all its addresses."""
    local, host, ending = F.regexp_extract(m, LOCAL, 1), F.regexp_extract(m, HOST, 1), F.regexp_extract(m, ENDING, 0)
    country = F.regexp_extract(m, COUNTRY, 0)
    return (
        F.when(kind == "email", F.array(_part(local, seed, F.lit("local"), host, ending), _part(host, seed, F.lit("domain"), ending)))
        .when(kind == "name", _name_parts(m, seed))
        .when(kind == "card", F.array(_part(F.substr(m, F.lit(1), F.length(m) - 1), seed)))
        .when(kind == "iban", F.array(_part(F.substr(m, F.lit(5), F.length(m)), seed, F.substr(m, F.lit(1), F.lit(2)))))
        .when(kind == "ip", F.array().cast(f"array<{_PART}>"))
        .otherwise(F.array(_part(F.substr(m, F.length(country) + 1, F.length(m)), seed, country)))
    )


def _luhn(digits: Column) -> Column:
    """Check digit of the 15 digits of a card."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    places = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.struct(i.alias("i"), F.substr(digits, i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(places, F.lit(0), lambda acc, p: acc + F.when(p["i"] % 2 == 1, doubled(p["d"])).otherwise(p["d"]))
    return F.pmod(-total, F.lit(10))


def _last_digit(m: Column, body: Column) -> Column:
    """Of a card whose other signs are now ``body``: as far from the check digit as it was, so a valid card stays valid."""
    plain = lambda t: F.regexp_replace(t, "[^0-9]", "")
    off = F.substr(m, F.length(m), F.lit(1)).cast("int") - _luhn(F.substr(plain(m), F.lit(1), F.lit(15)))
    return F.pmod(_luhn(plain(body)) + off, F.lit(10)).cast("string")


def _account_check(country: Column, account: Column) -> Column:
    """The two check digits, as a number, of an account of a country."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    signs = F.filter(F.split(F.concat(F.replace(account, F.lit(" "), F.lit("")), country, F.lit("00")), ""), lambda c: c != "")
    rest = F.aggregate(signs, F.lit(0), lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return 98 - rest


def _check_digits(m: Column, account: Column) -> Column:
    """Of an account that is now ``account``: as far from the right ones as they were."""
    country = F.substr(m, F.lit(1), F.lit(2))
    off = F.substr(m, F.lit(3), F.lit(2)).cast("int") - _account_check(country, F.substr(m, F.lit(5), F.length(m)))
    return F.lpad(F.pmod(_account_check(country, account) + off, F.lit(100)).cast("string"), 2, "0")


def kind_of(m: Column) -> Column:
    """Kind of a match of ``ANY``: the first whose pattern is the whole of it."""
    kinds = [(F.lit(k), m.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    return reduce(lambda rest, k: F.when(k[1], k[0]).otherwise(rest), reversed(kinds), F.lit(KINDS[-1]))


def surrogate(m: Column, settings: Settings, tweak: int) -> Column:
    """The surrogate of a match of ``ANY``. The permutation stands in the plan once, for the parts of all kinds."""
    rounds = settings.rounds

    def made(kind: Column) -> Column:
        seed = F.concat(F.lit(f"{settings.key}|{tweak}|"), kind)
        move = lambda p: F.when(p["stays"], p["text"]).otherwise(_moved(p["text"], p["seed"], rounds, p["word"]))

        def whole(new: Column) -> Column:
            first = F.get(new, F.lit(0))
            return (
                F.when(kind == "email", F.concat(first, F.lit("@"), F.get(new, F.lit(1)), F.regexp_extract(m, ENDING, 0)))
                .when(kind == "ip", _ip(m, seed, rounds))
                .when(kind == "name", F.array_join(new, " "))
                .when(kind == "card", F.concat(first, _last_digit(m, first)))
                .when(kind == "iban", F.concat(F.substr(m, F.lit(1), F.lit(2)), _check_digits(m, first), first))
                .otherwise(F.concat(F.regexp_extract(m, COUNTRY, 0), first))
            )

        return _let(F.transform(_parts(m, kind, seed), move), whole)

    return _let(kind_of(m), made)


# ---------------------------------------------------------------- Spark


def settle(spark: SparkSession, settings: Settings = Settings()) -> int:
    """The first tweak under which no word stays on its way round the listed first names.

    A word stays if all others on its cycle of the permutation are listed. Such a cycle has a
    listed name, so going on from each of them shows it: a question of the key and the
    lists, not of any text. Nearly always the answer is 0.
    """
    names = spark.createDataFrame([(n,) for n in LISTED], "listed string")
    for tweak in count():
        seed = F.lit(f"{settings.key}|{tweak}|name|family")
        after = F.transform(F.array("listed"), lambda w: _moved(w, seed, settings.rounds, F.lit(True)))
        words = names.select(F.explode(after).alias("word"))
        following = F.transform(F.array("word"), lambda w: _moved(w, seed, settings.rounds, F.lit(True)))
        if words.select("word", F.explode(following).alias("next")).filter("word = next").isEmpty():
            return tweak


def replace(docs: DataFrame, settings: Settings = Settings(), tweak: int = 0) -> DataFrame:
    """(doc_id, text, n_entities) of every row, all entities replaced. A row's text is searched once and never leaves its task."""
    text = F.col("text")
    both = F.struct(F.split(text, ANY, -1).alias("between"), F.regexp_extract_all(text, F.lit(ANY), 0).alias("match"))
    joined = lambda x: F.array_join(
        F.transform(x["between"], lambda t, i: F.concat(t, F.coalesce(surrogate(F.get(x["match"], i), settings, tweak), F.lit("")))), ""
    )
    row = lambda x: F.struct(joined(x).alias("text"), F.size(x["match"]).cast("bigint").alias("n_entities"))
    clean = F.array(F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n_entities")))
    # a null text stays null; a text without an entity is passed on
    made = F.when(text.rlike(ANY), F.transform(F.array(both), row)).otherwise(clean)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select("doc_id", F.inline(made))


def op9_surrogates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with surrogates for personal data, and their number.

    Null texts stay null, with 0 entities; texts without an entity stay as they are. Rows
    that repeat get the same result; an empty table gives no rows. Very long texts and very
    long entities take time in proportion to their length. Other columns are not read.
    """
    return replace(docs, settings, settle(docs.sparkSession, settings))
