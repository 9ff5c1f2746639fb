"""Masking policies as role-specialised Column expressions.

A policy lists what each role group sees, in order. The role is known when the
plan is built, so the branch is chosen here and only that branch's expression
enters the plan: nothing is left for the executors to compare, and a role that
sees a constant never reads the column at all. Roles match exactly; inheritance
between roles does not widen what a policy shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.roles import (
    ADMINS,
    DATA_ANALYST,
    ENGINEERS,
    ENROLLMENT_ANALYST,
    FINANCIAL_AID_ANALYST,
    IR_ANALYST,
    REGISTRAR_ANALYST,
)

MaskExpr = Callable[[Column, T.DataType], Column]


@dataclass(frozen=True)
class View:
    """What one group of roles sees. ``raw`` marks unmasked access."""

    roles: tuple[str, ...]
    expr: MaskExpr
    raw: bool = False


@dataclass(frozen=True)
class MaskingPolicy:
    name: str
    accepts: tuple[type[T.DataType], ...]
    views: tuple[View, ...]  # the last one is for every other role
    constants: tuple[str, ...] = ()  # outputs that carry nothing of the value

    def view_index(self, role: str) -> int:
        for i, view in enumerate(self.views[:-1]):
            if role in view.roles:
                return i
        return len(self.views) - 1

    def view_for(self, role: str) -> View:
        return self.views[self.view_index(role)]

    def mask(self, value: Column, role: str, dtype: T.DataType) -> Column:
        """The column as ``role`` sees it, with the type it came with."""
        if not isinstance(dtype, self.accepts):
            raise TypeError(f"{self.name} does not apply to a column of type {dtype.simpleString()}")
        return self.view_for(role).expr(value, dtype)


def _raw(value: Column, dtype: T.DataType) -> Column:
    return value


def _constant(text: str) -> MaskExpr:
    return lambda value, dtype: F.lit(text)


def _null(value: Column, dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def _last(n: int, prefix: str) -> MaskExpr:
    return lambda value, dtype: F.concat(F.lit(prefix), F.right(value, F.lit(n)))


def _email_domain(value: Column, dtype: T.DataType) -> Column:
    # The text before the first @ becomes ***; a value starting with @, or empty, has no such text.
    at = F.locate("@", value)
    return (
        F.when(at > 1, F.concat(F.lit("***"), F.substring(value, at, F.length(value))))
        .when((at == 1) | (value == ""), value)
        .when(value.isNotNull(), F.lit("***"))
    )


def _year_start(value: Column, dtype: T.DataType) -> Column:
    return F.trunc(value, "YEAR")


# Telephone formats. They describe the whole value.
PHONE_DASHED = r"\d{3}-\d{3}-\d{4}"
PHONE_BRACKETED = r"\(\d{3}\)\s*\d{3}-\d{4}"
PHONE_AREA_ONLY = r"\(\d{3}\)"


def _is_exactly(value: Column, pattern: str) -> Column:
    # rlike searches, and $ would accept a trailing line feed.
    return value.rlike(rf"\A(?:{pattern})\z")


def _phone_area(value: Column, dtype: T.DataType) -> Column:
    # A full match fixes where the area code stands, so no group needs capturing.
    return (
        F.when(_is_exactly(value, PHONE_DASHED), F.concat(F.left(value, F.lit(3)), F.lit("-XXX-XXXX")))
        .when(_is_exactly(value, PHONE_BRACKETED), F.concat(F.left(value, F.lit(5)), F.lit(" XXX-XXXX")))
        .otherwise("XXX-XXX-XXXX")
    )


def _phone_format(value: Column, dtype: T.DataType) -> Column:
    return (
        F.when(_is_exactly(value, PHONE_DASHED), "XXX-XXX-XXXX (formatted)")
        .when(_is_exactly(value, PHONE_AREA_ONLY), "(XXX) XXX-XXXX (formatted)")
        .otherwise("XXXXXXXXXX (unformatted)")
    )


def _locality(value: Column, dtype: T.DataType) -> Column:
    # (?d): only a line feed ends a line, and . does not cross it. Without a match the value stays.
    return F.when(
        F.contains(value, F.lit(",")),
        F.regexp_replace(value, r"(?d)\A[^,]+,\s*(.*)\z", "*** $1"),
    ).otherwise("*** (Address)")


def _locality_strict(value: Column, dtype: T.DataType) -> Column:
    out = _locality(value, dtype)
    return F.when(out == value, "*** (Address)").otherwise(out)


def _rounded(digits: int) -> MaskExpr:
    # Rounding up may leave the column's precision: such a value becomes NULL instead of failing the read.
    return lambda value, dtype: F.round(value, digits).try_cast(dtype)


def _initials(value: Column, dtype: T.DataType) -> Column:
    # The second part starts after the first space; it is empty if another space follows.
    space = F.locate(" ", value)
    first = F.left(value, F.lit(1))
    second = F.trim(F.substring(value, space + 1, F.lit(1)))
    return F.when(space > 0, F.concat(first, F.lit(". "), second, F.lit("."))).otherwise(
        F.concat(first, F.lit("."))
    )


_TEXT = (T.StringType,)
_DATE = (T.DateType,)
_NUMBER = (T.NumericType,)


def _view(*roles: str | Iterable[str], expr: MaskExpr) -> View:
    names = tuple(n for r in roles for n in ((r,) if isinstance(r, str) else r))
    return View(names, expr, raw=expr is _raw)


def _others(expr: MaskExpr) -> View:
    return View((), expr)


# Who sees what, and the replacement texts, are fixed values.
SSN_MASK = MaskingPolicy(
    "SSN_MASK",
    _TEXT,
    (
        _view(ADMINS, FINANCIAL_AID_ANALYST, REGISTRAR_ANALYST, expr=_raw),
        _view(ENGINEERS, expr=_last(4, "XXX-XX-")),
        _others(_constant("XXX-XX-XXXX")),
    ),
    constants=("XXX-XX-XXXX",),
)

EMAIL_MASK = MaskingPolicy(
    "EMAIL_MASK",
    _TEXT,
    (
        _view(
            ADMINS, ENROLLMENT_ANALYST, REGISTRAR_ANALYST, IR_ANALYST, FINANCIAL_AID_ANALYST, expr=_raw
        ),
        _view(ENGINEERS, expr=_email_domain),
        _others(_constant("***@***.***")),
    ),
    constants=("***@***.***",),
)

DOB_MASK = MaskingPolicy(
    "DOB_MASK",
    _DATE,
    (
        _view(ADMINS, FINANCIAL_AID_ANALYST, REGISTRAR_ANALYST, expr=_raw),
        _view(IR_ANALYST, ENROLLMENT_ANALYST, DATA_ANALYST, ENGINEERS, expr=_year_start),
        _others(_null),
    ),
)

PHONE_MASK = MaskingPolicy(
    "PHONE_MASK",
    _TEXT,
    (
        _view(ADMINS, ENROLLMENT_ANALYST, REGISTRAR_ANALYST, FINANCIAL_AID_ANALYST, expr=_raw),
        _view(IR_ANALYST, expr=_phone_area),
        _view(ENGINEERS, expr=_phone_format),
        _others(_constant("XXX-XXX-XXXX")),
    ),
    constants=(
        "XXX-XXX-XXXX",
        "XXX-XXX-XXXX (formatted)",
        "(XXX) XXX-XXXX (formatted)",
        "XXXXXXXXXX (unformatted)",
    ),
)


def _address_policy(name: str, locality: MaskExpr) -> MaskingPolicy:
    return MaskingPolicy(
        name,
        _TEXT,
        (
            _view(ADMINS, REGISTRAR_ANALYST, FINANCIAL_AID_ANALYST, expr=_raw),
            _view(IR_ANALYST, ENROLLMENT_ANALYST, DATA_ANALYST, expr=locality),
            _view(ENGINEERS, expr=_constant("*** (Address Present)")),
            _others(_constant("***")),
        ),
        constants=("*** (Address)", "*** (Address Present)", "***"),
    )


ADDRESS_MASK = _address_policy("ADDRESS_MASK", _locality)

# As ADDRESS_MASK, but a value the locality rule cannot split is hidden instead of shown.
ADDRESS_MASK_STRICT = _address_policy("ADDRESS_MASK_STRICT", _locality_strict)

FINANCIAL_AMOUNT_MASK = MaskingPolicy(
    "FINANCIAL_AMOUNT_MASK",
    _NUMBER,
    (
        _view(ADMINS, FINANCIAL_AID_ANALYST, expr=_raw),
        _view(REGISTRAR_ANALYST, IR_ANALYST, expr=_rounded(-2)),
        _view(ENGINEERS, expr=_rounded(-3)),
        _others(_null),
    ),
)

STUDENT_ID_MASK = MaskingPolicy(
    "STUDENT_ID_MASK",
    _TEXT,
    (
        _view(
            ADMINS,
            REGISTRAR_ANALYST,
            ENROLLMENT_ANALYST,
            FINANCIAL_AID_ANALYST,
            IR_ANALYST,
            DATA_ANALYST,
            expr=_raw,
        ),
        _view(ENGINEERS, expr=_last(4, "ID_")),
        _others(_constant("XXXXXXXX")),
    ),
    constants=("XXXXXXXX",),
)

NAME_MASK = MaskingPolicy(
    "NAME_MASK",
    _TEXT,
    (
        _view(ADMINS, REGISTRAR_ANALYST, ENROLLMENT_ANALYST, FINANCIAL_AID_ANALYST, expr=_raw),
        _view(IR_ANALYST, DATA_ANALYST, expr=_initials),
        _view(ENGINEERS, expr=_last(1, "Student ")),
        _others(_constant("***")),
    ),
    constants=("***",),
)

MASKING_POLICIES: dict[str, MaskingPolicy] = {
    p.name: p
    for p in (
        SSN_MASK,
        EMAIL_MASK,
        DOB_MASK,
        PHONE_MASK,
        ADDRESS_MASK,
        ADDRESS_MASK_STRICT,
        FINANCIAL_AMOUNT_MASK,
        STUDENT_ID_MASK,
        NAME_MASK,
    )
}
