"""Row access policies as role-specialised boolean Columns.

``RowPolicy.predicate`` returns a bare predicate for use in ``filter``: a row is
kept only where it is TRUE, so NULL hides the row. It is never wrapped in CASE,
which would keep it from being pushed into the file scan. Full and no access
come out as TRUE and FALSE literals, which Catalyst folds into "no filter" and
"no scan".
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.roles import (
    ADMINS,
    ANALYSTS,
    BUSINESS_SCHOOL_ANALYST,
    DATA_ANALYST,
    ENGINEERS,
    ENROLLMENT_ANALYST,
    FINANCIAL_AID_ANALYST,
    GRADUATE_ANALYST,
    IR_ANALYST,
    REGISTRAR_ANALYST,
    UNDERGRAD_ANALYST,
)

RowExpr = Callable[[Column, date], Column]


@dataclass(frozen=True)
class RowRule:
    roles: tuple[str, ...]
    expr: RowExpr


@dataclass(frozen=True)
class RowPolicy:
    name: str
    rules: tuple[RowRule, ...]  # a role in none of them sees nothing

    def predicate(self, column: Column, role: str, as_of: date) -> Column:
        for rule in self.rules:
            if role in rule.roles:
                return rule.expr(column, as_of)
        return F.lit(False)

    def apply(self, df: DataFrame, column: str, role: str, as_of: date) -> DataFrame:
        return df.filter(self.predicate(F.col(column), role, as_of))

    def allows(self, column: Column, role: str, as_of: date) -> Column:
        """The predicate as TRUE or FALSE, for counting instead of filtering."""
        return F.coalesce(self.predicate(column, role, as_of), F.lit(False))


def years_before(day: date, years: int) -> str:
    """``yyyy`` of the same day some years earlier."""
    return f"{day.year - years:04d}"


def months_before(day: date, months: int) -> str:
    """``yyyyMM`` of the same day some months earlier."""
    month = day.year * 12 + day.month - 1 - months
    return f"{month // 12:04d}{month % 12 + 1:02d}"


def _everything(column: Column, as_of: date) -> Column:
    return F.lit(True)


def _one_of(values: Sequence[str]) -> RowExpr:
    return lambda column, as_of: F.upper(column).isin(*values)


# Enrolment statuses each analyst role works with.
STATUSES_BY_ROLE: dict[str, tuple[str, ...]] = {
    ENROLLMENT_ANALYST: ("PROSPECTIVE", "ADMITTED", "ENROLLED", "DEPOSITED", "APPLIED"),
    REGISTRAR_ANALYST: ("ENROLLED", "GRADUATED", "WITHDRAWN", "LEAVE_OF_ABSENCE", "COMPLETED"),
    FINANCIAL_AID_ANALYST: ("ADMITTED", "ENROLLED", "DEPOSITED"),
    DATA_ANALYST: ("ENROLLED",),
}

DEPARTMENT_ACCESS, PROGRAM_TYPE_ACCESS = "DEPARTMENT_ACCESS", "PROGRAM_TYPE_ACCESS"

# Example roles limited to some departments or programme types. As rows of a
# table they are in ``registry.standard_entitlements``.
EXAMPLE_DEPARTMENTS: dict[str, tuple[str, ...]] = {
    BUSINESS_SCHOOL_ANALYST: ("ACCT", "FIN", "MGMT", "MKTG"),
}
EXAMPLE_PROGRAMS: dict[str, tuple[str, ...]] = {
    UNDERGRAD_ANALYST: ("UNDERGRADUATE",),
    GRADUATE_ANALYST: ("GRADUATE", "DOCTORAL"),
}

RECENT_YEARS = 2
RECENT_MONTHS = 24

_HISTORY_ROLES = ADMINS + (IR_ANALYST,) + ENGINEERS
_RECENT_ROLES = (ENROLLMENT_ANALYST, REGISTRAR_ANALYST, FINANCIAL_AID_ANALYST, DATA_ANALYST)

ENROLLMENT_ROW_ACCESS = RowPolicy(
    "ENROLLMENT_ROW_ACCESS",
    (RowRule(_HISTORY_ROLES, _everything),)
    + tuple(RowRule((role,), _one_of(statuses)) for role, statuses in STATUSES_BY_ROLE.items()),
)

ACTIVE_RECORDS_ONLY = RowPolicy(
    "ACTIVE_RECORDS_ONLY",
    (
        RowRule(ADMINS + ENGINEERS, _everything),
        RowRule(ANALYSTS, lambda column, as_of: column == F.lit(True)),
    ),
)

CURRENT_AY_ACCESS = RowPolicy(
    "CURRENT_AY_ACCESS",
    (
        RowRule(_HISTORY_ROLES, _everything),
        RowRule(_RECENT_ROLES, lambda column, as_of: column >= F.lit(years_before(as_of, RECENT_YEARS))),
    ),
)

# Term codes are year + term number; they are compared as text with a year + month.
CURRENT_TERM_ACCESS = RowPolicy(
    "CURRENT_TERM_ACCESS",
    (
        RowRule(_HISTORY_ROLES, _everything),
        RowRule(_RECENT_ROLES, lambda column, as_of: column >= F.lit(months_before(as_of, RECENT_MONTHS))),
    ),
)


def department_access(limited: Mapping[str, Sequence[str]] | None = None) -> RowPolicy:
    """All listed roles see every department; ``limited`` adds roles tied to some of them."""
    extra = tuple(
        RowRule((role,), (lambda codes: lambda column, as_of: column.isin(*codes))(tuple(codes)))
        for role, codes in (limited or {}).items()
    )
    return RowPolicy(
        DEPARTMENT_ACCESS, (RowRule(ADMINS + ENGINEERS + ANALYSTS, _everything),) + extra
    )


FERPA_CONSENT_ACCESS = RowPolicy(
    "FERPA_CONSENT_ACCESS",
    (
        RowRule(ADMINS + (REGISTRAR_ANALYST,) + ENGINEERS, _everything),
        RowRule(
            (ENROLLMENT_ANALYST, IR_ANALYST, FINANCIAL_AID_ANALYST, DATA_ANALYST),
            # No answer counts as consent.
            lambda column, as_of: (column == F.lit(True)) | column.isNull(),
        ),
    ),
)


def program_type_access(limited: Mapping[str, Sequence[str]] | None = None) -> RowPolicy:
    """All listed roles see every programme; ``limited`` adds roles tied to some types."""
    extra = tuple(RowRule((role,), _one_of(tuple(types))) for role, types in (limited or {}).items())
    return RowPolicy(
        PROGRAM_TYPE_ACCESS, (RowRule(ADMINS + ENGINEERS + ANALYSTS, _everything),) + extra
    )


ROW_POLICIES: dict[str, RowPolicy] = {
    p.name: p
    for p in (
        ENROLLMENT_ROW_ACCESS,
        ACTIVE_RECORDS_ONLY,
        CURRENT_AY_ACCESS,
        CURRENT_TERM_ACCESS,
        department_access(),
        FERPA_CONSENT_ACCESS,
        program_type_access(),
    )
}
