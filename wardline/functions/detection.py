"""Guessing from a column's name whether it is sensitive, and how to mask it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns per kind of sensitive data. The first kind that matches counts.
PII_TYPE_PATTERNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("SSN", ("%ssn%", "%social%security%")),
    ("EMAIL", ("%email%",)),
    ("DOB", ("%dob%", "%birth%date%", "%birthdate%")),
    ("PHONE", ("%phone%", "%mobile%", "%telephone%")),
    ("ADDRESS", ("%address%", "%street%", "%addr%")),
    ("FINANCIAL", ("%salary%", "%wage%", "%income%", "%amount%")),
    ("STUDENT_ID", ("%student%id%",)),
    ("PASSWORD", ("%password%", "%pwd%")),
    ("NAME", ("%name%",)),
)

# Name patterns per suggested masking policy. The first match counts.
SUGGESTED_POLICY_PATTERNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("SSN_MASK", ("%ssn%",)),
    ("EMAIL_MASK", ("%email%",)),
    ("DOB_MASK", ("%dob%", "%birth%")),
    ("PHONE_MASK", ("%phone%",)),
    ("ADDRESS_MASK", ("%address%",)),
    ("FINANCIAL_AMOUNT_MASK", ("%amount%",)),
    ("STUDENT_ID_MASK", ("%student%id%",)),
    ("NAME_MASK", ("%name%",)),
)

# Names that put a column on the review list. Narrower than the kinds above.
REVIEW_PATTERNS = (
    "%ssn%",
    "%social%",
    "%email%",
    "%dob%",
    "%birth%",
    "%phone%",
    "%address%",
    "%salary%",
    "%amount%",
    "%student%id%",
    "%password%",
)
NAME_PATTERN = "%name%"  # counts in the curated layers only

UNKNOWN_TYPE = "REVIEW"
NO_SUGGESTION = "REVIEW_NEEDED"


def name_like(name: Column, patterns: Sequence[str]) -> Column:
    lowered = F.lower(name)
    return reduce(or_, (lowered.like(p) for p in patterns))


def _first_match(branches: Sequence[tuple[Column, str]], default: str) -> Column:
    return F.coalesce(*(F.when(condition, label) for condition, label in branches), F.lit(default))


def pii_type(name: Column, in_curated_layer: Column) -> Column:
    """Kind of sensitive data the name points to, or REVIEW."""
    branches = []
    for label, patterns in PII_TYPE_PATTERNS:
        matches = name_like(name, patterns)
        branches.append((matches & in_curated_layer if label == "NAME" else matches, label))
    return _first_match(branches, UNKNOWN_TYPE)


def suggested_policy(name: Column) -> Column:
    """Masking policy the name points to, or REVIEW_NEEDED."""
    return _first_match(
        [(name_like(name, patterns), label) for label, patterns in SUGGESTED_POLICY_PATTERNS], NO_SUGGESTION
    )


def on_review_list(name: Column, in_curated_layer: Column) -> Column:
    return name_like(name, REVIEW_PATTERNS) | (name_like(name, (NAME_PATTERN,)) & in_curated_layer)
