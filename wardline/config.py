"""Names of the governed estate: databases, layers and the governance schema."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

ENVIRONMENTS = ("DEV", "TEST", "PROD")
LAYERS = ("DEPOSIT", "DETERGE", "DISTRIBUTE")  # raw, cleaned, marts
CURATED_LAYERS = ("DETERGE", "DISTRIBUTE")


@dataclass(frozen=True)
class Estate:
    """Where governed data and governance objects live."""

    prefix: str = "ORG"
    governance_database: str = "GOV_DB"
    governance_schema: str = "GOVERNANCE"
    environments: tuple[str, ...] = ENVIRONMENTS
    layers: tuple[str, ...] = LAYERS
    curated_layers: tuple[str, ...] = CURATED_LAYERS

    def database(self, environment: str) -> str:
        return f"{self.prefix}_{environment}"

    @property
    def environment_databases(self) -> tuple[str, ...]:
        return tuple(self.database(e) for e in self.environments)

    @property
    def production_database(self) -> str:
        return self.database("PROD")


@dataclass(frozen=True)
class TableId:
    """Three-part name of a governed table."""

    database: str
    schema: str
    name: str


@dataclass(frozen=True)
class Clock:
    """The moment a report speaks about. Never taken from the machine clock."""

    as_of: datetime
    access_window_days: int = 30
    policy_window_days: int = 90

    @property
    def as_of_date(self) -> date:
        return self.as_of.date()


@dataclass(frozen=True)
class AccessThresholds:
    """Query counts above which a user's volume gets a label."""

    very_high: int = 1000
    high: int = 500
    moderate: int = 100


@dataclass(frozen=True)
class BusinessHours:
    """Hours that count as working time, and the days (0 = Monday) that do not."""

    opens: int = 6
    closes: int = 22
    weekend: tuple[int, ...] = (5, 6)
