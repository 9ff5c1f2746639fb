"""The governance tables an estate is described by, gathered in one place."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import Clock, Estate
from wardline.sources import registry, schemas
from wardline.sources.object_facts import StoredFacts
from wardline.sources.query_log import read_query_history


def wall_clock(moment: datetime) -> Column:
    """A literal without a time zone, whatever zones the session and the driver are in."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


class Governance:
    """Metadata tables, the query log and the moment reports speak about.

    Tables are given as functions that open them and are opened when first used. The tag
    taxonomy, role grants and privileges are the standard ones unless given. A stored log
    may have facts on accessed objects beside it.
    """

    def __init__(
        self,
        spark: SparkSession,
        clock: Clock,
        estate: Estate = Estate(),
        stored_facts: StoredFacts | None = None,
        **tables: Callable[[], DataFrame],
    ):
        self.spark = spark
        self.stored_facts = stored_facts
        self.clock = clock
        self.estate = estate
        self._tables = {
            "tag_allowed_values": lambda: registry.tag_taxonomy(spark),
            "role_grants": lambda: registry.standard_role_grants(spark),
            "grants": lambda: registry.standard_grants(spark, estate),
            **tables,
        }

    def with_(self, clock: Clock | None = None, **tables: DataFrame) -> Governance:
        """The same estate at another moment, or with some tables replaced."""
        replaced = {name: (lambda df=df: df) for name, df in tables.items()}
        facts = None if "query_history" in tables else self.stored_facts  # they speak about the log they were made of
        return Governance(self.spark, clock or self.clock, self.estate, facts, **{**self._tables, **replaced})

    @cached_property
    def policy_references(self) -> DataFrame:
        return self._tables["policy_references"]()

    @cached_property
    def tag_references(self) -> DataFrame:
        return self._tables["tag_references"]()

    @cached_property
    def columns(self) -> DataFrame:
        return self._tables["columns"]()

    @cached_property
    def tables(self) -> DataFrame:
        return self._tables["tables"]()

    @cached_property
    def query_history(self) -> DataFrame:
        return self._tables["query_history"]()

    @cached_property
    def tag_allowed_values(self) -> DataFrame:
        return self._tables["tag_allowed_values"]()

    @cached_property
    def role_grants(self) -> DataFrame:
        return self._tables["role_grants"]()

    @cached_property
    def grants(self) -> DataFrame:
        return self._tables["grants"]()

    @cached_property
    def user_grants(self) -> DataFrame:
        return self._tables["user_grants"]()

    # -- scans shared by the views and audits ---------------------------------

    def masking_attachments(self) -> DataFrame:
        """Masking policies of the governance schema, wherever they are attached."""
        return self._governed_attachments(schemas.MASKING_KIND)

    def row_access_attachments(self) -> DataFrame:
        return self._governed_attachments(schemas.ROW_ACCESS_KIND)

    def attachments(self) -> DataFrame:
        """Masks and row policies together, told by ``policy_kind``."""
        return self._governed_attachments(schemas.MASKING_KIND, schemas.ROW_ACCESS_KIND)

    def _governed_attachments(self, *kinds: str) -> DataFrame:
        return self.policy_references.filter(
            F.col("policy_kind").isin(*kinds)
            & (F.col("policy_db") == self.estate.governance_database)
            & (F.col("policy_schema") == self.estate.governance_schema)
        )

    def live_tags(self) -> DataFrame:
        """Tag assignments of the governance schema on objects that still exist."""
        return self.tag_references.filter(
            (F.col("tag_database") == self.estate.governance_database)
            & (F.col("tag_schema") == self.estate.governance_schema)
            & F.col("object_deleted").isNull()
        )

    def production_columns(self, layers: tuple[str, ...]) -> DataFrame:
        return self.columns.filter(
            (F.col("table_catalog") == self.estate.production_database) & F.col("table_schema").isin(*layers)
        )

    def production_base_tables(self, layers: tuple[str, ...]) -> DataFrame:
        return self.tables.filter(
            (F.col("table_catalog") == self.estate.production_database)
            & F.col("table_schema").isin(*layers)
            & (F.col("table_type") == "BASE TABLE")
        )

    def history_since(self, days: int) -> DataFrame:
        """Queries started in the last ``days`` days up to the report's moment.

        The bounds are literals. A log stored by :func:`~wardline.sources.query_log.write_query_history` also has them on
        the partition column, so older days are not listed, let alone read.
        """
        start = self.clock.as_of - timedelta(days=days)
        recent = self.query_history.filter(
            F.col("start_time").between(wall_clock(start), wall_clock(self.clock.as_of))
        )
        if schemas.LOG_DATE in recent.columns:
            recent = recent.filter(F.col(schemas.LOG_DATE).between(F.lit(start.date()), F.lit(self.clock.as_of_date)))
        return recent

    def environment_history(self, days: int, layers: tuple[str, ...] | None = None) -> DataFrame:
        queries = self.history_since(days).filter(
            F.col("database_name").isin(*self.estate.environment_databases)
        )
        return queries if layers is None else queries.filter(F.col("schema_name").isin(*layers))


def read_governance(
    spark: SparkSession, path: str, clock: Clock, estate: Estate = Estate(), stored_facts: StoredFacts | None = None
) -> Governance:
    """The governance tables as parquet directories under ``path``, one per table.

    ``query_history`` is the folder :func:`write_query_history` of ``query_log`` fills;
    ``stored_facts`` may be those :func:`wardline.operators.access.stored_facts` keeps of it.
    """

    def table(name: str, schema: str):
        return lambda: spark.read.schema(schema).parquet(f"{path}/{name}")

    return Governance(
        spark,
        clock,
        estate,
        stored_facts,
        policy_references=table("policy_references", schemas.POLICY_REFERENCES),
        tag_references=table("tag_references", schemas.TAG_REFERENCES),
        columns=table("columns", schemas.COLUMNS),
        tables=table("tables", schemas.TABLES),
        user_grants=table("user_grants", schemas.USER_GRANTS),
        query_history=lambda: read_query_history(spark, f"{path}/query_history"),
    )
