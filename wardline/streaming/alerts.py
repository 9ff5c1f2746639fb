"""Access alerts on a live query log.

The log arrives as a stream of ``query_history`` rows. Each check is the batch
audit's own expression on that stream, so stream and batch agree. What a stream has
found is kept in levelled sinks (:mod:`wardline.sources.levels`), whose number of files
does not grow with the number of micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.access import METADATA_TYPES, sensitive_tables
from wardline.plans.audits import access_level, after_hours_accesses, is_policy_change
from wardline.sources.estate_tables import Governance
from wardline.sources.levels import LevelledSink

ALERT_COLUMNS = ["query_id", "user_name", "role_name", "schema_name", "table_name", "start_time", "query_text"]


def _environment(gov: Governance, history: DataFrame) -> DataFrame:
    return history.filter(F.col("database_name").isin(*gov.estate.environment_databases))


def after_hours_alerts(gov: Governance, history: DataFrame) -> DataFrame:
    """After-hours SELECTs on sensitive tables in a batch of the log."""
    return after_hours_accesses(_environment(gov, history), sensitive_tables(gov)).select(*ALERT_COLUMNS)


def alert_sink(spark: SparkSession, root: str) -> LevelledSink:
    return LevelledSink(spark, root)


def start_after_hours_alerts(
    load_governance: Callable[[], Governance],
    history: DataFrame,
    sink: str,
    checkpoint: str,
    trigger: dict,
) -> StreamingQuery:
    """Append alerts to the levelled ``sink``. Each micro-batch reads the sensitive tables anew.

    A batch that is repeated after a failure does not alert twice.
    """
    levels = alert_sink(history.sparkSession, sink)

    def write(batch: DataFrame, batch_id: int) -> None:
        levels.commit(after_hours_alerts(load_governance(), batch), batch_id)

    return history.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


ALERTS = """query_id bigint, user_name string, role_name string, schema_name string, table_name string,
    start_time timestamp_ntz, query_text string"""


def read_alerts(spark: SparkSession, sink: str) -> DataFrame:
    """All alerts so far, by the newest manifest of the sink."""
    return alert_sink(spark, sink).read(ALERTS).select(*ALERT_COLUMNS)


# -- access volume: keyed state

VOLUME_KEY = ["day", "user_name", "role_name"]
VOLUMES = "arrival_day timestamp, day date, user_name string, role_name string, query_count bigint, rows_returned bigint, batch bigint"
# State in RocksDB, with a log of changes for each batch instead of whole snapshots.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _with_level(volume: DataFrame) -> DataFrame:
    return volume.withColumn("access_level", access_level(F.col("query_count")))


def _counted(gov: Governance, history: DataFrame) -> DataFrame:
    """The queries that count, with their day."""
    return (
        _environment(gov, history)
        .filter(F.col("schema_name").isin(*gov.estate.layers) & ~F.col("query_type").isin(*METADATA_TYPES))
        .withColumn("day", F.col("start_time").cast("date"))
    )


FIGURES = ("query_count", "rows_returned")


def _figures() -> list[Column]:
    return [f.alias(n) for n, f in zip(FIGURES, (F.count("*"), F.sum("rows_produced")), strict=True)]


def access_volume(gov: Governance, history: DataFrame) -> DataFrame:
    """Queries per user, role and day of a log, with the volume label."""
    return _with_level(_counted(gov, history).groupBy(*VOLUME_KEY).agg(*_figures()))


def running_volume(gov: Governance, history: DataFrame, remember: str, arrived: Column) -> DataFrame:
    """Queries per user, role, day and day of arrival of a live log, each query id counted once.

    Two states follow the clock of arrival. Query ids are remembered for ``remember`` after
    they came; a row that comes again within that time is dropped. Sums are kept for tumbling
    days of arrival. When the clock has passed a day of arrival by ``remember``, its sums
    leave the state; what was last emitted of them stays in the sink, and rows of an
    old day that come later count under their own day of arrival. So no row is too late, and
    the state holds what came within ``remember`` and a day, not the whole log. Rows
    without a query id are repetitions if all their counted columns agree.

    The shuffle by query id has no hot key, and the sums merge on the map side before theirs.
    """
    narrow = _counted(gov, history).select("query_id", *VOLUME_KEY, "start_time", "rows_produced", arrived.alias("arrived"))
    stand_in = F.when(F.col("query_id").isNull(), F.xxhash64(*VOLUME_KEY, "start_time", "rows_produced"))
    return (
        narrow.withColumn("stand_in", stand_in)
        .withWatermark("arrived", remember)
        .dropDuplicatesWithinWatermark(["query_id", "stand_in"])
        .groupBy(F.window("arrived", "1 day").alias("arrival"), *VOLUME_KEY)
        .agg(*_figures())
        .select(F.col("arrival.start").alias("arrival_day"), *VOLUME_KEY, *FIGURES)
    )


def _newest(volumes: DataFrame) -> DataFrame:
    """The last emitted sums of each key: later batches have those of earlier ones in them."""
    sums = F.struct("query_count", "rows_returned")
    return (
        volumes.groupBy("arrival_day", *VOLUME_KEY)
        .agg(F.max_by(sums, "batch").alias("sums"), F.max("batch").alias("batch"))
        .select("arrival_day", *VOLUME_KEY, "sums.*", "batch")
    )


def volume_sink(spark: SparkSession, root: str) -> LevelledSink:
    return LevelledSink(spark, root, _newest)


def start_access_volume(
    gov: Governance,
    history: DataFrame,
    sink: str,
    checkpoint: str,
    trigger: dict,
    remember: str = "7 days",
    arrived: Column | None = None,
) -> StreamingQuery:
    """Keep the sums of :func:`running_volume` in the levelled ``sink``, in update mode.

    Each micro-batch adds the sums it changed. ``arrived`` is when a row came: the time of
    its micro-batch, which the checkpoint keeps for a repeated one, or a column of the
    source, which must not run back by more than ``remember``, or rows are dropped.
    """
    spark = history.sparkSession
    levels = volume_sink(spark, sink)
    volumes = running_volume(gov, history, remember, F.current_timestamp() if arrived is None else arrived)

    def write(batch: DataFrame, batch_id: int) -> None:
        levels.commit(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id)

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:  # a query takes the settings of the moment it starts
        return (
            volumes.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_access_volume(spark: SparkSession, sink: str) -> DataFrame:
    """The counts per day, user and role over all batches, by the newest manifest of the sink."""
    sums = [F.sum(c).alias(c) for c in FIGURES]
    return _with_level(volume_sink(spark, sink).read(VOLUMES).groupBy(*VOLUME_KEY).agg(*sums))


# -- policy changes


def policy_change_alerts(gov: Governance, history: DataFrame) -> DataFrame:
    """Changes of policies and tags. Stateless."""
    return history.filter(is_policy_change(gov)).select(
        "query_id", "query_type", "user_name", "role_name", "start_time", "query_text"
    )


def start_policy_change_alerts(
    gov: Governance, history: DataFrame, sink: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    return (
        policy_change_alerts(gov, history)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
