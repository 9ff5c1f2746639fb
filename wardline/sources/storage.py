"""The shared folder jobs write to, and the report sinks."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.sources import schemas

CHECKPOINT_DIR = "spark.checkpoint.dir"
CSV = {"header": True, "escape": '"'}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a session that runs in one process may fall back to a local folder.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return _local_dir()


_local: list[str] = []


def _local_dir() -> str:
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="wardline-"))
    return _local[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut.

    What a lost executor held is read from that folder again. The files stay until ``discard``,
    or until the frame is gone in a session with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that ``written`` returned and that nothing reads any more."""
    files = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if files.isDefined():
        remove_dir(frame.sparkSession, files.get())


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/wardline/{purpose}-{uuid.uuid4().hex}"


class Folder:
    """Names and small files in a folder, wherever it is stored; a folder that is not there is empty."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._path = self._hadoop.Path(path)
        self._files = self._path.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(self._path, name)

    def names(self) -> list[str]:
        if not self._files.exists(self._path):
            return []
        return [found.getPath().getName() for found in self._files.listStatus(self._path)]

    def folders(self, pattern: str) -> list[str]:
        """Paths, relative to this folder, that a glob pattern such as ``a=*/b=*`` matches."""
        found = self._files.globStatus(self._at(pattern))
        depth = pattern.count("/") + 1
        return ["/".join(str(f.getPath()).rstrip("/").split("/")[-depth:]) for f in found or []]

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file under another name and rename it: it is there as a whole or not at all.

        Fails if ``name`` exists. Needs a store whose rename is atomic, as streaming checkpoints do.
        """
        hidden = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._files.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._path.toUri(), self._conf)
        keep = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        try:
            context.rename(hidden, self._at(name), keep)
        except Exception:
            self._files.delete(hidden, False)
            raise

    def remove(self, name: str) -> None:
        self._files.delete(self._at(name), True)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever it is stored. A folder that is not there is no error."""
    parent, _, name = path.rstrip("/").rpartition("/")
    Folder(spark, parent).remove(name)


def export_csv(report: DataFrame, root: str, name: str, run_date: date) -> str:
    """Write a report as CSV, one directory per report and run date."""
    path = f"{root}/{name}/run_date={run_date.isoformat()}"
    report.write.mode("overwrite").options(**CSV).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An exported report; a cell may hold line feeds and quotes."""
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def append_audit_log(results: DataFrame, path: str, run_date: date) -> None:
    """Append ``(audit_name, issue_count)`` rows to the log kept for trending.

    Writing an audit again for the same day replaces it, so a job that is run twice
    after a failure does not count twice.
    """
    (
        results.select(
            F.col("audit_name"),
            F.col("issue_count").cast("bigint").alias("issue_count"),
            F.lit(run_date).alias("audit_date"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("audit_date", "audit_name")
        .parquet(path)
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT_LOG).parquet(path)
