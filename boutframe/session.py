"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Tables that :func:`written` has left in the shared folder, until :func:`discard_written`.
_LEFT: list[str] = []

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide aggregates otherwise compile to methods the JVM refuses to optimise.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Call-site capture costs more than building the wide plans themselves.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Rows do not bound what a batch of texts holds.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's defaults; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName("boutframe")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Set the run-time defaults that results, wide plans or a worker's memory depend on."""
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.codegen.hugeMethodLimit",
        "spark.sql.execution.arrow.maxBytesPerBatch",
    ):
        spark.conf.set(key, DEFAULTS[key])


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and written intermediates.

    A temporary folder is used only in local mode, where driver and executors share
    one disk. On a cluster the setting must be present.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="boutframe-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage where a result is scanned several times (model fitting, all-null
    checks). Unlike a cache it survives lost executors and keeps column pruning.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, label))


def written_path(df: DataFrame, label: str) -> str:
    """Write ``df`` as :func:`written` does; its path."""
    path = f"{shared_folder(df.sparkSession)}/written/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _LEFT.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written_so_far() -> int:
    """A mark for :func:`discard_written`."""
    return len(_LEFT)


def discard_written(spark: SparkSession, since: int) -> None:
    """Remove the intermediate tables written after a mark, once what was made of them is stored."""
    while len(_LEFT) > since:
        remove_folder(spark, _LEFT.pop())


def written_together(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """:func:`written` for independent tables at once, so one fills the other's idle cores."""
    with ThreadPoolExecutor(len(tables)) as pool:
        jobs = {label: pool.submit(written, df, label) for label, df in tables.items()}
        return {label: job.result() for label, job in jobs.items()}
