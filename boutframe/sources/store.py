"""Stored tables: materialised stages, CSV in and out, partition refresh."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.functions import calendar as cal
from boutframe.session import remove_folder, written


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when there is none or it has no files."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class VersionTaken(RuntimeError):
    """Another build stored the version that this one would have become."""


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force: bool = False,
    keep_versions: int | None = None,
) -> DataFrame:
    """The stored table, built first when absent, empty or ``force``.

    A build may read the version it replaces, and a lost job leaves the old one in place. The
    result is always read back, so fresh and stored tables have the same types. After a build,
    all but the newest ``keep_versions`` are removed, or none where it is not given.
    """
    current = _current_version(spark, path)
    if current and not force:
        stored = read_if_present(spark, f"{path}/{current}")
        if stored is not None and not stored.isEmpty():
            return stored
    version = add_version(spark, path, lambda folder: build().write.parquet(folder), keep_versions)
    return spark.read.parquet(version)


def add_version(
    spark: SparkSession, path: str, write: Callable[[str], object], keep_versions: int | None = None
) -> str:
    """Have ``write`` fill a folder and make it the next version of ``path``; returns its path.

    The folder becomes the version that follows the one current when the build began, in one step
    that fails if that version has come to exist meanwhile. Of two builds at once, one is stored
    whole; the other raises :class:`VersionTaken` and leaves nothing.
    """
    current = _current_version(spark, path)
    version = f"{path}/v{int(current[1:]) + 1 if current else 1:06d}"
    staged = f"{path}/_building-{uuid.uuid4().hex}"
    try:
        write(staged)
        _mark(spark, staged)
        _rename_to_new(spark, staged, version)
    except BaseException:
        remove_folder(spark, staged)
        raise
    if keep_versions is not None:
        for old in _versions(spark, path)[: -max(1, keep_versions)]:
            remove_folder(spark, f"{path}/{old}")
    return version


def _mark(spark: SparkSession, folder: str) -> None:
    """The marker of a finished folder, which Spark leaves in tables but not in models."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()


def newest_version(spark: SparkSession, path: str) -> str | None:
    """The path of the newest version, or None without any."""
    current = _current_version(spark, path)
    return f"{path}/{current}" if current else None


def _rename_to_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a name that must not exist, in one step of the file system.

    HDFS and local disks rename in one step; an object store without that must be given a
    committer or file system that has it.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    start, end = hadoop.Path(source), hadoop.Path(target)
    if start.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        try:
            os.rename(start.toUri().getPath(), end.toUri().getPath())
        except OSError as taken:
            raise VersionTaken(f"{target} has been stored by another build") from taken
        return
    files = hadoop.FileContext.getFileContext(start.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(start, end, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" not in str(problem.java_exception):
            raise
        raise VersionTaken(f"{target} has been stored by another build") from problem


def _current_version(spark: SparkSession, path: str) -> str | None:
    return max(_versions(spark, path), default=None)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions, oldest first: folders with the commit marker Spark leaves."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = [
        entry.getPath().getName()
        for entry in files.listStatus(folder)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS"))
    ]
    return sorted(name for name in done if name.startswith("v"))


def refresh_partitions(df: DataFrame, path: str, keep: Column, due: Column | None = None) -> set[tuple[int, int]]:
    """Overwrite the (season, week) partitions of ``path`` that the rows selected by ``keep`` are in.

    Stored partitions that are ``due``, by default those selected, and have no rows any more are
    removed after the others are written. Returns the steps that were written or removed.
    """
    spark = df.sparkSession
    rows = written(df.where(keep), "refresh")
    # Steps of the calendar, not rows, come to the driver; before writing, as it replaces files.
    stored = read_if_present(spark, path)
    before = set() if stored is None else _steps(stored.where(keep if due is None else due))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("season", "week")
        .parquet(path)
    )
    after = _steps(rows)
    for season, week in before - after:
        remove_folder(spark, f"{path}/season={season}/week={week}")
    return after | before


def _steps(df: DataFrame) -> set[tuple[int, int]]:
    return {tuple(r) for r in df.select("season", "week").distinct().collect()}


def rows_to_refresh(df: DataFrame, stored: DataFrame, due: Column) -> DataFrame:
    """Rows of ``df`` whose step is ``due`` or has no rows in the stored table yet.

    How the steps present are joined is left to the run-time size check.
    """
    present = stored.select("season", "week").distinct()
    missing = df.where(~due).join(present, ["season", "week"], "left_anti")
    return df.where(due).unionByName(missing)


def due_for_refresh(as_of: date, skip_current: bool = False, force: bool = False) -> Column:
    """Steps to recompute: the current season's weeks at most one away from today's."""
    today = F.lit(as_of)
    near = F.abs(F.col("week") - cal.week_of(today)) <= 1
    due = (F.col("season") == cal.season_of(today)) & near & F.lit(not skip_current)
    return due | F.lit(force)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, index: bool = True
) -> DataFrame:
    """CSV with a header and a declared schema; a leading index column is dropped.

    A missing path raises when the table is planned.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not index:
        return spark.read.schema(declared).option("header", True).csv(path)
    indexed = T.StructType([T.StructField("_row", T.LongType()), *declared.fields])
    raw = spark.read.schema(indexed).option("header", True).option("enforceSchema", True)
    return raw.csv(path).drop("_row")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, creating folders; rows carry no position of their own."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_first_csv(
    spark: SparkSession, paths: Iterable[str | None], schema: T.StructType | None = None
) -> DataFrame:
    """The first readable path of a list, without an accidental index column.

    Types are inferred by an extra pass unless ``schema`` names the columns to keep.
    """
    tried = [p for p in paths if p]
    for path in tried:
        try:
            names = spark.read.option("header", True).csv(path).columns
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        blank = names[0] in ("", "_c0") or names[0].lower().startswith("unnamed")
        if schema is None:
            found = spark.read.option("header", True).option("inferSchema", True).csv(path)
            return found.drop(found.columns[0]) if blank else found
        declared = {f.name: f for f in schema}
        in_file = [declared.get(n, T.StructField(n, T.StringType())) for n in names]
        found = spark.read.schema(T.StructType(in_file)).option("header", True).csv(path)
        return found.select(*[n for n in names if n in declared])
    raise FileNotFoundError(f"none of {tried} exists")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line quotes from a plain CSV file with a header."""
    return read_csv(spark, path, schema, index=False)


def from_records(spark: SparkSession, records: list[dict], schema: T.StructType) -> DataFrame:
    """A table from a short list of records, with declared types."""
    rows = [tuple(record.get(f.name) for f in schema) for record in records]
    return spark.createDataFrame(rows, schema)


def records_in(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """A row per record of the JSON lists in ``column``, with the declared fields after the others.

    Fields that a record lacks are null and others are ignored; a list that is null, empty or
    unreadable gives no rows.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = F.from_json(F.col(column), T.ArrayType(declared))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(records))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column: missing means null from here on."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan")).cast(df.schema[c].dataType)) for c in floating}) if floating else df
