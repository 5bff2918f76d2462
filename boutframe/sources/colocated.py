"""Tables stored in buckets of their join keys, which join without moving again.

A table is shuffled once, when it is stored. Later joins on the same keys read bucket beside bucket;
only the other, usually narrow side is moved. Buckets go by all keys of the join, step and entity,
so an entity with a third of all rows is spread over its steps.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.sources import store

#: Buckets of a table unless it says otherwise. Tables that join each other need the same number.
BUCKETS = 64


def store_colocated(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Store ``df`` as the next version of ``path``, a file for each of ``buckets`` by ``keys``.

    Rows with null keys are kept, in the bucket of null. Schema, keys and the number of buckets
    stand beside the files, so :func:`read_colocated` needs the path alone. An empty table gives a
    version without rows.
    """
    if not keys or buckets < 1 or set(keys) - set(df.columns):
        raise ValueError(f"no buckets by {keys} into {buckets}")
    spark = df.sparkSession
    layout = {"schema": df.schema.jsonValue(), "keys": keys, "buckets": buckets}

    def write(folder: str) -> None:
        name = f"boutframe_{uuid.uuid4().hex}"
        # One task per bucket, so a bucket is one file.
        spread = df.repartition(buckets, *keys)
        spread.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the table is external: its files stay
        out = _files(spark, folder).create(_layout(spark, folder), True)
        out.write(bytearray(json.dumps(layout).encode()))
        out.close()

    return _registered(spark, store.add_version(spark, path, write))


def read_colocated(spark: SparkSession, path: str) -> DataFrame:
    """The newest version stored at ``path``, with its buckets known to the planner."""
    version = store.newest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table is stored at {path}")
    return _registered(spark, version)


def _layout(spark: SparkSession, folder: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder, "_layout.json")


def _files(spark: SparkSession, folder: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _registered(spark: SparkSession, version: str) -> DataFrame:
    file = _files(spark, version).open(_layout(spark, version))
    layout = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    file.close()
    schema = T.StructType.fromJson(layout["schema"])
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    keys = ", ".join(quoted(name) for name in layout["keys"])
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    name = f"boutframe_{uuid.uuid4().hex}"
    location = version.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
        f"INTO {layout['buckets']} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def join_colocated(left: DataFrame, stored: DataFrame, on: list[tuple[str, str]], how: str = "left") -> DataFrame:
    """Join ``left`` to a stored table by pairs of columns (of left, of stored).

    The hint keeps the planner from moving the stored side instead, be ``left`` small or large.
    """
    named = stored.withColumnsRenamed({b: f"_stored_{b}" for _, b in on})
    same = [F.col(a) == F.col(f"_stored_{b}") for a, b in on]
    return left.join(named.hint("merge"), same, how).drop(*[f"_stored_{b}" for _, b in on])
