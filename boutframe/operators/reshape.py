"""Nested maps to rows and tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.session import written

def _exploded(df: DataFrame, column: str, keep: list[str], levels: int | None) -> DataFrame:
    """One explode per map level, ``levels`` of them or all; ``path`` gathers the keys."""
    level: T.DataType = df.schema[column].dataType
    out = df.select(*keep, F.array().cast("array<string>").alias("path"), F.col(column).alias("leaf"))
    while isinstance(level, T.MapType) and levels != 0:
        out = out.select(*keep, "path", F.explode("leaf").alias("step", "leaf")).select(
            *keep,
            F.concat("path", F.array(F.col("step").cast("string"))).alias("path"),
            "leaf",
        )
        level = level.valueType
        levels = None if levels is None else levels - 1
    return out


def flatten_map(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(path, leaf) rows of a nested map of any depth; ``path`` is an array of keys.

    The depth is read from the schema: one explode per map level, nothing shuffles.
    """
    return _exploded(df, column, keep, None)


def map_depth(kind: T.DataType) -> int:
    return 1 + map_depth(kind.valueType) if isinstance(kind, T.MapType) else 0


def nested_table(
    df: DataFrame, column: str, keep: list[str], names: list[str] | None = None
) -> DataFrame:
    """Rows keyed by the outer path, columns named by the innermost key.

    With ``names`` the columns are read from the innermost maps, and nothing shuffles; rows
    without any of them stay. Without, a pass finds the names and a shuffle gathers each row.
    """
    depth = map_depth(df.schema[column].dataType)
    if names is not None and depth:
        outer = _exploded(df, column, keep, depth - 1).filter(F.size("leaf") > 0)
        inner: Column = F.map_from_entries(
            F.transform(F.map_entries("leaf"), lambda e: F.struct(e["key"].cast("string"), e["value"]))
        )
        return outer.select(*keep, "path", *[F.element_at(inner, F.lit(n)).alias(n) for n in names])
    flat = flatten_map(df, column, keep)
    last: Column = F.element_at("path", -1)
    rest = F.slice("path", F.lit(1), F.size("path") - 1)
    keyed = flat.select(*keep, rest.alias("path"), last.alias("name"), "leaf")
    return keyed.groupBy(*keep, "path").pivot("name").agg(F.max("leaf"))


def flatten_variant(df: DataFrame, column: str, keep: list[str], arrays: bool = True) -> DataFrame:
    """(path, leaf) rows of variants whose depth the schema does not tell, rows differing in it.

    Objects are taken apart by key and, with ``arrays``, arrays by position (from 0), one level a
    pass, until no row holds either; a pass reads only what the one before left open, which is
    written. ``leaf`` is a variant; values that are null in the document are leaves, null variants
    and empty objects and arrays give no rows. Rows that repeat keep their leaves each.
    """
    spark = df.sparkSession
    kinds = r"^(OBJECT|ARRAY)" if arrays else r"^OBJECT"
    nested = F.schema_of_variant("leaf").rlike(kinds)
    no_path = F.array().cast("array<string>").alias("path")
    rows = df.select(*keep, no_path, F.col(column).alias("leaf")).where("leaf IS NOT NULL")
    rows = written(rows.withColumn("open", nested), "variant")
    out = []
    while True:
        out.append(rows.where("NOT open").drop("open"))
        left = rows.where("open")
        if left.isEmpty():
            break
        name = f"variants_{uuid.uuid4().hex}"
        left.createOrReplaceTempView(name)
        columns = ", ".join(f"t.`{c}`" for c in keep)
        deeper = spark.sql(
            f"SELECT {columns}, array_append(t.path, coalesce(v.key, CAST(v.pos AS STRING))) AS path, v.value AS leaf "
            f"FROM {name} t, LATERAL variant_explode(t.leaf) v"
        )
        rows = written(deeper.withColumn("open", nested), "variant")
        spark.catalog.dropTempView(name)
    return reduce(DataFrame.unionByName, out)
