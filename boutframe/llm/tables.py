"""Reading the given tables, and columns that several operators need."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so the length in bytes stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the documents, by a checksum of the id's digits.

    A document without an id is never held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds, in rows and, where texts are long, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def runs(values: list, most: int) -> Iterator[list]:
    """The values (texts, sets or nulls) in order, in runs that end once their lengths reach ``most``.

    What a worker makes of values is many times their size, so memory follows the longest one.
    """
    run, held = [], 0
    for value in values:
        run.append(value)
        held += 0 if value is None else len(value)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run
