"""Places and running sums over ordered rows, without a task that holds a whole group.

Rows are range-partitioned by their order, so a group of any size is split over tasks. What the
tasks exchange is a row per task and group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutframe.session import written

#: ``monotonically_increasing_id`` holds the number of the partition above these bits.
ROW_BITS = 33


def _numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """A written table, sorted over all tasks, with each row's number (``row_at``)."""
    # Rows that agree in everything may fill several tasks; which is which makes no difference.
    keys = [F.col(c).asc_nulls_first() for c in [*order, "row_tie"]]
    dealt = rows.withColumn("row_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).drop("row_tie")
    return written(dealt.withColumn("row_at", F.monotonically_increasing_id()), label)


def placed(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``place``, from 0 within the group by ``order`` (null first), and ``of``, the group's size."""
    return summed(rows, group, order, {}, label)


def summed(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], label: str) -> DataFrame:
    """:func:`placed`, with running sums within the group, the row included.

    A sum is an expression over ``rows``, which must not have columns ``row_...``; columns named
    as the sums, ``place`` and ``of`` are added. Sums are of whole numbers.
    """
    part = F.shiftright("row_at", ROW_BITS)
    numbered = _numbered(rows.withColumns({f"row_{s}": e for s, e in sums.items()}), [*group, *order], label)
    numbered = numbered.withColumn("row_part", part)
    if sums:
        upto = W.partitionBy("row_part", *group).orderBy("row_at").rowsBetween(W.unboundedPreceding, 0)
        numbered = numbered.withColumns({f"row_upto_{s}": F.sum(f"row_{s}").over(upto) for s in sums})
    runs = numbered.groupBy("row_part", *group).agg(
        F.min("row_at").alias("row_first"),
        F.count("*").alias("row_n"),
        *[F.sum(f"row_{s}").alias(f"row_sum_{s}") for s in sums],
    )
    of_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    earlier = of_group.orderBy("row_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns(
        {"row_start": F.coalesce(F.sum("row_n").over(earlier), F.lit(0)), "of": F.sum("row_n").over(of_group)}
        | {f"row_before_{s}": F.coalesce(F.sum(f"row_sum_{s}").over(earlier), F.lit(0)) for s in sums}
    )
    # Other names, so that the two sides' columns can be told apart.
    runs = runs.withColumnsRenamed({c: f"row_of_{c}" for c in ["row_part", *group]})
    same = [F.col(c).eqNullSafe(F.col(f"row_of_{c}")) for c in group]
    known = numbered.join(runs, reduce(and_, same, F.col("row_part") == F.col("row_of_row_part")))
    return known.select(
        *rows.columns,
        (F.col("row_at") - F.col("row_first") + F.col("row_start")).alias("place"),
        "of",
        *[(F.col(f"row_upto_{s}") + F.col(f"row_before_{s}")).alias(s) for s in sums],
    )
