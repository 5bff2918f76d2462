"""Repeatable holdout and stratified folds from an integer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 42
KNUTH = 2654435761  # multiplicative hashing constant
RANGE = 2**32


def mixed(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 2**32) that depends only on the key and the seed.

    Use ``xxhash64`` over the key columns first where the key is not one integer.
    """
    folded = F.pmod(key.cast("long"), F.lit(2**31 - 1).cast("long"))
    return F.pmod(folded * KNUTH + seed * 40503, F.lit(RANGE).cast("long"))


def bucket_of(mix: Column, buckets: int) -> Column:
    """The mix scaled down to [0, buckets), keeping its order."""
    return F.shiftright(mix * buckets, 32)


def in_holdout(key: Column, share: float = 0.3, seed: int = SEED) -> Column:
    """True for a fixed share of keys, however the data is partitioned."""
    return bucket_of(mixed(key, seed), 1000) < round(share * 1000)


def stratified_folds(
    df: DataFrame, target: str, key: str, folds: int = 5, buckets: int = 4096, seed: int = SEED
) -> DataFrame:
    """Fold 0..folds-1 per row, dealt in turn within each target value in mixed order.

    The running number within a target value is built from bucket counts plus a number
    within the bucket, so no task has to order all rows of a common target value.
    ``buckets`` times the share of the commonest value bounds a task's rows.
    """
    mix = mixed(F.col(key), seed)
    placed = df.where(F.col(target).isNotNull()).withColumn("__mix", mix)
    placed = placed.withColumn("__bucket", bucket_of(F.col("__mix"), buckets))
    earlier = W.partitionBy(target).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = (
        placed.groupBy(target, "__bucket")
        .agg(F.count("*").alias("__n"))
        .select(target, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    within = F.row_number().over(W.partitionBy(target, "__bucket").orderBy("__mix", key))
    numbered = placed.withColumn("__within", within).join(before, [target, "__bucket"])
    fold = F.pmod(F.col("__before") + F.col("__within") - 1, F.lit(folds))
    return numbered.withColumn("fold", fold.cast("int")).drop(
        "__mix", "__bucket", "__within", "__before"
    )
