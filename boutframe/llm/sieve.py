"""A sieve tells rows that cannot matter from those that may, without moving the rows.

It is a bit per slot of a fixed number of slots, in at most ``SLOTS / 64`` rows whatever the
input, so it may be broadcast. A set bit may be another row's doing; a clear one is certain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 22


def sieve(rows: DataFrame, hashed: Column) -> DataFrame:
    """Words of 64 bits, with a bit set for the slot of each row's hash."""
    return (
        rows.select(F.pmod(hashed, F.lit(SLOTS)).alias("sieve_slot"))
        .groupBy(F.shiftright("sieve_slot", 6).alias("sieve_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(sieve_slot % 64 as int)))").alias("sieve_bits"))
    )


def marked(rows: DataFrame, words: DataFrame, hashed: Column, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: whether the bit of their hash is set."""
    slotted = rows.withColumn("sieve_slot", F.pmod(hashed, F.lit(SLOTS)))
    known = slotted.join(F.broadcast(words), F.shiftright(slotted["sieve_slot"], 6) == words["sieve_word"], "left")
    bit = F.expr("shiftrightunsigned(sieve_bits, cast(sieve_slot % 64 as int)) & 1L")
    return known.withColumn(name, F.coalesce(bit == 1, F.lit(False))).select(*rows.columns, name)


def without(
    docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame, named: Callable[[Column], dict[str, Column]]
) -> DataFrame:
    """``docs`` without the rows that ``dropped`` names, whatever their columns are called.

    ``dropped`` has ``dropped_id`` and the columns that ``named`` makes of a text; nulls are equal.
    Rows whose id the sieve clears stay where they are; only the others' texts are looked at.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    carried = docs.select(whole, docs[id_col].alias("id"), docs[text_col].alias("text"))
    sifted = marked(carried, sieve(dropped, F.xxhash64("dropped_id")), F.xxhash64("id"), "maybe")
    asked = sifted.filter("maybe").withColumns({f"own_{name}": e for name, e in named(F.col("text")).items()})
    same = F.col("id").eqNullSafe(F.col("dropped_id"))
    for name in dropped.columns:
        if name != "dropped_id":
            same = same & F.col(f"own_{name}").eqNullSafe(F.col(name))
    left = asked.join(dropped, same, "left_anti")
    return sifted.filter(~F.col("maybe")).select("row.*").union(left.select("row.*"))
