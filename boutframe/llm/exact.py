"""Exact duplicates by progressive refinement: length, then prefix, then the whole text.

Each round leaves a sieve of what at least two texts agree in so far. It is of a fixed size and
broadcast, so the texts stay where they are read; only (length, hash) pairs are shuffled, summed
before. Two groups meeting in a slot cost a needless look at a text, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.llm.sieve import marked, sieve, without
from boutframe.llm.tables import ascii_lower
from boutframe.session import written

PREFIX_CHARS = 256


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Of equal
    texts the row with the largest id stays; rows repeating an id share one verdict, and null ids
    lose to any other. The digest is null for texts that an earlier round has shown to be unique,
    unless ``digest_all`` asks for it; other columns of ``docs`` are ignored.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text"))

    by_length = sieve(rows.groupBy("n_bytes").count().filter("count > 1"), F.xxhash64("n_bytes"))
    survivors = marked(rows, by_length, F.xxhash64("n_bytes"), "same_length")

    head = F.xxhash64("n_bytes", ascii_lower(F.substring("text", 1, prefix_chars)))
    heads = survivors.filter("same_length").select("n_bytes", head.alias("head"))
    by_head = sieve(heads.groupBy("n_bytes", "head").count().filter("count > 1"), F.col("head"))
    survivors = marked(
        survivors.withColumn("head", F.when(F.col("same_length"), head)), by_head, F.col("head"), "same_head"
    )

    whole = _digest(F.col("text"))
    shared = F.col("same_length") & F.col("same_head")
    digests = written(
        survivors.select(
            "id",
            shared.alias("shared"),
            (whole if digest_all else F.when(shared, whole)).alias("text_sha256"),
        ),
        "exact-digests",
    )
    pool = digests.filter("shared")
    groups = pool.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # A written side of one row per group: an adaptive sort-merge join splits a hot group's rows.
    grouped = pool.join(written(groups, "exact-groups"), "text_sha256")
    alone = digests.filter("not shared").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    columns = [
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    ]
    return alone.select(columns).unionByName(grouped.select(columns))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id repeats.

    Columns stay as they are, whatever their names; only texts whose id is that of some dropped row
    are hashed again.
    """
    verdicts = exact_groups(docs, id_col, text_col).filter("not kept")
    dropped = verdicts.select(F.col(id_col).alias("dropped_id"), F.col("text_sha256").alias("sha256")).distinct()
    # Ids may repeat or be null, so a row goes by its text too.
    return without(docs, id_col, text_col, written(dropped, "exact-dropped"), lambda text: {"sha256": _digest(text)})


def _digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)
