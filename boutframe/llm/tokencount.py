"""Token counts behind a digest cache: only texts that no run has met are encoded, once each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm import tokens
from boutframe.llm.tables import small_batches
from boutframe.session import written

CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    The cache is a table of (content digest, tokenizer digest) and count in ``cache_path``, which
    need not exist. A content digest is the SHA-256 of the text's UTF-8 bytes, null read as empty:
    any further normalising would change counts. Distinct digests that the cache lacks for this
    version of the tokenizer are encoded and appended; rows appended twice by runs at the same
    time are read as one. Repeated rows and ids keep a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    version = tokens.tokenizer_digest(definition)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.sha2(text.cast("binary"), 256).alias("content"), text.alias("text"))
    keys = written(rows.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")

    # One row of each content, or the rows that repeat it with its id.
    chosen = keys.groupBy(F.col("content").alias("wanted")).agg(F.min("id").alias("first_id"))
    parts, stored = [], _stored(spark, cache_path, version)
    if stored is not None:
        chosen = written(chosen.join(stored, F.col("wanted") == F.col("content"), "left"), "token-wanted")
        parts.append(chosen.filter("n_tokens IS NOT NULL").select("content", "n_tokens"))
        chosen = chosen.filter("n_tokens IS NULL").select("wanted", "first_id")
    chosen = written(chosen, "token-misses")
    misses = rows.join(
        chosen.hint("shuffle_hash"),
        (rows["content"] == chosen["wanted"]) & rows["id"].eqNullSafe(chosen["first_id"]),
    ).select("content", "text")
    counted = misses.mapInArrow(_counter(definition), "content string, n_tokens long").dropDuplicates(["content"])
    parts.append(written(counted, "token-counted"))
    new = parts[-1].withColumn("tokenizer", F.lit(version))
    new.write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    # Written rows, one per content, so that an adaptive sort-merge join splits a hot text.
    counts = reduce(DataFrame.unionByName, parts).withColumnRenamed("content", "counted")
    return keys.join(counts, F.col("content") == F.col("counted")).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _stored(spark, cache_path: str, version: str) -> DataFrame | None:
    """The cached counts of one tokenizer, a row per content; None without a cache."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    cache = cache.filter(F.col("tokenizer") == version)
    return cache.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(definition: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(definition)
        for batch in batches:
            n = [len(x) // 4 for x in encode.ids(batch.column("text").to_pylist())]
            yield pa.record_batch({"content": batch.column("content"), "n_tokens": pa.array(n, pa.int64())})

    return count
