"""Best-fit packing of tokenized documents with large-item matching.

How pieces of documents share sequences depends on their lengths alone, so it is planned on the
histogram of lengths, which has at most one entry per token of capacity whatever the input. The
plan is a list of bin kinds, each with a number of bins; a piece finds its place by its length and
its rank among the pieces of that length. Ranks are a count within the task that made the piece
plus the counts of the tasks before, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutframe.llm import tokens
from boutframe.llm.tables import small_batches
from boutframe.session import written

CAPACITY = 2048
END_ID = 0


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin kinds as (lengths, number of bins) that hold ``counts`` pieces of each length.

    Pieces above a third of the capacity go first, the longest taking the longest partner that
    fits, so at most two share a bin. Smaller ones, longest first, go where the least is left.
    """
    left = {n: c for n, c in counts.items() if c}
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    large = [n for n in sorted(left, reverse=True) if 3 * n > capacity]
    for n in large:
        partners = [p for p in large if p <= n and p + n <= capacity]
        for p in partners:
            bins = left[n] // 2 if p == n else min(left[n], left[p])
            if bins:
                gaps[capacity - n - p].append(((n, p), bins))
                left[n] -= bins
                left[p] -= bins
        if left[n]:
            gaps[capacity - n].append(((n,), left[n]))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while (count := left[n]) > 0:
            gap = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if gap is None:
                per_bin = capacity // n
                if count >= per_bin:
                    gaps[capacity - n * per_bin].append(((n,) * per_bin, count // per_bin))
                if count % per_bin:
                    gaps[capacity - n * (count % per_bin)].append(((n,) * (count % per_bin), 1))
                break
            kind, bins = gaps[gap].pop()
            used = min(bins, count)
            if used < bins:
                gaps[gap].append((kind, bins - used))
            gaps[gap - n].append(((*kind, n), used))
            left[n] -= used
    return [entry for gap in sorted(gaps) for entry in gaps[gap]]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, closed by ``END_ID``.

    Only longer documents are cut; the first piece takes what full ones leave over. ``part`` and
    ``nth`` say which task made a piece and how many of the same length it had made before.
    """
    small_batches(docs.sparkSession)
    definition = Path(tokenizer_path).read_text(encoding="utf-8")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made, part = tokens.encoder(definition), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("id"), encode.ids(batch.column("text").to_pylist())):
                ids += end
                n, a = len(ids) // 4, 0
                b = n % capacity or capacity
                for k in range(-(-n // capacity)):
                    span = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(span), part, made[b - a], span if with_ids else None))
                    made[b - a] += 1
                    a, b = b, b + capacity
            columns = list(zip(*rows)) or [()] * 8
            types = [batch.schema.field("id").type, pa.int32(), *[pa.int64()] * 5, pa.binary()]
            values = [pa.array([x.as_py() for x in columns[0]], types[0])]
            values += [pa.array(c, t) for c, t in zip(columns[1:], types[1:])]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            yield pa.record_batch(dict(list(zip(names, values))[: 8 if with_ids else 7]))

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long"
    return rows.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and maybe ids.

    Null and empty texts are a lone ``END_ID``. Repeated rows are packed each; other columns of
    ``docs`` are ignored. Which piece of a length goes where depends on the order of the input
    files; the number and filling of sequences do not.
    """
    made = written(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "pack-pieces")
    by_part = made.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = written(by_part.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "pack-counts")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    lengths, ranks, bins, offsets = _slots(plan_bins(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        k = np.searchsorted(ranks, length.to_numpy() << 40 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": bins[k] + rank.to_numpy() - (ranks[k] & (1 << 40) - 1), "offset": offsets[k]})

    keys = by_part.select(F.col("length").alias("l"), F.col("part").alias("p"), "before")
    ranked = made.join(keys, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    placed = ranked.withColumn("at", place("length", F.col("nth") + F.col("before")))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"]
    return placed.select(*columns, *["ids"][: int(with_ids)])


def sequences(packed: DataFrame) -> DataFrame:
    """Sequence id, length and ids (little-endian) of the sequences of ``pack(..., with_ids=True)``.

    A sequence holds at most ``capacity`` ids, so its group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select(
        "sequence_id",
        F.expr("aggregate(parts, 0L, (n, x) -> n + x.length)").alias("length"),
        F.expr("aggregate(parts, cast('' as binary), (b, x) -> concat(b, x.ids))").alias("ids"),
    )


def _slots(kinds: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Per run of ranks of a length: length, its first rank, its first bin, the offset in the bin."""
    used: dict[int, int] = defaultdict(int)
    runs, first_bin = [], 0
    for kind, bins in kinds:
        offset = 0
        for n in kind:
            runs.append((n, n << 40 | used[n], first_bin, offset))
            used[n] += bins
            offset += n
        first_bin += bins
    runs.sort(key=lambda r: r[1])
    return tuple(np.array(c, np.int64) for c in zip(*runs)) if runs else (np.empty(0, np.int64),) * 4
