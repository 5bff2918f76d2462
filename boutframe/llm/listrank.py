"""List ranking: the place of every item of a linked list that lies scattered over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.session import written

#: So many items at most are walked one after another, in a task.
WALKED = 16_384


def _coin(item: Column, n: int) -> Column:
    return F.xxhash64(item, F.lit(n)) % 2 == 0


def ranked(links: DataFrame) -> DataFrame:
    """``id``, ``place`` from 0 at the head, of one list given by ``id`` and ``next`` (null at its end).

    Each round tosses a coin per item, by a hash that its neighbours can compute as well. An item
    with heads takes its follower out of the list if that has tails, and remembers how far it now
    reaches, so a quarter of the list goes, no two neighbours together. What is left in the end is
    short and walked; then the rounds are undone, each item that went being placed by the one that
    took it out. All joins are on unique ids, and all rounds together move a few times the list.
    An empty list has no places. Ids are not null and appear once.
    """
    items = written(links.select("id", "next", F.lit(1).cast("long").alias("reach")), "list-0")
    taken, n = [], 0
    while items.count() > WALKED:
        n += 1
        heads = _coin(F.col("id"), n)
        takes = heads & F.col("next").isNotNull() & ~_coin(F.col("next"), n)
        takers = items.filter(takes).select(F.col("id").alias("taker"), F.col("next").alias("of"), F.col("reach").alias("far"))
        rest = items.filter(~takes)
        # A taker stands in the place of what it takes; the others stay as they are.
        step = rest.join(takers, rest["id"] == takers["of"], "left").select("id", "next", "reach", "taker", "far")
        step = written(step, f"list-{n}")
        items = step.select(
            F.coalesce("taker", "id").alias("id"), "next", (F.col("reach") + F.coalesce("far", F.lit(0))).alias("reach")
        )
        taken.append(step.filter("taker IS NOT NULL").select("id", "taker", "far"))
    places = written(items.repartition(1).mapInArrow(_walk, "id string, place long"), "list-walked")
    for gone in reversed(taken):
        found = gone.join(places.withColumnsRenamed({"id": "known", "place": "at"}), F.col("taker") == F.col("known"))
        found = written(found.select("id", (F.col("at") + F.col("far")).alias("place")), "list-placed")
        places = places.unionByName(found)
    return places


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of a short list."""
    after = {}
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("id", "next", "reach")))
        after.update((item, (following, reach)) for item, following, reach in rows)
    at = next(iter(after.keys() - {following for following, _ in after.values()}), None)
    places, place = {}, 0
    while at is not None:
        places[at] = place
        at, reach = after[at]
        place += reach
    yield pa.record_batch({"id": pa.array(places, pa.string()), "place": pa.array(places.values(), pa.int64())})
