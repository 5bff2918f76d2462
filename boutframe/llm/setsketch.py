"""Near duplicates by SetSketch registers, bands, a joint likelihood and exact checks.

A document is the set of its five-word shingles. Documents with the same set are one from the
start. A sketch holds ``REGISTERS`` truncated minima on an exponential scale; documents that agree
in all registers of a band meet in a bucket. Within a bucket the Jaccard similarity of two sketches
is estimated by maximum likelihood, which groups the documents coarsely; within a coarse group the
links are confirmed on the full sets. Both steps walk a graph breadth first and compare a visited
document with the unvisited ones only, so a dense group costs little more than its size, and no
pair is left out that could join two components. Buckets and groups too large for a task are cut in
blocks, and every pair of blocks is walked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.llm.components import components
from boutframe.llm.sieve import marked, sieve, without
from boutframe.llm.tables import runs, small_batches
from boutframe.session import written

SHINGLE = 5
REGISTERS, BANDS, ROWS = 127, 25, 5  # a prime number of registers; two of them are in no band
BASE, RATE, TOP = 1.02, 20.0, 65_000
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Standard errors of the estimate below the threshold at which a pair is given up.
ESTIMATE_MARGIN = 4.5
BLOCK_DOCS, BLOCK_BYTES = 2048, 48 << 20
#: Shingles are sketched and compared so many at a time, or a set.
RUN_SHINGLES = 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=_U)
_WORD_CODES = _rng.integers(1, 1 << 63, SHINGLE, dtype=_U) | _U(1)
_BAND_OF = _rng.permutation(REGISTERS)[: BANDS * ROWS].reshape(BANDS, ROWS)
_BAND_CODES = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=_U) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_FACTOR = _U(0x2545F4914F6CDD1D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# --- shingles ------------------------------------------------------------------
class Powers:
    """Powers of the rolling factor and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            back = _U(pow(int(_FACTOR), -1, 1 << 64))
            self.up = np.cumprod(np.r_[_U(1), np.full(size - 1, _FACTOR)])
            self.down = np.cumprod(np.r_[_U(1), np.full(size - 1, back)])
        return self.up[:n], self.down[:n]


_POWERS = Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, lower-cased from A-Z."""
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = np.r_[False, ~_SPACE[data], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    total = np.r_[_U(0), np.cumsum(_BYTE_CODES[data] * up[: len(data)])]
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _STEP)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, of the whole text if it has fewer words."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    size = min(n, SHINGLE)
    codes = np.zeros(n - size + 1, _U)
    for k in range(size):
        codes += words[k : n - size + 1 + k] * _WORD_CODES[k]
    return np.unique(mixed(codes + _U(size)))


# --- sketches ------------------------------------------------------------------
def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Register values of each set, a row each; sets must not be empty.

    An element has a point in every register, drawn in rising order as a Poisson process with
    registers from a permutation. Points above a bound that all minima of a set lie below can
    change nothing, so they are not drawn; a set whose minima do not all lie below is drawn on.
    """
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    seed = mixed(np.concatenate(sets) ^ _STEP)
    place = (seed % _U(REGISTERS)).astype(np.int64)
    stride = ((seed >> _U(32)) % _U(REGISTERS - 1)).astype(np.int64) + 1
    point, drawn = np.zeros(len(seed)), np.zeros(len(seed), np.int64)
    least = np.full((len(sets), REGISTERS), np.inf)
    flat = least.reshape(-1)
    bound = (log(REGISTERS) + 3) / (RATE * sizes)
    todo = np.arange(len(seed))
    while True:
        while len(todo):
            j = drawn[todo]
            uniform = ((mixed(seed[todo] + (j + 1).astype(_U) * _STEP) >> _U(11)).astype(float) + 0.5) / (1 << 53)
            point[todo] -= np.log(uniform) / (RATE * (REGISTERS - j))
            register = (place[todo] + j * stride[todo]) % REGISTERS
            np.minimum.at(flat, of[todo] * REGISTERS + register, point[todo])
            drawn[todo] += 1
            todo = todo[(point[todo] < bound[of[todo]]) & (drawn[todo] < REGISTERS)]
        late = least.max(axis=1) > bound
        open_ = late[of] & (drawn < REGISTERS)
        if not open_.any():
            break
        bound[late] *= 2
        todo = np.flatnonzero(open_ & (point < bound[of]))
    values = np.floor(1 - np.log(least) / log(BASE))
    return np.clip(values, 0, TOP).astype("<u2")


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each sketch."""
    bands = registers[:, _BAND_OF].astype(_U) + _U(1)
    codes = (bands * _BAND_CODES).sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U) * _STEP
    return mixed(codes)


def _agreeing(registers: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int):
    """Sketches that may be linked with ``one``: their places, and the log-likelihood of a similarity.

    Pairs whose sizes rule the threshold out, or that agree in far too few registers, are left out.
    Given the set sizes, the counts of larger, smaller and equal registers are sufficient.
    """
    small, large = np.minimum(sizes, size), np.maximum(sizes, size)
    close = np.flatnonzero(100 * small >= PERCENT * large)
    equal = (registers[close] == one).sum(axis=1)
    agree = equal >= REGISTERS * (cut() - 0.1)
    close, equal = close[agree], equal[agree]
    more = (registers[close] > one).sum(axis=1)
    u = sizes[close] / (sizes[close] + size)
    v = 1 - u
    scale = (BASE - 1) / BASE

    def likelihood(j):
        a = -np.log1p(-np.maximum(u - v * j, 1e-12) * scale) / log(BASE)
        b = -np.log1p(-np.maximum(v - u * j, 1e-12) * scale) / log(BASE)
        rest = np.maximum(1 - a - b, 1e-12)
        return more * np.log(a) + (REGISTERS - equal - more) * np.log(b) + equal * np.log(rest)

    return close, likelihood, np.minimum(u / v, v / u)


def estimated(registers: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of ``one`` with each sketch, 0 for hopeless pairs."""
    result = np.zeros(len(sizes))
    close, likelihood, high = _agreeing(registers, sizes, one, size)
    low = np.zeros(len(close))
    for _ in range(40):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(a) < likelihood(b)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    result[close] = (low + high) / 2
    return result


def maybe_linked(registers: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """Whether the estimate is at least :func:`cut`: with one peak, whether likelihood rises there."""
    result = np.zeros(len(sizes), bool)
    close, likelihood, _ = _agreeing(registers, sizes, one, size)
    if len(close):
        result[close] = likelihood(cut() - 1e-4) <= likelihood(cut() + 1e-4)
    return result


def cut() -> float:
    j = PERCENT / 100
    return j - ESTIMATE_MARGIN * (j * (1 - j) / REGISTERS) ** 0.5


# --- walking a group -------------------------------------------------------------
def walked(n: int, neighbours: Callable[[int, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Components of n nodes; ``neighbours(node, others)`` says which of the others it is linked to."""
    waiting, found = np.arange(n), []
    while len(waiting):
        queue, waiting, group = [int(waiting[0])], waiting[1:], []
        while queue:
            node = queue.pop()
            group.append(node)
            if len(waiting):
                linked = neighbours(node, waiting)
                queue.extend(waiting[linked].tolist())
                waiting = waiting[~linked]
        found.append(np.array(group))
    return found


def likely(registers: np.ndarray, sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda node, others: maybe_linked(registers[others], sizes[others], registers[node], sizes[node])


def confirmed(registers: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]):
    """Links on full sets, asked only where the likelihood allows them."""
    maybe = likely(registers, sizes)

    def neighbours(node: int, others: np.ndarray) -> np.ndarray:
        linked = maybe(node, others)
        asked = others[linked]
        if len(asked):
            lengths = sizes[asked]
            common = np.concatenate([_common(sets[node], run) for run in runs([sets[k] for k in asked], RUN_SHINGLES)])
            linked[linked] = 100 * common >= PERCENT * (lengths + sizes[node] - common)
        return linked

    return neighbours


def _common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each set has in common with ``one``."""
    values = np.concatenate(sets)
    at = np.searchsorted(one, values)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == values).astype(np.int64), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]])


def _stars(ids: np.ndarray, groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges from every member of a component to its smallest id."""
    edges = []
    for g in groups:
        if len(g) > 1:
            least = ids[g].min()
            edges += [(int(i), int(least)) for i in ids[g] if i != least]
    return edges


# --- jobs ------------------------------------------------------------------------
SKETCH_SCHEMA = "n_shingles long, set_sum long, set_xor long, sketch binary"


#: What tells one shingle set from another.
SETS = ["n_shingles", "set_sum", "set_xor"]


def checksums(shingles: np.ndarray) -> tuple[int, int, int]:
    """The values of ``SETS`` for a set."""
    total = mixed(shingles).sum(dtype=_U).view(np.int64)
    return len(shingles), int(total), int(np.bitwise_xor.reduce(mixed(shingles + _STEP), dtype=_U).view(np.int64))


def sketched(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, set size, two checksums of the set, and the sketch (null without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"") for t in batch.column("text")]
            full, sums = [s for s in sets if len(s)], list(map(checksums, sets))
            rows = chain.from_iterable(map(sketches, runs(full, RUN_SHINGLES)))
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    **{c: pa.array([v[i] for v in sums], pa.int64()) for i, c in enumerate(SETS)},
                    "sketch": pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return docs.mapInArrow(sketch, f"id long, {SKETCH_SCHEMA}")


def coarse_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all documents of a bucket that are likely linked."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
            hashes = band_hashes(rows).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), BANDS)
            yield pa.record_batch({"bucket": pa.array(hashes.reshape(-1)), "id": pa.array(ids)})

    banded = nodes.select("id", "sketch").mapInArrow(bands, "bucket long, id long")
    coded = F.xxhash64("id")
    buckets = banded.groupBy("bucket").agg(
        F.count("*").alias("members"),
        F.expr("bit_xor(xxhash64(id))").alias("x"),
        F.sum(F.shiftright(coded, 20)).alias("s"),
    )
    # Buckets of the same members are walked once.
    buckets = buckets.filter("members > 1").groupBy("members", "x", "s").agg(F.min("bucket").alias("chosen"))
    buckets = written(buckets.select("chosen", "members"), "near-buckets")
    # Only sketches of documents that meet another are moved.
    inside = marked(banded, sieve(buckets, F.xxhash64("chosen")), F.xxhash64("bucket"), "maybe").filter("maybe")
    members = inside.join(buckets, F.col("bucket") == F.col("chosen")).select("bucket", "members", "id")
    members = written(members, "near-members")
    held = nodes.select(F.col("id").alias("node"), "n_shingles", "sketch")
    members = members.join(held, F.col("id") == F.col("node")).drop("node")
    members = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK_DOCS).cast("int"))
    return _walk(_in_block_pairs(members, ["bucket"]), ["bucket", "one", "two"], with_sets=False)


def confirmed_edges(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges that connect all documents of a coarse group that are linked by their full sets."""
    # Each representative of a coarse group, with its text.
    wanted = groups.join(nodes, "id").select(F.col("id").alias("node"), "doc", "component", *SETS, "sketch")
    sizes = wanted.groupBy("component").agg(F.sum(F.col("n_shingles") * 8 + 600).alias("bytes"))
    sizes = sizes.select(F.col("component").alias("c"), F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    wanted = written(wanted.join(written(sizes, "near-sizes"), F.col("component") == F.col("c")).drop("c"), "near-wanted")
    texts = marked(docs, sieve(wanted, F.xxhash64("doc")), F.xxhash64("id"), "maybe").filter("maybe").drop("maybe")
    members = texts.join(wanted, F.col("id") == F.col("doc")).drop("id", "doc").withColumnRenamed("node", "id")

    kept = ["component", "blocks", "id", "n_shingles", "sketch"]

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            # Rows may share an id and not a text: only those with the node's own set are the node.
            asked = zip(*(batch.column(c).to_pylist() for c in SETS))
            own = pa.array([checksums(s) == a for s, a in zip(sets, asked)], pa.bool_())
            shingles = pa.array([s.tobytes() for s in sets], pa.binary())
            rows = pa.record_batch({c: batch.column(c) for c in kept} | {"shingles": shingles})
            yield rows.filter(own)

    schema = "component long, blocks int, id long, n_shingles long, sketch binary, shingles binary"
    members = members.select(*dict.fromkeys([*kept, *SETS]), "text").mapInArrow(with_sets, schema)
    return _walk(_in_block_pairs(members, ["component"]), ["component", "one", "two"], with_sets=True)


def _in_block_pairs(members: DataFrame, key: list[str]) -> DataFrame:
    """Each member once for every pair of blocks that its block is part of."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    rows = members.withColumn("block", block).withColumn("other", other)
    return rows.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("block", "other")


def _walk(members: DataFrame, key: list[str], with_sets: bool) -> DataFrame:
    """Edges of the components of each group of ``key``; a task streams its groups in order."""
    columns = [*key, "id", "n_shingles", "sketch", *["shingles"][: int(with_sets)]]

    def edges_of(keys: np.ndarray, table: dict, out: list) -> None:
        bounds = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            ids, sizes = table["id"][a:b], table["n_shingles"][a:b]
            registers = np.frombuffer(b"".join(table["sketch"][a:b]), "<u2").reshape(-1, REGISTERS)
            if with_sets:
                links = confirmed(registers, sizes, [np.frombuffer(s, _U) for s in table["shingles"][a:b]])
            else:
                links = likely(registers, sizes)
            out += _stars(ids, walked(len(ids), links))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            """Walk all groups but the last, which may go on in the next batch."""
            keys = np.stack([rows.column(k).to_numpy() for k in key], axis=1)
            end = len(keys) if last else int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            out: list = []
            if end:
                whole = rows.slice(0, end)
                table = {c: whole.column(c).to_numpy() for c in ("id", "n_shingles")}
                table |= {c: whole.column(c).to_pylist() for c in columns[len(key) + 2 :]}
                edges_of(keys[:end], table, out)
            return out, rows.slice(end)

        def batch_of(edges):
            a, b = zip(*edges) if edges else ((), ())
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            first, final = rows.slice(0, 1), rows.slice(len(rows) - 1, 1)
            if all(first.column(k)[0] == final.column(k)[0] for k in key):
                continue  # one group so far: wait for its end
            edges, rest = flush(rows, False)
            held = rest.to_batches()
            yield batch_of(edges)
        if held:
            yield batch_of(flush(pa.Table.from_batches(held), True)[0])

    ordered = members.select(columns).repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(walk, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id and kept.

    Linked are documents with 100 * intersection >= 85 * union of their shingle sets; component_id
    is the smallest id reachable over links and kept marks that document. Null, empty and wordless
    texts have no shingles, are linked with nothing and stay. Rows that share an id and a set share
    a verdict; those that share an id and not a set are documents of their own. A row without an id
    is linked with nothing, has no component and stays. Other columns are ignored.
    """
    out = _grouped(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    return out.select(
        F.col("id").cast(kind).alias(id_col),
        "n_shingles",
        F.col("least").cast(kind).alias("component_id"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"),
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's id, what tells its set, and ``least``, the smallest id of its group."""
    small_batches(docs.sparkSession, 256)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    known = written(sketched(rows), "near-sketches")
    nodes = known.filter("id IS NOT NULL AND n_shingles > 0")
    # Equal sets are one node; its smallest id may be another's too, so nodes have numbers.
    nodes = nodes.groupBy(*SETS).agg(F.min("id").alias("doc"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    coarse = components(coarse_edges(nodes))
    found = written(components(confirmed_edges(rows, nodes, coarse)).withColumnRenamed("id", "linked"), "near-linked")
    least = found.join(nodes, F.col("id") == F.col("linked")).groupBy(F.col("component").alias("of")).agg(F.min("doc").alias("first"))
    least = found.join(least, F.col("component") == F.col("of")).select("linked", "first")
    named = nodes.select(*[F.col(c).alias(f"of_{c}") for c in SETS], F.col("id").alias("node"), "doc")
    named = named.join(least, F.col("node") == F.col("linked"), "left").withColumn("least", F.coalesce("first", "doc"))
    named = written(named.drop("linked", "first", "node", "doc"), "near-named")
    same = [F.col(c) == F.col(f"of_{c}") for c in SETS]
    full = known.filter("n_shingles > 0 AND id IS NOT NULL").select("id", *SETS).join(named, same)
    alone = known.filter("NOT (n_shingles > 0 AND id IS NOT NULL)").withColumn("least", F.col("id"))
    return full.select("id", *SETS, "least").unionByName(alone.select("id", *SETS, "least"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates; columns unchanged.

    Rows go by their id and their set of shingles, so of rows that share an id only those go whose
    own text is a copy.
    """
    verdicts = _grouped(docs, id_col, text_col).filter(~F.col("id").eqNullSafe(F.col("least")))
    dropped = written(verdicts.select(F.col("id").cast(docs.schema[id_col].dataType).alias("dropped_id"), *SETS).distinct(), "near-dropped")

    @F.pandas_udf(", ".join(f"{c} long" for c in SETS))
    def own_set(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checksums(shingle_set(t)) for t in texts], columns=SETS)

    def named(text: Column) -> dict[str, Column]:
        found = own_set(F.coalesce(text.cast("binary"), F.lit(b"")))
        return {c: found[c] for c in SETS}

    return without(docs, id_col, text_col, dropped, named)
