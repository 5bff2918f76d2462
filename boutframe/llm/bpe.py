"""Byte-level BPE of whole texts by a rank file, long texts in overlapping chunks.

A text beyond ``CHUNK`` characters is cut into chunks that go to tasks of their own, each with some
of the text that follows. A chunk is split into pre-tokens from its first character on, so its first
boundaries may be wrong. What a pattern without look-behind finds from a boundary on depends only on
the text from there, so that two chunks that have a boundary in common in their overlap agree from
it on: there they are stitched. Chunks without one are joined and split again as one, until all are
stitched; that costs memory only where a single pre-token is longer than the overlap.

Ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutframe.llm.tables import small_batches
from boutframe.session import written

CHUNK = 16_384
OVERLAP = 512
#: How many characters beyond a pre-token the pattern may look at to end it, itself included.
LOOKAHEAD = 3
#: Pre-tokens a worker remembers; beyond that it starts anew. Bounds memory, not results.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's content, the pattern that splits texts before the merges, and disputed characters.

    ``disputed`` has ranges of characters, first and last, with what stands in for them (:func:`disputes`).
    """

    ranks: bytes
    pattern: str
    disputed: tuple[tuple[int, int, str], ...]

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        return cls(Path(path).read_bytes(), pattern, disputes())


@lru_cache(maxsize=2)
def codec(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


class Codec:
    """What a worker keeps of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import regex
        import tiktoken

        lines = (line.split() for line in vocabulary.ranks.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        # A pattern that takes a whole piece, as pieces are found here.
        self.merger = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(vocabulary.pattern).findall
        ranges = vocabulary.disputed
        spans = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b, _ in ranges)
        self.beyond = re.compile(f"[{chr(ranges[0][0])}-{chr(0x10FFFF)}]") if ranges else None
        self.disputed = re.compile(f"[{spans}]") if ranges else None
        self.stand_ins = {c: stand_in for a, b, stand_in in ranges for c in range(a, b + 1)}
        self.known: dict[str, bytes] = {}

    def lengths(self, text: str) -> list[int]:
        """Characters of each pre-token of a text."""
        return list(map(len, self.split(text.translate(self.stand_ins) if self._in_dispute(text) else text)))

    def pieces(self, text: str) -> list[str]:
        if not self._in_dispute(text):
            return self.split(text)
        ends = list(accumulate(self.lengths(text)))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def _in_dispute(self, text: str) -> bool:
        """Whether a text has a disputed character; most have none as high as the first of them."""
        return bool(self.beyond and self.beyond.search(text) and self.disputed.search(text))

    def ids(self, pieces: list[str]) -> bytes:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = np.array(self.merger.encode_ordinary(piece), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def disputes() -> tuple[tuple[int, int, str], ...]:
    """Characters whose class the pattern engine here and tiktoken's see differently, as ranges.

    The two follow different versions of Unicode. A stand-in has the class that tiktoken sees. They
    are found once, on the driver, as looking at all characters takes more memory than a worker's share.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    stand_ins, wrong = {}, set()
    for kind, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t")):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(every)).decode())
        differ = theirs.symmetric_difference(regex.findall(kind, every))
        wrong |= differ
        stand_ins |= dict.fromkeys(theirs & differ, stand_in)
    ranges: list[tuple[int, int, str]] = []
    for c in sorted(wrong):
        stand_in = stand_ins.get(c, "!")
        if ranges and ranges[-1][1] == ord(c) - 1 and ranges[-1][2] == stand_in:
            ranges[-1] = (ranges[-1][0], ord(c), stand_in)
        else:
            ranges.append((ord(c), ord(c), stand_in))
    return tuple(ranges)


@dataclass(frozen=True)
class Encoded:
    """Ids of all texts: ``id``, ``row``, ``part``, ``ids``; a text's ids are its parts' in turn.

    ``row`` tells rows apart that share an id. ``short`` has one part per text; ``long`` has more.
    """

    short: DataFrame
    long: DataFrame
    vocabulary: Vocabulary

    def rows(self) -> DataFrame:
        return self.short.unionByName(self.long)

    def decoded(self) -> DataFrame:
        """The texts' bytes in parts, ``id``, ``row``, ``part``, ``bytes``: each id's own bytes, joined."""
        rows = self.rows()
        fields = {f.name: f.dataType.simpleString() for f in rows.schema}
        schema = f"id {fields['id']}, row long, part long, bytes binary"
        return rows.mapInArrow(_decoder(self.vocabulary), schema)

    def digests(self) -> DataFrame:
        """A row per text: ``id``, ``n_tokens`` and the SHA-256 of its ids and of its decoded bytes.

        The parts of a long text come sorted to one task, which holds one of them at a time.
        """
        kind = self.short.schema["id"].dataType.simpleString()
        schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        digest = _digester(self.vocabulary)
        ordered = self.long.repartition("row").sortWithinPartitions("row", "part")
        return self.short.mapInArrow(digest, schema).unionByName(ordered.mapInArrow(digest, schema))


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> Encoded:
    """Ids of every row's whole text, as ``tiktoken`` gives them without special tokens.

    Null is read as empty and has no ids. Repeated rows and ids are encoded each; other columns are
    ignored; an empty table gives none. ``overlap`` is at most ``chunk``, and more than
    ``LOOKAHEAD``. Texts of up to ``chunk`` characters are encoded where they are read; the chunks
    of longer ones are written once and join only their two limits.
    """
    if not LOOKAHEAD < overlap <= chunk:
        raise ValueError("an overlap is longer than the look-ahead, and not longer than a chunk")
    small_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, part long, ids binary"
    short = rows.filter(F.char_length("text") <= chunk).mapInArrow(_encoder(vocabulary), schema)

    cut = f"id {kind}, row long, part long, size long, last boolean, text string"
    found = f"{cut}, lengths binary, head array<long>, tail array<long>"
    chunks = rows.filter(F.char_length("text") > chunk).mapInArrow(_cutter(chunk, overlap), cut)
    split = _splitter(vocabulary, overlap)
    chunks = written(chunks.repartition("row", "part").mapInArrow(split, found), "bpe-chunks")
    while True:
        limits = written(_stitched(chunks), "bpe-limits")
        if not limits.filter("part <> run").head(1):
            break
        # A chunk that found no boundary in common becomes one with those before it.
        runs = limits.withColumn("members", F.count("*").over(W.partitionBy("row", "run"))).filter("members > 1")
        keyed = runs.select(F.col("row").alias("of_row"), F.col("part").alias("of_part"), "run")
        same = (F.col("row") == F.col("of_row")) & (F.col("part") == F.col("of_part"))
        alone = chunks.join(keyed, same, "left_anti")
        joined = chunks.join(keyed, same).groupBy("id", "row", F.col("run").alias("part")).agg(
            F.sum("size").alias("size"),
            F.bool_or("last").alias("last"),
            F.sort_array(F.collect_list(F.struct("part", "size", "last", "text"))).alias("members"),
        )
        # The last one brings its overlap, the others what is their own.
        texts = F.transform("members", lambda m: m["text"].substr(F.lit(1), m["size"].cast("int")))
        whole = F.concat(
            F.array_join(F.slice(texts, 1, F.size("members") - 1), ""), F.element_at("members", -1)["text"]
        )
        joined = joined.select("id", "row", "part", "size", "last", whole.alias("text"))
        chunks = written(alone.unionByName(joined.mapInArrow(split, found)), "bpe-chunks")

    own = limits.select(F.col("row").alias("of_row"), F.col("part").alias("of_part"), "begin", "stop")
    stretches = chunks.join(own, (F.col("row") == F.col("of_row")) & (F.col("part") == F.col("of_part")))
    stretches = stretches.select("id", "row", "part", "text", "lengths", "begin", "stop")
    return Encoded(short, stretches.mapInArrow(_encoder(vocabulary), schema), vocabulary)


def _stitched(chunks: DataFrame) -> DataFrame:
    """Where each chunk's own stretch begins and stops, in its characters; ``run`` is its first chunk.

    A chunk begins where it first has a boundary in common with the one before, and stops where the
    next begins. One without such a boundary belongs to the run before it.
    """
    order = W.partitionBy("row").orderBy("part")
    begin = F.when(F.lag("part").over(order).isNull(), 0).otherwise(
        F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    )
    limits = chunks.select("row", "part", "size", "last", begin.alias("begin"))
    run = F.last(F.when(F.col("begin").isNotNull(), F.col("part")), ignorenulls=True).over(order)
    stop = F.when(~F.col("last"), F.col("size") + F.lead("begin").over(order))
    return limits.select("row", "part", "begin", stop.alias("stop"), run.alias("run"))


def _cutter(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                text, own = text.as_py(), batch.slice(i, 1)
                for part, start in enumerate(range(0, len(text), chunk)):
                    last = start + chunk + overlap >= len(text)
                    piece = text[start:] if last else text[start : start + chunk + overlap]
                    yield pa.record_batch(
                        {
                            "id": own.column("id"),
                            "row": own.column("row"),
                            "part": pa.array([part], pa.int64()),
                            "size": pa.array([len(piece) if last else chunk], pa.int64()),
                            "last": pa.array([last]),
                            "text": pa.array([piece]),
                        }
                    )
                    if last:
                        break

    return cut


def _splitter(vocabulary: Vocabulary, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = codec(vocabulary).lengths
        for batch in batches:
            out = {name: [] for name in ("lengths", "head", "tail")}
            for text, size, last in zip(*(batch.column(c).to_pylist() for c in ("text", "size", "last"))):
                lengths = np.array(measure(text), "<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                sure = ends if last else ends[ends <= len(text) - LOOKAHEAD]
                out["lengths"].append(lengths.tobytes())
                out["head"].append([0, *sure[sure <= overlap].tolist()])
                out["tail"].append([] if last else (sure[sure >= size] - size).tolist())
            kinds = {"lengths": pa.binary(), "head": pa.list_(pa.int64()), "tail": pa.list_(pa.int64())}
            added = [pa.array(out[name], kind) for name, kind in kinds.items()]
            names = ["id", "row", "part", "size", "last", "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *added], names=[*names, *kinds])

    return split


def _encoder(vocabulary: Vocabulary):
    """Ids of whole texts, or of the stretch of a chunk that is its own."""

    def encode_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if "lengths" in batch.schema.names:
                limits = (batch.column(c).to_pylist() for c in ("lengths", "begin", "stop"))
                pieces = (_between(*x) for x in zip(texts, *limits))  # one text's at a time
                parts = batch.column("part")
            else:
                pieces, parts = map(own.pieces, texts), pa.array([0] * len(texts), pa.int64())
            ids = pa.array([own.ids(p) for p in pieces], pa.binary())
            yield pa.record_batch({"id": batch.column("id"), "row": batch.column("row"), "part": parts, "ids": ids})

    return encode_


def _between(text: str, lengths: bytes, begin: int, stop: int | None) -> list[str]:
    """The pre-tokens of a chunk from one boundary to another, or to its end."""
    ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)
    first = 0 if begin == 0 else int(np.searchsorted(ends, begin)) + 1
    until = len(ends) if stop is None else int(np.searchsorted(ends, stop)) + 1
    ends = ends[first:until].tolist()
    return [text[a:b] for a, b in zip([begin, *ends], ends)]


def _decoder(vocabulary: Vocabulary):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = pa.array([own.decoded(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.record_batch({c: batch.column(c) for c in ("id", "row", "part")} | {"bytes": texts})

    return decode


def _digester(vocabulary: Vocabulary):
    """Digests of rows that come with all their parts in turn."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, state = codec(vocabulary), None, None
        for batch in batches:
            done = []
            for i, (at, ids) in enumerate(zip(batch.column("row").to_pylist(), batch.column("ids"))):
                if at != row:
                    if state:
                        done.append(state)
                    row, state = at, [batch.column("id").slice(i, 1), 0, hashlib.sha256(), hashlib.sha256()]
                ids = ids.as_py()
                state[1] += len(ids) // 4
                state[2].update(ids)
                state[3].update(own.decoded(ids))
            if done:
                yield _finished(done)
        if state:
            yield _finished([state])

    return digest


def _finished(states: list) -> pa.RecordBatch:
    ids, counts, coded, decoded = zip(*states)
    return pa.record_batch(
        {
            "id": pa.concat_arrays(ids),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array([x.hexdigest() for x in coded]),
            "decoded_sha256": pa.array([x.hexdigest() for x in decoded]),
        }
    )
