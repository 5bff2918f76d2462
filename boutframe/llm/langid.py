"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language is counted on a bounded sample of labelled documents. The models share
their n-grams: an n-gram seen in any language has a row of log probabilities, one per language,
with all backing off done beforehand, found by its 64-bit hash in a sorted array. A text goes to
the language of lowest cross-entropy per character. Documents of the sample that the counts have
not seen calibrate how sure a choice is, and the entropy beyond which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.tables import held_out, runs, small_batches
from boutframe.session import written

ORDER = 4
#: Labelled documents of each language that the models are counted on, about: the bound of the fit.
SAMPLE_DOCS = 1500
#: Of these, the share that calibrates instead.
CALIBRATION = 0.2
#: Of a language's calibrating documents the highest entropies are left out, one at least: the label may be wrong.
TRIMMED = 0.02
#: A text is rejected so many standard deviations above the usual entropy of its language, but not
#: below the middle between that and the entropy of documents in other languages.
REJECT_AT = 8.0
UNKNOWN = "und"
RUN_CHARS = 100_000

_U = np.uint64
_ROLL = _U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, other runs than letters as one space, and their text."""
    raw = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), "<u4") for t in texts]
    of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    chars = np.concatenate(raw) if raw else np.empty(0, "<u4")
    chars = np.where(_letters()[chars], chars, 32).astype(np.uint32)
    space = chars == 32
    again = np.r_[True, (of[1:] == of[:-1]) & space[:-1]][: len(chars)]
    if len(chars):
        again[np.r_[True, of[1:] != of[:-1]]] = True  # a text begins after a space
    keep = ~(space & again)
    return chars[keep], of[keep]


def grams(chars: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The ORDER characters that end at each character; spaces stand before a text."""
    out = np.full((len(chars), ORDER), 32, np.uint32)
    out[:, -1] = chars
    for back in range(1, min(ORDER, len(chars))):
        inside = of[back:] == of[:-back]
        out[back:, -1 - back][inside] = chars[:-back][inside]
    return out


def hashed(table: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of characters."""
    h = np.full(len(table), table.shape[1], _U)
    for k in range(table.shape[1]):
        h = h * _ROLL + table[:, k].astype(_U) + _U(1)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class HashArray:
    """Rows of values under sorted hashes; a directory over leading bits starts each search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        edges = np.arange((1 << self.bits) + 1, dtype=_U)[:-1] << _U(64 - self.bits)
        self.starts = np.r_[np.searchsorted(self.keys, edges), len(keys)].astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        cell = (hashes >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.starts[cell], self.starts[cell + 1]
        out = np.full(len(hashes), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, wanted = at[todo], end[todo], hashes[todo]
        while len(todo):
            key = self.keys[at]
            hit = key == wanted
            out[todo[hit]] = at[hit]
            on = (key < wanted) & (at + 1 < end)
            todo, at, end, wanted = todo[on], at[on] + 1, end[on], wanted[on]
        return out


class Models:
    """Log probabilities of all languages: ``grams[n]`` of n-grams, ``backoff[n]`` of their contexts."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts``: distinct ORDER-grams and their counts, for each language."""
        self.languages = languages
        by_order = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):  # lower orders count the kinds of n-grams, not the n-grams
            by_order[n] = [_distinct(g[:, 1:], np.ones(len(g))) for g, _ in by_order[n + 1]]
        self.grams: dict[int, HashArray] = {}
        self.backoff: dict[int, HashArray] = {}
        alphabet = len(np.unique(np.concatenate([g[:, 0] for g, _ in by_order[1]]))) + 1
        lower = np.full(len(languages), 1 / alphabet)
        for n in range(1, ORDER + 1):
            union = np.unique(np.concatenate([g for g, _ in by_order[n]]), axis=0)
            context, ctx = np.unique(union[:, :-1], axis=0, return_inverse=True) if n > 1 else (None, np.zeros(len(union), int))
            ctx = ctx.reshape(-1)
            keys = HashArray(hashed(union), np.arange(len(union)))
            below = np.tile(lower, (len(union), 1)) if n == 1 else np.exp(self.log_p(union[:, 1:]))
            p, gamma = np.empty((len(union), len(languages))), np.ones((ctx.max() + 1, len(languages)))
            for k, (g, c) in enumerate(by_order[n]):
                count = np.zeros(len(union))
                count[keys.values[keys.find(hashed(g))]] = c
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                total = np.bincount(ctx, count, minlength=len(gamma))
                kinds = np.bincount(ctx, count > 0, minlength=len(gamma))
                gamma[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                seen = np.maximum(count - discount, 0) / np.maximum(total, 1)[ctx]
                p[:, k] = seen + gamma[ctx, k] * below[:, k]
            self.grams[n] = HashArray(hashed(union), np.log(p).astype(np.float32))
            if n == 1:
                self.unseen = np.log(gamma[0] * lower)
            else:
                self.backoff[n] = HashArray(hashed(context), np.log(gamma).astype(np.float32))

    def log_p(self, table: np.ndarray) -> np.ndarray:
        """Log probability of each row's last character after the others, a column per language."""
        n = table.shape[1]
        at = self.grams[n].find(hashed(table))
        out = self.grams[n].values[at].astype(np.float64)
        lost = np.flatnonzero(at < 0)
        if not len(lost):
            return out
        if n == 1:
            out[lost] = self.unseen
            return out
        shorter = table[lost]
        where = self.backoff[n].find(hashed(shorter[:, :-1]))
        weight = self.backoff[n].values[where] * (where >= 0)[:, None]
        out[lost] = self.log_p(shorter[:, 1:]) + weight
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, its variance, and lengths.

        Texts are worked through in runs of bounded length, so memory follows the longest text.
        """
        runs, held = [[]], 0
        for text in texts:
            if held > RUN_CHARS:
                runs, held = [*runs, []], 0
            runs[-1].append(text)
            held += len(text or "")
        return tuple(np.concatenate(parts) for parts in zip(*map(self._score, runs)))

    def _score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars, of = codes(texts)
        n = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), int)
        entropy, spread = (np.zeros((len(texts), len(self.languages))) for _ in range(2))
        if len(chars):
            starts = np.r_[0, np.cumsum(n)[:-1]][n > 0]
            log_p = self.log_p(grams(chars, of))
            length = n[n > 0][:, None]
            entropy[n > 0] = -np.add.reduceat(log_p, starts) / length
            spread[n > 0] = np.add.reduceat(np.square(log_p), starts) / length - entropy[n > 0] ** 2
        return entropy, spread, n


def _distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    union, at = np.unique(rows, axis=0, return_inverse=True)
    return union, np.bincount(at.reshape(-1), counts, minlength=len(union))


@dataclass
class Identifier:
    """Models with their calibration."""

    models: Models
    sharpness: float = 1.0  # of the softmax over negative entropies
    usual: np.ndarray | None = None  # by language: mean entropy, its variance, the variance of a character
    middle: np.ndarray | None = None  # by language, between its own documents and foreign ones

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, entropy and whether rejected, for each text."""
        entropy, _, n = self.models.score(texts)
        out = []
        for row, length in zip(entropy, n):
            if not length or not self.models.languages:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            best = int(row.argmin())
            score = 1 / np.exp(self.sharpness * (row[best] - row)).sum()
            out.append((self.models.languages[best], float(score), float(row[best]), bool(row[best] > self.limit(best, length))))
        return out

    def limit(self, language: int, length: int) -> float:
        if self.usual is None:
            return np.inf
        mean, doc, char = self.usual[language]
        return max(mean + REJECT_AT * (doc + char / length) ** 0.5, self.middle[language])

    def calibrate(self, entropy: np.ndarray, spread: np.ndarray, labels: list[str]) -> None:
        """Fit the softmax by likelihood, and each language's usual entropy.

        ``entropy`` and ``spread`` are those of :meth:`Models.score`, of texts with letters.
        """
        index = {name: k for k, name in enumerate(self.models.languages)}
        truth = np.array([index[x] for x in labels], int)
        if not len(truth):
            return
        rows = np.arange(len(truth))

        def loss(t):
            z = -t * (entropy - entropy.min(axis=1, keepdims=True))
            return -(z[rows, truth] - np.log(np.exp(z).sum(axis=1))).mean()

        self.sharpness = min((2.0**k for k in range(-1, 8)), key=loss)
        usual, middle = [], []
        for k in range(len(self.models.languages)):
            own = np.flatnonzero(truth == k)
            # Of a language that too few documents calibrate, all documents tell.
            own = own if len(own) > 1 else np.arange(len(truth))
            foreign = np.setdiff1d(np.arange(len(truth)), own)
            own = own[np.argsort(entropy[own, k], kind="stable")][: max(1, int(len(own) * (1 - TRIMMED)))]
            h = entropy[own, k]
            usual.append((h.mean(), h.var(), spread[own, k].mean()))
            apart = entropy[foreign, k].mean() if len(foreign) else h.mean()
            middle.append(max(h.max(), (h.mean() + apart) / 2))
        self.usual, self.middle = np.array(usual), np.array(middle)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """Models of the languages that ``labelled`` names, from about ``sample_docs`` rows of each.

    Rows are drawn by a hash of their key, which is no input of the models; rows without text,
    letters or language are left out. Every language that has a row is learned, be it one. The driver
    gets distinct n-grams of the sample and the entropies of its calibrating share, and no texts.
    """
    rows = labelled.filter(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(key_col), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    sizes = rows.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"), F.max("place").alias("last"))
    # A language whose documents would all calibrate has them counted instead.
    share = F.when(F.col("last") < CALIBRATION, 0.0).otherwise(CALIBRATION)
    sizes = sizes.select("l", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n")).alias("odds"), share.alias("share"))
    # One row per language; its size decides how it is joined.
    sample = rows.join(written(sizes, "languages"), F.col("lang") == F.col("l")).withColumn("place", F.col("place") / F.col("odds"))
    sample = sample.filter("place < 1").select("lang", "text", (F.col("place") < F.col("share")).alias("calibrates"))
    # Read twice: for the counts, and by the models to be calibrated.
    sample = written(sample, "language-sample")
    small_batches(labelled.sparkSession)
    counted = sample.filter("NOT calibrates").mapInArrow(_count, GRAM_SCHEMA)
    # The n-grams of the bounded sample, as columns of numbers.
    found = counted.groupBy("lang", "head", "tail").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(pc.unique(found.column("lang")).to_pylist())
    counts = []
    for lang in languages:
        own = found.filter(pc.equal(found.column("lang"), lang))
        counts.append((unpacked(own.column("head").to_numpy(), own.column("tail").to_numpy()), own.column("n").to_numpy().astype(float)))
    del found
    if not languages:
        return Identifier(_NoModels())
    identifier = Identifier(Models(languages, counts))
    shared = labelled.sparkSession.sparkContext.broadcast(identifier.models)  # bounded by the sample

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, spread, n = shared.value.score(batch.column("text").to_pylist())
            columns = [batch.column("lang"), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(list(spread), pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["lang", "entropy", "spread"]).filter(pa.array(n > 0))

    # Numbers of the bounded sample, two per language and document.
    held = sample.filter("calibrates").filter(F.col("lang").isin(languages))
    held = held.mapInArrow(scores, "lang string, entropy array<double>, spread array<double>").orderBy("lang", "entropy").toArrow()
    tables = (np.array(held.column(c).to_pylist(), float).reshape(-1, len(languages)) for c in ("entropy", "spread"))
    identifier.calibrate(*tables, held.column("lang").to_pylist())
    return identifier


class _NoModels:
    languages: list[str] = []

    def score(self, texts):
        return np.zeros((len(texts), 0)), np.zeros((len(texts), 0)), np.zeros(len(texts), int)


GRAM_SCHEMA = "lang string, head long, tail long, n long"


def packed(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four characters as two numbers each."""
    wide = table.astype(np.int64)
    return wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]


def unpacked(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    low = (1 << 32) - 1
    return np.stack([head >> 32, head & low, tail >> 32, tail & low], axis=1).astype(np.uint32)


def gram_counts(names: list[str], texts: list[str | None]) -> pa.RecordBatch:
    """Counted n-grams of the texts of each name."""
    out: dict[str, list] = {"lang": [], "head": [], "tail": [], "n": []}
    for name in sorted(set(names)):
        chars, of = codes([t for t, x in zip(texts, names) if x == name])
        head, tail = packed(grams(chars, of))
        order = np.lexsort((tail, head))
        head, tail = head[order], tail[order]
        first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])][: len(head)])
        n = np.diff(np.r_[first, len(head)])
        for column, values in zip(out.values(), (np.full(len(first), name, object), head[first], tail[first], n)):
            column.append(values)
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out.values(), types)]
    return pa.record_batch(columns, names=list(out))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = iter(batch.column("lang").to_pylist())
        for texts in runs(batch.column("text").to_pylist(), RUN_CHARS):
            yield gram_counts(list(islice(names, len(texts))), texts)


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, entropy and rejected.

    A null text or one without letters is ``und``, with score 0, and rejected; so is every text if
    no language was learned. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(identifier)  # bounded by the sample it was counted on

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.predict(batch.column("text").to_pylist())
            lang, score, entropy, rejected = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "entropy": pa.array(entropy, pa.float64()),
                    "rejected": pa.array(rejected, pa.bool_()),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    found = rows.mapInArrow(
        predict, f"id {kind}, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"
    )
    return found.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is rejected; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.predict(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([not r[3] for r in rows], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
