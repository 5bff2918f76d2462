"""Token ids, counts behind a cache, and packing, against the library itself."""

import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boutframe.llm import packing, tokencount, tokens
from boutframe.llm.catalogue import QUERIES, tokenizer_path
from boutframe.llm.tables import table

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "\n\n x", "it's we'll DON'T", "a<|endoftext|>b", "ﬁne ½ ² Ⅷ 漢字 ​\x1c\x85\xa0é", "×÷ 1234a5",
    "tab\t\tend  ", "word " * 3000, "x" * 20_000, "naïve été\r\n\r\n  ñandú",
]


def expected(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    encoder = tokens.Encoder(Path(PATH).read_text())
    texts = [t or "" for t in ODD]
    for _ in range(2):  # the second time all pieces are known
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)] == [expected(t) for t in texts]


def test_a_worker_remembers_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "RUN_CHARS", 200)
    encoder = tokens.Encoder(Path(PATH).read_text())
    texts = [f"often met w{chr(97 + k // 26)}{chr(97 + k % 26)}ord {k}" for k in range(600)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)] == [expected(t) for t in texts]
    assert len(encoder.known) + len(encoder.earlier) <= 2 * (50 + 200)
    assert " met" in encoder.known or " met" in encoder.earlier


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r'abzéßÿ×½1-_.,<|>sSt\xa0 ǅ") | st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    encoder = tokens.encoder(Path(PATH).read_text())
    assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == expected(text)


@pytest.mark.parametrize("name", ["op10_token_counts"])
def test_counts_of_the_whole_table(spark, root, name):
    docs = {r["doc_id"]: r["text"] for r in table(spark, root, "documents").collect()}
    rows = QUERIES[name](spark, root).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(expected(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((docs[r["doc_id"]] or "").encode()), n > 1024)


def test_cache_is_used_and_only_misses_are_added(spark, documents, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = documents((1, "one two"), (2, "one two"), (3, None), (None, "x"), (1, "one two"), extra="content")
    got = tokencount.token_counts(first, PATH, cache).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 2), (3, 0)]
    stored = spark.read.parquet(cache)
    assert stored.count() == 3
    # A stored count is trusted, so a changed one shows that the text was not encoded again.
    spark.createDataFrame(
        [(r["content"], 77, r["tokenizer"]) for r in stored.collect()], tokencount.CACHE_SCHEMA
    ).write.partitionBy("tokenizer").parquet(f"{cache}-2")
    more = documents((1, "one two"), (9, "new text"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(more, PATH, f"{cache}-2").collect()}
    assert got == {1: 77, 9: 2}
    assert spark.read.parquet(f"{cache}-2").count() == 4


def test_cache_of_an_empty_table(spark, documents, tmp_path):
    assert tokencount.token_counts(documents().limit(0), PATH, f"file://{tmp_path}/c").collect() == []


def check_packed(rows, texts):
    """Pieces restore each document's ids; sequences are gapless and within capacity."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids = np.array([*expected(texts[doc]), 0], "<u4")
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert [r["start"] for r in found] == [0, *np.cumsum([r["length"] for r in found])[:-1]]
        assert sum(r["length"] for r in found) == len(ids)
        assert all(r["length"] == 2048 for r in found[1:])
        for r in found:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by_bin)


def test_packing_of_the_whole_table(spark, root):
    texts = {r["doc_id"]: r["text"] for r in table(spark, root, "documents").collect()}
    rows = QUERIES["op5_best_fit_pack"](spark, root).collect()
    bins = check_packed(rows, texts)
    total = sum(r["length"] for r in rows)
    assert bins <= 1.02 * total / 2048 + 2


def test_packing_of_odd_texts_and_their_sequences(spark, documents):
    texts = dict(enumerate(ODD))
    docs = documents(*texts.items(), extra="piece")
    packed = packing.pack(docs, PATH, with_ids=True)
    check_packed(packed.collect(), texts)
    found = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        whole = found[r["sequence_id"]]["ids"]
        assert whole[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def test_packing_nothing(spark, documents):
    assert packing.pack(documents().limit(0), PATH).collect() == []


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_plan_holds_every_piece_in_few_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 100, 2048])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / (capacity * rng.choice([0.05, 0.2, 0.5]))))) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_bins(counts, capacity)
    held = defaultdict(int)
    for kind, bins in plan:
        assert sum(kind) <= capacity and bins > 0
        assert sum(3 * n > capacity for n in kind) <= 2
        for n in kind:
            held[n] += bins
    assert dict(held) == counts
    # A bin never holds three pieces of over a third, which plain best fit may allow at 3 * n = capacity + 1.
    assert sum(b for _, b in plan) <= best_fit_decreasing(lengths, capacity) * 1.03 + 1
