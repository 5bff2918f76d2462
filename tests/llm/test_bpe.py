"""Ids and bytes against the library, with chunks of every awkward size."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from boutframe.llm import bpe
from boutframe.llm.catalogue import QUERIES, tokenizer_path
from boutframe.llm.tables import table

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def mixed_text(rng, n):
    parts = ["word", "Été", " ", "  ", "\n\n\n", "'ll", "'re", "don't", "12", "x" * 40, "漢字", "--", " \t ", "½"]
    return "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [None, "", " ", "short one", "<|endoftext|> is text", "a\x1c\x85\xa0b"]
    texts += [mixed_text(rng, n) for n in (5, 40, 200, 900)]
    texts += ["z" * 700, " " * 333 + "a", "ab " * 200, "q" * 90 + " " * 90 + "'" * 90 + "s" * 90, "\n" * 100 + "'re"]
    texts += ["\U00016ea7" * 50 + " x", "a" * 61 + " " + "b" * 61]
    return texts


def regrouped(rows, column):
    parts = defaultdict(list)
    for r in rows:
        parts[r["id"]].append((r["part"], bytes(r[column])))
    return {k: b"".join(x for _, x in sorted(v)) for k, v in parts.items()}


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (50, 4), (200, 200), (7, 5)])
def test_long_texts_in_chunks_equal_the_library(spark, documents, chunk, overlap):
    texts = corpus()
    docs = documents(*enumerate(texts), extra="part").repartition(3)
    found = bpe.encode(docs, VOCABULARY, chunk=chunk, overlap=overlap)
    ids, back = regrouped(found.rows().collect(), "ids"), regrouped(found.decoded().collect(), "bytes")
    for i, text in enumerate(texts):
        assert np.frombuffer(ids[i], "<u4").tolist() == PLAIN.encode_ordinary(text or ""), (i, text)
        assert back[i] == (text or "").encode()
    # Texts beyond a chunk do come in parts, unless one pre-token is all there is.
    longest = texts.index(max((t for t in texts if t), key=len))
    assert found.long.filter(f"id = {longest}").count() > 5


def test_repeated_rows_null_ids_and_empty_tables(spark, documents):
    docs = documents((1, "same"), (1, "same"), (1, "other " * 50), (None, "x"), (None, None), (2, ""))
    found = bpe.encode(docs, VOCABULARY, chunk=32, overlap=8).digests()
    got = sorted((r["id"] or 0, r["n_tokens"]) for r in found.collect())
    assert got == sorted((i or 0, len(PLAIN.encode_ordinary(t))) for i, t in
                         [(1, "same"), (1, "same"), (1, "other " * 50), (None, "x"), (None, ""), (2, "")])
    assert bpe.encode(docs.limit(0), VOCABULARY).digests().collect() == []
    with pytest.raises(ValueError):
        bpe.encode(docs, VOCABULARY, chunk=8, overlap=9)


def test_one_pre_token_of_a_million_characters(spark, documents):
    text = "x" * 300_000 + " tail"
    row = bpe.encode(documents((1, text)), VOCABULARY).digests().first()
    assert row["n_tokens"] == len(PLAIN.encode_ordinary(text))
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_engines_agree_on_every_character():
    own = bpe.codec(VOCABULARY)
    for c in range(0, 0x110000):
        if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 16 == 7):
            text = f"a{chr(c)}{chr(c)}1{chr(c)} {chr(c)}"
            ids = np.frombuffer(own.ids(own.pieces(text)), "<u4").tolist()
            assert ids == PLAIN.encode_ordinary(text), hex(c)
    own.known.clear()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r'abzéßÿ×½1-_.,<|>sSt\xa0 ǅ") | st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    own = bpe.codec(VOCABULARY)
    ids = own.ids(own.pieces(text))
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert own.decoded(ids) == text.encode()


def test_query_equals_the_library(spark, root):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, root, "documents").collect()}
    rows = QUERIES["op12_byte_bpe"](spark, root).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert any(len(t) > bpe.CHUNK for t in docs.values())
    for r in rows:
        ids = PLAIN.encode_ordinary(docs[r["doc_id"]])
        coded = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), coded, back)
