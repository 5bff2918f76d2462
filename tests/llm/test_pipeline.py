"""The stages one by one against brute force, each on what its predecessor kept."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from boutframe.llm.catalogue import ORACLE_SQL
from boutframe.llm.tables import table
from tests.llm.test_setsketch import brute
from tests.llm.test_tokens import expected as token_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_stages_equal_brute_force(spark, tmp_path, size):
    root = f"/root/testdata/sf{size}"
    docs, kept = table(spark, root, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = docs.toPandas()
        if name != "pack_sequences":
            assert docs.columns == COLUMNS
    raw = table(spark, root, "documents").toPandas()
    identified = kept["identify_language"]
    gone = raw[~raw.doc_id.isin(identified.doc_id)]
    assert len(gone) <= 0.01 * len(raw) and len(identified) + len(gone) == len(raw)

    exact = kept["drop_exact_copies"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = identified.assign(norm=identified.text.map(lambda t: t.translate(lower))).groupby("norm").doc_id.max()
    assert sorted(exact.doc_id) == sorted(want)

    near = kept["drop_near_copies"]
    groups = brute(list(zip(exact.doc_id, exact.text)))
    assert sorted(near.doc_id) == sorted({least for _, least in groups.values()})

    mixed = kept["mix_sources"]
    con = duckdb.connect()
    con.register("documents", near)
    taken = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, taken / size FROM ({ORACLE_SQL['op3_mix_sources']}) WHERE taken > 0").fetchall()}
    assert Counter(mixed.doc_id) == taken

    packed = kept["pack_sequences"]
    texts = dict(zip(near.doc_id, near.text))
    assert packed.length.sum() == sum(n * (len(token_ids(texts[i])) + 1) for i, n in taken.items())
    filled = packed.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and len(filled) <= packed.length.sum() / 2048 * 1.05 + 2


def test_stages_take_odd_and_empty_tables(spark, documents):
    odd = documents(
        (1, None, None, None), (2, "", "en", None), (3, "the cat", "en", "s"), (3, "the cat", "en", "s"), (None, "the dog", "en", "t"),
        (4, "word " * 60_000, "en", "t"), (5, "the cat and the dog and the hat", "en", "s"), (6, "der Hund und die Katze", "de", "s"),
        extra="size",
    )
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            if name != "pack_sequences":
                assert out.columns == docs.columns
            out.collect()


def test_pipeline_is_registered(spark, root):
    assert contract.queries()["pipeline"](spark, root).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "pack_sequences"
