"""Candidates against Python's regular expressions, features, held-out quality, odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from boutframe.llm import secret_scan as sc
from boutframe.llm.catalogue import QUERIES, credential
from boutframe.llm.tables import table


def plain_candidates(rows):
    out = []
    for i, text in rows:
        for token in re.finditer(r"\S+", text or ""):
            for m in re.finditer(sc.CANDIDATE, token[0]):
                if re.search(sc.NO_WORD, m[0]):
                    out.append((i or 0, token.start() + m.start(), m[0]))
    return sorted(out)


def test_candidates_of_the_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["id"], r["start"], r["candidate"]) for r in sc.candidates(docs).collect())
    assert got == plain_candidates(rows) and got


def test_held_out_quality_on_the_whole_table(spark):
    rows = QUERIES["op8_secret_scan"](spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r["held_out"]]
    true, false = [[r["predicted"] for r in held if r["label"] == k] for k in (1, 0)]
    assert len(true) > 20 and len(false) > 20
    assert sum(true) >= 0.95 * len(true) and sum(false) <= 0.05 * len(false)


def test_features(spark, documents):
    rows = [
        (1, 'set token = "0123456789abcdefABCD" here', "en", "a/b"), (2, "the house street " * 3, "en", "a/b"),
        (3, "x housestreet-house_XY9 y", "en", None), (4, "house the end", "en", "c"),
    ]
    docs = documents(*rows)
    got = {r["id"]: r for r in sc.described(sc.candidates(docs), docs).collect()}
    assert set(got) == {1, 3}
    one, three = got[1], got[3]
    assert (one["start"], one["candidate"], one["before2"], one["before"], one["after"]) == (13, "0123456789abcdefABCD", "token", "=", "here")
    assert (one["quoted"], one["assigned"], one["length"], one["digit_share"], one["upper_share"]) == (1.0, 1.0, 20.0, 0.5, 0.2)
    assert one["transitions"] == pytest.approx(2 / 20) and one["hex_share"] == 1.0
    # "housestreet" is no word of the corpus, "house" is.
    assert three["word_coverage"] == pytest.approx(5 / 21) and three["quoted"] == 0.0


def test_odd_tables(spark, documents):
    long = "word " * 40_000 + 'key = "a1b2c3d4e5f6a7b8c9d0" ' + "word " * 10
    rows = [
        (1, None), (2, ""), (3, " "), (4, long), (None, 'key = "a1b2c3d4e5f6a7b8c9d0"'), (5, "aaaaaaaaaaaaaaaa1,aaaaaaaaaaaaaaaa1;bbbbbbbbbbbbbbbb2"),
        (5, "aaaaaaaaaaaaaaaa1,aaaaaaaaaaaaaaaa1;bbbbbbbbbbbbbbbb2"), (6, "É" * 40), (7, "UPPERCASEUPPERCASE\tx"),
    ]
    docs = documents(*rows, extra="candidate")
    found = sc.described(sc.candidates(docs), docs)
    got = sorted(((r["id"] or 0), r["start"], r["candidate"]) for r in found.collect())
    assert got == plain_candidates(rows)
    labelled = found.withColumn("label", F.col("candidate").startswith("a1b2").cast("int"))
    scanner = sc.train(labelled)
    scored = sc.scan(found, scanner).collect()
    assert len(scored) == len(got) and all(0 <= r["score"] <= 1 for r in scored)
    one_kind = sc.train(labelled.filter("label = 0"))
    assert {r["score"] for r in sc.scan(found, one_kind).collect()} == {0.0}
    nothing = sc.described(sc.candidates(docs.limit(0)), docs.limit(0))
    assert sc.scan(nothing, sc.train(nothing.withColumn("label", F.lit(1)))).collect() == []


VALUE = "a1B2c3D4e5F6a7B8c9D0"
SPELLINGS = ['{} = "v"', '{}="v"', '{}: "v"', '"{}": "v"', '{{"{}":"v"}}', "{}=v", "{} = v", "{}: v", "{}:v", "{} ='v'", "{}= 'v'", "{} =v", "conf.{}='v',", "{} := `v`"]


def test_labels_of_all_spellings(spark, documents):
    texts = [f"we set {s.format(n)} in it".replace("v", VALUE, 1) for s in SPELLINGS for n in ("token", "api_key", "API-KEY", "colour")]
    true = ["colour" not in t for t in texts]
    texts += [f"a token {VALUE} here", f"token: see {VALUE}", "token=01234567890123456789", 'key: "01234567890123456789"', f"{VALUE}==", f"x = {VALUE}"]
    true += [False] * 6
    docs = documents(*enumerate(texts))
    found = sc.candidates(docs)
    rows = found.select("id", credential(found).alias("label"), "assigned", "name").collect()
    got = {r["id"]: r for r in rows}
    assert len(rows) == len(texts)
    assert [(texts[k], got[k]["label"]) for k in range(len(texts))] == list(zip(texts, true))
    assert all(got[k]["assigned"] == 1 and got[k]["name"] for k in range(len(texts) - 6))


def test_forest_keeps_other_spellings(spark, documents):
    rng = random.Random(5)
    value = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24)) + "7x"
    rows = [(k, f"x{k} {SPELLINGS[k % len(SPELLINGS)].format(rng.choice(['token', 'colour']))} y".replace('v', value(), 1)) for k in range(1400)]
    docs = documents(*rows)
    found = sc.described(sc.candidates(docs), docs)
    found = found.withColumn("label", credential(found).cast("int"))
    scanner = sc.train(found.filter("id % 4 > 0"))
    out = sc.scan(found.filter("id % 4 = 0"), scanner).collect()
    wanted = {k: "token" in t for k, t in rows}
    assert len(out) == 350 and sum(r["predicted"] == wanted[r["id"]] for r in out) >= 0.95 * len(out)
