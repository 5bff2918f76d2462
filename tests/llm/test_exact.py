"""Exact duplicates against SQL and a dictionary, on whole and odd tables."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from boutframe.llm import exact
from boutframe.llm.catalogue import ORACLE_SQL, QUERIES
from boutframe.llm.sieve import marked, sieve
from check import TABLES, compare, type_differences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table_equals_sql(spark, name, size):
    root = f"/root/testdata/sf{size}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    df, result = QUERIES[name](spark, root), con.sql(ORACLE_SQL[name])
    assert compare(df.toPandas(), result.df()) == "ok"
    assert type_differences(df, result) == []


ROWS = [
    (1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "abd"), (6, "Éa"), (7, "éa"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "x" * 199_999 + "y"),
    (11, "p" * 256 + "one"), (12, "p" * 256 + "two"), (12, "p" * 256 + "two"), (None, "abc"), (None, "lone"), (-5, "\x00"), (13, "İ"),
]


@pytest.mark.parametrize("slots", [1 << 22, 64])
def test_odd_rows(spark, documents, monkeypatch, slots):
    monkeypatch.setattr("boutframe.llm.sieve.SLOTS", slots)  # a full sieve only costs time
    docs = documents(*ROWS, extra="keep_id")
    got = exact.exact_groups(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)
    plain = exact.exact_groups(docs).collect()
    # Without digest_all, only texts that reach the last round are hashed whole.
    assert all(r["text_sha256"] for r in plain if r["group_size"] > 1)
    if slots > 64:
        assert any(r["text_sha256"] is None for r in plain)
    assert exact.exact_groups(docs.limit(0)).collect() == []


def test_dropping_keeps_columns(spark, documents):
    docs = documents(*ROWS, extra="dropped")
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    want = sorted({k for _, k, *_ in brute(ROWS) if k is not None})
    assert sorted({r["doc_id"] for r in kept.collect() if r["doc_id"] is not None}) == want


@pytest.mark.parametrize("more", [[], [(20, "same"), (20, "other"), (21, "SAME"), (None, "same"), (None, None)]])
def test_dropping_goes_by_row(spark, documents, more):
    rows = ROWS + more
    best = {norm: keep for _, keep, _, _, norm in brute(rows)}
    digest = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    want = sorted(((i, t) for i, t in rows if best[digest(t)] == i), key=str)
    got = sorted(((r["doc_id"], r["text"]) for r in exact.drop_exact(documents(*rows)).collect()), key=str)
    assert got == want and (None, "lone") in got


def test_sieve_never_loses_a_row(spark):
    held, asked = spark.range(0, 3000, 3), spark.range(3000)
    rows = marked(asked, sieve(held, F.xxhash64("id")), F.xxhash64("id"), "maybe").collect()
    assert all(r["maybe"] for r in rows if r["id"] % 3 == 0)
    assert sum(r["maybe"] for r in rows) < 1100


@pytest.mark.parametrize("name", ["sieve_slot", "sieve_word", "sieve_maybe", "maybe", "row", "id", "own_sha256", "dropped_id"])
def test_columns_of_any_name_come_back(spark, documents, name):
    docs = documents((1, "same"), (2, "same"), (3, "alone"), (None, "same"), extra=name)
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r[name]) for r in kept.collect()) == [(2, "x"), (3, "x")]
