"""Roots and proofs against plain hashing."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from boutframe.llm import merkle
from boutframe.llm.catalogue import ORACLE_SQL, QUERIES
from check import compare, type_differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climbed(nodes):
    """The root of a list of nodes, and every node's siblings level by level."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [range(a, min(a + 16, len(level))) for a in range(0, len(level), 16)]
        for run in runs:
            for at in run:
                for i in owners[at]:
                    paths[i].append(([level[x] for x in run if x < at], [level[x] for x in run if x > at]))
        owners = [[i for at in run for i in owners[at]] for run in runs]
        level = [h(*[level[x] for x in run]) for run in runs]
    return level[0], paths


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded root of the tampered row) per row, in order."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        due = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        true = leaf(doc_id, source, lang, n_chars, text)
        claimed = leaf(doc_id, source, lang, n_chars, low) if due else true
        groups[source].append((doc_id is not None, doc_id or 0, true, claimed))
    out = []
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([r[2] for r in sorted(groups[s])]) for s in order}
    root, tops = climbed([trees[s][0] for s in order])
    for s, top in zip(order, tops):
        for (known, doc_id, true, claimed), path in zip(sorted(groups[s]), trees[s][1]):
            node = claimed
            for left, right in path + top:
                node = h(*left, node, *right)
            siblings = [x for left, right in path + top for x in left + right]
            out.append((doc_id if known else None, true, trees[s][0], root, h(*siblings), node, node == root))
    return out


def corpus():
    """Groups of 1, 2, 16, 17, 300 and 700 rows and forty small ones; nulls, ties and repeated rows."""
    rows = [(1, "Lone", "en", "lone", 4), (None, None, None, None, None), (2, "", None, None, 0)]
    for name, n in (("b", 16), ("c", 17), ("é", 300), ("big", 700)):
        rows += [(1000 + 3 * i, f"{name} Text {i} é", "de", name, i) for i in range(n)]
    rows += [(i, "S" * i, "en", f"s{i}", i) for i in range(40)]
    rows += [(5, "Tie One", "en", "big", 1), (5, "Tie Two", "en", "big", 1), (5, "Tie Two", "en", "big", 1)]
    rows += [(None, "No Id", "en", "big", 1)] * 3 + [(7, "Long " * 50_000, "en", "big", 1)]
    return rows


def proven(docs, **options):
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = F.when(due, merkle.leaf_digest(*[low if f == "text" else docs[f] for f in merkle.FIELDS]))
    found = merkle.build(docs, carry={"claimed": claimed}, **options)
    rows = found.proofs().withColumn("node", merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")))
    columns = ["id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")), "node", F.expr("node = root")]
    return found, [tuple(r) for r in rows.select(*columns).collect()]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("span", [1, 2, 3])
def test_proofs_equal_plain_hashing(spark, span):
    rows = corpus()
    docs = spark.createDataFrame([r + ("x", 9, "y") for r in rows], SCHEMA).repartition(7)
    _, got = proven(docs, span=span)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_stored_levels_are_every_few_and_can_be_read_again(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([r + ("x", 9, "y") for r in rows], SCHEMA)
    built, _ = proven(docs, folder=f"file://{tmp_path}/manifest")
    assert len(built.groups.levels) == 2 and len(built.top.levels) == 1
    sizes = [level.selectExpr("sum(size(nodes))", "max(size(nodes))").first() for level in built.groups.levels]
    # 708 rows fill three subtrees of 256, 300 rows two: of the levels above the leaves, only the second is stored.
    assert [tuple(s) for s in sizes] == [(len(rows), 256), (5, 3)]
    again = merkle.stored(spark, f"file://{tmp_path}/manifest")
    assert again.root().collect() == built.root().collect()
    assert sorted(again.proofs().collect(), key=str) == sorted(built.proofs().collect(), key=str)


def test_order_and_partitions_make_no_difference(spark):
    rows = corpus()
    roots = set()
    for n in (1, 5, 40):
        docs = spark.createDataFrame([r + ("x", 9, "y") for r in rows[::-1] if r], SCHEMA).repartition(n)
        roots.add(merkle.build(docs).root().first()["root"])
    assert roots == {expected(rows)[0][3]}


def test_single_row_and_empty_table(spark, documents):
    one = documents((3, "x"))
    _, got = proven(one)
    alone = leaf(3, "s", "en", None, "x")
    assert got == [(3, alone, alone, alone, h(), alone, True)]
    found, got = proven(one.limit(0))
    assert got == [] and found.root().collect() == []


def test_query_equals_sql(spark, root):
    df = QUERIES["op11_merkle_manifest"](spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/documents.parquet')")
    result = con.sql(ORACLE_SQL["op11_merkle_manifest"])
    assert compare(df.toPandas(), result.df()) == "ok"
    assert type_differences(df, result) == []
    rows = df.collect()
    tampered = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert 0 < sum(not r["verified"] for r in rows) <= len(tampered) < len(rows)
