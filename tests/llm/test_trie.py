"""The trie against dictionaries of prefixes, list ranking against a walk."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from boutframe.llm import listrank, ordered, trie
from boutframe.llm.catalogue import ORACLE_SQL, QUERIES
from check import compare, type_differences

SCHEMA = "conv_id long, turn long, role string, text string, place long, node string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs_of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs_of) - 1) * len(node[-1][1]) if node else 0
    return [
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, ())), leaves[node],
         saved[node], sha(",".join(map(str, sorted(c for c in m if paths[c] == node)))))
        for node, m in members.items()
    ]


def built(spark, rows, partitions=5):
    docs = spark.createDataFrame([r + (9, "x") for r in rows], SCHEMA).repartition(partitions)
    conv = F.col("conv")
    turns = trie.numbered_turns(docs)
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return trie.trie(*trie.rebuilt(turns, donor=conv - conv % 100, head=head, most=5))


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else x for x in row)


def corpus(seed=4):
    """Shared and equal conversations, a long one, null turns, roles and texts, ties, absent donors."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 140), *range(250, 300), 1234, 7007]:
        same = rng.random() < 0.5
        for t in range(rng.randint(1, 7)):
            text = f"turn {t} é" if same else rng.choice(["a", "b", "", "long " * 30]) + str(rng.randint(0, 3))
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(5000, t, "user", f"x{t % 3}") for t in range(400)]
    rows += [(5001, t, "user", f"x{t % 3}") for t in range(300)]
    rows += [(8, None, None, None), (8, None, "user", "null turn"), (9, 1, "user", "tie"), (9, 1, "user", "tie")]
    rows += [(None, 0, "user", "no conversation"), (400, 0, "user", "z" * 100_000), (6000, 0, "a", "b"), (6001, 0, "ab", "")]
    return rows


@pytest.mark.parametrize("walked", [listrank.WALKED, 10])
def test_nodes_equal_dictionaries(spark, monkeypatch, walked):
    monkeypatch.setattr(listrank, "WALKED", walked)
    rows = corpus()
    got = [tuple(r) for r in built(spark, rows).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_long_lists_of_ids_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 64)
    rows = [(c, 0, "user", "same") for c in range(0, 5000, 7)]
    got = [tuple(r) for r in built(spark, rows, 9).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_empty_table_and_a_conversation_left_without_turns(spark):
    assert built(spark, [(1, 0, "user", "x")]).limit(0).count() == 0
    docs = spark.createDataFrame([], SCHEMA)
    turns = trie.numbered_turns(docs)
    assert trie.trie(*trie.rebuilt(turns, F.col("conv"), F.lit(0), 0)).collect() == []
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = [tuple(r) for r in built(spark, [(alone, 0, "user", "x")]).collect()]
    assert got == [(alone, 0, None, 1, 0, 1, 0, sha(str(alone)))]


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_list_ranking(spark, monkeypatch, n):
    monkeypatch.setattr(listrank, "WALKED", 50)
    order = [f"item {i}" for i in range(n)]
    random.Random(n).shuffle(order)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None])), "id string, next string").repartition(4)
    got = {r["id"]: r["place"] for r in listrank.ranked(links).collect()}
    assert got == {x: i for i, x in enumerate(order)}


def test_running_sums_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randint(0, 40), 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x long, one long").repartition(6)
    got = ordered.summed(df, ["g"], ["x"], {"upto": F.col("x")}, "test").collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r["place"], r["x"], r["upto"], r["of"]) for r in got if r["g"] == g)
        xs = sorted(r[1] for r in rows if r[0] == g)
        assert [o[:2] for o in own] == list(enumerate(xs))
        assert [o[2] for o in own] == [sum(xs[: i + 1]) for i in range(len(xs))]
        assert {o[3] for o in own} == {len(xs)}


def test_query_equals_sql(spark, root):
    df = QUERIES["op13_prefix_trie"](spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{root}/conversations.parquet')")
    result = con.sql(ORACLE_SQL["op13_prefix_trie"])
    assert compare(df.toPandas(), result.df()) == "ok"
    assert type_differences(df, result) == []
