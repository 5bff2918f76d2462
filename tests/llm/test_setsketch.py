"""Shingle sets, sketches, walks and whole groups, against brute force."""

import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pytest

from boutframe.llm import setsketch as ss
from boutframe.llm.catalogue import QUERIES
from boutframe.llm.components import components
from boutframe.llm.tables import table


def plain_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """{id: (set size, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    pairs = {p for ns in holders.values() for p in combinations(ns, 2)}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        common = len(x & y)
        if 100 * common >= percent * (len(x) + len(y) - common):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def as_dict(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    root = f"/root/testdata/sf{size}"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, root, "documents").collect()]
    assert as_dict(QUERIES["op6_setsketch_dedup"](spark, root)) == brute(rows)


def variants(rng, groups=6, members=12, words=120):
    """Groups of texts at many distances from a text of their own, some far, some equal."""
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(words)] = f"x{rng.randrange(9999)}"
            out.append(" ".join(text).title() if rng.random() < 0.2 else " ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [2048, 5])
def test_chains_and_blocks(spark, documents, monkeypatch, block):
    monkeypatch.setattr(ss, "BLOCK_DOCS", block)
    monkeypatch.setattr(ss, "BLOCK_BYTES", block * 1600)
    rows = variants(random.Random(3))
    assert as_dict(ss.near_groups(documents(*rows))) == brute(rows)


def test_odd_texts(spark, documents):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\x0btwo"), (6, "a b c d e"), (7, "É b c d e"), (8, "é b c d e"),
        (9, "x " * 30_000), (10, "X\n" * 40_000), (11, "a\xa0b c d e"), (12, "same same same same same same"), (13, "\x85"),
    ]
    assert as_dict(ss.near_groups(documents(*rows, extra="id"))) == brute(rows)
    got = ss.near_groups(documents((None, "one two three"), (5, "one two three"), (5, "one two three"), (3, "one two three"))).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(3, 3, True), (5, 3, False), (5, 3, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert ss.near_groups(documents().limit(0)).collect() == []


def test_dropping_keeps_columns_and_one_of_a_group(spark, documents):
    docs = documents((4, "one two three"), (2, "One two three"), (None, "one two three"), (7, None), extra="component")
    kept = ss.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 7]


def pair(rng, size, j):
    common = round(size * 2 * j / (1 + j))
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    both = draw(common)
    return [np.unique(np.r_[both, draw(size - common)]) for _ in range(2)]


@pytest.mark.parametrize("size", [30, 300, 5000])
def test_estimates_follow_the_similarity(size):
    rng = np.random.default_rng(size)
    for j in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(60):
            x, y = pair(rng, size, j)
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            regs = ss.sketches([x, y])
            got = ss.estimated(regs[:1], np.array([len(x)]), regs[1], len(y))[0]
            errors.append(got - true if got else 0.0)
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) < 0.055


def test_the_short_cut_agrees_with_the_estimate():
    rng = np.random.default_rng(2)
    pairs = [pair(rng, 150, j) for j in rng.uniform(0.5, 0.95, 300)]
    regs = ss.sketches([s for p in pairs for s in p])
    for k, (x, y) in enumerate(pairs):
        args = regs[2 * k : 2 * k + 1], np.array([len(x)]), regs[2 * k + 1], len(y)
        estimate = ss.estimated(*args)[0]
        if abs(estimate - ss.cut()) > 1e-3:
            assert ss.maybe_linked(*args)[0] == (estimate >= ss.cut())


def test_sketches_merge_and_ignore_company():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 80, 900, 20_000)]
    together = ss.sketches(sets)
    assert all((ss.sketches([s])[0] == row).all() for s, row in zip(sets, together))
    union = np.unique(np.concatenate(sets[2:4]))
    assert (ss.sketches([union])[0] == np.maximum(together[2], together[3])).all()


def test_links_at_the_threshold_meet_in_a_band():
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(300):
        x, y = pair(rng, 200, 0.85)
        regs = ss.sketches([x, y])
        a, b = ss.band_hashes(regs)
        met += (a == b).any()
    assert met == 300


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    want, changed = {i: i for e in edges for i in e}, True
    while changed:
        changed = False
        for a, b in edges:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: c for i, c in want.items() if i in ends}


WORDS = [f"word{k}" for k in range(80)]


@pytest.mark.parametrize("name", ["note", "sieve_slot", "sieve_word", "maybe", "row", "text2", "n_shingles", "set_sum", "doc"])
def test_rows_that_share_an_id_go_by_their_text(spark, documents, name):
    """A copy goes; the other text under the same id stays, as do all columns, whatever they are called."""
    text, other, third = " ".join(WORDS), "something else entirely " * 9, " ".join(WORDS[::-1])
    near = text + " more"
    rows = [(1, text), (7, near), (7, other), (9, third), (9, None), (12, text), (None, text), (None, near)]
    docs = documents(*rows, extra=name)
    kept = ss.drop_near(docs)
    assert kept.columns == docs.columns
    want = [(1, text), (7, other), (9, third), (9, None), (None, text), (None, near)]
    assert sorted(((r["doc_id"], r["text"], r[name]) for r in kept.collect()), key=str) == sorted(((*w, "x") for w in want), key=str)
    groups = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ss.near_groups(docs).collect() if r["doc_id"])
    assert (7, 77, 1) in groups and [g for g in groups if g[0] == 7 and g[2] == 7]


def test_the_smallest_id_of_a_chain_is_found_among_clashing_ids(spark, documents):
    chain = [" ".join(WORDS[k:] + [f"end{j}" for j in range(k)]) for k in (0, 2, 4)]
    rows = [(5, chain[2]), (6, chain[1]), (5, "lone " * 30), (6, chain[0]), (3, "unlike " * 30)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in ss.near_groups(documents(*rows)).collect())
    assert got == [(3, 3, True), (5, 5, True), (5, 5, True), (6, 5, False), (6, 5, False)]


def test_runs_give_the_same_links_in_less_memory(monkeypatch):
    one = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 2000, dtype=np.uint64))
    sets = [one[k % 9 :] for k in range(1000)]
    registers, sizes = np.repeat(ss.sketches([one]), len(sets), axis=0), np.array([len(s) for s in sets])
    monkeypatch.setattr(ss, "maybe_linked", lambda registers, sizes, one, size: np.ones(len(sizes), bool))
    tracemalloc.start()
    try:
        linked = ss.confirmed(registers, sizes, [*sets[:-1], one[1900:]])(0, np.arange(1, len(sets)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert linked.tolist() == [True] * (len(sets) - 2) + [False]
    assert peak < 8 << 20  # of all sets at once over 30 MB
