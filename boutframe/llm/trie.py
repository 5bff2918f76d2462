"""Prefix trie of conversations, measured by an Euler tour.

Every node has an arc that enters its subtree and one that leaves it. The arcs make a linked list,
which is ranked over all tasks; a subtree is then a stretch of the ranked arcs, and what it holds is
the difference of two prefix sums. No step depends on the depth of the trie, on the length of a
conversation or on how many share a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.llm.listrank import ranked
from boutframe.llm.ordered import placed, summed
from boutframe.session import written

#: A prefix is known by so many sums of 32 bits each; a conversation may have two billion turns.
SUMS = 5
ROOT = "root"
#: Bytes of a list of ids that is handed on at a time.
LISTED = 1 << 16


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv``, ``place`` from 0, ``of`` (turns), ``digest`` of role and text, ``chars`` of the text.

    Turns stand by number, null first, and by digest where numbers agree. Null roles and texts are
    read as empty. Rows without a conversation's id belong to none and are left out; other columns
    are ignored.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].alias("conv"),
        conversations["turn"].alias("turn"),
        F.sha2(named.cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    return placed(written(rows, "turns"), ["conv"], ["turn", "digest"], "turns-ordered").drop("turn")


def rebuilt(turns: DataFrame, donor: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: its first ``head`` turns, then the own ones after as many.

    ``donor`` and ``head`` are expressions over ``conv``, ``head`` from 0 to ``most``. Returns the
    turns, ``conv``, ``place``, ``digest``, ``chars``, and a row per conversation, ``conv``, ``n``
    (turns). A donor that is absent or too short gives what it has; a conversation may end up
    without turns.
    """
    convs = turns.filter("place = 0").select("conv", "of", donor.alias("donor"), head.alias("head"))
    donors = turns.filter("place = 0").select(F.col("conv").alias("giver"), F.col("of").alias("has"))
    convs = convs.join(donors, F.col("donor") == F.col("giver"), "left")
    given = F.least("head", F.coalesce("has", F.lit(0))).alias("given")
    convs = written(convs.select("conv", "of", "donor", "head", given), "conversations")
    first = turns.filter(F.col("place") < most).withColumnRenamed("conv", "giver").drop("of")
    same = (F.col("giver") == F.col("donor")) & (F.col("place") < F.col("given"))
    taken = first.join(convs, same).select("conv", "place", "digest", "chars")
    shift = convs.select(F.col("conv").alias("of_conv"), "head", "given")
    kept = turns.join(shift, F.col("conv") == F.col("of_conv")).filter("place >= head")
    kept = kept.select("conv", (F.col("place") - F.col("head") + F.col("given")).alias("place"), "digest", "chars")
    n = F.col("given") + F.greatest(F.col("of") - F.col("head"), F.lit(0))
    return taken.unionByName(kept), convs.select("conv", n.alias("n"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations, the empty one included.

    ``turns`` has ``conv``, ``place``, ``digest``, ``chars``; ``convs`` every ``conv`` once, those
    without turns too, and ``n``, its turns. Per node: ``conv_id`` (smallest member; with ``depth``
    it tells the prefix), ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the subtree, where a node saves its last text's characters for every member
    but one, and ``ends_sha256`` of the members that end there. No conversations give no rows.
    """
    members = _members(turns, convs)
    nodes = written(_nodes(members, convs), "trie-nodes")
    ends = members.filter("ends").select("node", "conv")
    ends = ends.unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("node"), "conv"))

    below = placed(nodes.filter("depth > 0").select("node", "parent"), ["parent"], ["node"], "trie-children")
    below = written(below, "trie-placed")
    first = below.filter("place = 0").select(F.col("parent").alias("above"), F.col("node").alias("first"), "of")
    nodes = nodes.join(first, F.col("node") == F.col("above"), "left")
    nodes = nodes.withColumn("n_children", F.coalesce("of", F.lit(0))).drop("above", "of")
    nodes = written(nodes, "trie-measured")

    places = ranked(_tour(nodes, below))
    subtrees = _subtrees(nodes, places)
    parents = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    lists = _lists(ends)
    found = nodes.join(parents, F.col("parent") == F.col("above"), "left").drop("above")
    found = found.join(subtrees, "node").join(lists, "node", "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def _members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation's prefixes: ``conv``, ``node``, ``parent``, ``depth``, ``chars``, ``ends``.

    A prefix is known by sums of digests of its turns, each taken with its place. Sums are had
    without going through a conversation turn by turn in one task.
    """
    mixed = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256)
    parts = {f"mix_{i}": F.conv(F.substring("mixed", 8 * i + 1, 8), 16, 10).cast("long") for i in range(SUMS)}
    rows = turns.withColumn("mixed", mixed).withColumns(parts).drop("mixed", "digest")
    rows = written(rows.withColumnRenamed("place", "at"), "trie-turns")
    sums = {f"sum_{i}": F.col(f"mix_{i}") for i in range(SUMS)}
    rows = summed(rows, ["conv"], ["at"], sums, "trie-ordered")

    def named(depth: Column, values: list[Column]) -> Column:
        return F.md5(F.concat_ws("|", depth.cast("string"), *[v.cast("string") for v in values]).cast("binary"))

    whole = [F.col(s) for s in sums]
    before = [F.col(f"sum_{i}") - F.col(f"mix_{i}") for i in range(SUMS)]
    above = F.when(F.col("at") == 0, F.lit(ROOT)).otherwise(named(F.col("at"), before))
    members = rows.select(
        "conv",
        named(F.col("at") + 1, whole).alias("node"),
        above.alias("parent"),
        (F.col("at") + 1).alias("depth"),
        "chars",
        (F.col("at") + 1 == F.col("of")).alias("ends"),
    )
    return written(members, "trie-members")


def _nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with what their members tell; combined before the shuffle, so a hot prefix is few rows."""
    inner = members.groupBy("node").agg(
        F.min("parent").alias("parent"),
        F.min("depth").alias("depth"),
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"),
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(
        F.lit(ROOT).alias("node"),
        F.lit(None).cast("string").alias("parent"),
        zero.alias("depth"),
        "conv_id",
        "n_convs",
        zero.alias("chars"),
    )
    return root.unionByName(inner)


def _enter(node: str) -> Column:
    return F.concat(F.lit("+"), F.col(node))


def _leave(node: str) -> Column:
    return F.concat(F.lit("-"), F.col(node))


def _tour(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """The arcs as a linked list: into the first child or out again, on to the next one or up."""
    down = nodes.select(_enter("node").alias("id"), F.coalesce(_enter("first"), _leave("node")).alias("next"))
    others = below.select(F.col("parent").alias("above"), (F.col("place") - 1).alias("before"), F.col("node").alias("follower"))
    same = (F.col("parent") == F.col("above")) & (F.col("place") == F.col("before"))
    on = below.join(others, same, "left").select(
        _leave("node").alias("id"), F.coalesce(_enter("follower"), _leave("parent")).alias("next")
    )
    out = nodes.filter("depth = 0").select(_leave("node").alias("id"), F.lit(None).cast("string").alias("next"))
    return down.unionByName(on).unionByName(out)


def _subtrees(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Leaves and savings of each subtree from prefix sums over the ranked arcs."""
    none = F.lit(0).cast("long")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    arcs = nodes.select("node", _enter("node").alias("arc"), leaf.alias("leaf"), saved.alias("saved"))
    arcs = arcs.unionByName(nodes.select("node", _leave("node").alias("arc"), none.alias("leaf"), none.alias("saved")))
    known = arcs.join(places.withColumnRenamed("place", "rank"), F.col("arc") == F.col("id")).drop("id")
    sums = {"leaves": F.col("leaf"), "savings": F.col("saved")}
    known = summed(written(known, "trie-arcs"), [], ["rank"], sums, "trie-ranked")
    inside = {"n_leaves": ("leaves", "leaf"), "saved_tokens": ("savings", "saved")}
    entering = F.col("arc").startswith("+")
    return known.groupBy("node").agg(
        *[
            F.sum(F.when(entering, F.col(own) - F.col(upto)).otherwise(F.col(upto))).alias(name)
            for name, (upto, own) in inside.items()
        ]
    )


def _lists(ends: DataFrame) -> DataFrame:
    """``node`` and the digest of its ids, ascending, with commas between.

    Ids are joined to texts wherever they lie after a sort over all tasks, so that the one task that
    hashes a node's list reads a few long texts, one at a time, and not a row per id.
    """
    ends = written(ends, "trie-ends")
    dealt = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    texts = written(dealt.mapInArrow(_joined, "node string, first long, ids string"), "trie-lists")
    ordered = texts.repartition("node").sortWithinPartitions("node", "first")
    return ordered.mapInArrow(_hashed, "node string, ends_sha256 string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(done):
        nodes, lists = zip(*done)
        firsts = pa.array([ids[0] for ids in lists], pa.int64())
        return pa.record_batch({"node": pa.array(nodes), "first": firsts, "ids": [",".join(map(str, x)) for x in lists]})

    node, ids = None, []
    for batch in batches:
        done = []
        for at, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (at != node or len(ids) * 8 >= LISTED):
                done.append((node, ids))
                ids = []
            node = at
            ids.append(conv)
        if done:
            yield rows(done)
    if ids:
        yield rows([(node, ids)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        done = []
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
            if at == node:
                state.update(b",")
            else:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256()
            state.update(ids.as_py().encode())
        if done:
            yield pa.record_batch({"node": [n for n, _ in done], "ends_sha256": [d for _, d in done]})
    if state:
        yield pa.record_batch({"node": [node], "ends_sha256": [state.hexdigest()]})
