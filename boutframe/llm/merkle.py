"""Merkle manifest of a table: a tree per group, a tree over their roots, and proofs of every row.

Only every few levels are stored. A stored level is a table with a row per aligned subtree, which
holds the subtree's lowest nodes in order; what lies between two stored levels is computed again
from them when a proof needs it, and not kept. A subtree has a fixed number of nodes at most, so a
group with a third of all rows is spread over tasks like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutframe.llm.ordered import placed
from boutframe.session import written

#: Consecutive nodes that become one.
FAN = 16
#: Levels of a subtree between two stored levels.
SPAN = 2

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields in turn, each with its length in bytes, a null as a hyphen."""
    texts = [v.cast("string") for v in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def _raised(nodes: Column) -> Column:
    """The next level up: a digest of every ``FAN`` nodes, the last of what is left."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda run: _digest(F.slice(nodes, run * FAN + 1, FAN)))


def _height(of: Column, span: int) -> Column:
    """Levels from a subtree's lowest nodes to its top, in a tree with ``of`` nodes on this level."""
    height = F.lit(span)
    for k in reversed(range(span)):
        height = F.when(of <= FAN**k, k).otherwise(height)
    return height


def _regenerated(nodes: Column, height: Column) -> Column:
    """The levels of one subtree, its lowest nodes first and its top last."""
    lowest = F.transform(nodes, lambda n: n["digest"])
    return F.aggregate(
        F.array_repeat(F.lit(0), height),
        F.array(lowest),
        lambda levels, _: F.concat(levels, F.array(_raised(F.element_at(levels, -1)))),
    )


def _siblings(level: Column, at: Column) -> Column:
    """What stands left and right of a node among the nodes that are hashed with it."""
    first = F.floor(at / FAN).cast("int") * FAN
    return F.struct(
        F.array_join(F.slice(level, first + 1, at - first), "").alias("left"),
        F.array_join(F.slice(level, at + 2, first + FAN - 1 - at), "").alias("right"),
    )


@dataclass(frozen=True)
class Trees:
    """The stored levels of one or more trees, lowest first, and the trees' roots.

    A level has a row per subtree: ``tree``, ``of`` (nodes of that tree on this level), ``block``
    (the subtree's number) and ``nodes``. Roots are ``tree``, ``root``.
    """

    levels: list[DataFrame]
    span: int = SPAN

    @property
    def width(self) -> int:
        return FAN**self.span

    @property
    def roots(self) -> DataFrame:
        tops = [_tops(level, self.span).filter(F.col("of") <= self.width) for level in self.levels]
        found = tops[0]
        for more in tops[1:]:
            found = found.unionByName(more)
        return found.select("tree", F.col("digest").alias("root"))

    def proofs(self, beyond: DataFrame) -> DataFrame:
        """Every lowest node with its ``path``: siblings on each level up to the root and on.

        ``beyond`` has a row per tree: ``tree``, the ``path`` from its root on, and columns that
        are passed on to the tree's nodes.
        """
        passed = [c for c in beyond.columns if c not in ("tree", "path")]
        upper = None
        for level in reversed(self.levels):
            above, kept = beyond.withColumnRenamed("tree", "of_tree"), [*level.columns, "path", *passed]
            same = F.col("tree").eqNullSafe(F.col("of_tree"))
            found = level.filter(F.col("of") <= self.width).join(above, same).select(*kept)
            if upper is not None:
                inner = level.filter(F.col("of") > self.width)
                above = upper.withColumnRenamed("tree", "of_tree")
                inner = inner.join(above, same & (F.col("block") == F.col("place")))
                found = found.unionByName(inner.select(*kept))
            lowest = self._extracted(found, passed)
            upper = lowest.select("tree", "node.place", "path", *passed)
        return lowest.select("tree", "node.*", "path", *passed)

    def _extracted(self, subtrees: DataFrame, passed: list[str]) -> DataFrame:
        """A row per lowest node of each subtree, with its siblings inside it before the path on."""
        height = _height(F.col("of"), self.span)

        def steps(levels: Column, i: Column) -> Column:
            at = [F.floor(i / FAN**k).cast("int") for k in range(self.span)]
            return F.slice(F.array(*[_siblings(F.get(levels, F.lit(k)), at[k]) for k in range(self.span)]), 1, height)

        def nodes(levels: Column) -> Column:
            return F.transform(
                F.col("nodes"), lambda n, i: F.struct(n.alias("node"), F.concat(steps(levels, i), "path").alias("path"))
            )

        # A single-element array binds the levels, so that they are computed once per subtree.
        bound = F.transform(F.array(_regenerated(F.col("nodes"), height)), nodes)
        return subtrees.select("tree", *passed, F.inline(F.element_at(bound, 1)))


def _tops(level: DataFrame, span: int) -> DataFrame:
    """The top of every subtree, as a node of the next stored level."""
    height = _height(F.col("of"), span)
    top = F.element_at(F.element_at(_regenerated(F.col("nodes"), height), -1), 1)
    return level.select("tree", "of", F.col("block").alias("place"), top.alias("digest"))


def _grown(nodes: DataFrame, span: int, store) -> Trees:
    """Stored levels over ``nodes`` (tree, place, of, digest and more); ``store`` keeps level n."""
    width, levels = FAN**span, []
    while True:
        own = F.struct("place", *[c for c in nodes.columns if c not in ("tree", "of", "place")])
        block = F.floor(F.col("place") / width).alias("block")
        grouped = nodes.groupBy("tree", "of", block).agg(F.sort_array(F.collect_list(own)).alias("nodes"))
        levels.append(store(grouped, len(levels)))
        open_ = levels[-1].filter(F.col("of") > width)
        if not open_.select("of").head(1):
            return Trees(levels, span)
        nodes = _tops(open_, span).withColumn("of", F.ceil(F.col("of") / width))


@dataclass(frozen=True)
class Manifest:
    """A tree per group (``groups``) and the tree over their roots (``top``)."""

    groups: Trees
    top: Trees

    def root(self) -> DataFrame:
        """One row, the ``root`` of all; none for an empty table."""
        return self.top.roots.select("root")

    def proofs(self) -> DataFrame:
        """A row per row of the table: id, group, leaf, subroot, root, path and what was carried.

        ``path`` has a struct per level from the leaf to the root, the digests left and right of
        the node as one text each. Rows that agree in all fields have a proof each.
        """
        none = F.array().cast("array<struct<left:string,right:string>>")
        whole = self.top.roots.withColumn("path", none)
        of_groups = self.top.proofs(whole).select(
            F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
        )
        found = self.groups.proofs(of_groups).drop("place")
        return found.withColumnsRenamed({"tree": "group", "digest": "leaf"})


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings_digest(path: Column) -> Column:
    """A digest of all siblings, level by level from the leaf, left to right."""
    texts = F.transform(path, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(texts, "").cast("binary"), 256)


def build(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    carry: dict[str, Column] | None = None,
    folder: str | None = None,
    span: int = SPAN,
) -> Manifest:
    """The manifest of ``docs``; its stored levels go to ``folder``, or else to the shared one.

    Leaves stand by group and then by id, nulls first; rows that share an id stand by their digest,
    so any order of the input gives the same root. ``carry`` adds columns (expressions over
    ``docs``) that proofs bring along. Nulls are values of their own, a null group is a group. An
    empty table has no root and no proofs. Other columns of ``docs`` are ignored.
    """
    carry = carry or {}
    leaves = docs.select(
        docs[group_col].cast("string").alias("tree"),
        docs[id_col].alias("id"),
        leaf_digest(*[docs[f] for f in fields]).alias("digest"),
        *[e.alias(name) for name, e in carry.items()],
    )
    leaves = written(leaves, "merkle-leaves")  # texts are read once, not for the sampling too
    ordered = placed(leaves, ["tree"], ["id", "digest"], "merkle-ordered")
    groups = _grown(ordered, span, _keeper(folder, "groups"))
    roots = groups.roots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("group"), "root")
    roots = written(roots.withColumnRenamed("root", "digest"), "merkle-roots")
    return Manifest(groups, _grown(placed(roots, [], ["group"], "merkle-top"), span, _keeper(folder, "top")))


def stored(spark: SparkSession, folder: str, span: int = SPAN) -> Manifest:
    """The manifest that :func:`build` left in ``folder``."""
    return Manifest(*[Trees(_levels(spark, f"{folder}/{name}"), span) for name in ("groups", "top")])


def _levels(spark: SparkSession, folder: str) -> list[DataFrame]:
    found = []
    for n in count():
        try:
            found.append(spark.read.parquet(f"{folder}/level-{n}"))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND" or not found:
                raise
            return found


def _keeper(folder: str | None, name: str):
    def keep(level: DataFrame, n: int) -> DataFrame:
        if folder is None:
            return written(level, f"merkle-{name}-{n}")
        path = f"{folder}/{name}/level-{n}"
        level.write.mode("errorifexists").parquet(path)
        return level.sparkSession.read.schema(level.schema).parquet(path)

    return keep
