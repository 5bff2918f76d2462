"""Secret scans: candidate strings, and a random forest that removes false findings.

All columns are built-in functions and the forest is Spark ML's, so everything stays in the JVM.
A candidate is described by its length, by the changes between kinds of characters in it, by how
much of it is made of words of the corpus, by where its document comes from and by the words next
to it. What a path and a neighbouring word say is learned from labelled findings, as is the forest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.llm.sieve import marked, sieve
from boutframe.session import written

LEAST_CHARS = 16
CANDIDATE = r"[A-Za-z0-9+/=_\-]{%d,}" % LEAST_CHARS
#: A plain word is no candidate: it needs a digit, a sign or a capital after another character.
NO_WORD = r"[0-9+/=_\-]|.[A-Z]"
#: A name, its closing quote if it has one, and the sign that assigns to it.
ASSIGNED_NAME = r"([\p{L}\p{N}_\-]+)[\"'`]?(?::=|=>|=|:)"
#: The same inside a candidate, which may hold equals signs: those at its end are padding.
OWN_NAME = r"^([A-Za-z0-9_\-]+)=+[^=]"
#: Labelled findings that the forest is fitted on, about: the bound of the fit.
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 30, 8, 11
THRESHOLD = 0.5
#: Findings of the usual rate that a path or word is mixed with before it counts.
PRIOR_ROWS = 4.0

FEATURES = [
    "length", "transitions", "digit_share", "upper_share", "distinct_share", "hex_share", "word_coverage",
    "path_rate", "name_rate", "before_rate", "before2_rate", "after_rate", "quoted", "assigned",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, path, start, candidate, the words around it and their signs.

    ``start`` counts characters of the text. Null and empty texts have none; a null path is a path
    of its own. Rows that repeat keep their candidates each. Other columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[path_col].alias("path"), docs[text_col].alias("text"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE))
    # Split at single spaces, so that lengths of tokens add up to places.
    rows = rows.withColumn("tokens", F.split("text", r"\s"))
    each = rows.select("id", "path", "tokens", F.posexplode("tokens").alias("nth", "token"))
    each = each.filter(F.col("token").rlike(CANDIDATE))
    before = F.expr("slice(tokens, 1, nth)")
    near = F.filter(F.reverse(F.expr("slice(tokens, greatest(nth - 3, 1), least(nth, 4))")), lambda t: t != "")
    after = F.filter(F.expr("slice(tokens, nth + 2, 3)"), lambda t: t != "")
    each = each.select(
        "id",
        "path",
        "token",
        (F.length(F.array_join(before, " ")) + F.when(F.col("nth") > 0, 1).otherwise(0)).alias("token_start"),
        F.get(near, F.lit(0)).alias("before"),
        F.get(near, F.lit(1)).alias("before2"),
        F.get(after, F.lit(0)).alias("after"),
        F.regexp_extract_all("token", F.lit(CANDIDATE), F.lit(0)).alias("parts"),
    )
    each = each.select("*", F.posexplode("parts").alias("part", "candidate")).filter(F.col("candidate").rlike(NO_WORD))
    # A candidate ends at a sign that none holds, so one that an earlier part contains is found behind it.
    ahead = F.expr("aggregate(slice(parts, 1, part), 0, (at, p) -> locate(p, token, at + 1) + length(p))")
    each = each.withColumn("ahead", ahead).withColumn("inside", F.expr("locate(candidate, token, ahead + 1)"))
    return each.select(
        "id",
        "path",
        (F.col("token_start") + F.col("inside") - 1).cast("long").alias("start"),
        "candidate",
        _word(F.col("before")).alias("before"),
        _word(F.col("before2")).alias("before2"),
        _word(F.col("after")).alias("after"),
        F.expr("substring(token, inside - 1, 1)").isin('"', "'", "`").cast("double").alias("quoted"),
        (
            F.coalesce(F.col("before").isin("=", ":", ":="), F.lit(False)) | F.col("token").rlike(r"^\w+[=:]") | _name().isNotNull()
        ).cast("double").alias("assigned"),
        _name().alias("name"),
    )


def _name() -> Column:
    """What the candidate is assigned to, in lower case with ``_`` for ``-``, or null.

    The name and its sign are in the token (``name="v"``, ``name=v``), before it (``name: "v"``), or
    parted by blanks (``name = "v"``, ``name ="v"``).
    """
    head = F.expr("substring(token, 1, inside - 1)")
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    bare = head.rlike("^[\"'`]?$")
    signed = head.rlike("^(:=|=>|=|:)[\"'`]?$") | (bare & F.col("candidate").startswith("="))
    name = F.coalesce(
        found(F.col("candidate"), OWN_NAME),
        found(head, ASSIGNED_NAME + "[\"'`]?$"),
        F.when(signed, _word(F.col("before"))),
        F.when(bare & F.col("before").isin("=", ":", ":=", "=>"), _word(F.col("before2"))),
        F.when(bare, found(F.col("before"), ASSIGNED_NAME + "$")),
    )
    return F.translate(F.lower(name), "-", "_")


def _word(token: Column) -> Column:
    """A neighbouring token in lower case without signs around it; a lone sign stays."""
    bare = F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(bare == "", token).otherwise(bare)


def described(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with the features of each candidate that need no labels.

    Coverage is the share of a candidate's characters in letter runs that occur twice or more as
    words of the whole corpus. Only words that some candidate contains are counted.
    """
    text = F.col("candidate")
    n = F.length(text)
    kinds = F.translate(
        text, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", "a" * 26 + "A" * 26 + "0" * 10 + "#" * 5
    )
    count = lambda pattern, col=text: F.regexp_count(col, F.lit(pattern)).cast("double")
    shaped = found.withColumns(
        {
            "length": n.cast("double"),
            "transitions": count(r"(.)(?=.)(?!\1)", kinds) / n,
            "digit_share": count("[0-9]") / n,
            "upper_share": count("[A-Z]") / n,
            "hex_share": count("[0-9a-fA-F]") / n,
            "distinct_share": F.size(F.array_distinct(F.split(text, ""))) / n,
        }
    )
    runs = found.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("run")).distinct()
    runs = written(runs, "secret-runs")
    words = docs.select(F.explode(F.split(F.col(text_col), r"\s+")).alias("token"))
    words = words.select(F.lower(F.regexp_replace("token", r"[.,;:!?]+$", "")).alias("word")).filter(F.col("word").rlike("^[a-z]{3,}$"))
    words = marked(words, sieve(runs, F.xxhash64("run")), F.xxhash64("word"), "maybe").filter("maybe")
    words = words.groupBy("word").count().filter("count > 1")
    known = written(runs.join(words, F.col("run") == F.col("word")).select("run"), "secret-words")

    keyed = shaped.withColumn("key", F.xxhash64("candidate"))
    split = keyed.select("key", "candidate").distinct()
    split = split.select("key", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("part"))
    covered = split.join(known, F.col("part") == F.col("run")).groupBy(F.col("key").alias("k"))
    covered = written(covered.agg(F.sum(F.length("part")).alias("letters")), "secret-covered")
    joined = keyed.join(covered, F.col("key") == F.col("k"), "left").drop("k", "key")
    return joined.withColumn("word_coverage", F.coalesce(F.col("letters"), F.lit(0)) / F.length("candidate")).drop("letters")


@dataclass
class Scanner:
    """A forest with the rates of paths and neighbouring words it was fitted with."""

    forest: RandomForestClassificationModel | None
    rates: dict[str, DataFrame]
    usual: float  # share of true findings among the labelled


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Scanner:
    """Fit a scanner on described candidates with a ``label`` of 0 or 1; null labels are left out.

    Rates count all labelled findings, the forest sees about ``fit_rows`` of them, drawn by a hash
    of the finding. Without findings of both kinds there is no forest and every score is the
    usual rate.
    """
    labelled = written(labelled.filter(F.col("label").isin(0, 1)), "secret-labelled")
    total, true = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    usual = true / total if total else 0.0
    rates = {}
    for c in ("path", "name", "before", "before2", "after"):
        seen = labelled.groupBy(F.col(c).alias(f"of_{c}")).agg(F.sum("label").alias("t"), F.count("*").alias("n"))
        rate = (F.col("t") + PRIOR_ROWS * usual) / (F.col("n") + PRIOR_ROWS)
        rates[c] = written(seen.select(f"of_{c}", rate.alias(f"{c}_rate")), f"secret-rate-{c}")
    if not 0 < true < total:
        return Scanner(None, rates, usual)
    odds = min(1.0, fit_rows / total)
    place = F.pmod(F.xxhash64("id", "start", "candidate", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    sample = written(_assembled(labelled.filter(place < odds), rates, usual).select("features", F.col("label").cast("double").alias("label")), "secret-fit")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return Scanner(forest.fit(sample), rates, usual)


def scan(found: DataFrame, scanner: Scanner, threshold: float = THRESHOLD) -> DataFrame:
    """Described candidates with ``score``, the forest's share of votes, and ``predicted``."""
    if scanner.forest is None:
        scored = found.withColumn("score", F.lit(float(scanner.usual)))
    else:
        votes = scanner.forest.transform(_assembled(found, scanner.rates, scanner.usual))
        scored = votes.withColumn("score", vector_to_array("probability")[1])
        scored = scored.drop("features", "rawPrediction", "probability", "prediction", *[f"{c}_rate" for c in scanner.rates])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _assembled(found: DataFrame, rates: dict[str, DataFrame], usual: float) -> DataFrame:
    """``found`` with all features in one vector; unseen paths and words have the usual rate."""
    for c, rate in rates.items():
        # Written tables of one row per value: their size decides between broadcast and shuffle.
        found = found.join(rate, F.col(c).eqNullSafe(F.col(f"of_{c}")), "left").drop(f"of_{c}")
        found = found.withColumn(f"{c}_rate", F.coalesce(f"{c}_rate", F.lit(float(usual))))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
