"""One query per operator over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutframe.llm import (
    bpe,
    exact,
    langid,
    merkle,
    mixture,
    nearest,
    packing,
    secret_scan,
    setsketch,
    tokencount,
    toxicity,
    trie,
    twins,
    warc,
)
from boutframe.llm.tables import ascii_lower, held_out, table
from boutframe.session import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_round_trip(spark, root):
    """All pages as WARC records, as read back from the archives."""
    return warc.round_trip(table(spark, root, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


@query
def op2_nearest_neighbours(spark, root):
    """The ten nearest vectors of every hundredth one."""
    vectors = table(spark, root, "embeddings")
    return nearest.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op3_mix_sources(spark, root):
    """The words that a mix of all sources takes of each document."""
    return mixture.mix(table(spark, root, "documents")).drop("copies")


@query
def op4_toxicity(spark, root):
    """Toxicity scores of all documents, learned from the labelled ones not held out."""
    docs = table(spark, root, "documents")
    labels = table(spark, root, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.train(docs, labels))


@query
def op5_best_fit_pack(spark, root):
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(table(spark, root, "documents"), tokenizer_path())


@query
def op6_setsketch_dedup(spark, root):
    """Groups of documents whose five-word shingles agree to 85 % or more."""
    return setsketch.near_groups(table(spark, root, "documents"))


@query
def op7_exact_dedup(spark, root):
    """Groups of equal texts, the largest id staying."""
    return exact.exact_groups(table(spark, root, "documents"), digest_all=True)


#: What makes a labelled finding true: it is assigned to the name of a credential.
CREDENTIAL_NAMES = ("token", "secret", "password", "passwd", "key", "apikey", "api_key", "access_key", "credential")


def credential(found: DataFrame) -> Column:
    """Whether a candidate is assigned to the name of a credential and is no number."""
    named = F.coalesce(found["name"].isin(*CREDENTIAL_NAMES), F.lit(False))
    value = F.regexp_replace(found["candidate"], r"^[A-Za-z0-9_\-]*=+(?=[^=])", "")
    return named & ~value.rlike("^[0-9]+$")


@query
def op8_secret_scan(spark, root):
    """Candidates of all documents with the forest's score; the strings themselves as digests.

    No table labels secrets, so findings of documents not held out are labelled by their context:
    true where the string, quoted or not, is assigned to the name of a credential and is no number.
    """
    docs = table(spark, root, "documents")
    found = secret_scan.described(secret_scan.candidates(docs), docs)
    found = found.withColumn("label", credential(found).cast("int"))
    found = written(found.withColumn("held_out", held_out(F.col("id"))), "secret-found")
    scanner = secret_scan.train(found.filter("NOT held_out"))
    return secret_scan.scan(found, scanner).select(
        F.col("id").alias("doc_id"),
        "start",
        F.length("candidate").cast("long").alias("length"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        "held_out",
        "label",
        "score",
        "predicted",
    )


@query
def op9_language_id(spark, root):
    """The language of every document, learned from those not held out."""
    docs = table(spark, root, "documents")
    identifier = langid.train(docs.filter(~held_out(docs["doc_id"])))
    return langid.identify(docs, identifier)


@query
def op10_token_counts(spark, root):
    """Token counts of all documents, through a cache of this run's own."""
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    return tokencount.token_counts(table(spark, root, "documents"), tokenizer_path(), cache)


@query
def op11_merkle_manifest(spark, root):
    """Proofs of all documents, and what they say of texts that were tampered with."""
    docs = table(spark, root, "documents")
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = {f: docs[f] for f in merkle.FIELDS}
    claimed = F.when(due, merkle.leaf_digest(*(fields | {"text": ascii_lower(docs["text"])}).values()))
    rows = merkle.build(docs, carry={"claimed": claimed}).proofs()
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op12_byte_bpe(spark, root):
    """Token ids of all documents by a rank file, and what they decode to, as digests."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = bpe.encode(table(spark, root, "documents"), vocabulary).digests()
    return found.withColumnRenamed("id", "doc_id")


@query
def op13_prefix_trie(spark, root):
    """The prefixes of all conversations, after each took over the beginning of another."""
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    turns = trie.numbered_turns(table(spark, root, "conversations"))
    return trie.trie(*trie.rebuilt(turns, donor=conv - conv % 100, head=head, most=5))


ORACLE_SQL["op11_merkle_manifest"] = twins.MERKLE
ORACLE_SQL["op13_prefix_trie"] = twins.TRIE

# Base32 from the hexadecimal digest: five digits are twenty bits, that is four letters.
ORACLE_SQL["op1_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(digest, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)
    FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

ORACLE_SQL["op7_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLE_SQL["op3_mix_sources"] = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{mixture.SEED}|' || doc_id) AS rank
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sources
), filled AS (  -- sources by the level at which they are full
  SELECT *, row_number() OVER w AS nth,
    3 * sum(source_size) OVER ()::HUGEINT - coalesce(sum(4 * source_size) OVER before, 0) AS open_words,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM weighed
  WINDOW w AS (ORDER BY source_size / weight, place),
    before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT nth, open_words, open_weight FROM filled
  WHERE 4 * source_size * open_weight > weight * open_words ORDER BY nth LIMIT 1
), targets AS (
  SELECT f.source, f.source_size, CASE WHEN l.nth IS NULL OR f.nth < l.nth THEN f.source_size::DOUBLE * 2
    ELSE f.weight::DOUBLE * l.open_words::DOUBLE / (2 * l.open_weight)::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON true
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    floor(target)::BIGINT - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS need
  FROM targets
), units AS (  -- rows that share an id come together
  SELECT s.source, s.rank, sum(s.size)::BIGINT AS unit, row_number() OVER (PARTITION BY s.source ORDER BY s.rank) AS nth
  FROM sized s GROUP BY s.source, s.rank
), walk AS (  -- in the seeded order, whatever still fits is taken
  SELECT source, 0::BIGINT AS nth, need AS open, '' AS rank, false AS taken FROM needs
  UNION ALL
  SELECT u.source, u.nth, CASE WHEN u.unit <= w.open THEN w.open - u.unit ELSE w.open END, u.rank, u.unit <= w.open
  FROM walk w JOIN units u ON u.source IS NOT DISTINCT FROM w.source AND u.nth = w.nth + 1
)
SELECT s.doc_id, s.size, n.source_size, n.target, ((n.whole + w.taken::INT) * s.size)::BIGINT AS taken
FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source
JOIN walk w ON w.source IS NOT DISTINCT FROM s.source AND w.rank = s.rank
"""
