"""SQL twins of the manifest and of the conversation trie, for DuckDB."""

from __future__ import annotations

def crc32(number: str) -> str:
    """CRC-32 of the decimal digits of a number that is not null, as an expression."""
    bits = ", ".join(["-1"] * 8)
    steps = f"flatten([[ascii(c)::BIGINT, {bits}] FOR c IN string_split({number}::VARCHAR, '')])"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda crc, v: CASE
    WHEN v >= 0 THEN xor(crc, v) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295)"""


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _tree(name: str, levels: int = 8) -> str:
    """CTEs over ``name``_0 (tree, place, of, digest, one row per lowest node), sixteen nodes to a run.

    ``name``_runs has the runs of all levels, ``name``_{levels} the roots. A tree of one node is done.
    """
    parts = []
    for k in range(levels):
        parts.append(f"""{name}_{k + 1} AS (
  SELECT tree, place // 16 AS place, (of + 15) // 16 AS of,
    CASE WHEN of = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
  FROM {name}_{k} GROUP BY tree, place // 16, of
)""")
    runs = [
        f"SELECT {k} AS level, tree, place // 16 AS run, list(digest ORDER BY place) AS nodes "
        f"FROM {name}_{k} WHERE of > 1 GROUP BY tree, place // 16"
        for k in range(levels)
    ]
    parts.append(f"{name}_runs AS (\n  {' UNION ALL '.join(runs)}\n)")
    return ",\n".join(parts)


def _climb(name: str, trees: str, first: str, levels: int = 8) -> str:
    """CTEs that take each row of ``first`` (tree, place, path, node) up its tree: siblings and digests."""
    parts, before = [], first
    for k in range(levels):
        at, run = f"(b.place // {16**k})", f"(b.place // {16 ** (k + 1)})"
        left = f"array_to_string(r.nodes[1:{at} % 16], '')"
        right = f"array_to_string(r.nodes[{at} % 16 + 2:16], '')"
        parts.append(f"""{name}_{k} AS (
  SELECT b.* REPLACE (
    CASE WHEN r.run IS NULL THEN b.path ELSE b.path || {left} || {right} END AS path,
    CASE WHEN r.run IS NULL THEN b.node ELSE sha256({left} || b.node || {right}) END AS node)
  FROM {before} b LEFT JOIN {trees}_runs r
    ON r.level = {k} AND r.tree IS NOT DISTINCT FROM b.tree AND r.run = {run}
)""")
        before = f"{name}_{k}"
    return ",\n".join(parts)


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH leaves AS (
  SELECT doc_id, source AS tree, {_leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32('coalesce(doc_id, 0)')} % 5 = 0 THEN {_leaf(LOWERED)} END AS claimed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), doc_0 AS (
  SELECT tree, place, count(*) OVER (PARTITION BY tree) AS of, leaf AS digest FROM numbered
), {_tree('doc')}, src_0 AS (
  SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS of,
    digest, tree AS source
  FROM doc_8
), {_tree('src')}, started AS (
  SELECT *, '' AS path, coalesce(claimed, leaf) AS node FROM numbered
), {_climb('up', 'doc', 'started')}, halfway AS (
  SELECT u.doc_id, u.leaf, s.digest AS subroot, 0 AS tree, s.place, u.path, u.node
  FROM up_7 u JOIN src_0 s ON s.source IS NOT DISTINCT FROM u.tree
), {_climb('top', 'src', 'halfway')}
SELECT t.doc_id, t.leaf, t.subroot, r.digest AS root, sha256(t.path) AS proof_sha256, t.node AS folded_root,
  t.node = r.digest AS verified
FROM top_7 t, src_8 r
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS donor, {crc32('conv_id')} % 6 AS head FROM turns
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.place < c.head
  UNION ALL SELECT t.conv_id, 1, t.place, t.role, t.text FROM turns t JOIN convs c USING (conv_id) WHERE t.place >= c.head
), paths AS (
  SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.own, r.place)
    FILTER (WHERE r.role IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), members AS (
  SELECT conv_id, depth, path[1:depth] AS node, len(path) = depth AS ends
  FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM paths)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), measured AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[depth].text) END AS saved
  FROM nodes n LEFT JOIN children c USING (node)
), sums AS (
  SELECT node[1:above] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM measured) GROUP BY 1
)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM measured m JOIN sums s ON s.node = m.node
LEFT JOIN nodes p ON m.depth > 0 AND p.node = m.node[1:m.depth - 1]
"""
