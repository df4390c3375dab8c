"""DuckDB SQL of queries whose SQL is long."""

from __future__ import annotations


def crc32(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal text, bit by bit."""
    return f"""xor(list_reduce(
        [4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(({number})::VARCHAR, '')],
        lambda c, x: list_reduce(
            [xor(c, x)] || [0::BIGINT FOR z IN range(8)],
            lambda b, z: xor(b >> 1, (b & 1) * 3988292384))), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf("text")} AS leaf,
        CASE WHEN {crc32("doc_id")} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS shown
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS size,
        dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree
    FROM leaves),
up AS (
    SELECT tree, 0 AS level, pos, size, leaf AS hash FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 8, (any_value(size) + 7) // 8,
        sha256(string_agg(hash, '' ORDER BY pos))
    FROM up WHERE size > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, level AS height, hash AS subroot FROM up WHERE size = 1),
top AS (
    SELECT 0 AS level, tree AS pos, count(*) OVER () AS size, subroot AS hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
    FROM top WHERE size > 1 GROUP BY level, pos // 8),
runs AS (
    SELECT tree, level, pos // 8 AS run, list(hash ORDER BY pos) AS hashes
    FROM up WHERE size > 1 GROUP BY tree, level, pos // 8
    UNION ALL
    SELECT -1, level, pos // 8, list(hash ORDER BY pos) FROM top WHERE size > 1
    GROUP BY level, pos // 8),
climb AS (
    SELECT tree AS home, pos AS place, 0 AS step,
        CASE WHEN size = 1 THEN -1 ELSE tree END AS tree, 0 AS level,
        CASE WHEN size = 1 THEN tree ELSE pos END AS pos, height,
        doc_id, leaf, subroot, '' AS proof, shown AS folded
    FROM placed JOIN subroots USING (tree)
    UNION ALL
    SELECT home, place, step + 1,
        CASE WHEN level + 1 = height THEN -1 ELSE tree END,
        CASE WHEN level + 1 = height AND tree >= 0 THEN 0 ELSE level + 1 END,
        CASE WHEN level + 1 = height AND tree >= 0 THEN home ELSE run END,
        CASE WHEN level + 1 = height THEN -1 ELSE height END, doc_id, leaf, subroot,
        proof || array_to_string(hashes[:pos % 8] || hashes[pos % 8 + 2:], ''),
        sha256(array_to_string(hashes[:pos % 8] || [folded] || hashes[pos % 8 + 2:], ''))
    FROM climb JOIN runs USING (tree, level) WHERE run = pos // 8),
ends AS (
    SELECT *, row_number() OVER (PARTITION BY home, place ORDER BY step DESC) AS n FROM climb)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
    folded = root AS verified
FROM ends, (SELECT hash AS root FROM top WHERE size = 1) WHERE n = 1
"""

OP11 = f"""
WITH steps AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
named AS (
    SELECT conv_id, turn, strlen(text) AS size,
        left(sha256(strlen(role) || ':' || role || text), 32) AS digest
    FROM steps),
own AS (
    SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests,
        list(size ORDER BY turn NULLS FIRST, digest) AS sizes,
        ({crc32("conv_id")} % 9)::BIGINT AS h
    FROM named GROUP BY conv_id),
rebuilt AS (
    SELECT a.conv_id, coalesce(b.digests[:a.h], []) || a.digests[a.h + 1:] AS digests,
        coalesce(b.sizes[:a.h], []) || a.sizes[a.h + 1:] AS sizes
    FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (
    SELECT conv_id, digests, sizes, unnest(range(len(digests) + 1)) AS depth FROM rebuilt),
members AS (
    SELECT conv_id, depth, array_to_string(digests[:depth], '') AS key,
        CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, depth = len(digests) AS ends
    FROM prefixes),
nodes AS (
    SELECT key, any_value(depth) AS depth, left(key, 32 * (any_value(depth) - 1)) AS parent,
        min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), ''))
            AS ends_sha256
    FROM members GROUP BY key),
children AS (
    SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
counted AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
above AS (
    SELECT left(key, (32 * unnest(range(depth + 1)))::BIGINT) AS key, n_children = 0 AS leaf,
        (n_convs - 1) * size AS saved
    FROM counted),
below AS (
    SELECT key, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM above GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
    saved_tokens, n.ends_sha256
FROM counted n JOIN below USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.parent
"""
