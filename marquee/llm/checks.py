"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), placed AS (
    SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM words
), windows AS (
    SELECT doc_id, n, i, x, lead(x, 1) OVER later AS y, lead(x, 2) OVER later AS z
    FROM placed WINDOW later AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
    SELECT DISTINCT doc_id, concat_ws(' ', x, y, z) AS s FROM windows WHERE z IS NOT NULL OR (n < 3 AND i = 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 85 * (x.n + y.n - common)
), either AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, either.b FROM reach JOIN either ON either.a = reach.b
), component AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN sizes USING (doc_id)
"""

# Markup of a turn: <turn ROLE>TEXT</turn> and a line feed; \ < > in it get a mark.
CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, role || text AS said FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(15 + 2 * length(said) - length(replace(replace(replace(said, '\', ''), '<', ''), '>', '')))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

FIELDS = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text"]


def leaf(text: str) -> str:
    """A leaf's digest: each value behind its length in bytes, or ``-``."""
    values = [*FIELDS[:-1], text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


# crc32 of the number as decimal text, bit by bit, the lowest of each byte first.
CRC = """xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INTEGER) & 1))),
    lambda state, bit: xor(state >> 1, 3988292384 * (xor(state, bit) & 1)), 4294967295))"""

# Levels from 100 on are those of the tree over the sources.
MERKLE = rf"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {leaf("text")} AS leaf,
        CASE WHEN {CRC} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS m
    FROM leaves
), nodes AS (
    SELECT source, 0 AS level, place, m, leaf AS hash FROM placed
    UNION ALL
    SELECT source, level + 1, place // 16, (m + 15) // 16, sha256(string_agg(hash, '' ORDER BY place))
    FROM nodes WHERE m > 1 GROUP BY source, level, place // 16, m
), subroots AS (
    SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees
    FROM nodes WHERE m = 1
), upper_nodes AS (
    SELECT 100 AS level, tree AS place, trees AS m, subroot AS hash FROM subroots
    UNION ALL
    SELECT level + 1, place // 16, (m + 15) // 16, sha256(string_agg(hash, '' ORDER BY place))
    FROM upper_nodes WHERE m > 1 GROUP BY level, place // 16, m
), steps AS (
    SELECT a.source, a.level, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
        coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
    FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 16 = b.place // 16
    WHERE a.m > 1 GROUP BY ALL
), upper_steps AS (
    SELECT a.level, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
        coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
    FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.place // 16 = b.place // 16
    WHERE a.m > 1 GROUP BY ALL
), paths AS (
    SELECT p.source, p.place, s.level, before, after
    FROM placed p JOIN steps s ON p.source IS NOT DISTINCT FROM s.source AND s.place = p.place // (16 ** s.level)::BIGINT
    UNION ALL
    SELECT p.source, p.place, s.level, before, after
    FROM placed p JOIN subroots t ON p.source IS NOT DISTINCT FROM t.source
        JOIN upper_steps s ON s.place = t.tree // (16 ** (s.level - 100))::BIGINT
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY source, place ORDER BY level) AS step FROM paths
), fold AS (
    SELECT source, place, 0 AS step, coalesce(changed, leaf) AS hash FROM placed
    UNION ALL
    SELECT f.source, f.place, o.step, sha256(before || hash || after)
    FROM fold f JOIN ordered o ON f.source IS NOT DISTINCT FROM o.source AND f.place = o.place AND o.step = f.step + 1
), ends AS (
    SELECT source, place, arg_max(hash, step) AS folded_root FROM fold GROUP BY ALL
), proofs AS (
    SELECT source, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM ordered GROUP BY ALL
)
SELECT doc_id, leaf, subroot, hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = hash AS verified
FROM placed p JOIN subroots t ON p.source IS NOT DISTINCT FROM t.source
    JOIN ends e ON p.source IS NOT DISTINCT FROM e.source AND p.place = e.place
    LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place
    JOIN upper_nodes u ON u.m = 1
"""

ORACLES = {
    "op1_superminhash_near_dedup": NEAR_DUPLICATES,
    "op9_chat_templates": CHAT,
    "op12_merkle_manifest": MERKLE,
}
