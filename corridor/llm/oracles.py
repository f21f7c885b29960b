"""DuckDB SQL of the operators that SQL can state as a whole."""

from __future__ import annotations

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string (polynomial 0xEDB88320, bit by bit)."""
    step = "list_reduce(range(8), lambda g, i: xor(g >> 1, 3988292384 * (g & 1)), xor(h, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce({codes}, lambda h, b: {step}, 4294967295::BIGINT))"


LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
     k AS (SELECT *, translate(trim(line, {BLANKS}), {LOWER}) AS key FROM l),
     s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key
           HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 5),
     m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def merkle(levels: int = 6, tops: int = 3) -> str:
    """Trees of up to 8**levels leaves a group, 8**tops groups."""
    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, n: int) -> list[str]:
        out = []
        for j in range(n):
            out.append(f"{name}{j + 1} AS (SELECT g, r // 8 AS r, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) > 1 "
                       f"THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {name}{j} GROUP BY g, r // 8)")
            out.append(f"{name}p{j} AS (SELECT c.g, c.r, c.n > 1 AS hashed, coalesce(string_agg(s.h, '' ORDER BY s.r) FILTER (s.r < c.r), '') AS b, "
                       f"coalesce(string_agg(s.h, '' ORDER BY s.r) FILTER (s.r > c.r), '') AS a "
                       f"FROM {name}{j} c JOIN {name}{j} s ON c.g = s.g AND c.r // 8 = s.r // 8 GROUP BY c.g, c.r, c.n)")
        return out

    paths = [(f"ap{j}", f"p.g = z.g AND p.r = z.r // {8**j}") for j in range(levels)]
    paths += [(f"bp{j}", f"p.r = z.top // {8**j}") for j in range(tops)]
    steps = [
        f"rows_ AS (SELECT coalesce('=' || lang, '') AS g, doc_id, {leaf('text')} AS h, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 "
        f"THEN {leaf(f'translate(text, {LOWER})')} ELSE {leaf('text')} END AS t FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM rows_)",
        *tree("a", levels),
        f"b0 AS (SELECT '' AS g, g AS lang, h, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM a{levels})",
        *tree("b", tops),
        "z0 AS (SELECT a0.doc_id, a0.g, a0.r, b0.r AS top, a0.h AS leaf, b0.h AS subroot, a0.t AS v, '' AS siblings FROM a0 JOIN b0 ON a0.g = b0.lang)",
        *(f"z{k + 1} AS (SELECT z.doc_id, z.g, z.r, z.top, z.leaf, z.subroot, CASE WHEN p.hashed THEN sha256(p.b || z.v || p.a) ELSE z.v END AS v, "
          f"z.siblings || p.b || p.a AS siblings FROM z{k} z JOIN {p} p ON {on})" for k, (p, on) in enumerate(paths)),
        f"f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM b{tops}) AS root, sha256(siblings) AS proof_sha256, v AS folded_root FROM z{len(paths)})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT *, folded_root = root AS verified FROM f"


TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
     a AS (SELECT conv_id, list(struct_pack(role := role, x := x) ORDER BY turn NULLS FIRST,
                  sha256(strlen(role)::VARCHAR || ':' || role || x)[1:32] || ':' || length(x)) AS own FROM t GROUP BY conv_id),
     c AS (SELECT *, ({crc32('conv_id::VARCHAR')} % 6)::INT AS h FROM a),
     b AS (SELECT c.conv_id, list_concat(coalesce(f.own[1:c.h], []), c.own[c.h + 1:]) AS path
           FROM c LEFT JOIN a f ON f.conv_id = c.conv_id - c.conv_id % 100),
     e AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM b),
     n AS (SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(path)), '')) AS ends_sha256
           FROM e GROUP BY path[1:depth], depth),
     m AS (SELECT *, (SELECT count(*) FROM n o WHERE o.depth = n.depth + 1 AND o.p[1:n.depth] = n.p) AS n_children FROM n),
     s AS (SELECT u.p, count(*) FILTER (v.n_children = 0) AS n_leaves,
                  coalesce(sum((v.n_convs - 1) * length(v.p[v.depth].x)), 0)::BIGINT AS saved_tokens
           FROM m u JOIN m v ON v.depth >= u.depth AND v.p[1:u.depth] = u.p GROUP BY u.p)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON m.p = s.p LEFT JOIN m q ON q.depth = m.depth - 1 AND q.p = m.p[1:m.depth - 1]
"""

ORACLES = {"op11_line_duplicates": LINES, "op12_merkle_proofs": merkle(), "op13_conversation_trie": TRIE}
