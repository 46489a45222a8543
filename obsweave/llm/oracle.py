"""The same answers in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

# A string of the six white characters, and A-Z in lower case.
_WHITE = "[\\x20\\x09-\\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of a string of ASCII characters, bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: 0::UBIGINT)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _tree(name: str, leaves: str) -> str:
    """Every level of the trees over ``leaves (g, pos, n, digest)``."""
    return f"""{name}(lvl, g, pos, n, digest) AS (
        SELECT 0, g, pos, n, digest FROM {leaves}
        UNION ALL
        SELECT lvl + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name}
        WHERE n > 1 GROUP BY lvl, g, pos // 8, n)"""


def _steps(name: str) -> str:
    """What lies left and right of every node in its run."""
    run = f"SELECT string_agg(s.digest, '' ORDER BY s.pos) FROM {name} s WHERE s.lvl = t.lvl AND s.g = t.g AND s.pos // 8 = t.pos // 8"
    return f"""{name}_steps AS (SELECT *, coalesce(({run} AND s.pos < t.pos), '') AS lhs,
        coalesce(({run} AND s.pos > t.pos), '') AS rhs FROM {name} t WHERE n > 1)"""


_MERKLE = f"""
    WITH RECURSIVE d AS (
        SELECT *, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head,
               CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LOWER.format("text")} ELSE text END AS changed
        FROM documents),
    h AS (SELECT doc_id, lang, coalesce(lang, '') || (lang IS NULL) AS g, sha256(head || {_field("text")}) AS digest,
                 sha256(head || {_field("changed")}) AS claim FROM d),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
                      count(*) OVER (PARTITION BY g) AS n FROM h),
    {_tree("nodes", "leaves")},
    {_steps("nodes")},
    subroots AS (SELECT x.g, x.digest, row_number() OVER (ORDER BY l.lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS many
                 FROM nodes x JOIN (SELECT DISTINCT g, lang FROM leaves) l ON l.g = x.g WHERE x.n = 1),
    tops AS (SELECT 'all' AS g, rank AS pos, many AS n, digest FROM subroots),
    {_tree("uppers", "tops")},
    {_steps("uppers")},
    way AS (
        SELECT l.doc_id, l.g, l.pos, s.lvl, s.lhs, s.rhs FROM leaves l
        JOIN nodes_steps s ON s.g = l.g AND s.pos = l.pos // CAST(pow(8, s.lvl) AS BIGINT)
        UNION ALL
        SELECT l.doc_id, l.g, l.pos, 100 + s.lvl, s.lhs, s.rhs FROM leaves l JOIN subroots r ON r.g = l.g
        JOIN uppers_steps s ON s.pos = r.rank // CAST(pow(8, s.lvl) AS BIGINT)),
    steps AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY lvl) AS step FROM way),
    folded(g, pos, step, digest) AS (
        SELECT g, pos, CAST(0 AS BIGINT), claim FROM leaves
        UNION ALL
        SELECT f.g, f.pos, s.step, sha256(s.lhs || f.digest || s.rhs) FROM folded f
        JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.step = f.step + 1)
    SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, u.digest AS root,
           sha256(coalesce((SELECT string_agg(lhs || rhs, '' ORDER BY step) FROM steps s WHERE s.g = l.g AND s.pos = l.pos), '')) AS proof_sha256,
           f.digest AS folded_root, f.digest = u.digest AS verified
    FROM leaves l JOIN subroots r ON r.g = l.g JOIN uppers u ON u.n = 1
    JOIN (SELECT g, pos, arg_max(digest, step) AS digest FROM folded GROUP BY g, pos) f ON f.g = l.g AND f.pos = l.pos"""

_INFILL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
                      sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    e AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM d),
    f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS m,
                 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
                      WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
    o AS (SELECT *, CASE form WHEN 'plain' THEN t
                     WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, m + 1) || '<M>' || substr(t, p + 1, m - p)
                     ELSE '<S>' || substr(t, m + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, m - p) END AS output FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
           sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

SQL = {
    "op11_merkle_manifest": _MERKLE,
    "op12_fill_in_middle": _INFILL,
    "op3_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
        r AS (SELECT *, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                     row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS n
              FROM d WINDOW g AS (PARTITION BY text_sha256))
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM r""",
    "op7_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                   THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
              FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1""",
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {_LOWER.format(f"regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g')")} AS key FROM l),
        h AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20
              GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        f AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keep_id AS falls
              FROM k LEFT JOIN h ON h.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (falls) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT falls), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
}
