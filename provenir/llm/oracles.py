"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")


def escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\.{c[1:]}')"
    return out


OP3 = f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|><|text|><|end|>') + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(10, len(w)) - 1) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (SELECT rid, k, list_slice(w, k, k + n - 1) AS g, n FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT rid, item_id, k, n FROM grams JOIN win USING (g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM met) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""


def spans_of(kind: str, rank: int, pattern: str, group: int, least: int, flags: str = "") -> str:
    """Spans of a pattern's matches: what is between them and they themselves alternate."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS a, length(whole[i]) AS n, length(v[i]) AS size, {least} AS least
FROM (SELECT rid, gaps, whole, v, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{flags}{quoted}') AS gaps, regexp_extract_all(t, '{flags}{quoted}') AS whole, regexp_extract_all(t, '{flags}{quoted}', {group}) AS v FROM d))"""


BASE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({spans_of("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {spans_of("hex", 2, "[0-9a-f]+", 0, 24)}
      UNION ALL {spans_of("assign", 0, ASSIGN, 1, 6)}),
s AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS spans FROM m WHERE size >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (rid)
"""

# 255 is no byte of UTF-8, so that the padded payload is digested from its hexadecimal digits.
MEDIA = """
SELECT doc_id, octet_length(b) AS n_bytes, n AS payload_bytes, sha256(unhex(hex(b) || repeat('FF', CAST(n - octet_length(b) AS BIGINT)))) AS payload_sha256, n + 44 AS media_bytes
FROM (SELECT doc_id, b, 576 * greatest(1, CAST(ceil(octet_length(b) / 576) AS BIGINT)) AS n FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents))
"""

ORACLES: dict[str, str] = {"op3_chat_formatting": OP3, "op6_decontamination": OP6, "secret_base_columns": BASE, "media_byte_columns": MEDIA}
