"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, media, mixing, near_dedup, pii, quality, token_files, toxicity, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_near_dedup, pii.op2_pii, token_files.op3_token_files, url_filter.op4_url_filter, decontaminate.op5_decontaminate,
        warc.op6_warc, toxicity.op7_toxicity, mixing.op8_mixing, media.op9_media, quality.op10_quality,
    )
}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
_DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
),
places AS (
    SELECT doc, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT doc, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT doc, i, p.n AS n, item FROM places p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase),
hits AS (SELECT doc, count(DISTINCT j) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc, i, n FROM found)) GROUP BY doc),
named AS (SELECT doc, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc) LEFT JOIN named USING (doc)
"""
_DIGIT = "(instr('0123456789abcdef', substr(h, cast({0} AS int) + 1, 1)) - 1)"  # hex digit {0} of h; base32 digit i takes the bits from 5 i on
_FIVE = f"(({_DIGIT.format('5 * i // 4')} * 16 + {_DIGIT.format('least(39, 5 * i // 4 + 1)')}) // cast(pow(2, 3 - 5 * i % 4) AS int)) % 32"
_BASE32 = f"array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast({_FIVE} AS int) + 1, 1)), '')"
_SAFE = "replace(replace(replace(coalesce(url, ''), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D')"
_REST = f"substr({_SAFE}, instr({_SAFE}, '://') + 3)"
_HOST = f"regexp_extract({_REST}, '^[^/?#]*')"
_KEY = f"CASE WHEN contains({_SAFE}, '://') THEN array_to_string(list_reverse(string_split(lower({_HOST}), '.')), ',') || ')' || substr({_REST}, length({_HOST}) + 1) ELSE {_SAFE} END"
_WARC = f"""
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to, key
FROM (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, {_KEY} AS key FROM pages)
"""

#: The others can't be written whole in SQL; the tests hold each against a brute-force version or an exact round trip.
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": _DECONTAMINATE, "op6_warc": _WARC}
