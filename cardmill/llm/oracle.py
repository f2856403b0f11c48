"""SQL for DuckDB that must give the rows of the queries, where SQL can express them.

Without: byte-level BPE (the pattern looks ahead), the mix of sources (draws),
nearest neighbours (approximate), compression ratios, places of matches
of patterns, and parsing against automata. Tests hold these against brute force.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SYMBOL_WORD = r"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*"

TOKEN_ROLLUP = rf"""
WITH counted AS (
    SELECT source, lang,
        len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words,
        len(regexp_extract_all(coalesce(text, ''), '{_LETTERS}')) AS letters,
        len(regexp_extract_all(coalesce(text, ''), '{_SYMBOL_WORD}')) AS symbols,
        text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) AS again
    FROM documents
), versions AS (
    SELECT source, lang, 'words' AS version, words - symbols AS n FROM counted WHERE NOT again
    UNION ALL SELECT source, lang, 'letters', letters FROM counted WHERE NOT again
)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM versions GROUP BY ALL
"""

JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, b FROM reached r JOIN links ON r.other = links.a
)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes ON r.doc_id = sizes.doc_id GROUP BY r.doc_id
"""

PERSPECTIVE_ROTATION = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), speakers AS (
    SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), segments AS (
    SELECT t.conv_id, speaker, turn, role, text,
        CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
             WHEN role = speaker THEN '<|assistant|>' || chr(10)
             ELSE '<|user|>' || chr(10) || replace(role, '<|', '< |') || ': ' END AS opening,
        text || '<|end|>' || chr(10) AS rest
    FROM turns t JOIN speakers s ON t.conv_id = s.conv_id
), placed AS (
    SELECT *, sum(length(opening) + length(rest)) OVER (
        PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop
    FROM segments
)
SELECT conv_id, speaker, count(*)::BIGINT AS n_turns,
    string_agg(opening || rest, '' ORDER BY stop) AS transcript,
    coalesce(string_agg((stop - length(rest))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop) FILTER (WHERE role = speaker), '') AS mask,
    coalesce(sum(length(rest)) FILTER (WHERE role = speaker), 0)::BIGINT AS n_trained
FROM placed GROUP BY conv_id, speaker
"""

WARC = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
    SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(strpos('0123456789abcdef', hex[i]) + 15), 4)), '') AS b,
        min(page_id) OVER (PARTITION BY hex) AS first
    FROM hashed
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
            1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]
    ), '') AS payload_digest,
    CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first THEN first END AS refers_to
FROM bits
"""

# Sums are whole numbers; the floor of a mean is taken without a fraction.
_ROUND = """
), near{i} AS (
    SELECT row, p, c, d FROM (
        SELECT row, p, c, list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i])))::BIGINT AS d,
            row_number() OVER (PARTITION BY row ORDER BY d, c) AS place
        FROM points, centres{i}
    ) WHERE place = 1
"""
_MOVED = """
), sums{i} AS (
    SELECT c, j, sum(p[j])::BIGINT AS s, count(*)::BIGINT AS n FROM near{i}, range(1, 65) t(j) GROUP BY ALL
), means{i} AS (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM sums{i} GROUP BY c
), centres{j} AS (
    SELECT c, coalesce(m.q, o.q) AS q FROM centres{i} o LEFT JOIN means{i} m USING (c)
"""
ORCHARD = (
    """
WITH points AS (
    SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS p
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), centres0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1 AS c, p AS q FROM points
    WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16
"""
    + "".join(_ROUND.format(i=i) + _MOVED.format(i=i, j=i + 1) for i in range(3))
    + _ROUND.format(i=3)
    + """
)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
    sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM near3 JOIN points USING (row) JOIN centres3 USING (c)
"""
)

HARD_NEGATIVES = """
WITH points AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS p,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), named AS (
    SELECT *, row_number() OVER () AS row FROM points
), scores AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
        coalesce(list_sum(list_transform(range(1, least(len(a.p), len(b.p)) + 1), lambda i: a.p[i] * b.p[i])), 0)::BIGINT AS score
    FROM named a, named b WHERE a.vec_id % 100 = 0 AND a.row <> b.row
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM scores WHERE same
), negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row)::INTEGER AS rank
    FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same
        AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    WHERE place <= 5
)
SELECT * FROM negatives WHERE rank <= 5
"""

ORACLE: dict[str, str] = {
    "op2_token_rollup": TOKEN_ROLLUP,
    "op4_ngram_jaccard_join": JACCARD_JOIN,
    "op5_perspective_rotation": PERSPECTIVE_ROTATION,
    "op6_warc": WARC,
    "op12_orchard_search": ORCHARD,
    "op13_hard_negatives": HARD_NEGATIVES,
}
