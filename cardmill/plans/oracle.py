"""The same queries as SQL for DuckDB, written apart from the operators."""

from __future__ import annotations

from ..operators.digest import CLOSING, INSTRUCTION, PREAMBLE
from . import registry as r

ENTRIES = """
entries AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 24, '0') AS id,
         split_part(text, chr(10), 1) AS title,
         substring(text, length(split_part(text, chr(10), 1)) + 2) AS content,
         source,
         'https://example.org/doc/' || doc_id AS link,
         strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS date_scraped,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER))
           + to_seconds(doc_id * 7919 % 86400) AS created_at
  FROM documents
)"""

FEED_ORDER = "date_scraped DESC NULLS LAST, created_at DESC NULLS LAST, id DESC NULLS LAST"

STORED = f"stored AS (SELECT * FROM entries WHERE extract(hour FROM created_at) < {r.SECOND_RUN_HOUR})"

DISTINCT = """
one_per_key AS (
  SELECT * FROM entries
  QUALIFY row_number() OVER (PARTITION BY title, source, date_scraped ORDER BY created_at, id) = 1
)"""

NEW = """
new_entries AS (
  SELECT * FROM one_per_key o
  WHERE NOT EXISTS (
    SELECT 1 FROM stored s
    WHERE s.title = o.title AND s.source = o.source AND s.date_scraped = o.date_scraped
  )
)"""


def inner_text(fragment: str) -> str:
    text = f"regexp_replace({fragment}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
    for name, character in [("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")]:
        text = f"replace({text}, '&{name};', '{character}')"
    return text


HEADING = "'(?is)<h1\\b[^>]*>(.*?)</h1\\s*>'"
PARAGRAPH = "'(?is)<article\\b[^>]*>.*?<p\\b[^>]*>(.*?)</p\\s*>'"

EXTRACTED = f"""
fields AS (
  SELECT page_id, url,
         CASE WHEN regexp_matches(html, {HEADING}) THEN {inner_text(f"regexp_extract(html, {HEADING}, 1)")}
              ELSE 'Unknown Title' END AS title,
         {inner_text(f"regexp_extract(html, {PARAGRAPH}, 1)")} AS content,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS source,
         strftime(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER), '%Y-%m-%d') AS date_scraped,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 30 AS INTEGER))
           + to_seconds(page_id * 7919 % 86400) AS created_at
  FROM pages
),
extracted AS (
  SELECT page_id, CAST(0 AS INTEGER) AS pos,
         substring(sha256(title || chr(31) || source || chr(31) || date_scraped), 1, 24) AS id,
         title, content, source, url AS link, date_scraped, created_at
  FROM fields WHERE source <> ''
)"""

LINKS = f"""
links AS (
  SELECT page_id, url,
         regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>.*?</a\\s*>', 1) AS hrefs
  FROM pages
),
hrefs AS (
  SELECT page_id, url, CAST(pos - 1 AS INTEGER) AS pos, {inner_text("hrefs[pos]")} AS href
  FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS pos FROM links)
)"""

RESULTS = f"""
results AS (
  SELECT *, CAST(id AS BIGINT) AS page_id,
         CASE CAST(id AS BIGINT) % {r.FAULTS} WHEN 0 THEN 'href_without_query' WHEN 1 THEN 'no_children' WHEN 2 THEN 'no_source'
              WHEN 3 THEN 'no_body' WHEN 4 THEN 'no_snippet' ELSE 'ok' END AS status
  FROM entries
)"""

UNTIL = f"until AS (SELECT * FROM entries WHERE date_scraped <= '{r.STORED_UNTIL}')"

COLUMNS = "id, title, content, source, link, date_scraped, created_at"


def matches(pattern: str) -> str:
    return f"(regexp_matches(title, '{pattern}', 'i') OR regexp_matches(content, '{pattern}', 'i'))"


def counts(total: str, page: int) -> str:
    return f"""
SELECT CAST({page} AS BIGINT) AS page, total, (total + 29) // 30 AS pages,
       {page} < (total + 29) // 30 AS has_next, {page} > 1 AS has_prev
FROM (SELECT CAST(count(*) AS BIGINT) AS total FROM ({total}))"""


def digests(source: str, by: str | None = None, entries: str = "entries") -> str:
    """A CTE ``source`` with the digests of the newest ten, in all or of each group."""
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by} ORDER BY {FEED_ORDER}" if by else f"ORDER BY {FEED_ORDER}"
    prompt = f"""'{PREAMBLE}' || chr(10) || chr(10) || '{INSTRUCTION}' || chr(10) || chr(10)
           || string_agg('Title: ' || title || chr(10) || ' Content: ' || content, chr(10) || chr(10) ORDER BY n)
           || chr(10) || chr(10) || '{CLOSING}'"""
    return f"""
{source} AS (
  SELECT {keys}count(*) AS n_entries, sha256(string_agg(title, ' ' ORDER BY n)) AS title_hash, {prompt} AS prompt
  FROM (SELECT *, row_number() OVER ({over}) AS n FROM {entries})
  WHERE n <= 10 {f"GROUP BY {by}" if by else ""}
)"""


CACHED = f"""
earlier AS (SELECT * FROM entries WHERE date_scraped < '{r.CACHED_UNTIL}'),
{digests("earlier_digests", "source", "earlier")},
cache AS (SELECT title_hash, 'cached ' || source AS ai_summary FROM earlier_digests),
{digests("digests", "source")}"""

WITH = f"WITH {ENTRIES}"

ORACLE: dict[str, str] = {
    "entries_scan": f"{WITH} SELECT {COLUMNS} FROM entries",
    "entry_projection": f"""{WITH}
SELECT CAST(CAST(id AS BIGINT) AS VARCHAR) AS id, title, content, source, link, date_scraped, created_at FROM entries""",
    "entry_json": f"""{WITH}
SELECT id, CAST(to_json(struct_pack(
         id := id, title := title, content := content, source := source, link := link,
         date_scraped := date_scraped, created_at := strftime(created_at, '%Y-%m-%dT%H:%M:%S'))) AS VARCHAR) AS json
FROM entries ORDER BY {FEED_ORDER} LIMIT 50 OFFSET {r.API_START}""",
    "entry_by_id": f"{WITH} SELECT {COLUMNS} FROM entries WHERE id = '{r.ENTRY_ID}'",
    "entries_by_ids": f"""{WITH}
SELECT {COLUMNS} FROM entries WHERE CAST(id AS BIGINT) IN (SELECT doc_id FROM labels)""",
    "feed_page": f"{WITH} SELECT {COLUMNS} FROM entries ORDER BY {FEED_ORDER} LIMIT 30 OFFSET {(r.FEED_PAGE - 1) * 30}",
    "feed_all": f"{WITH} SELECT {COLUMNS} FROM entries ORDER BY {FEED_ORDER} LIMIT 1000",
    "feed_latest": f"{WITH} SELECT {COLUMNS} FROM entries ORDER BY {FEED_ORDER} LIMIT 10",
    "feed_page_index": f"""{WITH}
SELECT id, date_scraped, feed_rank, (feed_rank - 1) // 30 + 1 AS page
FROM (SELECT *, row_number() OVER (ORDER BY {FEED_ORDER}) AS feed_rank FROM entries)""",
    "page_meta": f"{WITH} {counts(f'SELECT 1 FROM entries ORDER BY {FEED_ORDER} LIMIT 1000', r.FEED_PAGE)}",
    "search": f"{WITH} SELECT {COLUMNS} FROM entries WHERE {matches(r.WORD)}",
    "search_page": f"""{WITH}
SELECT {COLUMNS} FROM (SELECT * FROM entries WHERE {matches(r.OPENING)} ORDER BY {FEED_ORDER} LIMIT 100)
ORDER BY {FEED_ORDER} LIMIT 30 OFFSET {(r.SEARCH_PAGE - 1) * 30}""",
    "search_meta": f"""{WITH}
{counts(f"SELECT 1 FROM entries WHERE {matches(r.OPENING)} ORDER BY {FEED_ORDER} LIMIT 100", r.SEARCH_PAGE)}""",
    "dedup_batch": f"{WITH}, {DISTINCT} SELECT {COLUMNS} FROM one_per_key",
    "ingest_new": f"{WITH}, {STORED}, {DISTINCT}, {NEW} SELECT {COLUMNS} FROM new_entries",
    "ingest_merged": f"""{WITH}, {STORED}, {DISTINCT}, {NEW}
SELECT {COLUMNS} FROM stored UNION ALL SELECT {COLUMNS} FROM new_entries""",
    "ingest_stream": f"""WITH {EXTRACTED}
SELECT {COLUMNS} FROM extracted
QUALIFY row_number() OVER (PARTITION BY title, source, date_scraped ORDER BY page_id, pos) = 1""",
    "page_cards": f"WITH {LINKS} SELECT page_id, pos, href FROM hrefs",
    "card_link": f"""WITH {LINKS}
SELECT page_id, pos, href, split_part(ltrim(split_part(href, '?', 2), 'q='), '&', 1) AS link FROM hrefs""",
    "page_entries": f"WITH {EXTRACTED} SELECT page_id, pos, {COLUMNS} FROM extracted",
    "extract_stats": f"""WITH {LINKS}
SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS host,
       CASE WHEN strpos(href, '?') > 0 THEN 'ok' ELSE 'href_without_query' END AS status,
       count(*) AS n
FROM hrefs GROUP BY 1, 2""",
    "feed_page_deep": f"{WITH} SELECT {COLUMNS} FROM entries ORDER BY {FEED_ORDER} LIMIT 30 OFFSET {(r.DEEP_PAGE - 1) * 30}",
    "feed_all_uncapped": f"{WITH} SELECT {COLUMNS} FROM entries ORDER BY {FEED_ORDER}",
    "search_page_blank": f"{WITH} SELECT {COLUMNS} FROM entries ORDER BY {FEED_ORDER} LIMIT 30 OFFSET {(r.SEARCH_PAGE - 1) * 30}",
    "search_meta_blank": f"{WITH} {counts('SELECT 1 FROM entries LIMIT 1000', r.SEARCH_PAGE)}",
    "result_entries": f"""{WITH}, {RESULTS}
SELECT page_id, CAST(0 AS INTEGER) AS pos, substring(sha256(title || chr(31) || source || chr(31) || date_scraped), 1, 24) AS id,
       title, content || ' more' AS content, source, link, date_scraped, created_at
FROM results WHERE status = 'ok'""",
    "result_rejects": f"""{WITH}, {RESULTS}
SELECT page_id, 'https://results.example/' || source AS url, CAST(0 AS INTEGER) AS pos, status FROM results WHERE status <> 'ok'""",
    "result_stats": f"""{WITH}, {RESULTS}
SELECT 'results.example' AS host, status, count(*) AS n FROM results GROUP BY status""",
    "stored_feed_page": f"""{WITH}, {UNTIL}
SELECT {COLUMNS} FROM until ORDER BY {FEED_ORDER} LIMIT 30 OFFSET {(r.FEED_PAGE - 1) * 30}""",
    "stored_page_meta": f"{WITH}, {UNTIL} {counts('SELECT 1 FROM until LIMIT 1000', r.FEED_PAGE)}",
    "stored_search_page": f"""{WITH}, {UNTIL}
SELECT {COLUMNS} FROM (SELECT * FROM until WHERE {matches(r.OPENING)} ORDER BY {FEED_ORDER} LIMIT 100)
ORDER BY {FEED_ORDER} LIMIT 30 OFFSET {(r.SEARCH_PAGE - 1) * 30}""",
    "stored_search_meta": f"""{WITH}, {UNTIL}
{counts(f"SELECT 1 FROM until WHERE {matches(r.OPENING)} LIMIT 100", r.SEARCH_PAGE)}""",
    "indexed_search": f"{WITH} SELECT {COLUMNS} FROM entries WHERE {matches(r.RARE_WORD)}",
    "indexed_search_page": f"""{WITH}, {UNTIL}
SELECT {COLUMNS} FROM (SELECT * FROM until WHERE {matches(r.WORD)} ORDER BY {FEED_ORDER} LIMIT 100)
ORDER BY {FEED_ORDER} LIMIT 30""",
    "digest_requests": f"""{WITH}, earlier AS (SELECT * FROM entries WHERE date_scraped < '{r.CACHED_UNTIL}'),
{digests("of_feed")}, {digests("of_earlier", entries="earlier")}
SELECT 'feed' AS part, title_hash, prompt, NULL AS ai_summary, 'to_generate' AS status FROM of_feed
UNION ALL SELECT 'earlier', title_hash, prompt, 'cached', 'cached' FROM of_earlier
UNION ALL SELECT 'none', NULL, NULL, NULL, 'empty'""",
    "cache_written": f"""{WITH}, {CACHED}
SELECT title_hash, ai_summary FROM cache
UNION ALL SELECT title_hash, min('new ' || source) FROM digests
WHERE title_hash NOT IN (SELECT title_hash FROM cache) GROUP BY title_hash""",
    "entry_payload": f"{WITH} SELECT title, content, source, link, date_scraped, created_at FROM entries",
    "digest_key": f"{WITH}, {digests('digest')} SELECT title_hash FROM digest",
    "digest_prompt": f"{WITH}, {digests('digest')} SELECT title_hash, prompt FROM digest",
    "digest_by_source": f"{WITH}, {digests('digest', 'source')} SELECT source, n_entries, title_hash, prompt FROM digest",
    "digest_lookup": f"""{WITH}, {CACHED}
SELECT d.source, d.title_hash, c.ai_summary,
       CASE WHEN c.ai_summary IS NULL THEN 'to_generate' ELSE 'cached' END AS status
FROM digests d LEFT JOIN cache c ON c.title_hash = d.title_hash""",
    "digest_cache_add": f"""{WITH}, {CACHED},
completions AS (
  SELECT title_hash,
         CASE source WHEN '{r.EMPTY_COMPLETION}' THEN '' WHEN '{r.MISSING_COMPLETION}' THEN NULL
                     ELSE 'new ' || source END AS ai_summary
  FROM digests
)
SELECT title_hash, ai_summary FROM cache
UNION ALL
SELECT title_hash, min(ai_summary) FROM completions
WHERE ai_summary <> '' AND title_hash NOT IN (SELECT title_hash FROM cache)
GROUP BY title_hash""",
    "freshness": f"""{WITH}
SELECT source, max(date_scraped) AS last_updated, max(date_scraped) < '{r.RUN_DATE}' AS due
FROM entries GROUP BY source""",
}

ORACLE |= {
    "maintained_digests": ORACLE["digest_by_source"],
    "maintained_page_meta": ORACLE["page_meta"],
    "maintained_page_index": f"SELECT * FROM ({ORACLE['feed_page_index']}) WHERE date_scraped IN {r.INDEXED_DATES}",
}
