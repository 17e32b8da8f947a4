"""DuckDB SQL of the library's queries, over the same tables."""

from __future__ import annotations

import re

from .queries import ADDRESSES, AGENTS, SIGNED_AT

_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"
_UNSAFE = r"""'[\x00-\x1f"*/:<>?\\|]'"""


def _part(n: int, url: str = "url") -> str:
    return f"regexp_extract({url}, {_URL}, {n})"


def scheme(url: str = "url") -> str:
    return f"lower({_part(1, url)})"


def netloc(url: str = "url") -> str:
    return _part(2, url)


def path(url: str = "url") -> str:
    return f"regexp_extract({_part(3, url)}, '^((?:.*/)?[^/;]*)', 1)"


def host(url: str = "url") -> str:
    return rf"lower(regexp_extract({netloc(url)}, '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1))"


def origin(url: str = "url") -> str:
    return f"{scheme(url)} || '://' || {netloc(url)}"


def content_hash(text: str) -> str:
    return rf"sha256(regexp_replace({text}, '\s+$', '') || chr(10))"


def normalized(url: str = "url") -> str:
    slim = f"case when {path(url)} = '/' then '/' else regexp_replace({path(url)}, '/+$', '') end"
    query = f"case when {_part(4, url)} <> '' then '?' || {_part(4, url)} else '' end"
    return f"case when {scheme(url)} = '' then 'https' else {scheme(url)} end || '://' || {netloc(url)} || {slim} || {query}"


def file_name(url: str = "url") -> str:
    slug = f"trim({path(url)}, '/')"
    safe = f"regexp_replace({netloc(url)}, {_UNSAFE}, '-', 'g')"
    named = f"case when {slug} <> '' then {safe} || '-' || regexp_replace({slug}, {_UNSAFE}, '-', 'g') else {safe} end"
    return f"case when {slug} = '' and {_part(4, url)} = '' then {safe} else {named} || '-' || substr(sha256({url}), 1, 8) end"


def decoded(text: str) -> str:
    for entity, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("amp", "&")):
        text = f"replace({text}, '&{entity};', '{char}')"
    return text


def collapsed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def visible(md: str) -> str:
    for pattern, to in ((r"(?s)```.*?```", " "), (r"!\[[^\]]*[\]][(][^)]*[)]", " "), (r"[\[]([^\]]*)[\]][(][^)]*[)]", r"\1"), (r"(?m)^#{1,6}\s*", ""), (r"[*_`>~]", ""), (r"\|", " ")):
        md = f"regexp_replace({md}, '{pattern}', '{to}', 'g')"
    return collapsed(md)


_NL = "chr(10) || chr(10)"

#: Pages as converted: the article, or the whole body where the article is short.
CONVERTED = rf"""
parts AS (
  SELECT page_id, url, html, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad,
    {decoded("regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<[^>]*>', '', 'gs')")} AS all_text,
    {decoded(r"regexp_extract(html, '<title>\s*([^<]*?)\s*</title>', 1)")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language
  FROM pages),
blocks AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(article, '<h1>\s*([^<]*?)\s*</h1>', {_NL} || '# \1' || {_NL}, 'g'), '<p><b>\s*([^<]*?)\s*<br>', {_NL} || '**\1**' || {_NL}, 'g'), '<p>\s*([^<]*?)\s*</p>', {_NL} || '\1' || {_NL}, 'g') AS body,
    length(trim({decoded("regexp_replace(article, '<[^>]*>', '', 'g')")})) >= 200 AS long_enough
  FROM parts),
raw AS (SELECT *, {decoded("case when long_enough then body else ad || body end")} AS raw_md FROM blocks),
converted AS (
  SELECT page_id, url, html, {decoded("title")} AS title, language, raw_md, length({collapsed("all_text")}) AS source_chars, length(raw_md) AS markdown_chars,
    length({visible("raw_md")}) AS kept_chars, len(regexp_extract_all(html, '<(nav|footer|aside|form|head|meta|link|button|input)[ >]')) AS stripped_elements,
    trim(regexp_replace(raw_md, '\n{{3,}}', {_NL}, 'g'), ' ' || chr(10)) || chr(10) AS markdown
  FROM raw)
"""

_TOKENS = r"greatest(1, list_sum(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda r: (length(r) + 3) // 4)) + len(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}]')))"


def tokens(text: str) -> str:
    return f"CAST(greatest(1, coalesce({_TOKENS.format(text)}, 1)) AS BIGINT)"


MANIFEST = f"""
manifest AS (
  SELECT page_id AS seq, url, CASE WHEN page_id % 3 = 0 THEN html ELSE html || 'old' END AS body, '"' || page_id || '"' AS etag, page_id % 2 = 0 AS file_exists FROM pages WHERE page_id % 3 < 2),
latest AS (SELECT url, sha256(body) AS old_hash, {content_hash("body")} AS old_content, etag, file_exists FROM manifest QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)
"""

LICENSED = r"""
licensed AS (
  SELECT doc_id, doc_id % 6 AS n, doc_id % 4 = 0 AS private, lower(regexp_extract(text, '(?im)^(.*(?:license|all rights reserved).*)$', 1)) AS license FROM documents)
"""

PAGE_ROWS = f"""
rows AS (
  SELECT page_id, url, {host()} AS host, {netloc()} AS site, page_id % 11 = 10 AS bad, CASE WHEN page_id % 11 = 10 THEN NULL WHEN page_id % 13 = 12 THEN 404 ELSE 200 END AS status_code,
    strlen(html) AS raw_bytes, markdown_chars, round(least(1.0, kept_chars / greatest(1, source_chars)), 4) AS ratio, markdown_chars < 150 AS low FROM converted)
"""


def card(by: str = "", digits: int = 4) -> str:
    return f"""SELECT {by + "," if by else ""} count(*) AS pages, count(*) FILTER (NOT bad AND coalesce(status_code, 0) < 400) AS succeeded, count(*) FILTER (NOT (NOT bad AND coalesce(status_code, 0) < 400)) AS failed,
  CAST(sum(raw_bytes) AS BIGINT) AS total_raw_bytes, CAST(sum(markdown_chars) AS BIGINT) AS total_markdown_chars, round(min(ratio), 4) AS retention_min, round(max(ratio), 4) AS retention_max, round(avg(ratio), {digits}) AS retention_avg,
  CASE WHEN bool_or(page_id % 4 = 0) THEN 'CC-BY' ELSE '' END AS licenses_seen, count(DISTINCT site) FILTER (page_id % 3 = 0) AS ai_txt_hosts, count(DISTINCT site) FILTER (page_id % 5 = 0) AS llms_txt_hosts, count(*) FILTER (low) AS low_content_pages
FROM rows {"GROUP BY " + by if by else ""}"""


#: Sites with their consent: an ai.txt for even lengths of the name, llms.txt for multiples of 3, one for /en of 5.
def _has(divisor: int) -> str:
    return f"length({netloc()}) % {divisor} = 0"


_CONSENT = f"CASE WHEN {_has(2)} THEN 'Deny' ELSE '' END AS training, {_has(3)} OR ({_has(5)} AND regexp_matches({path()}, '^/en/[^/]*$')) AS llms_txt"

JOB = f"""
{CONVERTED}, {MANIFEST},
stored AS (SELECT page_id AS seq, url, html FROM pages UNION ALL SELECT page_id + 1000000000, url || '&copy=1', html FROM pages WHERE page_id % 8 = 0),
looked AS (SELECT s.seq, s.url, s.html, sha256(s.html) AS h, s.seq % 17 = 16 AS bad, l.old_hash = sha256(s.html) AND l.file_exists AS same FROM stored s LEFT JOIN latest l USING (url)),
fresh AS (SELECT k.*, sha256(c.markdown) AS content FROM looked k JOIN converted c ON c.page_id = k.seq % 1000000000 WHERE NOT bad AND NOT coalesce(same, false)),
ranked AS (SELECT *, seq > min(seq) OVER (PARTITION BY content) AS again FROM fresh),
outcomes AS (
  SELECT k.seq, k.url, k.html, k.h, CASE WHEN k.bad THEN 'failed' WHEN coalesce(k.same, false) THEN 'unchanged' WHEN r.again THEN 'duplicate' WHEN regexp_matches({path("k.url")}, '^/es/') THEN 'blocked' ELSE 'saved' END AS outcome
  FROM looked k LEFT JOIN ranked r USING (seq))
"""

_STRICT = """CASE WHEN n = 0 THEN 'no-training-denied' WHEN n = 1 THEN 'no-data-denied' WHEN n = 2 AND private THEN 'no-disallow' WHEN contains(license, 'all rights reserved') THEN 'no-proprietary' ELSE '' END"""
_OPEN = """CASE WHEN contains(license, 'all rights reserved') OR contains(license, 'proprietary') OR contains(license, 'by-nc') OR contains(license, 'by-nd') THEN 'open-licenses-only' ELSE '' END"""

_AGENT_GROUPS = {"lake": [("training", "Allow"), ("allow", "/")], "lake/1.0": [("training", "Allow"), ("allow", "/")], "lake/2": [("data", "Deny")], "lake/2 beta": [("data", "Deny")]}
_ANY = [("training", "Deny"), ("data", "Allow"), ("disallow", "/private/")]


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


_PUBLIC = {"8.8.8.8", "1.1.1.1", "example.com", "2606:4700::1111"}

_BFS = """
node AS (SELECT page_id AS id, page_id % 9 <> 8 AS ok FROM pages),
edge AS (SELECT id AS src, unnest([id * 2 + 1, id * 2 + 2, 0]) AS dst FROM node WHERE ok)
"""

_CHUNK = "substr(t, s + 1, e - s)"


def _element(expected: str) -> str:
    """SQL of the Markdown of a fragment; W, S, L and N as in the queries."""
    values = {"W": "('w' || doc_id)", "S": "source", "L": "lang", "N": "doc_id"}
    parts = [values.get(part, "'" + part.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for part in re.split(r"\b([WSLN])\b", expected) if part]
    return " || ".join(parts)


_ELEMENTS = {
    "markdown_inline": "A **W** and *S*, `f(N)`.\nnext **L**\n\n---\n",
    "markdown_code": "```python\nx = N\n```\n\nor\n\n```js\nW\n```\n\n```rust\nS\n```\n\n```\nplain L\n```\n",
    "markdown_lists": "- W\n- S\n  L\n\n3. a\n5. W\n\n1. N\n",
    "markdown_quotes": "> W\n\n**T W**\n: S\n\nL\n",
    "markdown_tables": "| Name | Lang |\n| ---- | ---- |\n| W | L |\n| a \\| S | x<br>N |\n| W |  |\n",
    "markdown_links": "[W](https://h.org/a?n=N) S z ![I L](https://h.org/d/N.png)\n",
}


def _windows(limit: int, overlap: int) -> str:
    """Chunks of '# T' and n sentences of 21 characters and 4 tokens: a first window, then ones that begin with a tail.

    The first piece is the heading with the first sentence, 25 characters and 5 tokens.  A tail is 4 characters for a token.
    """
    first = (limit - 5) // 4 + 1
    # an empty tail counts as one token
    tail = tokens(f"substr(t, 5 + {first} * 21 - {4 * overlap}, {4 * overlap})") if overlap else "1"
    return f"""WITH d AS (SELECT doc_id, doc_id % 397 + 3 AS n, '# T' || chr(10) || repeat('aaaa bbbb cccc dddd. ', CAST(doc_id % 397 + 3 AS INTEGER)) AS t FROM documents),
sized AS (SELECT *, 1 + 4 * n <= {limit} AS whole, CASE WHEN n > {first} THEN {tail} ELSE 0 END AS tail FROM d),
steps AS (SELECT *, ({limit} - tail) // 4 AS step FROM sized),
cut AS (SELECT *, unnest(range(0, CASE WHEN whole OR n <= {first} THEN 1 ELSE 1 + CAST(ceil((n - {first}) / step) AS BIGINT) END)) AS k FROM steps),
chunk AS (SELECT doc_id, t, whole, k, CASE WHEN k = 0 THEN 0 ELSE 4 + 21 * ({first} + (k - 1) * step) - {4 * overlap} END AS s,
  CASE WHEN whole THEN length(t) WHEN k = 0 THEN 4 + 21 * least(n, {first}) ELSE 4 + 21 * least(n, {first} + k * step) END AS e,
  CASE WHEN whole THEN 1 + 4 * n WHEN k = 0 THEN 1 + 4 * least(n, {first}) ELSE tail + 4 * (least(n, {first} + k * step) - {first} - (k - 1) * step) END AS token_count FROM cut)
SELECT doc_id, CASE WHEN whole THEN 'c0' ELSE 'c0.' || k END AS chunk_id, 'T' AS heading, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(e - s AS BIGINT) AS char_count, CAST(token_count AS BIGINT) AS token_count, sha256({_CHUNK}) AS content_sha256 FROM chunk"""


_EXPORT = f"WITH {CONVERTED} SELECT url, CAST(strlen(html) AS BIGINT) AS raw_bytes, CAST(length(markdown) AS BIGINT) AS markdown_chars, '[\"' || url || '\"]' AS redirect_chain, sha256(html) AS bytes_sha256 FROM converted"

_SPECIAL = "'<think>why' || chr(10) || '</think>' || chr(10) || chr(10) || ' ' || chr(10) || text || chr(10)"

ORACLE: dict[str, str] = {
    **{name: f"SELECT doc_id, {_element(expected)} AS markdown FROM documents" for name, expected in _ELEMENTS.items()},
    "markdown_boilerplate": f"SELECT doc_id, {_element('## W' + chr(10) * 2 + 'kept W' + chr(10) * 2 + 'S' + chr(10) * 2 + 'L' + chr(10))} AS markdown, CAST(6 AS BIGINT) AS stripped_elements FROM documents",
    "markdown_shadow_tables": f"SELECT doc_id, '| ' || source || ' |' || chr(10) || '| ' || repeat('-', greatest(3, length(source))) || ' |' || chr(10) || '| w' || doc_id || ' |' || chr(10) AS markdown FROM documents",
    "markdown_content": "WITH d AS (SELECT doc_id, repeat('Many words of content stand here for w' || doc_id || '. ', 8) AS long FROM documents) SELECT doc_id, trim(long || 'inner ' || long) || chr(10) AS markdown FROM d",
    "meta_tags": "SELECT doc_id, 'w' || doc_id || ' & ' || source AS title, 'A w' || doc_id AS author, lang AS language, 'D \"' || lang || '\"' AS description, source AS site_name, '20N' AS published_time, '2021' AS modified_time, '/lic/' || doc_id AS license FROM documents",
    "chunk_windows": _windows(512, 64),
    "chunk_legacy_chars": _windows(250, 0),
    "chunk_hard_split": """WITH d AS (SELECT doc_id, CAST(doc_id % 97 * 100 + 1 AS BIGINT) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, (n + 2047) // 2048)) AS k FROM d)
SELECT doc_id, CASE WHEN n <= 2048 THEN 'c0' ELSE 'c0.' || k END AS chunk_id, '' AS heading, 2048 * k AS start, least(n, 2048 * (k + 1)) AS "end", least(n, 2048 * (k + 1)) - 2048 * k AS char_count, (least(n, 2048 * (k + 1)) - 2048 * k + 3) // 4 AS token_count, sha256(repeat('x', CAST(least(n, 2048 * (k + 1)) - 2048 * k AS INTEGER))) AS content_sha256 FROM c""",
    "sink_markdown_files": f"WITH {CONVERTED} SELECT {file_name()} || '.md' AS file, sha256(markdown) AS document_sha256 FROM converted",
    "sink_markdown_existing": f"SELECT {file_name()} || '.md' AS file, CASE WHEN page_id % 2 = 0 THEN url ELSE 'new' END AS document FROM pages",
    "sink_export_parquet": _EXPORT,
    "sink_export_jsonl": _EXPORT,
    "sink_export_json": _EXPORT,
    "sink_store": "SELECT DISTINCT sha256(html) AS name, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS bytes_sha256 FROM pages",
    "sink_chunk_manifests": f"WITH {CONVERTED} SELECT url AS doc_id, sha256(markdown) AS content_hash, CAST(0 AS BIGINT) AS first, count(*) AS openings FROM converted WHERE markdown <> '' GROUP BY ALL",
    "sink_archives": "SELECT url AS target_uri, sha256(html) AS bytes_sha256 FROM pages",
    "sink_llms_txt": "SELECT '# example' || chr(10) || chr(10) || '> All pages.' || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || string_agg('- [' || CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE url END || '](' || url || ')', chr(10) ORDER BY page_id) || chr(10) AS content FROM pages",
    "url_list_file": "SELECT url FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0",
    "capture_hash": "SELECT page_id, sha256(html) AS bytes_sha256, CAST(strlen(html) AS BIGINT) AS raw_bytes FROM pages",
    "content_hash": f"SELECT doc_id, {content_hash('text')} AS content_hash, substr(sha256(text), 1, 8) AS short_hash FROM documents",
    "capture_rows": f"SELECT page_id, url, url AS final_url, 200 AS status_code, '{SIGNED_AT}' AS fetched_at, 'text/html' AS content_type, url AS last_hop, CAST(length(html) AS BIGINT) AS html_chars FROM pages",
    "url_list_lines": "SELECT page_id, url FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0",
    "url_parts": f"SELECT page_id, {scheme()} AS scheme, {netloc()} AS netloc, {host()} AS host, CAST(CASE WHEN {scheme()} = 'https' THEN 443 ELSE 80 END AS BIGINT) AS port, {path()} AS path, {_part(4)} AS query, {origin()} AS origin FROM pages",
    "url_normalize": f"SELECT page_id, {normalized()} AS normalized FROM pages",
    "url_base_path": f"SELECT page_id, CASE WHEN ends_with({path()}, '/') THEN regexp_replace({path()}, '/+$', '') WHEN contains(regexp_extract({path()}, '([^/]*)$', 1), '.') THEN regexp_extract({path()}, '^(.*)/[^/]*$', 1) ELSE {path()} END AS base_path FROM pages",
    "url_filename": f"SELECT page_id, {file_name()} AS file FROM pages",
    "url_collection": f"SELECT page_id, trim(regexp_replace(lower({netloc()} || '/' || trim({path()}, '/')), '[^0-9a-z]+', '-', 'g'), '-') AS collection FROM pages",
    "url_same_origin": f"SELECT page_id, {scheme()} = 'https' AS same_secure, {scheme()} = 'https' AS same_upper FROM pages",
    "header_scoping": "SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_headers FROM pages",
    "fetch_and_convert_rows": f"WITH {CONVERTED} SELECT url, sha256(markdown) AS content_hash, sha256(html) AS bytes_sha256, 200 AS status_code, '{SIGNED_AT}' AS fetched_at FROM converted",
    "robots_redirects": f"SELECT page_id, page_id % 2 = 1 AND NOT starts_with({path()}, '/en/') AS robots_allowed FROM pages",
    "page_metadata": f"WITH {CONVERTED} SELECT page_id, title, language, '' AS author, '' AS license FROM converted",
    "page_links": f"""WITH found AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
links AS (SELECT page_id, pos, {normalized(f"({origin()} || {decoded('href')})")} AS link, {path(decoded("href"))} AS p FROM found)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS pos, link FROM links WHERE NOT regexp_matches(lower(p), '[.](pdf|jpg|jpeg|png|gif|svg|ico|css|js|json|xml|zip|tar|gz|mp3|mp4|webm|woff|woff2|ttf|eot)$')""",
    "links_in_site": f"""WITH found AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages WHERE {netloc()} = 'thther.example.org')
SELECT {normalized(f"({origin()} || {decoded('href')})")} AS link, count(*) AS n FROM found WHERE NOT regexp_matches(lower(href), '[.](pdf|jpg|jpeg|png|gif|svg|ico|css|js|json|xml|zip|tar|gz|mp3|mp4|webm|woff|woff2|ttf|eot)$') GROUP BY ALL""",
    "html_to_markdown": f"WITH {CONVERTED} SELECT page_id, markdown FROM converted",
    "page_measures": f"WITH {CONVERTED} SELECT page_id, source_chars, markdown_chars, kept_chars, stripped_elements, markdown_chars < 150 AS low_content FROM converted",
    "retention": f"WITH {CONVERTED} SELECT page_id, round(least(1.0, kept_chars / greatest(1, source_chars)), 4) AS retention_ratio, true AS agrees FROM converted",
    "markdown_text": f"WITH {CONVERTED} SELECT page_id, CAST(length({visible('markdown')}) AS BIGINT) AS visible_chars, true AS is_tidy FROM converted",
    "render_routing": f"WITH {CONVERTED} SELECT page_id, length(trim(markdown, ' ' || chr(10))) < 200 AS needs_render FROM converted",
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "token_budgets": f"WITH t AS (SELECT conv_id, turn, {tokens('text')} AS tokens FROM conversations) SELECT conv_id, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM t",
    "token_histogram": f"SELECT lang, CAST(floor({tokens('text')} / 256) AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY ALL",
    "thinking_tags": rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace({_SPECIAL}, '<think>.*?<[/]think>', '', 'gs'), '\n\s*\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS answer FROM conversations",
    "prompts": "SELECT item_id, 'Describe: ' || text || ' Briefly. /no_think' AS prompt FROM benchmark",
    "content_dedup": f"SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY {content_hash('text')}) AS is_duplicate FROM documents",
    "first_of_each": f"SELECT doc_id, lang, {content_hash('text')} AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY {content_hash('text')} ORDER BY doc_id) = 1",
    "duplicate_report": f"SELECT {content_hash('text')} AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "seen_hashes": f"WITH d AS (SELECT doc_id, {content_hash('text')} AS h FROM documents) SELECT doc_id FROM d WHERE h NOT IN (SELECT h FROM d WHERE doc_id % 3 = 0)",
    "incremental_changes": f"WITH {MANIFEST} SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 'not_modified' WHEN old_hash = sha256(html) AND file_exists THEN 'unchanged' WHEN old_hash IS NOT NULL THEN 'changed' ELSE 'new' END AS change FROM pages LEFT JOIN latest USING (url)",
    "conditional_headers": f"WITH {MANIFEST} SELECT page_id, CAST(CASE WHEN etag IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_headers, coalesce(etag, '') AS if_none_match FROM pages LEFT JOIN latest USING (url)",
    "policy_strict": f"WITH {LICENSED}, r AS (SELECT doc_id, {_STRICT} AS rule FROM licensed) SELECT doc_id, rule = '' AS allowed, rule, CASE rule WHEN 'no-training-denied' THEN 'site prohibits AI training' WHEN 'no-data-denied' THEN 'site prohibits use of its content as data' WHEN 'no-disallow' THEN 'site disallows scraping' WHEN 'no-proprietary' THEN 'proprietary content' ELSE '' END AS reason FROM r",
    "policy_open": f"WITH {LICENSED}, r AS (SELECT doc_id, {_OPEN} AS rule FROM licensed) SELECT doc_id, rule = '' AS allowed, rule, CASE WHEN rule = '' THEN '' ELSE 'license is not permissive/open' END AS reason FROM r",
    "policy_paths": f"""WITH p AS (SELECT page_id, {path()} AS p FROM pages)
SELECT page_id, NOT (p GLOB '/en/[5-9]*' OR p GLOB '/fr/?' OR p GLOB '*/7*') AS allowed,
  CASE WHEN p GLOB '/en/[5-9]*' OR p GLOB '/fr/?' THEN 'no-english' WHEN p GLOB '*/7*' THEN 'deny' WHEN p GLOB '/de/*' THEN 'german' ELSE '' END AS rule,
  CASE WHEN p GLOB '/en/[5-9]*' OR p GLOB '/fr/?' THEN 'blocked by policy' WHEN p GLOB '*/7*' THEN 'seven' ELSE '' END AS reason FROM p""",
    "ai_txt_groups": _values([(a, k, v) for a in AGENTS for k, v in _AGENT_GROUPS.get(a, _ANY)], "agent, key, value"),
    "directives": _values([("Deny", "Deny"), (" no ", "Deny"), ("opt-in", "Allow"), ("TRUE", "Allow"), ("ask first", "ask first"), ("never", "Deny"), ("Permitted", "Allow")], "value, directive"),
    "page_consent": f"SELECT page_id, {_CONSENT} FROM pages",
    "robots_rules": f"SELECT page_id, NOT ({scheme()} = 'https' AND starts_with({path()}, '/en/')) AS robots_allowed FROM pages",
    "rate_delays": "SELECT CAST(id AS INTEGER) AS id, CAST(c AS DOUBLE) AS crawl_delay_s, CAST(d AS DOUBLE) AS delay_ms FROM (VALUES (1, 2.5, 2500), (2, 90, 60000), (3, -1, 500), (4, 0.1, 500)) AS t(id, c, d)",
    "private_addresses": _values([(a, a not in _PUBLIC) for a in ADDRESSES], "host, blocked"),
    "chunk_spans": "SELECT doc_id, '' AS chunk_id FROM documents WHERE false",
    "chunk_whole": f"SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS \"end\", {tokens('text')} AS token_count FROM documents WHERE {tokens('text')} <= 512 AND trim(text) <> ''",
    "chunk_sections": f"WITH {CONVERTED}, lines AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line FROM converted) SELECT page_id, CAST(length(regexp_extract(line, '^(#+)', 1)) AS BIGINT) AS level, trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1)) AS title FROM lines WHERE regexp_matches(line, '^#{{1,6}}\\s+')",
    "provenance_records": f"WITH {CONVERTED} SELECT page_id, title, url, '{SIGNED_AT}' AS fetched_at, sha256(markdown) AS content_hash, sha256(html) AS bytes_sha256, 200 AS status_code, nullif(language, '') AS language, 'kb' AS team, CASE WHEN markdown_chars < 150 THEN true END AS low_content FROM converted",
    "provenance_complete": "SELECT count(*) AS pages, count(*) AS complete FROM pages",
    "export_flat": f"WITH {CONVERTED} SELECT url, CAST(strlen(html) AS BIGINT) AS raw_bytes, CAST(length(markdown) AS BIGINT) AS markdown_chars, '[\"' || url || '\"]' AS redirect_chain, sha256(html) AS bytes_sha256 FROM converted",
    "loader_rows": f"WITH {CONVERTED} SELECT url AS source, sha256(html) AS bytes_sha256, CAST(length(markdown) AS BIGINT) AS chars FROM converted",
    "yaml_documents": "SELECT page_id, true AS round_trip FROM pages",
    "sign_verify": "SELECT page_id, true AS ok, false AS ok_other, false AS ok_changed FROM pages",
    "warc_round_trip": "SELECT url AS target_uri, sha256(html) AS bytes_sha256 FROM pages",
    "data_card": f"WITH {CONVERTED}, {PAGE_ROWS} {card()}",
    "data_card_by_host": f"WITH {CONVERTED}, {PAGE_ROWS} {card('host', 6)}",
    "scorecard": f"""WITH {CONVERTED}, {PAGE_ROWS}, r AS (SELECT *, page_id % 7 * 10.0 AS latency, page_id % 2 = 0 AS complete, status_code IS NOT NULL AS ok FROM rows)
SELECT count(*) AS total, count(*) FILTER (ok) AS successful, round(count(*) FILTER (ok) / count(*), 4) AS success_rate, round(avg(CAST(latency AS DOUBLE)) FILTER (ok), 1) AS avg_latency_ms, round(avg(markdown_chars / greatest(1, raw_bytes)) FILTER (ok), 3) AS avg_markdown_ratio,
  count(*) FILTER (ok AND complete) AS provenance_complete, CAST(floor(sum(markdown_chars) FILTER (ok) / 4) AS BIGINT) AS token_estimate FROM r""",
    "scorecard_of_captures": "SELECT count(*) AS total, count(*) FILTER (page_id % 9 <> 8) AS successful, round(count(*) FILTER (page_id % 9 <> 8) / count(*), 4) AS success_rate, CAST(12.0 AS DOUBLE) AS avg_latency_ms, count(*) FILTER (page_id % 9 <> 8) AS provenance_complete FROM pages",
    "job_outcomes": f"WITH {JOB} SELECT seq, outcome FROM outcomes",
    "job_counters": f"WITH {JOB} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome",
    "job_manifest": f"WITH {JOB} SELECT seq, url, {file_name()} || '.md' AS file, h AS bytes_sha256, 200 AS status_code FROM outcomes WHERE outcome = 'saved'",
    "job_data_card": f"WITH {JOB} SELECT count(*) AS pages, count(*) FILTER (outcome NOT IN ('failed', 'blocked')) AS succeeded, count(*) FILTER (outcome IN ('failed', 'blocked')) AS failed, CAST(coalesce(sum(CASE WHEN outcome IN ('saved', 'blocked') THEN strlen(html) END), 0) AS BIGINT) AS total_raw_bytes FROM outcomes WHERE outcome <> 'duplicate'",
    "llms_txt": "SELECT '# example' || chr(10) || chr(10) || '> All pages.' || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || string_agg('- [' || CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE url END || '](' || url || ')', chr(10) ORDER BY page_id) || chr(10) AS content FROM pages",
    "llms_full_blocks": f"WITH b AS (SELECT page_id AS seq, '# ' || url || {_NL} || 'Source: ' || url || {_NL} || html AS block FROM pages) SELECT seq, CAST(length(block) AS BIGINT) AS chars, sha256(block) AS block_sha256 FROM b",
    "context_sample": """WITH f AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.md' AS name, text FROM documents ORDER BY name LIMIT 5),
r AS (SELECT *, 10000 - coalesce(sum(length(text)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f)
SELECT string_agg('## File: ' || name || chr(10) || CASE WHEN length(text) > room THEN substr(text, 1, CAST(room AS BIGINT)) || chr(10) || '[... truncated ...]' ELSE text END, chr(10) || chr(10) ORDER BY name) || chr(10) || chr(10) || '[Note: Showing 5 of ' || (SELECT count(*) FROM documents) || ' files]' AS content FROM r WHERE room > 0""",
    "crawl_bfs": f"""WITH RECURSIVE {_BFS}, seen(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM seen JOIN edge ON src = id WHERE depth < 4)
SELECT 'p' || s.id AS url, CAST(min(depth) AS BIGINT) AS depth, coalesce(bool_or(ok), false) AS ok FROM seen s LEFT JOIN node USING (id) GROUP BY s.id""",
    # every page but the first is linked from one smaller page, so links back lead to nothing new
    "crawl_whole": f"""WITH RECURSIVE {_BFS}, seen(id, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT dst, depth + 1 FROM seen JOIN edge ON src = id WHERE dst > id)
SELECT 'p' || s.id AS url, depth, coalesce(ok, false) AS ok FROM seen s LEFT JOIN node USING (id)""",
    "crawl_limited": f"""WITH RECURSIVE {_BFS}, seen(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM seen JOIN edge ON src = id WHERE depth < 10),
ranked AS (SELECT s.id, min(depth) AS depth FROM seen s JOIN node USING (id) WHERE ok GROUP BY s.id ORDER BY depth, s.id LIMIT 20) SELECT count(*) AS pages, CAST(max(depth) AS BIGINT) AS deepest FROM ranked""",
    "sitemap_urls": "SELECT page_id, unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT)]) AS seq, url FROM pages WHERE page_id % 6 < 4",
}
