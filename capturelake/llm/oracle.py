"""DuckDB SQL of those corpus queries that SQL can express and finish on whole tables.

None: op2 (a trained network), op5 and op6 (a tokenizer's merges), op10 (CRC-32 and sample statistics), the pipeline.
"""

from __future__ import annotations

from .licenses import CUE, LEAST, PHRASES, RARE, TEMPLATES
from .urls import CONFIDENCE, RULES, SUPPORT

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g FROM w, unnest(range(1, greatest(2, len(ws) - 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON e.x = r.other)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP4 = f"""WITH w AS (SELECT doc_id, {_SPACE_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
phrase AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS p FROM w, unnest(range(1, greatest(1, len(ws) - 11))) AS t(i)),
again AS (SELECT doc_id, i FROM phrase QUALIFY min(doc_id) OVER (PARTITION BY p) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM again) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id)"""

OP7 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other),
parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT p.vec_id, (SELECT count(*) FROM links WHERE x = p.vec_id) AS n_links, component_id, p.vec_id = component_id AS kept FROM parts p"""


def _op3() -> str:
    after = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    longest = sorted(RULES, key=lambda r: (-len(r.site), r.site))
    fits = []
    for r in longest:
        name, _, rest = r.site.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", r))
    rule = " ".join(f"WHEN {c} THEN '{r.site}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    return rf"""WITH after AS (SELECT page_id, coalesce(url, '') AS url, coalesce({after}, '') AS rest FROM pages),
parts AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS given,
  list_sort(list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda t: 'h:' || t), list_transform(string_split(path, '/'), lambda t: 'p:' || regexp_replace(t, '[0-9]+', '0', 'g')),
    list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda t: 'q:' || regexp_extract(t, '^[^=]*'))), lambda t: length(t) > 2))) AS tokens FROM parts),
known AS (SELECT page_id, tokens, given FROM ruled WHERE given IS NOT NULL AND len(tokens) > 0),
subsets AS (SELECT page_id, given, list_filter(tokens, lambda t, i: ((mask >> CAST(i - 1 AS BIGINT)) & 1) = 1) AS own FROM known, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS m(mask)),
counted AS (SELECT own, given, count(*) AS n FROM subsets GROUP BY ALL),
found AS (SELECT own, given, n / sum(n) OVER (PARTITION BY own) AS confidence, n FROM counted QUALIFY n >= ceil({SUPPORT} * (SELECT count(*) FROM known)) AND n / sum(n) OVER (PARTITION BY own) >= {CONFIDENCE}),
mined AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.given = f.given AND len(g.own) = len(f.own) - 1 AND list_has_all(f.own, g.own) AND g.confidence >= f.confidence)),
learnt AS (SELECT u.tokens, max_by(m.given, {{'c': m.confidence, 'b': m.given = 'block'}}) AS verdict FROM (SELECT DISTINCT tokens FROM ruled WHERE given IS NULL) u JOIN mined m ON list_has_all(u.tokens, m.own) GROUP BY u.tokens)
SELECT page_id, host, path, rule, coalesce(given, l.verdict, 'allow') AS verdict FROM ruled LEFT JOIN learnt l USING (tokens)"""


OP8 = r"""WITH RECURSIVE originals_of AS (SELECT conv_id, turn, min(text) AS original FROM conversations WHERE trim(text, ' ') <> '' GROUP BY ALL),
kinds AS (SELECT *, (strpos('0123456789abcdef', substr(md5(concat_ws('/', conv_id, turn)), 1, 1)) - 1) % 4 AS kind FROM conversations),
mail AS (SELECT k.conv_id, k.turn, k.role, CASE WHEN original IS NULL THEN text ELSE mark || replace(original, chr(10), chr(10) || mark) || chr(10) || text END AS text
  FROM (SELECT *, CASE kind WHEN 0 THEN '> ' ELSE '>> ' END AS mark, CASE WHEN text IS NOT NULL THEN turn - CASE kind WHEN 0 THEN 2 WHEN 1 THEN 4 END END AS target FROM kinds) k
  LEFT JOIN originals_of o ON o.conv_id = k.conv_id AND o.turn = k.target),
m AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS mid, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM mail),
lines AS (SELECT mid, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw FROM (SELECT mid, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM m)),
marked AS (SELECT mid, line, raw, regexp_extract(raw, '^((?:[ \t]*>)+)', 1) AS mark FROM lines),
levels AS (SELECT mid, line, length(mark) - length(replace(mark, '>', '')) AS level, CASE WHEN mark = '' THEN raw ELSE ltrim(substr(raw, length(mark) + 1), ' ') END AS body FROM marked),
turns AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY mid ORDER BY line) = level THEN 0 ELSE 1 END AS turned FROM levels),
runs AS (SELECT *, sum(turned) OVER (PARTITION BY mid ORDER BY line ROWS UNBOUNDED PRECEDING) AS part FROM turns),
parts AS (SELECT mid, part, level, string_agg(body, chr(10) ORDER BY line) AS body FROM runs GROUP BY mid, part, level),
norms AS (SELECT DISTINCT mid, level, trim(regexp_replace(lower(b), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM (SELECT mid, level, body AS b FROM parts UNION ALL SELECT mid, level, body FROM levels)),
units AS (SELECT u.*, conv_id, place FROM norms u JOIN m USING (mid) WHERE norm <> ''),
originals AS (SELECT conv_id, level, norm, min(place) AS first FROM units GROUP BY ALL),
votes AS (SELECT u.mid, u.level, o.conv_id, o.first, sum(length(u.norm)) AS weight FROM units u JOIN originals o ON o.conv_id IS NOT DISTINCT FROM u.conv_id AND o.level = u.level - 1 AND u.level >= 1 AND o.norm = u.norm WHERE o.first < u.place GROUP BY ALL),
linked AS (SELECT mid, first FROM votes QUALIFY row_number() OVER (PARTITION BY mid ORDER BY level, weight DESC, first DESC) = 1),
tree AS (SELECT m.*, l.first AS linked, CASE WHEN place > 1 THEN coalesce(l.first, place - 1) END AS parent FROM m LEFT JOIN linked l USING (mid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY parent = place - 1 DESC, place) = 1 AS goes_on FROM tree),
walk(conv_id, place, prefix) AS (SELECT conv_id, place, CAST([] AS BIGINT[]) FROM ranked WHERE parent IS NULL
  UNION ALL SELECT c.conv_id, c.place, CASE WHEN c.goes_on THEN w.prefix ELSE list_concat(w.prefix, [c.parent, c.place]) END FROM walk w JOIN ranked c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.parent = w.place),
bodies AS (SELECT mid, string_agg(body, chr(10) ORDER BY part) AS body FROM parts WHERE level = 0 GROUP BY mid)
SELECT t.conv_id, t.turn, t.role, p.turn AS reply_to, t.linked IS NOT NULL AS linked, row_number() OVER (PARTITION BY t.conv_id ORDER BY list_append(w.prefix, t.place)) AS position,
  trim(coalesce(b.body, ''), ' ') AS body, '<|' || coalesce(t.role, 'user') || '|>' || chr(10) || trim(coalesce(b.body, ''), ' ') || '<|end|>' || chr(10) AS formatted
FROM tree t JOIN walk w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.place = t.place LEFT JOIN tree p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.place = t.parent LEFT JOIN bodies b ON b.mid = t.mid"""


def _op9() -> str:
    places = ", ".join(f"({k}, '{t.label}', '{w}', {p})" for k, t in enumerate(TEMPLATES) for p, w in enumerate(t.words()))
    stands = lambda at, phrase: f"list_slice(ws, {at} + 1, {at} + {len(phrase)}) = [{', '.join(map(_quoted, phrase))}]"
    base = " UNION ALL ".join(f"SELECT doc_id, CAST(i AS BIGINT) AS place, '{label}' AS label FROM w, unnest(range(0, len(ws))) AS t(i) WHERE {stands('i', p.split(' '))}" for p, label in PHRASES.items())
    keys = []
    for k, t in enumerate(TEMPLATES):
        own, tests = t.words(), []
        for key in t.keys:
            phrase = key.split(" ")
            at = next(p for p in range(len(own)) if own[p : p + len(phrase)] == phrase)
            tests.append(f"off + {at} >= 0 AND {stands(f'off + {at}', phrase)}")
        keys.append(f"(template = {k} AND {' AND '.join(tests)})")
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, regexp_matches(coalesce(text, ''), '{CUE}') AS cued FROM documents),
spots(template, label, word, place) AS (VALUES {places}),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(ws) AS word FROM w) WHERE word IN (SELECT word FROM spots) GROUP BY word),
weighed AS (SELECT s.*, ln(((SELECT count(*) FROM documents) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS weight FROM spots s LEFT JOIN df USING (word)),
chosen AS (SELECT template, word FROM (SELECT DISTINCT template, word, weight FROM weighed) QUALIFY row_number() OVER (PARTITION BY template ORDER BY weight DESC, word) <= {RARE}),
kept AS (SELECT g.*, sum(weight) OVER (PARTITION BY template) AS total FROM weighed g JOIN chosen USING (template, word)),
hits AS (SELECT doc_id, ws, i AS at, ws[i + 1] AS word FROM w, unnest(range(0, len(ws))) AS t(i) WHERE cued),
aligned AS (SELECT h.doc_id, h.ws, k.template, k.label, h.at - k.place AS off, sum(weight) / max(total) AS share FROM hits h JOIN kept k USING (word) GROUP BY ALL),
verified AS (SELECT doc_id, label, least(share, 1.0) AS share FROM aligned WHERE least(share, 1.0) >= {LEAST} AND ({' OR '.join(keys)})),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
v AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM verified GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, array_to_string(coalesce(b.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(v.labels, [])))), ',') AS labels, round(greatest(coalesce(v.share, 0.0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END), 6) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id)"""


ORACLE: dict[str, str] = {"op1_minhash": OP1, "op3_urls": _op3(), "op4_substring": OP4, "op7_embedding": OP7, "op8_chat": OP8, "op9_licenses": _op9()}
