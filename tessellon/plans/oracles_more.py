"""Further queries of the catalog in DuckDB's SQL: assembly, intake, files, gates and search."""

from __future__ import annotations

from tessellon.operators.gates import RULES
from tessellon.plans.oracles import _CHUNKS, _D2, _HITS, _MAIL, _PAIRS, _SCORED, _STOPS, ORACLES, _capped, _feed, _final, _grade, _host, _strip, _terms, _tokens, _words

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::UHUGEINT), lambda s, c: (xor(s, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981037567433372::UHUGEINT)"


def _embedded(table: str, key: str) -> str:
    """Rows key, idx and value of a table's hashed texts."""
    return f"""SELECT {key}, idx, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM (
  SELECT {key}, CAST(h % 768 AS BIGINT) AS idx, sum(CASE WHEN h % 2 = 0 THEN n ELSE -n END)::DOUBLE AS v FROM (
    SELECT {key}, n, {_FNV.format('term')} AS h FROM (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest({_terms('text')}) AS term FROM {table}) GROUP BY ALL)) GROUP BY ALL HAVING v <> 0)"""


_MARKS = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE length(text) > 0),
cum AS (SELECT doc_id, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM ln),
marks AS (SELECT doc_id, list_concat([0::HUGEINT], list(upto ORDER BY k)) AS bounds FROM cum GROUP BY doc_id)"""

_METRICS = f"""c AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1),
m AS (
  SELECT 'n_docs' AS metric, CAST(count(*) AS DOUBLE) AS v FROM documents UNION ALL SELECT 'english', count(*) FILTER (WHERE lang = 'en') / greatest(count(*), 1) FROM documents UNION ALL SELECT 'unique_ids', CAST(count(*) = count(DISTINCT doc_id) AS INTEGER) FROM documents
  UNION ALL SELECT 'domains', count(DISTINCT source) FROM documents UNION ALL SELECT 'dup_rate', coalesce(sum(n) FILTER (WHERE n > 1), 0) / greatest(sum(n), 1) FROM c UNION ALL SELECT 'required', count(*) FILTER (WHERE quality = 1) / greatest(count(*), 1) FROM labels
  UNION ALL SELECT 'allowlisted', count(*) FILTER (WHERE h = 'example.com' OR ends_with(h, '.example.com')) / greatest(count(*), 1) FROM (SELECT regexp_replace({_host('url')}, ':[0-9]*$', '') AS h FROM pages)
  UNION ALL SELECT 'too_short', count(*) FILTER (WHERE length(html) < 50) FROM pages UNION ALL SELECT 'too_long', count(*) FILTER (WHERE length(text) > 1000000) FROM documents)"""


def _number(x: float | None) -> str:
    return "NULL::DOUBLE" if x is None else f"{float(x)!r}::DOUBLE"


_RULE_ROWS = ", ".join(f"('{r.gate}', '{r.id}', '{r.metric}', {_number(r.low)}, {_number(r.high)}, {_number(r.warn_low)}, {_number(r.warn_high)})" for r in RULES)


def _first_words(x: str, k: int, first: int = 1) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')[{first}:{k}], ' ')"


def _mail_flags() -> str:
    return rf"""list_filter([CASE WHEN trim(coalesce(unsub, '')) = '' THEN 'MISSING_UNSUBSCRIBE' END, CASE WHEN trim(coalesce(company, '')) = '' THEN 'MISSING_COMPANY_INFO' END,
  CASE WHEN regexp_matches(body, '(?i)(^|[^\p{{L}}\p{{N}}_])([0-9]+%[\p{{L}}\p{{N}}_]|(double|guarantee|always|never)([^\p{{L}}\p{{N}}_]|$))') THEN 'UNCITED_CLAIM' END,
  CASE WHEN len(list_filter(['guaranteed', 'free money', 'no strings attached', 'risk-free', '100% safe'], lambda k: contains(lower(body), k))) > 0 THEN 'PROHIBITED_PHRASE' END], lambda x: x IS NOT NULL) AS critical,
list_filter([CASE WHEN {_words('body')} > 160 THEN 'EXCESS_LENGTH' END, CASE WHEN {_grade('body')} > 10 THEN 'READABILITY' END], lambda x: x IS NOT NULL) AS warning"""


def _mail_round(before: str, k: int) -> str:
    """One round of checks and edits: CTEs f{k} (flags), a{k} to c{k} (edits) and r{k} (the mail after them)."""
    bullet = "starts_with(ltrim(x), '- ')"
    split = "string_split(body, chr(10))"
    long = f"list_concat(list_filter({split}, lambda x: NOT {bullet}), list_transform(list_filter({split}, lambda x: {bullet})[1:3], lambda x: {_first_words('x', 18)}))"
    short = f"list_transform(list_filter({split}, lambda x: trim(x) <> ''), lambda x: CASE WHEN {bullet} THEN {_first_words('x', 10)} ELSE {_first_words('x', 12)} END)"
    has = lambda kind, flag: f"list_contains({kind}, '{flag}')"
    return f"""f{k} AS (SELECT *, {_mail_flags()} FROM {before}),
a{k} AS (SELECT * REPLACE (CASE WHEN {has('critical', 'PROHIBITED_PHRASE')} THEN replace(replace(replace(body, 'guaranteed', 'designed to'), 'free money', 'budget savings'), 'no strings attached', 'no additional commitment') ELSE body END AS body) FROM f{k}),
b{k} AS (SELECT * REPLACE (CASE WHEN {has('critical', 'UNCITED_CLAIM')} THEN body || chr(10) || '(Reference: First card)' ELSE body END AS body) FROM a{k}),
c{k} AS (SELECT * REPLACE (CASE WHEN {has('warning', 'EXCESS_LENGTH')} THEN array_to_string({long}, chr(10)) ELSE body END AS body) FROM b{k}),
r{k} AS (SELECT conv_id, turn, CASE WHEN {has('warning', 'READABILITY')} THEN array_to_string({short}, chr(10)) ELSE body END AS body,
  CASE WHEN {has('critical', 'MISSING_UNSUBSCRIBE')} THEN 'You can unsubscribe at any time by replying ''unsubscribe''.' ELSE unsub END AS unsub,
  CASE WHEN {has('critical', 'MISSING_COMPANY_INFO')} THEN 'Sent by ACME AI, 123 Market St, San Francisco, CA.' ELSE company END AS company FROM c{k})"""


def _mail_shorter(before: str, k: int) -> str:
    bullet = "starts_with(ltrim(x), '- ')"
    split = "string_split(body, chr(10))"
    heads = f"list_filter(list_transform(list_filter({split}, lambda x: NOT {bullet}), lambda x: {_first_words('x', 10)}), lambda x: x <> '')"
    bullets = f"list_transform(list_filter({split}, lambda x: {bullet})[1:3], lambda x: '- ' || {_first_words('x', 9, 2)})"
    return f"s{k} AS (SELECT * REPLACE (CASE WHEN {_grade('body')} > 10 OR {_words('body')} > 160 THEN array_to_string(list_concat({heads}, {bullets}), chr(10)) ELSE body END AS body) FROM {before})"


# The gates' tables: pages as sidecars, documents as normalised ones, their windows as chunks.
_GATE_TABLES = f"""{_CHUNKS}, {_MARKS},
raw AS (SELECT ['sec', 'investor_news', 'newsroom', 'newsroom', 'product', 'dev_docs', 'help_docs', 'wikipedia'][page_id % 8 + 1] AS bucket, CASE page_id % 8 WHEN 2 THEN 'x; feed=corporate' WHEN 3 THEN 'feed=product' END AS notes,
  CASE WHEN page_id % 40 = 7 THEN 404 ELSE 200 END AS code, CASE WHEN page_id % 9 = 4 THEN 'same' WHEN page_id % 9 <> 5 THEN sha256(html) END AS digest,
  DATE '2025-09-08' - CASE WHEN page_id % 7 > 0 THEN CAST(page_id * 13 % 1500 AS INTEGER) WHEN page_id % 2 = 0 THEN 100 END AS day FROM pages),
gd AS (SELECT doc_id, ['press', '10-K', 'product', 'wiki'][doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 17 > 0 THEN 'Title ' || doc_id ELSE ' ' END AS title,
  CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN '2031-01-01' WHEN 2 THEN 'soon' ELSE CAST(DATE '2025-09-08' - CAST(doc_id % 1200 AS INTEGER) AS VARCHAR) END AS day,
  contains(text, 'a') AS topical, doc_id % 50 > 0 AS tagged, doc_id % 50 > 0 AND doc_id % 3 > 0 AS personal, lang, source, length(text) AS len, {_words('text')} AS words, {_tokens('text')} AS tokens, trim(text) <> '' AS filled FROM documents),
ck AS (SELECT doc_id, seq_no, text, {_tokens('text')} AS tok, {_words('text')} AS cw, start_char, seq_no = max(seq_no) OVER (PARTITION BY doc_id) AS tail FROM ch),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq_no) AS rn FROM ck QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, seq_no) = 1),
adj AS (SELECT CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM (
  SELECT list_distinct(CASE WHEN len(w) > 120 THEN w[1:len(w) - 120] ELSE w END) AS a, list_distinct(CASE WHEN len(w2) > 120 THEN w2[121:] ELSE w2 END) AS b FROM (
    SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY seq_no) AS w2 FROM (SELECT doc_id, seq_no, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains({_STOPS}, x)) AS w FROM ch)) WHERE w2 IS NOT NULL)),
kw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq_no) AS rn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM kept),
far AS (SELECT CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS j FROM kw a JOIN kw b ON a.doc_id = b.doc_id AND b.rn >= a.rn + 2),
near AS (SELECT list_min(list_transform(bounds, lambda b: abs(b - start_char))) AS delta FROM ck JOIN marks USING (doc_id) WHERE doc_id % 4 = 1),
norms AS (SELECT sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)) AS norm, len(embedding) AS dim FROM embeddings),
hinge AS (SELECT list_aggregate(l, 'median') AS med, list_aggregate(l[len(l) - len(l) // 2 + 1:], 'median') - list_aggregate(l[1:len(l) // 2], 'median') AS iqr FROM (SELECT list_sort(list(norm)) AS l FROM norms)),
{_HITS}, asked AS (SELECT query_id, count(*) FILTER (WHERE text <> '') AS texts, max(contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 're')::INT + contains(lower(coalesce(text, '')), 'zzz')::INT) AS held
  FROM hits LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 10 GROUP BY 1)"""

_OLD = "(DATE '2025-09-08' - try_cast(day AS DATE))"
_GATE_METRICS = f"""m AS (
  SELECT unnest(['sec_docs', 'ir_docs', 'newsroom_docs', 'least_feed', 'other_docs', 'http_ok', 'within_12mo', 'within_24mo']) AS metric, unnest([
    count(*) FILTER (WHERE bucket = 'sec'), count(*) FILTER (WHERE bucket = 'investor_news'), count(*) FILTER (WHERE bucket = 'newsroom'), least(count(*) FILTER (WHERE contains(notes, 'feed=corporate')), count(*) FILTER (WHERE contains(notes, 'feed=product'))),
    count(*) FILTER (WHERE bucket IN ('product', 'dev_docs', 'help_docs', 'wikipedia')), count(*) FILTER (WHERE code = 200) / greatest(1, count(*)),
    count(*) FILTER (WHERE bucket = 'newsroom' AND DATE '2025-09-08' - day <= 365) / greatest(1, count(*) FILTER (WHERE bucket = 'newsroom' AND day IS NOT NULL)),
    count(*) FILTER (WHERE bucket = 'newsroom' AND DATE '2025-09-08' - day <= 730) / greatest(1, count(*) FILTER (WHERE bucket = 'newsroom' AND day IS NOT NULL))]::DOUBLE[]) AS v FROM raw
  UNION ALL SELECT 'dup_rate', coalesce(sum(n) FILTER (WHERE n > 1 AND digest IS NOT NULL), 0) / greatest(1, sum(n)) FROM (SELECT digest, count(*) AS n FROM raw GROUP BY 1)
  UNION ALL SELECT unnest(['coverage', 'english', 'too_short', 'press_retention_gap', 'headings', 'page_map_missing', 'required', 'span_coverage', 'topic', 'persona', 'unique_ids', 'invalid_dates', 'n_docs', 'dated', 'n_seeds', 'chunks_per_doc', 'domains']), unnest([
    count(*) / (count(*) + 6), count(*) FILTER (WHERE lang = 'en') / greatest(1, count(*)), count(*) FILTER (WHERE words < CASE kind WHEN 'press' THEN 200 WHEN '10-K' THEN 540 ELSE 240 END),
    median(CASE WHEN kind = 'press' THEN CASE WHEN len + doc_id % 50 > 0 THEN len / (len + doc_id % 50) ELSE 1 END END) - 0.99::DOUBLE, count(*) FILTER (WHERE doc_id % 8 > 0) / greatest(1, count(*)), count(*) FILTER (WHERE doc_id % 10 = 0 AND doc_id % 20 <> 0),
    count(*) FILTER (WHERE title <> ' ' AND day <> '' AND topical AND tagged AND filled) / greatest(1, count(*)), median(CASE WHEN kind = '10-K' THEN doc_id % 100 / 100 END), count(*) FILTER (WHERE topical) / greatest(1, count(*)), count(*) FILTER (WHERE personal) / greatest(1, count(*)),
    (count(*) = count(DISTINCT doc_id))::INT, count(*) FILTER (WHERE day <> '' AND NOT coalesce(try_cast(day AS DATE) BETWEEN DATE '1999-01-01' AND DATE '2025-09-08', false)),
    count(*) FILTER (WHERE day <> ''), count(*) FILTER (WHERE day <> '') / greatest(1, count(*)), (SELECT count(*) FROM labels), (SELECT count(*) FROM ck) / count(*) FILTER (WHERE day <> ''), count(DISTINCT source)]::DOUBLE[]) FROM gd
  UNION ALL SELECT 'count_ok', count(*) FILTER (WHERE expected > 0 AND n >= floor(0.6::DOUBLE * expected) AND n <= ceil(1.6::DOUBLE * expected)) / greatest(1, count(*)) FROM (SELECT ceil(tokens / 680) AS expected, coalesce(n, 0) AS n FROM gd LEFT JOIN (SELECT doc_id, count(*) AS n FROM ck GROUP BY 1) USING (doc_id))
  UNION ALL SELECT 'press_envelope', count(*) FILTER (WHERE tok <= 900 AND (tail OR tok >= 500)) / count(*) FROM ck WHERE doc_id % 4 = 0
  UNION ALL SELECT 'adjacent_jaccard', coalesce(median(j), 0) FROM adj UNION ALL SELECT 'alignment', count(*) FILTER (WHERE delta <= 50) / count(*) FROM near
  UNION ALL SELECT 'dup_ratio', (SELECT count(*) FROM ck) / greatest(1, (SELECT count(*) FROM ck)) - (SELECT count(*) FROM kept) / greatest(1, (SELECT count(*) FROM ck))
  UNION ALL SELECT 'distant_p95', coalesce(list_sort(list(j))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS BIGINT) + 1], 0) FROM far
  UNION ALL SELECT 'kept_coverage', median(CASE WHEN words > 0 THEN coalesce(w, 0) / words ELSE 1 END) FROM gd LEFT JOIN (SELECT doc_id, sum(cw) AS w FROM kept GROUP BY 1) USING (doc_id)
  UNION ALL SELECT unnest(['embedded', 'dim_ok', 'zero_vectors', 'bad_values', 'outlier_share', 'indexed', 'round_trip_error']), unnest([1, (count(*) FILTER (WHERE dim <> 64) = 0)::INT, count(*) FILTER (WHERE norm = 0), count(*) FILTER (WHERE isnan(norm)), count(*) FILTER (WHERE abs(norm - med) > 4 * iqr) / greatest(1, count(*)), 1, 0]::DOUBLE[]) FROM norms, hinge
  UNION ALL SELECT 'missing_fields', count(*) FILTER (WHERE NOT coalesce(title <> ' ' AND day <> '', false)) / greatest(1, count(*)) FROM embeddings LEFT JOIN gd ON doc_id = vec_id
  UNION ALL SELECT 'least_hits', min(texts) FROM asked UNION ALL SELECT 'least_keywords', min(held) FROM asked
  UNION ALL SELECT 'pinecone_rate', 1)"""

_STATES = """g AS (SELECT gate, count(*) FILTER (WHERE status = 'FAIL') AS fails, count(*) FILTER (WHERE status = 'WARN') AS warns, count(*) FILTER (WHERE status = 'FAIL' AND abs(v - bound) <= 0.1::DOUBLE * abs(bound)) AS near, count(*) FILTER (WHERE status = 'FAIL' AND ends_with(id, '-01')) AS head,
  count(*) FILTER (WHERE id IN ('G2-01', 'G2-02', 'G2-03', 'G2-04') AND status <> 'PASS') AS missed, count(*) FILTER (WHERE id IN ('G2-01', 'G2-02', 'G2-03', 'G2-04') AND status = 'WARN') AS closely,
  count(*) FILTER (WHERE id = 'G2-05' AND status <> 'PASS') AS fifth, count(*) FILTER (WHERE id = 'G2-06' AND status = 'WARN') AS sixth FROM s GROUP BY gate),
st AS (SELECT gate, fails, warns, CASE WHEN starts_with(gate, 'G') THEN CASE WHEN fails > 0 THEN 'FAIL' ELSE 'PASS' END
  WHEN gate = 'S2' THEN CASE WHEN fails + warns = 0 THEN 'GREEN' WHEN missed = 1 AND closely = 1 OR missed = 0 AND fifth = 0 AND sixth = 1 THEN 'AMBER' ELSE 'RED' END
  WHEN fails = 1 AND ((gate = 'S0' AND near = 1) OR (gate = 'S7' AND head = 0)) THEN 'AMBER' WHEN fails > 0 THEN 'RED' WHEN warns > 0 THEN 'AMBER' ELSE 'GREEN' END AS status FROM g)"""
_JUDGED = f"""r(gate, id, metric, low, high, warn_low, warn_high) AS (VALUES {_RULE_ROWS}),
s AS (SELECT gate, id, metric, v, coalesce(low, high) AS bound, CASE WHEN v IS NULL THEN 'FAIL' WHEN (low IS NULL OR v >= low) AND (high IS NULL OR v <= high) THEN 'PASS'
  WHEN (warn_low IS NOT NULL OR warn_high IS NOT NULL) AND (warn_low IS NULL OR v >= warn_low) AND (warn_high IS NULL OR v <= warn_high) THEN 'WARN' ELSE 'FAIL' END AS status FROM r LEFT JOIN m USING (metric)),
{_STATES}"""



def _clean(x: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '')"


def _day_of(x: str) -> str:
    """Days of ISO texts: the only ones that pages hold."""
    return f"try_cast(nullif(regexp_extract({x}, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})(?:$|[T ].*)', 1), '') AS DATE)"


def _tag_value(tag: str, has: str, take: str) -> str:
    tags = f"list_filter(regexp_extract_all(html, '(?is)<{tag}\\b[^>]*>'), lambda t: regexp_matches(t, '(?is){has}'))"
    return f"""nullif(regexp_extract({tags}[1], '(?is)\\b{take}=["'']([^"'']+)["'']', 1), '')"""


def _merge(before: str, state: str, ranks: str, place: int) -> str:
    """A further backend's hits for queries whose first five hits hold fewer than three domains."""
    return f"""few{place} AS (SELECT query_id FROM {state} WHERE out_rank <= 5 GROUP BY 1 HAVING count(DISTINCT domain) < 3),
more{place} AS (SELECT * FROM {before} UNION ALL SELECT query_id, chunk_id, in_rank, score, day, domain, {place} AS source FROM scored WHERE {ranks} AND query_id IN (SELECT query_id FROM few{place})),
pool{place} AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY source, in_rank) AS in_rank, score, day, domain, source FROM (SELECT * FROM more{place} QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source, in_rank) = 1)),
state{place} AS ({_capped(f"({_final(f'pool{place}', (0.6, 0.3, 0.1))})", 5)})"""


_BUILT = rf"""clean AS (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t, doc_id % 3 > 0 AS whole, doc_id % 4 = 0 AS spared FROM documents),
b AS (SELECT *, CASE WHEN whole THEN 'H1: One' || CASE WHEN t <> '' THEN ' ' || t ELSE '' END || ' H2: Two more' ELSE trim('Page ' || doc_id || ' ' || t || CASE WHEN spared THEN ' side' ELSE '' END) END AS page FROM clean),
n AS (SELECT *, CASE WHEN page <> '' AND NOT contains(page, 'H1:') THEN 'H1: Page ' || doc_id || chr(10) || chr(10) || page ELSE page END AS text FROM b)"""

MORE: dict[str, str] = {
    "page_titles": f"""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:title["''][^>]+content=["''](.*?)["'']', 1)), ''), {_clean("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, {_clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
  coalesce(nullif(trim(regexp_extract(html, '(?i)<meta[^>]+property="og:title"[^>]+content="(.*?)"', 1)), ''), {_clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS meta_title,
  nullif(trim(regexp_extract(html, '(?i)<meta[^>]+(?:name|property)="(?:article:published_time|pubdate|date|dc\\.date)"[^>]+content="(.*?)"', 1)), '') AS meta_time,
  coalesce({', '.join(_day_of(f"""regexp_extract(html, '(?i)<meta[^>]+{a}=["'']{v}["''][^>]+content=["''](.*?)["'']', 1)""") for a, v in (('property', 'article:published_time'), ('name', 'pubdate'), ('name', 'date'), ('itemprop', 'datePublished')))}, {_day_of("regexp_extract(html, '(?i)<time[^>]+datetime=" + '"(.*?)"' + "', 1)")},
    try_strptime(regexp_extract(html, '([A-Z][a-z]+\\s+\\d{{1,2}},\\s+\\d{{4}})', 1), '%B %-d, %Y')::DATE) AS day,
  {_strip('url')} AS canonical
FROM (SELECT page_id, html, coalesce({_tag_value('link', '''\\brel=["''][^"'']*canonical''', 'href')}, {_tag_value('meta', '''\\bproperty=["'']og:url["'']''', 'content')}, nullif(trim(regexp_extract(html, '(?is)\\bdata-(?:canonical|share)-url=["'']([^"'']+)["'']', 1)), '')) AS url FROM pages)""",
    "page_documents": rf"""WITH a AS (SELECT page_id, url, {_clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS html_title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT *, regexp_replace(replace(replace(replace(body, '<h1>', chr(10) || 'H1: '), '<h2>', chr(10) || 'H2: '), '<h3>', chr(10) || 'H3: '), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, html_title, {_host('url')} AS source_domain, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '{_SPACE}', ' ', 'g')) AS text FROM b)
SELECT page_id, html_title, source_domain, {_words('text')} AS word_count, {_tokens('text')} AS token_count, sha256(text) AS hash_sha256, left(text, 200) AS head FROM c""",
    "heading_windows": f"""WITH RECURSIVE {_MARKS},
s AS (SELECT d.doc_id, length(text)::BIGINT AS n, bounds, 0::BIGINT AS pos, 0 AS i FROM documents d JOIN marks USING (doc_id)
  UNION ALL SELECT doc_id, n, bounds, coalesce(list_sort(list_transform(list_filter(bounds, lambda b: b > pos AND abs(b - (pos + 680)) <= 50), lambda b: {{'gap': abs(b - (pos + 680)), 'b': b}}))[1].b, pos + 680)::BIGINT, i + 1 FROM s WHERE pos + 800 < n)
SELECT doc_id, count(*) AS windows, string_agg(pos::VARCHAR, ',' ORDER BY i) AS starts FROM s GROUP BY doc_id""",
    "hash_embed_sparse": f"SELECT item_id, idx, round(value, 6) AS value FROM ({_embedded('benchmark', 'item_id')})",
    "lexvec_search": rf"""WITH d AS (SELECT doc_id AS id, idx, value FROM ({_embedded('documents', 'doc_id')})), q AS (SELECT item_id AS query_id, idx, value AS qv FROM ({_embedded('benchmark', 'item_id')})),
near AS (SELECT query_id, id, round(2 - 2 * sum(value * qv), 9) AS d2 FROM d JOIN q USING (idx) GROUP BY ALL),
hits AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, id) <= 100),
dt AS (SELECT doc_id AS id, list_distinct({_terms(r"left(trim(regexp_replace(text, '\s+', ' ', 'g')), 280)")}) AS t FROM documents), qt AS (SELECT item_id AS query_id, list_distinct({_terms('text')}) AS w FROM benchmark),
scored AS (SELECT query_id, id, d2, 0.7::DOUBLE / (1 + d2) + 0.3::DOUBLE * CASE WHEN len(w) > 0 THEN len(list_intersect(w, t)) / len(w) ELSE 0 END AS score FROM hits JOIN dt USING (id) JOIN qt USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d2, id) AS rank FROM scored)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10""",
    "diversity_merge": f"""WITH {_SCORED},
pool0 AS (SELECT query_id, chunk_id, in_rank, score, day, domain, 0 AS source FROM scored WHERE in_rank <= 4), state0 AS ({_capped(f"({_final('pool0', (0.6, 0.3, 0.1))})", 5)}),
{_merge('pool0', 'state0', 'in_rank BETWEEN 5 AND 12', 1)},
{_merge('pool1', 'state1', 'in_rank <= 30', 2)}
SELECT query_id, chunk_id, CAST(source AS BIGINT) AS source, out_rank FROM state2""",
    "gate_states": f"WITH {_METRICS}, {_JUDGED} SELECT gate, fails, warns, status FROM st",
    "gate_report": f"WITH {_GATE_TABLES}, {_GATE_METRICS}, {_JUDGED} SELECT gate, id, metric, round(v, 6) AS actual, s.status, st.status AS gate_status FROM s JOIN st USING (gate) WHERE gate IN ('G01', 'G02', 'G03', 'G04', 'G05', 'S0', 'S1', 'S2')",
    "chunk_assembly": rf"""WITH {_CHUNKS},
every AS (SELECT doc_id, seq_no, start_char, end_char, text FROM ch UNION ALL SELECT doc_id, 0, 0, 0, '' FROM documents WHERE length(text) = 0),
titled AS (SELECT e.doc_id, seq_no, start_char, end_char, trim(split_part(d.text, chr(10), 1)) AS title, regexp_replace(e.text, '\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM every e JOIN documents d USING (doc_id)),
t AS (SELECT *, CASE WHEN title <> '' THEN regexp_replace(title || chr(10) || chr(10) || body, '^{_SPACE}|{_SPACE}$', '', 'g') ELSE body END AS text FROM titled)
SELECT doc_id || '::chunk' || lpad(seq_no::VARCHAR, 4, '0') AS chunk_id, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST({_words('text')} AS INTEGER) AS word_count, CAST({_tokens('text')} AS INTEGER) AS token_count, 0 AS heads, md5(text) AS digest, 'u' AS url FROM t""",
    "doctype_baselines": f"""SELECT source AS doctype, count(*) AS docs, CAST(floor(median(w)) AS BIGINT) AS median_words, CAST(floor(median(t)) AS BIGINT) AS median_tokens FROM (
SELECT source, {_words('text')} AS w, {_tokens('text')} AS t FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) GROUP BY 1""",
    "chunk_size_envelope": f"""WITH {_CHUNKS}, f AS (SELECT source, floor(median(t)) AS md FROM (SELECT source, {_tokens('text')} AS t FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) GROUP BY 1),
k AS (SELECT source, {_tokens('ch.text')} AS tok, seq_no = max(seq_no) OVER (PARTITION BY ch.doc_id) AS tail, CASE WHEN md BETWEEN 1 AND 1600 THEN md ELSE 800 END AS mid FROM ch JOIN documents USING (doc_id) JOIN f USING (source))
SELECT source AS doctype, count(*) AS chunks, round(count(*) FILTER (WHERE tok <= mid + 800 AND (tail OR tok >= greatest(350, mid - 800))) / count(*), 6) AS share FROM k GROUP BY 1""",
    "chunk_ends": f"""WITH {_CHUNKS}, e AS (SELECT {_tokens('text')} AS tok, seq_no = min(seq_no) OVER w AS is_first, seq_no = max(seq_no) OVER w AS is_last FROM ch WINDOW w AS (PARTITION BY doc_id))
SELECT is_first, is_last, count(*) AS chunks, CAST(sum(tok) AS BIGINT) AS tokens FROM e GROUP BY ALL""",
    "boundary_alignment": f"""WITH {_CHUNKS}, {_MARKS}, a AS (SELECT list_min(list_transform(bounds, lambda b: abs(b - start_char))) AS delta FROM ch JOIN marks USING (doc_id))
SELECT count(*) AS chunks, count(*) FILTER (WHERE delta <= 50) AS aligned, CAST(sum(delta) AS BIGINT) AS total_delta FROM a""",
    "chunk_local_heads": f"""WITH {_CHUNKS}, {_MARKS}, a AS (SELECT ch.doc_id, seq_no, len(list_filter(bounds, lambda b: b <= start_char)) AS n FROM ch JOIN marks USING (doc_id))
SELECT doc_id, seq_no, CASE WHEN n >= 2 THEN 'line ' || (n - 1) || '|line ' || (n - 2) ELSE 'line 0' END AS heads FROM a""",
    "near_pairs_exempt": f"WITH RECURSIVE {_PAIRS} SELECT id_a, id_b, round(jaccard, 6) AS jaccard FROM pairs JOIN documents a ON a.doc_id = id_a JOIN documents b ON b.doc_id = id_b WHERE a.source <> 'src1' AND b.source <> 'src1'",
    "largest_dup_groups": f"WITH RECURSIVE {_PAIRS} SELECT component, count(*) AS members FROM comp GROUP BY 1 ORDER BY members DESC, component LIMIT 5",
    "low_coverage_docs": f"""WITH {_CHUNKS}, kept AS (SELECT doc_id, {_words('text')} AS cw FROM ch QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, seq_no) = 1)
SELECT doc_id, coverage FROM (SELECT doc_id, round(coalesce(w, 0) / words, 6) AS coverage FROM (SELECT doc_id, {_words('text')} AS words FROM documents) LEFT JOIN (SELECT doc_id, sum(cw) AS w FROM kept GROUP BY 1) USING (doc_id) WHERE words > 0) WHERE coverage < 0.9 ORDER BY coverage, doc_id LIMIT 10""",
    "role_shares": "WITH s AS (SELECT v.value, count(c.role) AS n, count(c.role) / greatest((SELECT count(*) FROM conversations), 1) AS share FROM (VALUES ('user'), ('assistant'), ('nobody')) v(value) LEFT JOIN conversations c ON c.role = v.value GROUP BY 1) SELECT value, n, round(share, 6) AS share, round(min(share) OVER (), 6) AS least_share FROM s",
    "derived_thresholds": f"""WITH d AS (SELECT count(DISTINCT {_host('url')})::DOUBLE AS n FROM pages), a AS (SELECT list_sort(list(DATE '1998-12-01' - o_orderdate::DATE))[CAST(ceil(0.5::DOUBLE * count(*)) AS BIGINT)]::DOUBLE AS age FROM orders)
SELECT * FROM (SELECT 'S7' AS gate, 'G7-03' AS id, 'eval_domains' AS metric, round(greatest(3.0::DOUBLE, 0.75::DOUBLE * n / 10), 6) AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS warn_low, NULL::DOUBLE AS warn_high FROM d
UNION ALL SELECT 'S7', 'G7-04', 'eval_age', NULL, round(greatest(540.0::DOUBLE, age), 6), NULL, NULL FROM a UNION ALL SELECT 'S4', 'FRS-001', 'mean_age', NULL, greatest(365.0::DOUBLE, floor(age)), NULL, round(greatest(365.0::DOUBLE, floor(age)) * 1.1::DOUBLE, 6) FROM a
UNION ALL SELECT 'S3', 'G3-03-faiss', 'latency_faiss', NULL, 15.0, NULL, 16.5 UNION ALL SELECT 'S3', 'G3-03-pinecone', 'latency_pinecone', NULL, 1500.0, NULL, 1650.0)""",
    "least_keyword_hits": """WITH h AS (SELECT role AS backend, conv_id, lower(coalesce(text, '')) AS t FROM conversations WHERE turn + 1 <= 10),
q AS (SELECT b.backend, c.conv_id, count(h.t) FILTER (WHERE h.t <> '') AS texts, coalesce(max(contains(t, 'the')::INT + contains(t, 're')::INT + contains(t, 'tion')::INT + contains(t, 'zzz')::INT), 0) AS held
  FROM (SELECT DISTINCT role AS backend FROM conversations) b CROSS JOIN (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.backend = b.backend AND h.conv_id = c.conv_id GROUP BY ALL)
SELECT backend, min(texts) AS least_hits, min(held) AS least_keywords FROM q GROUP BY 1""",
    "soft_recall": f"""WITH {_HITS}, h AS (SELECT query_id, vec_id, label, rank, abs(vec_id % 50 - query_id % 50) AS gap FROM hits WHERE rank <= 10 AND vec_id <> query_id),
e AS (SELECT vec_id AS query_id, label AS own FROM embeddings WHERE vec_id % 20 = 0),
m AS (SELECT e.query_id, coalesce(bool_or(vec_id = e.query_id + 1), false) AS hit, coalesce(bool_or(label = own AND gap <= 5), false) AS near, arg_min(gap, rank) FILTER (WHERE label = own) AS gap FROM e LEFT JOIN h USING (query_id) GROUP BY 1)
SELECT query_id, hit, near AND NOT hit AS near, CAST(gap AS BIGINT) AS gap FROM m""",
    "seeded_shuffle": "SELECT c_custkey, row_number() OVER (ORDER BY sha1('42/' || c_custkey), c_custkey) AS place FROM customer",
    "drawn_with_replacement": "WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier), d AS (SELECT k AS draw, list_reduce(list_transform(string_split(left(sha1('42/' || k), 12), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b) % (SELECT count(*) FROM supplier) AS place FROM range(100) r(k)) SELECT draw, s_suppkey FROM d JOIN s USING (place)",
    "json_payloads": """SELECT event_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM (SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS t FROM events)""",
    "normalized_records": f"""WITH {_BUILT}
SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 5 WHEN 0 THEN '8-K' WHEN 1 THEN 'press' ELSE 'product' END AS doctype, 'Page ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN '2024-03-05' ELSE '2025-03-05' END AS publish_date, 'http://x/' AS final_url, {_words('text')} AS word_count, sha256(text) AS hash_sha256
FROM n WHERE (spared OR doc_id % 7 <> 0) AND NOT (doc_id % 5 = 0 AND {_words('text')} < 200)""",
    "saved_page_intake": f"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '<link rel="canonical" href="' || url || '">' || html ELSE html END AS html, CASE page_id % 4 WHEN 0 THEN {_strip('url')} WHEN 1 THEN url WHEN 2 THEN url END AS u FROM pages),
k AS (SELECT *, {_feed('u')} AS requested FROM p), f AS (SELECT DISTINCT {_feed('url')} AS requested, DATE '2025-03-05' AS day FROM pages WHERE page_id % 6 = 0)
SELECT page_id || '.html' AS file, CASE WHEN requested IS NULL THEN 'WARN' ELSE 'OK' END AS status, requested AS requested_url, coalesce({_host('requested')}, '') AS source_domain, day AS rss_pubdate, strlen(html) AS content_length, 'manual_save=1' || CASE WHEN day IS NOT NULL THEN '; feed=ir_rss' ELSE '' END AS notes, left(sha1(requested), 8) AS url_digest
FROM k LEFT JOIN f USING (requested)""",
    "feed_limits": f"""WITH p AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS feed, url AS link, page_id AS place, {_feed('url')} AS key FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY place, link) AS nth FROM p),
f AS (SELECT key, feed, link, nth AS place FROM n WHERE nth <= CASE feed WHEN 'even' THEN 10 ELSE 5 END QUALIFY row_number() OVER (PARTITION BY key ORDER BY feed, nth) = 1),
i AS (SELECT key, 'index' AS feed, link, place FROM p WHERE key NOT IN (SELECT key FROM f) QUALIFY row_number() OVER (PARTITION BY key ORDER BY place, link) = 1),
m AS (SELECT * FROM i QUALIFY row_number() OVER (ORDER BY place, link) <= greatest(0, 25 - (SELECT count(*) FROM f)))
SELECT feed, link, CAST(place AS BIGINT) AS place FROM f UNION ALL SELECT feed, link, CAST(place AS BIGINT) FROM m""",
    "index_batches": "SELECT backend, index_name, CAST(vec_id // 500 AS BIGINT) AS batch, count(*) AS rows, min(vec_id) AS first_id, max(vec_id) AS last_id, CAST(max(len(embedding)) AS BIGINT) AS dim FROM embeddings, (VALUES ('pinecone', 'kb-chunks'), ('weaviate', 'KbChunk')) t(backend, index_name) GROUP BY ALL",
    "link_variants": """WITH u AS (SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_x=1&empty=&gclid=&fbclid=2&gclids=3#f' AS u FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND NOT regexp_matches(p, '^(utm_|(gclid|fbclid)=)')), '&') AS q FROM u)
SELECT page_id, regexp_extract(u, '^([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END || '#f' AS link FROM k""",
    "recency_rows": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS day, o_orderstatus = 'O' AS press FROM orders), a AS (SELECT *, DATE '1997-06-30' - day AS age FROM o WHERE day IS NULL OR (day >= DATE '1995-01-01' AND day <= DATE '1997-12-31'))
SELECT o_orderkey, CASE WHEN press THEN age <= 365 END AS is_within_12mo, CASE WHEN press THEN age <= 730 END AS is_within_24mo, age <= 185 AS within_6mo FROM a""",
    "utc_days": "SELECT o_orderkey, o_orderdate::DATE + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS day FROM orders",
    "stable_hashes": f"SELECT n_nationkey, CAST(h % 768 AS BIGINT) AS bucket, CAST(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS sign FROM (SELECT n_nationkey, {_FNV.format('lower(n_name)')} AS h FROM nation)",
    "dangling_points": "SELECT conv_id::VARCHAR AS session, turn::VARCHAR AS id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations u WHERE u.role = 'user' AND u.conv_id = c.conv_id AND u.turn = c.turn)",
    "json_lines_read_back": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS value FROM documents GROUP BY 1 UNION ALL SELECT 'bad', 1, 0 UNION ALL SELECT 'lines', count(*) + 2, 0 FROM documents",
    "versioned_update": """SELECT v AS version, count(*) AS rows, round(sum(c_acctbal) + CASE WHEN v = 2 OR v = 3 AND min(c_custkey) = (SELECT min(c_custkey) FROM customer) THEN 1 ELSE 0 END, 2) AS total, CASE v WHEN 1 THEN 8 WHEN 2 THEN 1 WHEN 4 THEN 0 END::BIGINT AS parts_written
FROM customer, (VALUES (1), (2), (3), (4)) t(v) WHERE v <> 3 OR c_custkey % 10 <> 0 GROUP BY v""",
    "packed_documents": "SELECT -1 AS doc_id, count(*) AS n, NULL AS digest FROM documents UNION ALL SELECT doc_id, 1, md5(text) FROM documents WHERE doc_id IN (0, 7, 19)",
    "raw_by_sidecar": """SELECT 'p' || page_id AS doc_id, kind AS ending, CAST(strlen(kind || html) AS BIGINT) AS length, md5(kind || html) AS digest, 'é' AS notes
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN '.raw.html' WHEN 1 THEN '.raw.html' ELSE '.pdf' END AS kind FROM pages WHERE page_id % 4 > 0 AND page_id % 5 > 0 AND page_id % 7 > 0)""",
    "sidecar_lookup": "SELECT 'p' || page_id AS doc_id, CAST(CASE WHEN page_id % 4 > 0 THEN CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END END AS BIGINT) AS status, CASE WHEN page_id % 4 > 0 THEN url END AS final_url FROM pages",
    "configured_routes": ORACLES["route_decisions"],
    "mail_negotiation": f"""WITH {_MAIL}, {_mail_round('mails', 1)}, {_mail_round('r1', 2)}, last AS (SELECT *, {_mail_flags()} FROM r2), {_mail_shorter('last', 1)}, {_mail_shorter('s1', 2)}, {_mail_shorter('s2', 3)}
SELECT conv_id, turn, body, unsub AS unsubscribe_block, company AS company_info_block, array_to_string(critical, ',') AS critical, array_to_string(warning, ',') AS warning FROM s3""",
    "csv_read_back": "SELECT c_custkey, c_name, c_mktsegment || ',' || c_name AS tags FROM customer",
    "parquet_read_back": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'",
    "log_words": "SELECT count(*) FILTER (WHERE event_id % 10 = 0) AS errors, count(*) FILTER (WHERE event_id % 10 <> 0) AS fine, CAST(0 AS BIGINT) AS nothing FROM events",
    "feed_items_read": "SELECT url AS link, 'Page ' || page_id AS title, DATE '2025-03-06' AS day FROM pages",
    "decoded_payloads": "SELECT c_custkey, CAST(2 + length(c_name) AS INTEGER) AS chars, md5(c_name) AS digest FROM customer",
    "index_round_trip": "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dim, least(100, count(*)) AS sampled, CAST(0 AS DOUBLE) AS error_max FROM embeddings",
    "index_nearest": f"WITH {_HITS} SELECT query_id, vec_id, round(d2, 6) AS d2, rank FROM hits WHERE rank <= 10",
    "index_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "prior_report": f"WITH {_METRICS} SELECT metric, round(CASE WHEN metric = 'domains' THEN 7.0 ELSE v END, 6) AS value FROM m",
}

ALL = ORACLES | MORE
