"""The queries of the catalog in DuckDB's SQL, written from the definitions alone."""

from __future__ import annotations

_W = r"[\p{L}\p{N}_]+"
_T = r"[^\s\p{Z}]+"
_STOP = (
    "the a an and or of for to in on by with from at as is are was were be been being this that those these it its their our your you "
    "we they i not no so if then than into out over under about above below after before during while up down off near far per via within without"
).split()
_NO_PHRASES = [*_STOP, "data", "salesforce", "press", "release", "results", "fiscal", "quarter", "year", "revenue", "agentforce", "api"]
_PHRASE_STOPS = "[" + ", ".join(f"'{w}'" for w in _NO_PHRASES) + "]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in _STOP) + "]"


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_W}'))"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_T}'))"


def _sentences(x: str) -> str:
    return rf"greatest(len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda s: trim(regexp_replace(s, '[\s\p{{Z}}]+', ' ', 'g')) <> '')), 1)"


def _grade(x: str) -> str:
    syllables = f"greatest(list_sum(list_transform(regexp_extract_all({x}, '{_W}'), lambda w: greatest(1, length(regexp_replace(w, '[^aeiouyAEIOUY]', '', 'g'))))), 1)"
    n = f"greatest({_words(x)}, 1)"
    return f"0.39::DOUBLE * ({n} / {_sentences(x)}) + 11.8::DOUBLE * (coalesce({syllables}, 1) / {n}) - 15.59::DOUBLE"


def _slug(x: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"


def _host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


_TRACK = "['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','mc_cid','mc_eid','igshid']"


def _strip(u: str) -> str:
    kept = f"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(split_part(p, '=', 1), 'utm_') AND NOT list_contains({_TRACK}, split_part(p, '=', 1))), '&')"
    return f"regexp_extract({u}, '^([^?#]*)', 1) || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END || regexp_extract({u}, '(#.*)$', 1)"


def _feed(u: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({u}, '^[A-Za-z]+:', 'https:'), '[?#].*$', ''), '(?i)/default\.aspx$', ''), '([^/])/$', '\1')"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\x00-\x7F]', '', 'g'), '[-/]', ' ', 'g'), '[0-9]+', '0', 'g'), '\s+', ' ', 'g'))"


def _terms(x: str) -> str:
    t = f"regexp_extract_all({_norm(x)}, '[a-z0-9]{{2,20}}')"
    return f"list_transform([{t}], lambda t: list_concat(t, list_transform(list_zip(t[1:len(t) - 1], t[2:]), lambda p: 'bg:' || p[1] || '_' || p[2])))[1]"


_CHUNKS = f"""
base AS (SELECT doc_id, text AS t, length(text) AS len, {_tokens('text')} AS n FROM documents WHERE length(text) > 0),
cpt AS (SELECT *, greatest(1, CAST(round_even(len / greatest(n, 1) * 800, 0) AS BIGINT)) AS win, greatest(1, CAST(round_even(len / greatest(n, 1) * 680, 0) AS BIGINT)) AS step FROM base),
cnt AS (SELECT *, CASE WHEN n < 350 OR len <= win THEN 1 ELSE 1 + CAST(ceil((len - win) / step) AS BIGINT) END AS k FROM cpt),
piece AS (SELECT doc_id, t, k, i AS seq_no, i * step AS s, CASE WHEN k = 1 THEN len ELSE least(len, i * step + win) END AS e FROM (SELECT *, unnest(range(0, k)) AS i FROM cnt)),
sized AS (SELECT *, {_tokens('substr(t, s + 1, e - s)')} AS tok FROM piece),
marked AS (SELECT *, lead(tok) OVER w AS next_tok, lead(e) OVER w AS next_e, lag(tok) OVER w AS prev_tok FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY seq_no)),
chunks AS (
  SELECT doc_id, seq_no, s AS start_char, CASE WHEN seq_no = k - 2 AND next_tok < 120 AND next_tok + tok <= 960 THEN next_e ELSE e END - 1 AS end_char, t
  FROM marked WHERE NOT (k > 1 AND seq_no = k - 1 AND tok < 120 AND tok + prev_tok <= 960)),
ch AS (SELECT doc_id, seq_no, start_char, end_char, substr(t, start_char + 1, end_char - start_char + 1) AS text FROM chunks)"""

_PAIRS = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
co AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, c / (x.n + y.n - c) AS jaccard FROM co JOIN sz x ON x.doc_id = id_a JOIN sz y ON y.doc_id = id_b WHERE c / (x.n + y.n - c) >= 0.85),
edges AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(id, r) AS (SELECT DISTINCT x, x FROM edges UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.id),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""

_GROUPS = f""",
m AS (SELECT component, id, {_words('text')} AS wc FROM comp JOIN documents ON doc_id = id),
canon AS (SELECT component, arg_min(id, (-wc, id)) AS canonical_id, count(*) AS members FROM m GROUP BY 1)"""

_D2 = "list_reduce(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)), lambda a, b: a + b)"
_HITS = f"""
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, v.label, {_D2} AS d2 FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q))"""
_SCORED = _HITS + """,
scored AS (
  SELECT query_id, vec_id AS chunk_id, rank AS in_rank, round(-d2, 6) AS score, CASE WHEN vec_id % 11 > 0 THEN DATE '2025-09-08' - CAST(vec_id % 900 AS INTEGER) END AS day,
    CASE WHEN label <> 9 THEN 'd' || label END AS domain FROM hits)"""


def _final(rows: str, w: tuple[float, float, float]) -> str:
    return f"""SELECT *, {w[0]}::DOUBLE * (1 / (1 + abs(score))) + {w[1]}::DOUBLE * CASE WHEN day IS NULL THEN 0.3::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (DATE '2025-09-08' - day) / 730.0::DOUBLE) END
    + {w[2]}::DOUBLE * CASE WHEN domain IS NOT NULL AND row_number() OVER (PARTITION BY query_id, domain ORDER BY in_rank) = 1 THEN 0.1::DOUBLE ELSE 0 END AS final FROM {rows}"""


def _capped(rows: str, k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chosen DESC, final DESC, in_rank) AS out_rank FROM (
    SELECT *, own <= 2 AND row_number() OVER (PARTITION BY query_id, own <= 2 ORDER BY final DESC, in_rank) <= {k} AS chosen FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(domain, '') ORDER BY final DESC, in_rank) AS own FROM {rows}))"""


_RANKS = _HITS + """,
h AS (SELECT query_id, vec_id AS id, label AS doc_id, rank - 1 AS rank FROM hits WHERE rank <= 11 AND vec_id <> query_id),
e AS (SELECT vec_id AS query_id, vec_id + 1 AS expected_id, label AS expected_doc FROM embeddings WHERE vec_id % 20 = 0),
ranks AS (SELECT e.query_id, expected_id, expected_doc, min(rank) FILTER (WHERE id = expected_id) AS rank, min(rank) FILTER (WHERE doc_id = expected_doc) AS doc_rank FROM e LEFT JOIN h USING (query_id) GROUP BY ALL)"""


def _stratified(stratum: str, n: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY sha1('7/' || doc_id), doc_id) AS place FROM documents) WHERE place <= {n}"


_MONTH = "(strptime({0}, '%B %-d, %Y')::DATE)"
_MAIL = r"""
mails AS (
  SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' Guaranteed results, always.' WHEN 1 THEN chr(10) || '- one two three four five six seven eight nine ten' || chr(10) || '- a b' || chr(10) || '- c' || chr(10) || '- d e f' WHEN 2 THEN ' 100% safe and risk-free' ELSE '' END AS body,
    CASE WHEN conv_id % 3 > 0 THEN 'Unsubscribe here' ELSE ' ' END AS unsub, CASE WHEN conv_id % 4 > 0 THEN 'ACME' END AS company FROM conversations)"""


def _tag(x: str, rules: list[tuple[str, list[str]]], join: str) -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains({x}, $${k}$$)' for k in keys)} THEN '{name}' END" for name, keys in rules)
    return f"array_to_string(list_filter([{cases}], lambda t: t IS NOT NULL), '{join}')"


_BUSINESS = [
    ("Agentforce", ["agentforce"]), ("Agent API", ["agent api"]), ("Data Cloud", ["data cloud", "cdp", "unified profiles", "real-time data", "connections"]),
    ("Earnings", ["revenue", "gaap", "non-gaap", "guidance", "outlook", "q1 fy", "q2 fy", "full year", "results", "quarterly", "fiscal"]),
    ("Partnership", ["announce", "expanded", "partnership", "collaborate", "work with", "integration", "google", "aws", "slack", "mulesoft", "informatica", "ferrari"]),
    ("Executive", ["appoints", "chief executive", "chief operating", "president", "board of directors"]), ("Security", ["security", "zero trust", "governance"]), ("Compliance", ["compliance", "regulatory"]),
    ("GenAI", ["gen ai", "generative", "llm", "prompt"]), ("Industry Solutions", ["retail", "financial services", "healthcare", "communications"]), ("Platform", ["platform", "apis", "developer"]), ("AI", ["ai ", " ai", "artificial intelligence"]),
]

ORACLES: dict[str, str] = {
    "doc_word_stats": f"SELECT doc_id, {_words('text')} AS word_count, {_tokens('text')} AS token_count, {_sentences('text')} AS sentences FROM documents",
    "readability": f"SELECT doc_id, round({_grade('text')}, 6) AS grade FROM documents",
    "slug_ids": f"""SELECT doc_id, {_slug("split_part(text, chr(10), 1)")} AS slug, 'crm::' || source || '::unknown::' || {_slug("split_part(text, chr(10), 1)")} || '::' || left(sha1(u), 8) AS composite, left(sha1(u), 8) AS url_digest, sha256(text) AS text_digest
FROM (SELECT *, 'https://' || source || '.example.com/' || doc_id AS u FROM documents)""",
    "normalized_terms": f"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)",
    "url_canonical": f"SELECT page_id, {_strip('url')} AS clean_url, {_host('url')} AS host, regexp_replace(url, '^[A-Za-z]+:', 'https:') AS secure_url, {_feed('url')} AS feed_key FROM pages",
    "url_domain_counts": f"SELECT {_host('url')} AS host, count(*) AS pages, count(DISTINCT {_feed('url')}) AS distinct_urls FROM pages GROUP BY 1",
    "allowlist_ratio": f"""SELECT count(*) AS pages, count(*) FILTER (WHERE ok) AS allowed, round(count(*) FILTER (WHERE ok) / greatest(count(*), 1), 6) AS ratio FROM (
SELECT h IN ('example.com', 'example.org') OR ends_with(h, '.example.com') OR ends_with(h, '.example.org') AS ok FROM (SELECT regexp_replace({_host('url')}, ':[0-9]*$', '') AS h FROM pages))""",
    "url_collisions": f"SELECT {_strip('url')} AS clean_url, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(DISTINCT page_id) > 1",
    "feed_match": f"""WITH f AS (SELECT {_feed('link')} AS k, min(link) AS link FROM (SELECT CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^[A-Za-z]+:', 'https:') || '#feed' ELSE regexp_replace(url, '^[A-Za-z]+://', 'https://moved.') END AS link FROM pages) GROUP BY 1)
SELECT page_id, {_feed('url')} AS feed_key, link FROM pages LEFT JOIN f ON f.k = {_feed('url')}""",
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE d END AS day, CASE WHEN o_orderkey % 6 = 5 OR d > DATE '1996-12-31' OR d < DATE '1994-01-01' THEN NULL ELSE d END AS sane_day FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)",
    "recency_buckets": """SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE age <= 90) AS within_90, count(*) FILTER (WHERE age <= 180) AS within_180, count(*) FILTER (WHERE age <= 365) AS within_365, count(*) FILTER (WHERE age > 365) AS older,
round(avg(greatest(0.0::DOUBLE, 1 - age / 730.0::DOUBLE)), 6) AS mean_recency FROM (SELECT o_orderpriority, DATE '1998-12-01' - o_orderdate::DATE AS age FROM orders) GROUP BY 1""",
    "language_filter": f"SELECT source, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words FROM (SELECT source, lang, {_words('text')} AS w FROM documents) WHERE (lang = 'en' OR source IN ('src1', 'src2')) AND NOT (source = 'src3' AND w < 200) GROUP BY 1",
    "phase_split": "SELECT CAST(strpos('0123456789abcdef', right(sha1(CAST(doc_id AS VARCHAR)), 1)) + 1 AS INTEGER) % 2 AS phase, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "topics_tagging": f"""SELECT conv_id, turn, {_tag('x', [("Greeting", ["the", "that"]), ("Question", ["?", "what"]), ("Waste", ["trash", "scum"]), ("AI", ["ai ", " ai"])], '|')} AS topic, {_tag('x', _BUSINESS, '|')} AS business_topic,
{_tag('x', [("agent", ["edo"]), ("analyst", ["ation", "ing"]), ("buyer", ["re", "con"])], ',')} AS personas FROM (SELECT conv_id, turn, lower(chr(10) || text) AS x FROM conversations)""",
    "publish_days": """SELECT o_orderkey, k AS doctype, coalesce(CASE WHEN day <= DATE '2001-01-01' AND day >= DATE '1999-01-01' THEN day END, DATE '1990-01-01') AS publish_date FROM (
SELECT o_orderkey, k, CASE k WHEN '10-K' THEN CASE WHEN o_orderkey % 3 = 0 THEN d + 2 ELSE d + 9 END WHEN 'press' THEN coalesce(CASE WHEN o_orderstatus = 'O' THEN d + 1 END, CASE WHEN o_orderkey % 3 = 0 THEN d + 2 END, d) WHEN 'help_docs' THEN d + 3 ELSE d END AS day
FROM (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS d, CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN 'press' WHEN 2 THEN 'help_docs' ELSE 'wiki' END AS k FROM orders))""",
    "inventory": """SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS publish_date, source, CASE WHEN lang <> 'fr' THEN lang ELSE '' END AS language, lang || ',' || source AS persona_tags FROM documents WHERE doc_id % 7 > 0""",
    "incremental_new": "SELECT lang, count(*) AS docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "required_fields": """SELECT array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'source' END, CASE WHEN doc_id % 3 = 0 THEN 'lang' END, CASE WHEN doc_id % 4 = 0 THEN 'persona_tags' END], lambda x: x IS NOT NULL), ',') AS missing, count(*) AS docs FROM documents GROUP BY 1""",
    "chunk_windows": f"WITH {_CHUNKS} SELECT doc_id, seq_no, start_char, end_char, {_tokens('text')} AS token_count, md5(text) AS digest FROM ch",
    "chunk_count_envelope": f"""WITH {_CHUNKS}, g AS (SELECT doc_id, count(*) AS chunks, sum({_words('text')}) AS cw FROM ch GROUP BY 1),
d AS (SELECT doc_id, {_tokens('text')} AS tokens, {_words('text')} AS words FROM documents), j AS (SELECT *, greatest(1, ceil((tokens - 120) / 680)) AS expected FROM d LEFT JOIN g USING (doc_id) WHERE tokens > 0)
SELECT count(*) AS docs, count(*) FILTER (WHERE chunks >= floor(0.6::DOUBLE * expected) AND chunks <= ceil(1.6::DOUBLE * expected)) AS inside, round(sum(cw) / sum(words), 6) AS coverage FROM j""",
    "adjacent_jaccard": f"""WITH {_CHUNKS}, w AS (SELECT doc_id, seq_no, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains({_STOPS}, x)) AS w FROM ch),
p AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY seq_no) AS w2 FROM w),
t AS (SELECT doc_id, seq_no, list_distinct(CASE WHEN len(w) > 120 THEN w[1:len(w) - 120] ELSE w END) AS a, list_distinct(CASE WHEN len(w2) > 120 THEN w2[121:] ELSE w2 END) AS b FROM p WHERE w2 IS NOT NULL)
SELECT doc_id, seq_no, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM t""",
    "nonadjacent_p95": f"""WITH {_CHUNKS}, w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq_no) AS rn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM ch),
j AS (SELECT len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.rn >= a.rn + 2)
SELECT count(*) AS pairs, round(list_sort(list(jaccard))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS BIGINT) + 1], 6) AS p95 FROM j""",
    "exact_dup_clusters": "SELECT sha256(text) AS sha256, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "near_dup_pairs": f"WITH RECURSIVE {_PAIRS} SELECT id_a, id_b, round(jaccard, 6) AS jaccard FROM pairs",
    "dedup_components": f"WITH RECURSIVE {_PAIRS} SELECT id, component FROM comp",
    "dedup_canonical": f"WITH RECURSIVE {_PAIRS}{_GROUPS} SELECT component, canonical_id, members, round(min(jaccard), 6) AS jaccard_min, round(max(jaccard), 6) AS jaccard_max FROM canon JOIN comp USING (component) JOIN pairs ON id_a = id GROUP BY ALL",
    "dedup_kept": f"WITH RECURSIVE {_PAIRS}{_GROUPS} SELECT doc_id, {_words('text')} AS word_count FROM documents WHERE doc_id NOT IN (SELECT id FROM comp JOIN canon USING (component) WHERE id <> canonical_id)",
    "vector_norm_outliers": """WITH v AS (SELECT sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)) AS norm FROM embeddings),
h AS (SELECT list_sort(list(norm)) AS l, count(*) // 2 AS h FROM v),
s AS (SELECT list_aggregate(l, 'median') AS med, list_aggregate(l[len(l) - h + 1:], 'median') - list_aggregate(l[1:h], 'median') AS iqr FROM (SELECT *, len(l) AS n FROM h))
SELECT CASE WHEN iqr = 0 THEN abs(norm - med) > 0 ELSE abs(norm - med) > 4 * iqr END AS outlier, count(*) AS vectors, round(min(norm), 6) AS least, round(max(norm), 6) AS greatest FROM v, s GROUP BY 1""",
    "vector_topk": f"WITH {_HITS} SELECT query_id, vec_id, round(d2, 6) AS d2, rank FROM hits WHERE rank <= 10",
    "rerank_scored": f"WITH {_SCORED} SELECT query_id, chunk_id, in_rank, round(final, 6) AS final FROM ({_final('(SELECT * FROM scored WHERE in_rank <= 12)', (0.5, 0.3, 0.2))})",
    "domain_cap_topk": f"WITH {_SCORED}, f AS (SELECT * REPLACE (round(final, 6) AS final) FROM ({_final('(SELECT * FROM scored WHERE in_rank <= 12)', (0.5, 0.3, 0.2))})) SELECT query_id, chunk_id, out_rank, chosen FROM ({_capped('f', 5)})",
    "fallback_answers": f"""WITH {_SCORED} SELECT CASE WHEN query_id % 40 = 0 THEN 'faiss' ELSE 'weaviate' END AS backend, query_id % 40 <> 0 AS fallback_used, count(DISTINCT query_id) AS queries, count(*) AS hits FROM scored WHERE in_rank <= CASE WHEN query_id % 40 = 0 THEN 6 ELSE 2 END GROUP BY 1, 2""",
    "retrieval_eval": f"""WITH {_RANKS} SELECT CAST(expected_doc AS BIGINT) AS label, count(*) AS queries, {', '.join(f'round(count(*) FILTER (WHERE doc_rank <= {k}) / count(*), 6) AS recall_{k}' for k in (1, 3, 5, 10))},
round(coalesce(sum(CASE WHEN doc_rank <= 5 THEN 1 / log2(doc_rank + 1) ELSE 0 END), 0) / count(*), 6) AS ndcg_5 FROM ranks GROUP BY 1""",
    "eval_outcomes": f"WITH {_RANKS} SELECT CASE WHEN rank <= 5 THEN 'HIT' WHEN doc_rank <= 5 AND abs(doc_rank - 1) <= 1 THEN 'NEAR_MISS' WHEN doc_rank <= 5 THEN 'DOC_HIT' ELSE 'MISS' END AS outcome, count(*) AS queries FROM ranks GROUP BY 1",
    "rank_stats": f"WITH {_RANKS}, s AS (SELECT list_sort(list(doc_rank)) AS v FROM ranks WHERE doc_rank IS NOT NULL) SELECT v[len(v) // 2 + 1] AS p50, v[CAST(floor(0.75::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS p75, v[CAST(floor(0.9::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS p90 FROM s",
    "freshness_coverage": f"WITH {_SCORED} SELECT query_id, round(avg(coalesce(DATE '2025-09-08' - day, 365)), 6) AS mean_age, count(DISTINCT domain) AS domains FROM scored WHERE in_rank <= 10 GROUP BY 1",
    "stratified_sample": f"SELECT source, doc_id, place FROM ({_stratified('source', 5)})",
    "seed_queries": f"""WITH s AS (SELECT *, ['cio', 'vp_customer_experience', 'vp_sales_ops'][CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1 AS INTEGER)] AS persona FROM ({_stratified('lang', 6)})),
q AS (SELECT doc_id, persona, CASE WHEN row_number() OVER (PARTITION BY persona, lang ORDER BY doc_id) = 1 THEN 'What about ' || lang ELSE 'Tell me of ' || lang || ' ' || source END AS query_text FROM s)
SELECT doc_id, persona, query_text, left(sha1(doc_id || persona || query_text), 12) AS eval_id FROM q""",
    "planner_queries": "SELECT min(conv_id * 1000 + turn) AS pos, md5(text) AS digest FROM conversations WHERE role = 'user' GROUP BY text ORDER BY 1 LIMIT 5",
    "percentile_variants": """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, median(value) AS med FROM events GROUP BY 1), h AS (SELECT *, len(v) // 2 AS k FROM s)
SELECT event_type, v[CAST(ceil(0.9::DOUBLE * len(v)) AS BIGINT)] AS nearest, v[CAST(floor(0.95::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS floored, v[CAST(round_even(0.95::DOUBLE * (len(v) - 1), 0) AS BIGINT) + 1] AS evened, v[len(v) // 2 + 1] AS upper_median,
round(list_median(v[1:k]), 6) AS hinge_low, round(list_median(v[len(v) - k + 1:]), 6) AS hinge_high, round(med, 6) AS median FROM h""",
    "semi_anti_integrity": """SELECT 'labelled' AS check_name, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'dangling', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'idle_customers', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "route_decisions": """WITH c AS (SELECT *, ['cio', 'vp_sales_ops', 'vp_customer_experience', 'other'][CAST(turn % 4 + 1 AS INTEGER)] AS p, lower(CASE conv_id % 5 WHEN 0 THEN 'Define ' || role WHEN 1 THEN 'What is the API of ' || role ELSE text END) AS q FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN len(list_filter(['results', 'earnings', 'fiscal', 'guidance', 'gaap', 'non-gaap', 'rpo', '10-k', '10-q', '8-k'], lambda k: contains(q, k))) > 0 THEN 'pinecone/PR_QUERY'
WHEN len(list_filter(['api', 'apis', 'endpoint', 'schema', 'developer', 'example'], lambda k: contains(q, k))) > 0 THEN 'weaviate/FILTER_MATCH' WHEN len(list_filter(['definition', 'what is', 'overview'], lambda k: contains(q, k))) > 0 THEN 'faiss/DEFINITION'
WHEN p = 'vp_sales_ops' THEN 'pinecone/PERSONA_BIAS' WHEN p = 'cio' THEN 'weaviate/PERSONA_BIAS' WHEN p = 'vp_customer_experience' THEN 'faiss/PERSONA_BIAS'
WHEN len(regexp_extract_all(q, '""" + _T + """')) <= 4 OR contains(q, 'what is') OR contains(q, 'define') OR contains(q, 'definition') OR contains(q, 'overview') THEN 'faiss/DEFAULT_SHORT_FAISS' ELSE 'weaviate/DEFAULT_WEAVIATE' END AS b FROM c)
SELECT conv_id, turn, split_part(b, '/', 1) AS backend, split_part(b, '/', 2) AS reason FROM d""",
    "compliance_flags": f"""WITH {_MAIL} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(unsub) = '' THEN 'MISSING_UNSUBSCRIBE' END, CASE WHEN company IS NULL THEN 'MISSING_COMPANY_INFO' END,
CASE WHEN regexp_matches(body, '(?i)(^|[^\\p{{L}}\\p{{N}}_])([0-9]+%[\\p{{L}}\\p{{N}}_]|(double|guarantee|always|never)([^\\p{{L}}\\p{{N}}_]|$))') THEN 'UNCITED_CLAIM' END,
CASE WHEN len(list_filter(['guaranteed', 'free money', 'no strings attached', 'risk-free', '100% safe'], lambda k: contains(lower(body), k))) > 0 THEN 'PROHIBITED_PHRASE' END], lambda x: x IS NOT NULL), ',') AS critical,
array_to_string(list_filter([CASE WHEN {_words('body')} > 160 THEN 'EXCESS_LENGTH' END, CASE WHEN {_grade('body')} > 10 THEN 'READABILITY' END], lambda x: x IS NOT NULL), ',') AS warning FROM mails""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_paid, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "top_orders_per_customer": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "event_props": "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, count(DISTINCT k) AS distinct_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "source_rollup": "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "user_sessions": """SELECT user_id, CAST(max(s) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, sum(CASE WHEN epoch_us(ts) - epoch_us(p) <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1""",
}
_FIRST_SEEN = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
def _within(u: str) -> str:
    h = f"regexp_replace({_host(u)}, ':[0-9]*$', '')"
    return f"coalesce({h} = 'example.org' OR ends_with({h}, '.example.org'), false)"



ORACLES |= {
    "keyphrases": f"""WITH a AS (SELECT doc_id, lower(text) AS low, lower(split_part(text, chr(10), 1)) || chr(10) || lower(text) AS whole FROM documents),
b AS (SELECT doc_id, low, list_transform(regexp_extract_all(whole, '[a-z0-9-]{{4,}}'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')) AS bare, list_filter(regexp_extract_all(low, '[a-z0-9]{{4,}}'), lambda w: NOT list_contains({_PHRASE_STOPS}, w)) AS more FROM a),
c AS (SELECT *, list_filter({_FIRST_SEEN.format('bare')}, lambda w: length(w) >= 4 AND NOT list_contains({_PHRASE_STOPS}, w) AND contains(low, w))[1:4] AS found FROM b),
d AS (SELECT *, list_concat(found, more) AS every FROM c)
SELECT doc_id, array_to_string(CASE WHEN len(found) >= 2 THEN found ELSE ({_FIRST_SEEN.format('every')})[1:2] END, ',') AS phrases FROM d""",
    "page_links": f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1) AS l FROM pages), d AS (SELECT page_id, {_FIRST_SEEN.format('l')} AS l FROM l)
SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM d""",
    "title_picks": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS el, trim(regexp_extract(html, '(?i)<meta[^>]+property="og:title"[^>]+content="(.*?)"', 1)) AS og FROM pages)
SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN coalesce(nullif(og, ''), nullif(el, '')) END, CASE WHEN page_id % 3 = 0 THEN 'Title ' || page_id END, 'Page No ' || page_id) AS title FROM t""",
    "link_status": f"""WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN url || '&gclid=1' WHEN 1 THEN 'https://www.example.org/kept/' || page_id || '?utm_source=x' END AS side, page_id % 4 = 0 AND page_id % 5 = 0 AS got, CASE WHEN page_id % 4 = 1 THEN 404 ELSE 0 END AS st FROM pages),
r AS (SELECT *, CASE WHEN got THEN coalesce(side, url) ELSE {_strip('url')} END AS reached FROM p),
i AS (SELECT *, {_within('reached')} AS stays, {_within('url')} AS own, {_within('side')} AS kept FROM r)
SELECT page_id, CASE WHEN stays THEN reached WHEN own THEN {_strip('url')} WHEN kept THEN {_strip('side')} ELSE reached END AS final_url, got OR (NOT stays AND (own OR kept)) AS link_ok, CASE WHEN got THEN 200 ELSE st END AS status_code FROM i""",
    "structure_spans": r"""WITH d AS (SELECT doc_id, string_split('Item 1. Business' || chr(10) || text || chr(10) || 'ITEM 1A Risk Factors' || chr(10) || 'risks' || chr(10) || 'Item 7. Discussion' || chr(10) || 'Item 2.02 Results' || chr(10) || 'end', chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM d),
s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS n FROM l),
i AS (SELECT *, regexp_extract(line, '(?i)\bitem[\s ]*(\d+(?:\.\d+)?)(.*)$', ['num', 'rest']) AS m FROM s WHERE regexp_matches(line, '(?i)\bitem[\s ]*\d')),
e AS (SELECT *, regexp_matches(m.rest, '(?i)^\s*[ab]([^a-z]|$)') AS lettered FROM i),
t AS (SELECT doc_id, pos, n, 'Item ' || m.num || CASE WHEN lettered THEN upper(left(trim(m.rest), 1)) ELSE '' END AS label, trim(regexp_replace(CASE WHEN lettered THEN trim(m.rest)[2:] ELSE m.rest END, '^\.?\s*', '')) AS title FROM e)
SELECT doc_id, label, CASE WHEN label = 'Item 1' AND (title = '' OR contains(lower(title), 'business')) THEN 'Business' WHEN label = 'Item 1A' AND (title = '' OR contains(lower(title), 'risk')) THEN 'Risk Factors'
  WHEN label = 'Item 7' AND (title = '' OR contains(lower(title), 'discussion')) THEN 'Management’s Discussion and Analysis' WHEN label = 'Item 7A' AND (title = '' OR contains(lower(title), 'risk')) THEN 'Market Risk'
  WHEN label = 'Item 8' AND (title = '' OR contains(lower(title), 'financial')) THEN 'Financial Statements' ELSE title END AS title,
  CAST(pos AS BIGINT) AS start_char, CAST(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n) - 1 AS BIGINT) AS end_char FROM t""",
    "gate_checks": f"""WITH c AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1),
m AS (
  SELECT 'n_docs' AS metric, CAST(count(*) AS DOUBLE) AS v FROM documents UNION ALL SELECT 'english', count(*) FILTER (WHERE lang = 'en') / greatest(count(*), 1) FROM documents UNION ALL SELECT 'unique_ids', CAST(count(*) = count(DISTINCT doc_id) AS INTEGER) FROM documents
  UNION ALL SELECT 'domains', count(DISTINCT source) FROM documents UNION ALL SELECT 'dup_rate', coalesce(sum(n) FILTER (WHERE n > 1), 0) / greatest(sum(n), 1) FROM c UNION ALL SELECT 'required', count(*) FILTER (WHERE quality = 1) / greatest(count(*), 1) FROM labels
  UNION ALL SELECT 'allowlisted', count(*) FILTER (WHERE h = 'example.com' OR ends_with(h, '.example.com')) / greatest(count(*), 1) FROM (SELECT regexp_replace({_host('url')}, ':[0-9]*$', '') AS h FROM pages) UNION ALL SELECT 'too_short', count(*) FILTER (WHERE length(html) < 50) FROM pages),
r(gate, id, metric, low, high) AS (VALUES ('G01', 'COL-007', 'dup_rate', NULL, 0.05), ('G02', 'STD-002', 'english', 0.95, NULL), ('G02', 'STD-003', 'too_short', NULL, 0), ('G03', 'META-001', 'required', 0.98, NULL), ('G03', 'META-005', 'unique_ids', 1, NULL), ('G06', 'LNK-003', 'allowlisted', 1, NULL), ('S0', 'G0-01', 'n_docs', 80, NULL), ('S0', 'G0-05', 'domains', 3, NULL))
SELECT gate, id, metric, round(v, 6) AS actual, CASE WHEN (low IS NULL OR v >= low) AND (high IS NULL OR v <= high) THEN 'PASS' ELSE 'FAIL' END AS status FROM r JOIN m USING (metric)""",
}
ORACLES["event_windows_streamed"] = ORACLES["event_windows"]
