"""Every query of the engine by name; plans/oracles.py has its SQL twin where SQL can say it.

All queries read whole tables. Days are counted from fixed reference days, so results can be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellon.functions import dates, stats, urls
from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.operators import assembly, cards, chunking, dedupe, evaluation, gate_metrics, gates, ingest, lexical_index, metadata, normalize, ordering, retrieval, routing, vector_index
from tessellon.plans import config
from tessellon.plans.oracles_more import ALL as ORACLES
from tessellon.plans.session import scratch, spread, staged, table
from tessellon.sources import readers, versions, writers
from tessellon.streaming import events as ev

__all__ = ["ORACLES", "QUERIES"]

def _as_of():
    return F.lit("2025-09-08").cast("date")

DIM = 768
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# ---------------------------------------------------------------- texts, ids, URLs, days


@query
def doc_word_stats(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("word_count"), tx.token_count(F.col("text")).alias("token_count"), tx.sentences(F.col("text")).alias("sentences"))


@query
def readability(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(tx.readability_grade(F.col("text")), 6).alias("grade"))


@query
def slug_ids(spark, sf):
    title = F.substring_index(F.col("text"), "\n", 1)
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return _docs(spark, sf).select("doc_id", tx.slugify(title).alias("slug"), metadata.doc_id(F.lit("crm"), F.col("source"), F.lit(None), title, url).alias("composite"), tx.sha1_8(url).alias("url_digest"), F.sha2("text", 256).alias("text_digest"))


@query
def normalized_terms(spark, sf):
    d = _docs(spark, sf).select("doc_id", tx.terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def keyphrases(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tx.keyphrases(F.substring_index(F.col("text"), "\n", 1), F.col("text")), ",").alias("phrases"))


@query
def url_canonical(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.strip_tracking(u).alias("clean_url"), urls.host(u).alias("host"), urls.with_https(u).alias("secure_url"), urls.feed_key(u).alias("feed_key"))


@query
def url_domain_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(urls.feed_key(F.col("url"))).alias("distinct_urls"))


@query
def allowlist_ratio(spark, sf):
    h = urls.bare_host(F.col("url"))
    roots = ["example.com", "example.org"]
    return table(spark, sf, "pages").agg(F.count("*").alias("pages"), F.count_if(urls.in_domains(h, roots)).alias("allowed"), F.round(F.count_if(urls.in_domains(h, roots)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("ratio"))


@query
def url_collisions(spark, sf):
    p = table(spark, sf, "pages").groupBy(urls.strip_tracking(F.col("url")).alias("clean_url")).agg(F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))
    return p.where("pages > 1")


@query
def feed_match(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    link = F.when(F.col("page_id") % 3 == 0, F.concat(urls.with_https(F.col("url")), F.lit("#feed"))).otherwise(F.regexp_replace("url", "^[A-Za-z]+://", "https://moved."))
    feed = table(spark, sf, "pages").select(link.alias("link"), F.col("page_id").alias("entry_no"))
    m = metadata.match_feed(pages, feed)
    return m.select("page_id", "feed_key", F.col("entry.link").alias("link"))


@query
def page_titles(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", normalize.page_title(h).alias("title"), normalize.meta_title(h).alias("meta_title"), normalize.meta_time(h).alias("meta_time"), normalize.page_day(h).alias("day"), normalize.canonical_url(h).alias("canonical"))


@query
def page_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", readers.page_links(F.col("html")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query
def date_parse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    forms = ["EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy", "'on' yyyy"]
    pick = None
    for k, f in enumerate(forms):
        test, value = F.col("o_orderkey") % len(forms) == k, F.date_format("d", f)
        pick = F.when(test, value) if pick is None else pick.when(test, value)
    return o.select("o_orderkey", dates.parse_day(pick).alias("day"), dates.sane(dates.parse_day(pick), F.lit("1996-12-31").cast("date"), "1994-01-01").alias("sane_day"))


@query
def recency_buckets(spark, sf):
    as_of = F.lit("1998-12-01").cast("date")
    age = dates.age_days(F.col("o_orderdate").cast("date"), as_of)
    o = table(spark, sf, "orders").select("o_orderpriority", age.alias("age"))
    return o.groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), *(F.count_if(F.col("age") <= n).alias(f"within_{n}") for n in (90, 180, 365)), F.count_if(F.col("age") > 365).alias("older"),
        F.round(F.avg(F.greatest(F.lit(0.0), 1 - F.col("age") / 730.0)), 6).alias("mean_recency"),
    )


# ---------------------------------------------------------------- documents


@query
def page_documents(spark, sf):
    d = normalize.documents(table(spark, sf, "pages"))
    return d.select("page_id", "html_title", "source_domain", "word_count", "token_count", "hash_sha256", F.left("text", F.lit(200)).alias("head"))


@query
def language_filter(spark, sf):
    d = _docs(spark, sf).withColumn("word_count", tx.word_count(F.col("text")))
    d = normalize.keep_language(d, "en", "lang", F.col("source").isin("src1", "src2"))
    d = normalize.drop_short(d, F.col("source") == "src3")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("word_count").alias("words"))


@query
def phase_split(spark, sf):
    p = normalize.phase(F.col("doc_id").cast("string"))
    return _docs(spark, sf).groupBy(p.alias("phase")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query
def topics_tagging(spark, sf):
    c = table(spark, sf, "conversations")
    t, x = F.lit(""), F.col("text")
    rules = [("Greeting", ["the", "that"]), ("Question", ["?", "what"]), ("Waste", ["trash", "scum"]), ("AI", ["ai ", " ai"])]
    people = [("buyer", ["re", "con"]), ("analyst", ["ation", "ing"]), ("agent", ["edo"])]
    return c.select("conv_id", "turn", metadata.topics(t, x, rules).alias("topic"), metadata.topics(t, x).alias("business_topic"), F.array_join(metadata.personas(t, x, people), ",").alias("personas"))


@query
def title_picks(spark, sf):
    p = table(spark, sf, "pages")
    slug = F.concat(F.lit("page-no-"), F.col("page_id").cast("string"))
    blank = F.when(F.col("page_id") % 2 == 0, normalize.meta_title(F.col("html"))).otherwise(F.lit("  "))
    h1 = F.concat(F.lit("x\nH1: Title "), F.col("page_id").cast("string"), F.lit("\ny"))
    return p.select("page_id", metadata.pick_title(blank, F.lit(None), F.when(F.col("page_id") % 3 == 0, h1), F.lit(""), slug).alias("title"))


@query
def publish_days(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "10-K").when(F.col("o_orderkey") % 4 == 1, "press").when(F.col("o_orderkey") % 4 == 2, "help_docs").otherwise("wiki")
    said = F.concat(F.lit("Last updated: "), F.date_format(F.date_add("d", 3), "MMMM d, yyyy"), F.lit(" by us"))
    meta = F.when(F.col("o_orderstatus") == "O", F.date_format(F.date_add("d", 1), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    day = metadata.pick_day(kind, meta, F.when(F.col("o_orderkey") % 3 == 0, F.date_add("d", 2)), F.col("d"), said, F.date_format("d", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_add("d", 9), F.lit("2001-01-01").cast("date"), F.lit("1990-01-01").cast("date"))
    return o.select("o_orderkey", kind.alias("doctype"), day.alias("publish_date"))


@query
def link_status(spark, sf):
    side = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("&gclid=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.example.org/kept/"), F.col("page_id").cast("string"), F.lit("?utm_source=x")))
    p = table(spark, sf, "pages").select("page_id", "url", side.alias("side_url"), F.when(F.col("page_id") % 4 == 0, 200).when(F.col("page_id") % 4 == 1, 404).alias("side_status"), (F.col("page_id") % 5 == 0).alias("has_payload"))
    return metadata.link_state(p, ["example.org"]).select("page_id", "final_url", "link_ok", "status_code")


@query
def inventory(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id"), F.when(F.col("doc_id") % 7 > 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")).alias("publish_date"), "source", F.when(F.col("lang") != "fr", F.col("lang")).alias("language"), F.array("lang", "source").alias("persona_tags"))
    return metadata.inventory(d)


@query
def incremental_new(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    have = table(spark, sf, "labels").select("doc_id")
    return metadata.new_only(d, have).groupBy("lang").agg(F.count("*").alias("docs"))


@query
def required_fields(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise(" ").alias("lang"), F.when(F.col("doc_id") % 4 > 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("persona_tags"))
    gaps = metadata.missing_fields(["source", "lang", "persona_tags"], dict(d.dtypes))
    m = d.select("doc_id", gaps.alias("gaps"))
    return m.groupBy(F.array_join("gaps", ",").alias("missing")).agg(F.count("*").alias("docs"))


# ---------------------------------------------------------------- chunks and spans


def _chunks(spark, sf):
    return chunking.windows(_docs(spark, sf))


@query
def chunk_windows(spark, sf):
    c = _chunks(spark, sf)
    return c.select("doc_id", F.col("seq_no").cast("long").alias("seq_no"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "token_count", F.md5("text").alias("digest"))


@query
def chunk_count_envelope(spark, sf):
    n = _chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("chunk_words"))
    d = _docs(spark, sf).select("doc_id", tx.token_count(F.col("text")).alias("tokens"), tx.word_count(F.col("text")).alias("words")).where("tokens > 0")
    e = d.join(n, "doc_id", "left").withColumn("expected", F.greatest(F.lit(1), F.ceil((F.col("tokens") - 120) / 680)))
    ok = (F.col("chunks") >= F.floor(0.6 * F.col("expected"))) & (F.col("chunks") <= F.ceil(1.6 * F.col("expected")))
    return e.agg(F.count("*").alias("docs"), F.count_if(ok).alias("inside"), F.round(F.sum("chunk_words") / F.sum("words"), 6).alias("coverage"))


@query
def structure_spans(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.concat(F.lit("Item 1. Business\n"), "text", F.lit("\nITEM 1A Risk Factors\nrisks\nItem 7. Discussion\nItem 2.02 Results\nend")).alias("text"))
    return chunking.item_spans(d)


@query
def adjacent_jaccard(spark, sf):
    a = chunking.adjacent_similarity(_chunks(spark, sf))
    return a.select("doc_id", F.col("seq_no").cast("long").alias("seq_no"), F.round("jaccard", 6).alias("jaccard"))


@query
def nonadjacent_p95(spark, sf):
    d = staged(chunking.distant_similarity(_chunks(spark, sf)).select("jaccard"), "distant")
    p = ordering.percentiles(d, "jaccard", {"p95": ordering.floor_index(0.95)})
    return d.agg(F.count("*").alias("pairs")).crossJoin(F.broadcast(p.select(F.round("p95", 6).alias("p95"))))


@query
def heading_windows(spark, sf):
    """Windows whose starts move to the nearest line start."""
    d = _docs(spark, sf).where(F.length("text") > 0).select("doc_id", "text", F.length("text").alias("n"))
    marks = _line_starts(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("marks"))
    d = d.join(marks, "doc_id")
    starts = chunking.snapped_starts(F.col("n"), F.lit(800), F.lit(680), F.col("marks"))
    return d.select("doc_id", F.size(starts).cast("long").alias("windows"), F.array_join(starts.cast("array<string>"), ",").alias("starts"))


# ---------------------------------------------------------------- duplicates


@query
def exact_dup_clusters(spark, sf):
    return dedupe.exact_clusters(_docs(spark, sf))


def _distinct_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", "text", tx.word_count(F.col("text")).alias("word_count"))


@query
def near_dup_pairs(spark, sf):
    p = dedupe.near_pairs(_docs(spark, sf))
    return p.select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


@query
def dedup_components(spark, sf):
    return dedupe.components(dedupe.links(_docs(spark, sf)))


@query
def dedup_canonical(spark, sf):
    d = _distinct_docs(spark, sf)
    g = dedupe.groups(d, dedupe.links(d))
    return g.select("component", "canonical_id", "members", F.round("jaccard_min", 6).alias("jaccard_min"), F.round("jaccard_max", 6).alias("jaccard_max"))


@query
def dedup_kept(spark, sf):
    d = _distinct_docs(spark, sf)
    return dedupe.kept(d, dedupe.links(d)).select("doc_id", "word_count")


# ---------------------------------------------------------------- vectors and search


@query
def hash_embed_sparse(spark, sf):
    e = vx.sparse_embedding(table(spark, sf, "benchmark"), "item_id", tx.terms(F.col("text")), DIM)
    return e.select("item_id", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


@query
def vector_norm_outliers(spark, sf):
    o = retrieval.outliers(table(spark, sf, "embeddings"))
    return o.groupBy("outlier").agg(F.count("*").alias("vectors"), F.round(F.min("norm"), 6).alias("least"), F.round(F.max("norm"), 6).alias("greatest"))


def _vector_hits(spark, sf, k):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return retrieval.nearest(v, q, k)


@query
def vector_topk(spark, sf):
    return _vector_hits(spark, sf, 10).select("query_id", "vec_id", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


def _index_queries(v):
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query
def index_round_trip(spark, sf):
    """An index of all vectors, written, opened again and asked for 100 of its own vectors."""
    v = table(spark, sf, "embeddings")
    r = vector_index.round_trip(vector_index.build(v, scratch(spark, "vector-index")), v)
    return r.select("vectors", F.col("dim").cast("long").alias("dim"), "sampled", F.round("error_max", 6).alias("error_max"))


@query
def index_nearest(spark, sf):
    v = table(spark, sf, "embeddings")
    found = vector_index.search(vector_index.build(v, scratch(spark, "vector-index")), _index_queries(v), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query
def index_recall(spark, sf):
    """Cells of a few hundred vectors, a part of them asked: how much of the exact answer is found."""
    v = table(spark, sf, "embeddings")
    q = _index_queries(v)
    index = vector_index.build(v, scratch(spark, "vector-index"), part_rows=400)
    probes = vector_index.probes_needed(index, v, q, 10, least=8)
    got = vector_index.recall(vector_index.search(index, q, 10, probes=probes), retrieval.nearest(v, q, 10), "vec_id")
    return got.select("queries", (F.col("recall") >= 0.95).alias("enough"))


@query
def lexvec_search(spark, sf):
    """Benchmark items as queries over documents: hashed vectors propose 100, shared terms re-score them."""
    docs, items = _docs(spark, sf), table(spark, sf, "benchmark")
    terms = tx.terms(F.col("text"))
    index = lexical_index.build(docs, scratch(spark, "lexical-index"), F.lower(F.coalesce("text", F.lit(""))), split=tx.terms_of)
    # staged, so that the join knows their size; only their texts are cut to snippets
    hits = staged(lexical_index.search(index, items.select(F.col("item_id").alias("query_id"), "text"), terms, 100), "hits")
    hits = hits.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("text", retrieval.snippet(F.col("text"))).join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    return retrieval.blended(hits).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _routed(spark, sf, decide):
    c = table(spark, sf, "conversations")
    who = F.element_at(F.array(*(F.lit(p) for p in ("cio", "vp_sales_ops", "vp_customer_experience", "other"))), (F.col("turn") % 4 + 1).cast("int"))
    q = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Define "), F.col("role"))).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("What is the API of "), F.col("role"))).otherwise(F.col("text"))
    d = decide(q, who)
    return c.select("conv_id", "turn", d["backend"].alias("backend"), d["reason"].alias("reason"))


@query
def route_decisions(spark, sf):
    return _routed(spark, sf, routing.decide)


def _scored_hits(spark, sf, k=12):
    h = _vector_hits(spark, sf, k).withColumnRenamed("rank", "in_rank")
    label = table(spark, sf, "embeddings").select("vec_id", "label")
    h = h.join(label, "vec_id").withColumn("domain", F.when(F.col("label") != 9, F.concat(F.lit("d"), F.col("label").cast("string"))))
    day = F.when(F.col("vec_id") % 11 > 0, F.date_sub(_as_of(), (F.col("vec_id") % 900).cast("int")))
    return h.select("query_id", F.col("vec_id").alias("chunk_id"), "in_rank", F.round(-F.col("d2"), 6).alias("score"), day.alias("day"), "domain")


@query
def rerank_scored(spark, sf):
    r = routing.rescore(_scored_hits(spark, sf), _as_of(), routing.WEIGHTS)
    return r.select("query_id", "chunk_id", F.col("in_rank").cast("long").alias("in_rank"), F.round("final", 6).alias("final"))


@query
def domain_cap_topk(spark, sf):
    r = routing.rescore(_scored_hits(spark, sf), _as_of(), routing.WEIGHTS).withColumn("final", F.round("final", 6))
    return routing.capped(r, 5, 2).select("query_id", "chunk_id", F.col("out_rank").cast("long").alias("out_rank"), "chosen")


@query
def diversity_merge(spark, sf):
    every = staged(_scored_hits(spark, sf, 30), "hits")
    main = every.where("in_rank <= 4")
    m = routing.merge_diverse(main, [every.where("in_rank between 5 and 12"), every], _as_of(), 5, 2)
    return m.select("query_id", "chunk_id", F.col("source").cast("long").alias("source"), F.col("out_rank").cast("long").alias("out_rank"))


@query
def fallback_answers(spark, sf):
    every = staged(_scored_hits(spark, sf, 6), "hits")
    q = every.select("query_id").distinct()
    got = retrieval.first_answer([("faiss", every.where("query_id % 40 = 0")), ("weaviate", every.where("in_rank <= 2"))], q)
    return got.groupBy("backend", "fallback_used").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("hits"))


# ---------------------------------------------------------------- evaluation


def _ranks(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    h = _vector_hits(spark, sf, 11).where("vec_id <> query_id").withColumn("rank", F.col("rank") - 1)
    h = h.join(v.select("vec_id", F.col("label").alias("doc_id")), "vec_id").withColumnRenamed("vec_id", "id")
    e = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("expected_id"), F.col("label").alias("expected_doc"))
    return evaluation.hit_ranks(e, h.select("query_id", "id", "doc_id", "rank"))


@query
def retrieval_eval(spark, sf):
    r = evaluation.recall_and_gain(_ranks(spark, sf), ["expected_doc"], "doc_rank")
    return r.select(F.col("expected_doc").cast("long").alias("label"), "queries", *(F.round(c, 6).alias(c) for c in r.columns[2:]))


@query
def eval_outcomes(spark, sf):
    r = _ranks(spark, sf)
    return r.groupBy(evaluation.outcome(F.col("rank"), F.col("doc_rank"), F.abs(F.col("doc_rank") - 1), 5, 1).alias("outcome")).agg(F.count("*").alias("queries"))


@query
def rank_stats(spark, sf):
    r = evaluation.rank_figures(_ranks(spark, sf), [], "doc_rank")
    return r.select(*(F.col(c).cast("long").alias(c) for c in r.columns))


@query
def freshness_coverage(spark, sf):
    h = _scored_hits(spark, sf).withColumnRenamed("in_rank", "rank")
    f = evaluation.freshness(h, _as_of())
    return f.select("query_id", F.round("mean_age", 6).alias("mean_age"), "domains")


@query
def stratified_sample(spark, sf):
    s = evaluation.stratified(_docs(spark, sf), "source", 5, "doc_id")
    return s.select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query
def seed_queries(spark, sf):
    """Labelled queries from a sample: personas in turn, second wording for a persona's repeated query."""
    s = evaluation.stratified(_docs(spark, sf), "lang", 6, "doc_id")
    s = ordering.round_robin(s, [F.col("doc_id")], ["cio", "vp_customer_experience", "vp_sales_ops"], "persona")
    s = s.withColumn("q1", F.concat(F.lit("What about "), "lang"))
    s = s.withColumn("query_text", evaluation.unlike_twins("persona", "q1", "doc_id", F.concat(F.lit("Tell me of "), "lang", F.lit(" "), "source")))
    return s.select("doc_id", "persona", "query_text", evaluation.eval_id(F.col("doc_id").cast("string"), F.col("persona"), F.col("query_text")).alias("eval_id"))


@query
def planner_queries(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    d = evaluation.distinct_first(c, "text", "pos")
    return d.select("pos", F.md5("text").alias("digest"))


@query
def percentile_variants(spark, sf):
    wanted = {
        "nearest": ordering.nearest_rank(0.9), "floored": ordering.floor_index(0.95), "evened": ordering.even_index(0.95), "upper_median": ordering.upper_median,
        "hinge_low": ordering.lower_hinge, "hinge_high": ordering.upper_hinge, "median": ordering.median,
    }
    p = ordering.percentiles(table(spark, sf, "events"), "value", wanted, ["event_type"])
    return p.select("event_type", "nearest", "floored", "evened", "upper_median", *(F.round(c, 6).alias(c) for c in ("hinge_low", "hinge_high", "median")))


# ---------------------------------------------------------------- gates


def _metrics(spark, sf):
    docs, labels, pages = _docs(spark, sf), table(spark, sf, "labels"), table(spark, sf, "pages")
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    n = F.greatest(F.count("*"), F.lit(1))
    d = docs.select("doc_id", "lang", "source", "text", F.sha2("text", 256).alias("h"))
    copies = d.groupBy("h").agg(F.count("*").alias("n"))
    rows = [
        one(d, "n_docs", F.count("*")), one(d, "english", F.count_if(F.col("lang") == "en") / n), one(d, "unique_ids", (F.count("*") == F.countDistinct("doc_id")).cast("int")), one(d, "domains", F.countDistinct("source")),
        one(copies, "dup_rate", F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))), one(labels, "required", F.count_if(F.col("quality") == 1) / n), one(pages, "allowlisted", F.count_if(urls.in_domains(urls.bare_host(F.col("url")), ["example.com"])) / n),
        one(pages, "too_short", F.count_if(F.length("html") < 50)), one(d, "too_long", F.count_if(F.length("text") > 1_000_000)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query
def gate_checks(spark, sf):
    names = ["n_docs", "english", "unique_ids", "domains", "dup_rate", "required", "allowlisted", "too_short"]
    c = gates.checks(_metrics(spark, sf), gates.rules_frame(spark, [r for r in gates.RULES if r.metric in names]))
    return c.select("gate", "id", "metric", F.round("actual", 6).alias("actual"), "status")


@query
def gate_states(spark, sf):
    return gates.states(gates.checks(_metrics(spark, sf), gates.rules_frame(spark)))


def _kept_chunks(chunks):
    """Chunks without repetitions of an earlier one's text, by document's number and place."""
    first = chunks.groupBy(F.sha2("text", 256)).agg(F.min(F.struct(F.col("doc_id").cast("long").alias("n"), "seq_no", "doc_id")).alias("f")).select("f.doc_id", "f.seq_no")
    return chunks.join(first, ["doc_id", "seq_no"], "left_semi")


def _gate_raw(spark, sf):
    """Pages as sidecars of buckets and feeds, some unanswered, copied, without a digest or a day."""
    n = F.col("page_id")
    bucket = F.get(F.array(*map(F.lit, ("sec", "investor_news", "newsroom", "newsroom", "product", "dev_docs", "help_docs", "wikipedia"))), (n % 8).cast("int"))
    before = lambda days: F.date_sub(_as_of(), days.cast("int"))
    return table(spark, sf, "pages").select(
        bucket.alias("source_bucket"), F.when(n % 8 == 2, "x; feed=corporate").when(n % 8 == 3, "feed=product").alias("notes"), F.when(n % 40 == 7, 404).otherwise(200).alias("http_status"),
        F.when(n % 9 == 4, "same").when(n % 9 == 5, " ").otherwise(F.sha2("html", 256)).alias("sha256_raw"), F.when(bucket == "newsroom", "press").otherwise(bucket).alias("doctype"),
        F.when(n % 7 > 0, before(n * 13 % 1500)).alias("visible_date"), F.when(n % 2 == 0, before(F.lit(100))).alias("rss_pubdate"),
    )


def _gate_docs(spark, sf):
    """Documents as normalised ones: kinds, titles, days and tags by number, some missing or wrong."""
    n, text = F.col("doc_id"), F.col("text")
    day = F.when(n % 13 == 0, "").when(n % 13 == 1, "2031-01-01").when(n % 13 == 2, "soon").otherwise(F.date_sub(_as_of(), (n % 1200).cast("int")).cast("string"))
    tags = F.when(n % 50 > 0, F.when(n % 3 > 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    fixed = {c: F.lit("x") for c in ("company", "url", "final_url", "section", "hash_sha256")}
    return _docs(spark, sf).select(
        n.cast("string").alias("doc_id"), F.get(F.array(*map(F.lit, ("press", "10-K", "product", "wiki"))), (n % 4).cast("int")).alias("doctype"), F.when(n % 17 > 0, F.concat(F.lit("Title "), n.cast("string"))).otherwise(" ").alias("title"),
        day.alias("publish_date"), F.col("source").alias("source_domain"), F.when(text.contains("a"), "T").otherwise("").alias("topic"), tags.alias("persona_tags"), F.col("lang").alias("language"), "text", tx.word_count(text).alias("word_count"),
        tx.token_count(text).alias("token_count"), F.lit(_AS_OF_TIME).cast("timestamp").alias("ingestion_ts"), F.when(n % 10 == 0, ".pdf").otherwise(".raw.html").alias("ending"), F.when(n % 20 == 0, "m").alias("pdf_page_map"),
        (F.length(text) + n % 50).alias("before_len"), F.length(text).alias("after_len"), ((n % 100) / 100).alias("sec_item_coverage_ratio"), (n % 8 > 0).alias("headed"), *(c.alias(k) for k, c in fixed.items()),
    )


_AS_OF_TIME = "2025-09-08 00:00:00"


@query
def gate_report(spark, sf):
    """All metrics of collection, normalisation, metadata, chunking, duplicates, baseline, embeddings and indexes, judged, with the gates' states."""
    docs = staged(_gate_docs(spark, sf), "gate-docs")
    chunks = staged(chunking.windows(docs), "gate-chunks")
    kept = staged(_kept_chunks(chunks), "gate-kept")
    sizes = spark.createDataFrame([("press", 700, 200)], "doctype string, median_tokens int, iqr_tokens int")
    headed = docs.withColumn("text", F.when(F.col("headed"), F.concat(F.lit("H1: t\n\n"), "text")).otherwise(F.col("text")))
    vectors = table(spark, sf, "embeddings")
    n_docs, n_vectors = docs.count(), vectors.count()
    hits = _vector_hits(spark, sf, 10).select(F.lit("index").alias("backend"), "query_id", "rank", F.col("vec_id").cast("string").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id", "left")
    asked = _index_queries(vectors).select("query_id", F.array(*map(F.lit, ("the", "re", "zzz"))).alias("words"))
    index = vector_index.build(vectors, scratch(spark, "vector-index"))
    held = index.manifest.agg(F.sum("rows")).first()[0] or 0
    indexed = vectors.select(F.col("vec_id").cast("string").alias("doc_id"))
    found = gate_metrics.collection(_gate_raw(spark, sf), _as_of()) | gate_metrics.normalization(headed, n_docs + 10, 4, {"press": (300, 0.99), "10-K": (900, 1.0)}) | gate_metrics.metadata_quality(docs, _as_of())
    found |= gate_metrics.chunk_quality(docs, chunks, sizes, _line_starts(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))) | gate_metrics.dedupe_quality(docs, chunks, kept)
    found |= gate_metrics.baseline(docs, chunks, table(spark, sf, "labels").count(), _as_of()) | gate_metrics.embedding_quality(vectors, n_vectors, 64, "embedding")
    found |= gate_metrics.index_quality(indexed, docs, n_vectors, vector_index.round_trip(index, vectors).first()["error_max"], evaluation.keyword_hits(hits, asked), {"pinecone": held})
    judged = gates.checks(gate_metrics.frame(spark, found), gates.rules_frame(spark, [r for r in gates.RULES if r.gate in ("G01", "G02", "G03", "G04", "G05", "S0", "S1", "S2")]))
    state = gates.states(judged).select("gate", F.col("status").alias("gate_status"))
    return judged.join(state, "gate").select("gate", "id", "metric", F.round("actual", 6).alias("actual"), "status", "gate_status")


@query
def semi_anti_integrity(spark, sf):
    docs, labels = _docs(spark, sf), table(spark, sf, "labels").select("doc_id")
    c = table(spark, sf, "customer")
    idle = c.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    counts = [("labelled", docs.join(labels, "doc_id", "left_semi")), ("unlabelled", docs.join(labels, "doc_id", "left_anti")), ("dangling", labels.join(docs, "doc_id", "left_anti")), ("idle_customers", idle)]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- cards and mails


def _mails(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.col("turn") % 5
    extra = F.when(n == 0, F.lit(" Guaranteed results, always.")).when(n == 1, F.lit("\n- one two three four five six seven eight nine ten\n- a b\n- c\n- d e f")).when(n == 2, F.lit(" 100% safe and risk-free")).otherwise("")
    return c.select("conv_id", "turn", F.concat("text", extra).alias("body"), F.when(F.col("conv_id") % 3 > 0, "Unsubscribe here").otherwise(" ").alias("unsubscribe_block"), F.when(F.col("conv_id") % 4 > 0, "ACME").alias("company_info_block"), F.lit("First card").alias("first_title"))


@query
def compliance_flags(spark, sf):
    critical, warning = cards.flags(F.col("body"), F.col("unsubscribe_block"), F.col("company_info_block"))
    return _mails(spark, sf).select("conv_id", "turn", F.array_join(critical, ",").alias("critical"), F.array_join(warning, ",").alias("warning"))


@query
def mail_negotiation(spark, sf):
    m = cards.negotiate(_mails(spark, sf))
    return m.select("conv_id", "turn", cards.shortened(F.col("body")).alias("body"), "unsubscribe_block", "company_info_block", F.array_join("critical", ",").alias("critical"), F.array_join("warning", ",").alias("warning"))


@query
def insight_cards(spark, sf):
    hits = _scored_hits(spark, sf, 10).select(F.concat(F.lit("s"), (F.col("query_id") % 7).cast("string")).alias("session"), (F.col("query_id") * 100 + F.col("in_rank")).cast("int").alias("place"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("chunk_id").cast("string").alias("doc_id"), F.lit("snippet").alias("snippet"), F.lit("").alias("title"), F.lit(None).cast("string").alias("html_title"), F.lit("Topic").alias("topic"), F.lit("").alias("final_url"), F.lit("u").alias("url"), F.col("day").cast("string").alias("publish_date"), F.when(F.col("chunk_id") % 2 == 0, F.col("domain")).otherwise("d0").alias("source_domain"), F.lit("").alias("text"))
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("press").alias("doctype"), F.lit("T").alias("title"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("publish_date"), "text", F.col("source").alias("source_domain"))
    return cards.select_cards(cards.candidates(hits), docs).select("session", "card_no", "id", "source_domain", "confidence")


# ---------------------------------------------------------------- relational idioms and extensions


@query
def pricing_summary(spark, sf):
    item = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return item.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(paid), 2).alias("sum_paid"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query
def revenue_by_nation(spark, sf):
    t = lambda name: table(spark, sf, name)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    r = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return r.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", F.round("v", 2).alias("revenue"))


@query
def top_orders_per_customer(spark, sf):
    o = retrieval.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return o.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query
def event_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.countDistinct("k").alias("distinct_k"))


@query
def event_windows(spark, sf):
    w = ev.windowed(table(spark, sf, "events"))
    return w.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query
def event_windows_streamed(spark, sf):
    """The same windows from a stream of the table's files, once all of it has been read."""
    path = scratch(spark, "windows")
    rows = ev.read_events(spark, f"{sf}/events.parquet")
    stream = ev.windowed(ev.deduplicated(rows), late=None).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", scratch(spark, "log"))
    stream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def source_rollup(spark, sf):
    d = _docs(spark, sf).rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return d.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "docs", "chars")


@query
def user_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)))
    e = e.withColumn("s", F.sum(F.when(F.col("gap") <= 1_800_000_000, 0).otherwise(1)).over(w))
    return e.groupBy("user_id").agg(F.max("s").alias("sessions"), F.count("*").alias("events"))


# ---------------------------------------------------------------- chunk assembly and its checks


@query
def chunk_assembly(spark, sf):
    d = _docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), "text", F.lit("wiki").alias("doctype"), F.lit(None).cast("string").alias("publish_date"), F.lit("u").alias("url"),
        F.lit("").alias("final_url"), F.lit("t").alias("topic"), F.array("lang").alias("persona_tags"), F.lit(0).alias("token_count"), F.lit(None).cast("array<struct<start_char:int,end_char:int>>").alias("item_spans"),
    )
    a = assembly.assemble(d, "ACME")
    return a.select("chunk_id", "start_char", "end_char", "word_count", "token_count", F.size("local_heads").alias("heads"), F.md5("text").alias("digest"), "metadata_snapshot.url")


def _sourced_chunks(spark, sf):
    return _chunks(spark, sf).join(_docs(spark, sf).select("doc_id", F.col("source").alias("doctype")), "doc_id")


@query
def doctype_baselines(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.col("source").alias("doctype"), tx.word_count(F.col("text")).alias("words"), tx.token_count(F.col("text")).alias("tokens"))
    return assembly.first_baselines(d, "doctype", F.col("doc_id"), ["words", "tokens"])


@query
def chunk_size_envelope(spark, sf):
    b = doctype_baselines(spark, sf).select("doctype", F.col("median_tokens"), F.lit(None).cast("long").alias("iqr_tokens"))
    e = assembly.size_envelope(_sourced_chunks(spark, sf), b)
    return e.select("doctype", "chunks", F.round("share", 6).alias("share"))


@query
def chunk_ends(spark, sf):
    e = assembly.end_flags(_chunks(spark, sf))
    return e.groupBy("is_first", "is_last").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def _line_starts(spark, sf):
    return chunking.line_starts(_docs(spark, sf).where(F.length("text") > 0))


@query
def boundary_alignment(spark, sf):
    a = chunking.aligned_starts(_chunks(spark, sf), _line_starts(spark, sf))
    return a.agg(F.count("*").alias("chunks"), F.count_if("aligned").alias("aligned"), F.sum("delta").cast("long").alias("total_delta"))


@query
def chunk_local_heads(spark, sf):
    """The two line starts before each window, by their numbers, as headings."""
    heads = _line_starts(spark, sf).select("doc_id", "pos", F.concat(F.lit("line "), F.col("line").cast("string")).alias("title"))
    c = chunking.with_heads(_chunks(spark, sf), heads)
    return c.select("doc_id", F.col("seq_no").cast("long").alias("seq_no"), F.array_join("local_heads", "|").alias("heads"))


# ---------------------------------------------------------------- groups, shares, thresholds


@query
def near_pairs_exempt(spark, sf):
    p = dedupe.near_pairs(_docs(spark, sf), exempt="source = 'src1'")
    return p.select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


@query
def largest_dup_groups(spark, sf):
    return dedupe.largest_groups(dedupe.components(dedupe.links(_docs(spark, sf))))


@query
def low_coverage_docs(spark, sf):
    """Documents of which repeated chunks left least: words of the chunks that stay by words of the document."""
    d = _docs(spark, sf).select(F.col("doc_id"), tx.word_count(F.col("text")).alias("words")).where("words > 0")
    words = _kept_chunks(_chunks(spark, sf)).groupBy("doc_id").agg(F.sum("word_count").alias("kept"))
    return dedupe.low_coverage(d.join(words, "doc_id", "left").select("doc_id", F.round(F.coalesce("kept", F.lit(0)) / F.col("words"), 6).alias("coverage")))


@query
def role_shares(spark, sf):
    s = evaluation.shares(table(spark, sf, "conversations"), "role", ["user", "assistant", "nobody"])
    return s.select("value", "n", F.round("share", 6).alias("share"), F.round("least_share", 6).alias("least_share"))


@query
def derived_thresholds(spark, sf):
    domains = table(spark, sf, "pages").agg(F.countDistinct(urls.host(F.col("url")))).first()[0]
    ages = table(spark, sf, "orders").select(F.datediff(F.lit("1998-12-01").cast("date"), "o_orderdate").alias("age"))
    age = ordering.percentiles(ages, "age", {"p50": ordering.nearest_rank(0.5)}).first()["p50"] or 0
    return gates.rules_frame(spark, gates.derived_rules(float(domains), float(age), {"faiss": 12.5, "pinecone": 2000.0})).select("gate", "id", "metric", *(F.round(c, 6).alias(c) for c in ("low", "high", "warn_low", "warn_high")))


@query
def least_keyword_hits(spark, sf):
    c = table(spark, sf, "conversations")
    hits = c.select(F.col("role").alias("backend"), F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), "text")
    asked = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("words", F.array(*map(F.lit, ("the", "re", "tion", "zzz"))))
    return evaluation.keyword_hits(hits, asked)


@query
def soft_recall(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = _vector_hits(spark, sf, 10).join(v, "vec_id").select("query_id", F.col("vec_id").alias("id"), F.col("label").alias("doc_id"), (F.col("vec_id") % 50).alias("seq_no"), "rank")
    expected = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("expected_id"), F.col("label").alias("expected_doc"), (F.col("vec_id") % 50).alias("seq_no"))
    s = evaluation.soft_hits(expected, hits.where("id <> query_id"), 5)
    return s.select("query_id", "hit", "near", F.col("gap").cast("long").alias("gap"))


@query
def seeded_shuffle(spark, sf):
    c = ordering.shuffled(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return c.select("c_custkey", (F.col("place") + 1).alias("place"))


@query
def drawn_with_replacement(spark, sf):
    d = ordering.with_replacement(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 100)
    return d.select("draw", "s_suppkey")


# ---------------------------------------------------------------- intake and payloads


@query
def json_payloads(spark, sf):
    e = table(spark, sf, "events").select("event_id", normalize.payloads(F.col("props"), F.lit(".json"), F.lit("")).alias("text"))
    return e.select("event_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def _built_pages(spark, sf):
    """Documents as pages: two articles, parts that are removed, and every third page without an article."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<nav>menu</nav><article><h1>One</h1><p>"), safe, F.lit('</p><div class="share">x</div></article><p>between</p><article><h2>Two</h2>more</article><footer>f</footer>'))
    bare = F.concat(F.lit("<script>var a = 1;</script><div>"), safe, F.lit('</div><div class="sidebar big">side</div>'))
    title = F.concat(F.lit("Page "), F.col("doc_id").cast("string"))
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), F.when(F.col("doc_id") % 3 > 0, body).otherwise(bare), F.lit("</body></html>")).alias("html"))


@query
def normalized_records(spark, sf):
    """Built pages through the whole normalisation: hosts' rules, kinds, days, languages, headings."""
    p = _built_pages(spark, sf)
    k = F.col("doc_id")
    raw = p.select(
        k.cast("string").alias("doc_id"), F.when(k % 5 == 0, "8-K").when(k % 5 == 1, "press").otherwise("product").alias("doctype"), F.lit("http://x/").alias("url"), F.when(k % 2 == 0, " ").alias("final_url"),
        F.when(k % 4 == 0, "www.salesforce.com").otherwise("example.net").alias("source_domain"), F.lit(".raw.html").alias("ending"), F.col("html").alias("payload"), F.when(k % 7 == 0, "fr").otherwise("en").alias("language"),
        F.when(k % 3 == 0, "2024-03-05").alias("visible_date"), F.lit("Wed, 05 Mar 2025 10:00:00 GMT").alias("rss_pubdate"), F.lit(None).cast("string").alias("last_modified_http"),
    )
    n = normalize.records(raw, "ACME")
    return n.select("doc_id", "doctype", "title", "publish_date", "final_url", "word_count", "hash_sha256")


@query
def saved_page_intake(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'), "html")).otherwise(F.col("html")).alias("html"), "url", "page_id")
    # pages that the manifest or the feed shouldn't know stand there under other names
    manifest = p.select(F.when(F.col("page_id") % 4 % 3 > 0, F.col("file")).otherwise(F.concat(F.lit("other-"), "file")).alias("file"), "url")
    feed = p.select(F.when(F.col("page_id") % 6 == 0, F.col("url")).otherwise(F.concat(F.lit("https://elsewhere.invalid/"), "file")).alias("link"), F.lit("Tue, 04 Mar 2025 23:30:00 -0500").alias("pub_date"))
    s = ingest.saved_pages(p.select("file", "html"), manifest, feed, spark.createDataFrame([], "doc_id string"), "crm")
    return s.select("file", "status", "requested_url", "source_domain", "rss_pubdate", "content_length", "notes", F.substring_index("doc_id", "::", -1).alias("url_digest"))


@query
def feed_limits(spark, sf):
    p = table(spark, sf, "pages").select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("feed"), F.col("url").alias("link"), F.col("page_id").alias("place"))
    f = ingest.feed_entries(p, p.select("link", "place"), {"even": 10, "odd": 5}, 25)
    return f.select("feed", "link", F.col("place").cast("long").alias("place"))


@query
def index_batches(spark, sf):
    m = ingest.index_manifests(table(spark, sf, "embeddings"), {"pinecone": "kb-chunks", "weaviate": "KbChunk"}, "vec_id", "embedding")
    return m.select("backend", "index_name", F.col("batch").cast("long").alias("batch"), "rows", "first_id", "last_id", F.col("dim").cast("long").alias("dim"))


@query
def link_variants(spark, sf):
    u = F.concat(F.substring_index("url", "#", 1), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_x=1&empty=&gclid=&fbclid=2&gclids=3#f"))
    return table(spark, sf, "pages").select("page_id", urls.strip_link(u).alias("link"))


@query
def recency_rows(spark, sf):
    as_of = F.lit("1997-06-30").cast("date")
    day = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate").cast("date"))
    o = table(spark, sf, "orders").select("o_orderkey", day.alias("day"), (F.col("o_orderstatus") == "O").alias("press"))
    o = o.where(metadata.in_window(F.col("day"), F.lit("1995-01-01").cast("date"), F.lit("1997-12-31").cast("date")))
    return o.select("o_orderkey", *metadata.recency_flags(F.col("day"), as_of, F.col("press")), dates.within_months(F.col("day"), as_of, 6).alias("within_6mo"))


@query
def utc_days(spark, sf):
    text = F.concat(F.date_format(F.col("o_orderdate").cast("date"), "EEE, dd MMM yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " 23:30:00 -0500").otherwise(" 00:30:00 +0200"))
    return table(spark, sf, "orders").select("o_orderkey", dates.utc_day(text).alias("day"))


@query
def stable_hashes(spark, sf):
    n = F.lower("n_name")
    return table(spark, sf, "nation").select("n_nationkey", vx.bucket(n, 768).cast("long").alias("bucket"), vx.sign(n).cast("long").alias("sign"))


@query
def dangling_points(spark, sf):
    from tessellon.operators import cards as own

    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("string").alias("id"), "role")
    return own.dangling(c.select("session", "id"), c.where("role = 'user'").select("session", "id"))


# ---------------------------------------------------------------- files written and read back


@query
def json_lines_read_back(spark, sf):
    """Documents' fields as JSON lines in two files by language, read with a schema; a broken line is kept apart."""
    path = scratch(spark, "json")
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    writers.json_lines(d.where("lang = 'en'"), path)
    writers.json_lines(d.where("lang <> 'en'"), path, append=True)
    spark.createDataFrame([('{"doc_id": 1, "lang": ',), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    good, bad = readers.json_records(spark, path, "doc_id long, lang string, source string, n_chars long")
    files = readers.line_counts(spark, path).agg(F.sum("lines").alias("n"))
    return good.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("value")).unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("lang"), "n", F.lit(0).cast("long").alias("value"))).unionByName(files.select(F.lit("lines").alias("lang"), "n", F.lit(0).cast("long").alias("value")))


@query
def versioned_update(spark, sf):
    """A table written, updated in one row, cut by a tenth and rolled back: rows and totals of each version, and how many parts it wrote."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    kept = versions.VersionedTable(spark, scratch(spark, "versions"), "c_custkey", 8)
    first = rows.agg(F.min("c_custkey")).first()[0]
    # other rows stay as they are: -0.0 plus 0.0 would be 0.0, a change; a null balance counts as none, as in the SQL twin
    changed = rows.withColumn("c_acctbal", F.when(F.col("c_custkey") == first, F.coalesce("c_acctbal", F.lit(0.0)) + 1.0).otherwise(F.col("c_acctbal")))
    made = [kept.write(rows), kept.update(changed), kept.update(changed), kept.remove(rows.where("c_custkey % 10 = 0")), kept.roll_back(1)]
    out = None
    for n in kept.versions():
        parts = None if n == 3 else len(next(v for v in made if v.number == n).written)
        one = kept.read(n).agg(F.count("*").alias("rows"), F.round(stats.exact_sum(F.col("c_acctbal")), 2).alias("total")).select(F.lit(n).cast("long").alias("version"), "rows", "total", F.lit(parts).cast("long").alias("parts_written"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def packed_documents(spark, sf):
    """Documents packed into files of about 256 KB, all counted by the manifest; three of them read by their files alone."""
    docs, folder = _docs(spark, sf).select("doc_id", "text"), scratch(spark, "packed")
    manifest = writers.packed_json_lines(docs, "doc_id", folder, 256 << 10)
    some = writers.read_packed(spark, folder, "doc_id long, text string", "doc_id", [0, 7, 19])
    every = manifest.agg(F.lit(-1).cast("long").alias("doc_id"), F.sum("rows").alias("n"), F.lit(None).cast("string").alias("digest"))
    return some.select("doc_id", F.lit(1).cast("long").alias("n"), F.md5("text").alias("digest")).unionByName(every)


def _raw_store(spark, sf):
    """Pages as a raw store: a sidecar for each, and its payloads (some have several, some none)."""
    n = F.col("page_id")
    folder = scratch(spark, "raw-store")
    name = F.concat(F.lit("p"), n.cast("string"))
    p = spread(table(spark, sf, "pages")).select(n, name.alias("doc_id"), F.col("url").alias("final_url"), F.when(n % 5 == 0, 404).otherwise(200).alias("http_status"), F.lit("é").alias("notes"), F.lit(None).cast("string").alias("headline"), "html")
    side = p.where("page_id % 4 > 0").select(F.concat("doc_id", F.lit(".meta.json")).alias("name"), writers.json_body("doc_id", "final_url", "http_status", "notes", "headline").alias("body"))
    kinds = F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 3 == 0, F.array(F.lit(".pdf"), F.lit(".raw.html"))).when(n % 3 == 1, F.array(F.lit(".raw.html"))).otherwise(F.array(F.lit(".json"), F.lit(".pdf")))
    files = p.select("doc_id", "html", F.explode(kinds).alias("kind")).select(F.concat("doc_id", "kind").alias("name"), F.concat("kind", "html").alias("body"))
    for rows in (side, files):
        writers.record_files(rows, folder).agg(F.sum("bytes")).collect()
    return folder


@query
def raw_by_sidecar(spark, sf):
    """Payloads of answered requests, the first kind of each, read after sidecars and paths are joined."""
    r = readers.eligible_raw(spark, _raw_store(spark, sf))
    return r.select("doc_id", "ending", "length", F.md5("content").alias("digest"), "notes")


@query
def sidecar_lookup(spark, sf):
    """Pages with their sidecars' fields, null where there is none."""
    side = readers.sidecars(spark, _raw_store(spark, sf))
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"))
    return readers.with_sidecars(p, side).select("doc_id", F.col("side_http_status").cast("long").alias("status"), F.col("side_final_url").alias("final_url"))


@query
def configured_routes(spark, sf):
    """The rules of a configuration file, checked and compiled: the same decisions as route_decisions."""
    rules = [{"if": {"has_keywords": keys}, "then": {"backend": backend, "reason": reason}} for keys, backend, reason in routing.RULES]
    body = json.dumps({"weights": routing.WEIGHTS, "persona_bias": routing.PERSONA_BACKEND, "rules": rules, "fallback_order": ["faiss", "weaviate", "pinecone"], "top_k_default": 10})
    folder = scratch(spark, "config")
    writers.record_files(spark.createDataFrame([("router.json", body)], "name string, body string"), folder).collect()
    made = config.router(config.load(spark, f"{folder}/router.json"))
    return _routed(spark, sf, made.decide)


@query
def csv_read_back(spark, sf):
    path = scratch(spark, "csv")
    writers.csv_with_header(table(spark, sf, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", "c_name").alias("tags")), path)
    return readers.csv_with_header(spark, path, "c_custkey long, c_name string, tags string")


@query
def parquet_read_back(spark, sf):
    path = scratch(spark, "parts")
    writers.parquet(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'F'").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def log_words(spark, sf):
    path = scratch(spark, "log")
    table(spark, sf, "events").select(F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 10 == 0, "ERROR").otherwise("ok"))).coalesce(1).write.text(path)
    return readers.log_hits(spark, path, ["ERROR", "ok", "none"]).select(F.col("ERROR").alias("errors"), F.col("ok").alias("fine"), F.col("none").alias("nothing"))


@query
def feed_items_read(spark, sf):
    """Feeds made of pages: their items' links, titles and days."""
    item = F.concat(F.lit("<item><title><![CDATA[ Page "), F.col("page_id").cast("string"), F.lit("]]></title><link> "), "url", F.lit(" </link><pubDate>Wed, 05 Mar 2025 22:00:00 -0500</pubDate></item>"))
    x = table(spark, sf, "pages").select((F.col("page_id") % 7).alias("feed"), item.alias("item")).groupBy("feed").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), "\n"), F.lit("</channel></rss>")).alias("xml"))
    i = readers.feed_items(x)
    return i.select("link", "title", dates.utc_day(F.col("pub_date")).alias("day"))


@query
def decoded_payloads(spark, sf):
    raw = F.concat(F.lit(b"\xff\xc3"), F.col("c_name").cast("binary"))
    return table(spark, sf, "customer").select("c_custkey", F.length(readers.decode_html(raw)).alias("chars"), F.md5(F.substring(readers.decode_html(raw), 3, 100)).alias("digest"))


@query
def prior_report(spark, sf):
    """Metrics with an earlier report's in the place of those that are missing."""
    now = _metrics(spark, sf).where("metric <> 'domains'")
    prior = spark.createDataFrame([("domains", 7.0), ("n_docs", 1.0)], "metric string, value double")
    m = gates.with_prior(now, prior)
    return m.select("metric", F.round("value", 6).alias("value"))
