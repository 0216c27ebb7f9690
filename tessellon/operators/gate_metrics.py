"""The metrics that the quality gates judge, gathered while their tables are read once.

Each function takes a stage's tables and returns a few named numbers. What can be summed is observed while narrow facts of the
rows are written (``observed``): the wide table is read once, and its metrics cost no further scan. Distinct counts and medians, which no sum can give,
are taken from the written facts. Shares of nothing are 0, as are medians of nothing unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import vectors
from tessellon.functions import text as tx
from tessellon.operators import assembly, chunking, metadata, ordering
from tessellon.operators.chunking import ChunkConfig
from tessellon.plans.session import drop, staged

Metrics = dict[str, float | None]
#: Fields that every document needs, and kinds of filings.
REQUIRED = ["doc_id", "company", "doctype", "title", "publish_date", "url", "final_url", "source_domain", "section", "topic", "persona_tags", "language", "text", "word_count", "token_count", "ingestion_ts", "hash_sha256"]
FILINGS = ("10-k", "10-q", "8-k", "ars_pdf")
#: The intake's buckets.
OTHER_BUCKETS = ("product", "dev_docs", "help_docs", "wikipedia")
OLDEST = "1999-01-01"


def observed(facts: DataFrame, name: str, sums: dict[str, Column]) -> tuple[DataFrame, Metrics]:
    """Writes the facts; the sums (aggregates without distinct) are gathered by the tasks that write."""
    seen = Observation(f"{name}-metrics")
    kept = staged(facts.observe(seen, *(c.cast("double").alias(k) for k, c in sums.items())), name)
    return kept, {k: seen.get.get(k) for k in sums}


def frame(spark: SparkSession, metrics: Metrics) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in sorted(metrics.items())], "metric string, value double")


def share(part: float | None, of: float | None) -> float:
    return (part or 0.0) / max(1.0, of or 0.0)


def middle(facts: DataFrame, x: str, nothing: float = 0.0) -> float:
    value = ordering.percentiles(facts, x, {"m": ordering.median}).first()["m"]
    return nothing if value is None else float(value)


def filled(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


# ---------------------------------------------------------------- G01 to G05


def collection(raw: DataFrame, as_of: Column) -> Metrics:
    """Sidecars: documents by bucket and feed, answered requests, exact copies, and how recent the press is (of dated press alone)."""
    day, press = F.coalesce("visible_date", "rss_pubdate"), F.col("doctype") == "press"
    age = F.datediff(as_of, day)
    news = F.col("source_bucket") == "newsroom"
    has = lambda mark: news & F.coalesce(F.col("notes").contains(mark), F.lit(False))
    sums = {
        "n": F.lit(True), "sec_docs": F.col("source_bucket") == "sec", "ir_docs": F.col("source_bucket") == "investor_news", "newsroom_docs": news, "corporate": has("feed=corporate"), "product": has("feed=product"),
        "other_docs": F.col("source_bucket").isin(*OTHER_BUCKETS), "ok": F.col("http_status") == 200, "dated": press & day.isNotNull(), "in12": press & (age <= 365), "in24": press & (age <= 730),
    }
    # one scan: first by payload digest, whose groups show the copies, then all together
    by_digest = raw.groupBy(tx.blank_to_null(F.col("sha256_raw")).alias("digest")).agg(*(F.count_if(c).alias(k) for k, c in sums.items()))
    copies = F.sum(F.when(F.col("digest").isNotNull() & (F.col("n") > 1), F.col("n")))
    m = by_digest.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums), F.coalesce(copies, F.lit(0)).alias("copies")).first()
    return {
        "sec_docs": m["sec_docs"], "ir_docs": m["ir_docs"], "newsroom_docs": m["newsroom_docs"], "least_feed": min(m["corporate"], m["product"]), "other_docs": m["other_docs"],
        "http_ok": share(m["ok"], m["n"]), "dup_rate": share(m["copies"], m["n"]), "within_12mo": share(m["in12"], m["dated"]), "within_24mo": share(m["in24"], m["dated"]),
    }


def normalization(docs: DataFrame, raw_docs: int, dropped: int, baselines: dict[str, tuple[int, float]]) -> Metrics:
    """Normalised documents with `ending`, `before_len` and `after_len` (their payload's kind, its length and what is left of it) against the number of raw
    ones and of those dropped on purpose. baselines: by kind the median word count and the median of what is retained; the least word
    count is 0.6 of the one, 200 at least, and press may retain 0.05 less than the other."""
    least = {k: max(200, int(0.6 * (words or 400))) for k, (words, _) in baselines.items()}
    floor = F.lit(max(200, int(0.6 * 400)))
    for kind, words in least.items():
        floor = F.when(F.col("doctype") == kind, words).otherwise(floor)
    facts = docs.select(
        F.when(F.col("doctype") == "press", F.when(F.col("before_len") > 0, F.col("after_len") / F.col("before_len")).otherwise(1.0)).alias("retained"),
        F.coalesce(F.col("language") == "en", F.lit(False)).alias("english"), F.coalesce(F.col("text").rlike("H[123]:"), F.lit(False)).alias("heading"),
        (F.coalesce("word_count", F.lit(0)) < floor).alias("short"), (F.coalesce(F.col("ending") == ".pdf", F.lit(False)) & F.col("pdf_page_map").isNull()).alias("unmapped"),
    )
    facts, m = observed(facts, "normalization", {"n": F.count(F.lit(1)), **{c: F.count_if(c) for c in ("english", "heading", "short", "unmapped")}})
    gap = middle(facts, "retained", 1.0) - baselines.get("press", (0, 1.0))[1]
    drop(facts)
    return {
        "coverage": share(m["n"], raw_docs - dropped), "english": share(m["english"], m["n"]), "too_short": m["short"] or 0.0, "press_retention_gap": gap, "headings": share(m["heading"], m["n"]), "page_map_missing": m["unmapped"] or 0.0,
    }


def metadata_quality(docs: DataFrame, as_of: Column, coverage: str = "sec_item_coverage_ratio") -> Metrics:
    """Required fields, spans of filings, topics, personas, ids and days of documents."""
    gaps = metadata.missing_fields([f for f in REQUIRED if f != "persona_tags"], dict(docs.dtypes))
    day = F.try_to_date(F.col("publish_date"), "yyyy-MM-dd")
    facts = docs.select(
        "doc_id", F.when(F.lower("doctype").isin(*FILINGS), F.coalesce(F.col(coverage), F.lit(0.0))).alias("spans"), (~((F.size(gaps) > 0) | F.col("persona_tags").isNull())).alias("whole"), filled("topic").alias("topical"),
        F.coalesce(F.size("persona_tags") > 0, F.lit(False)).alias("personal"), (filled("publish_date") & ~F.coalesce(day.between(F.lit(OLDEST).cast("date"), as_of), F.lit(False))).alias("undated"),
    )
    facts, m = observed(facts, "metadata", {"n": F.count(F.lit(1)), **{c: F.count_if(c) for c in ("whole", "topical", "personal", "undated")}})
    distinct = facts.select("doc_id").distinct().count()
    spans = middle(facts, "spans")
    drop(facts)
    return {
        "required": share(m["whole"], m["n"]), "span_coverage": spans, "topic": share(m["topical"], m["n"]), "persona": share(m["personal"], m["n"]), "unique_ids": float(distinct == (m["n"] or 0)), "invalid_dates": m["undated"] or 0.0,
    }


def chunk_quality(docs: DataFrame, chunks: DataFrame, baselines: DataFrame, bounds: DataFrame | None = None, cfg: ChunkConfig = ChunkConfig()) -> Metrics:
    """Chunks of documents (doc_id, doctype, token_count): how many there should be, their sizes for press, the likeness of neighbours, and how near
    filings' chunks start to a boundary (bounds: doc_id, pos). baselines as for assembly.size_envelope."""
    many = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    expected = F.ceil(F.col("token_count") / max(1, cfg.target - cfg.overlap))
    n = F.coalesce("chunks", F.lit(0))
    fits = (expected > 0) & (n >= F.floor(F.lit(0.6) * expected)) & (n <= F.ceil(F.lit(1.6) * expected))
    m = docs.join(many, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("fits")).first()
    own = chunks.join(docs.select("doc_id", "doctype"), "doc_id")
    press = assembly.size_envelope(own.where("doctype = 'press'"), baselines, target=cfg.target).first()
    out = {"count_ok": share(m["fits"], m["n"]), "press_envelope": 1.0 if press is None else press["share"], "adjacent_jaccard": middle(chunking.adjacent_similarity(chunks), "jaccard"), "alignment": 1.0}
    if bounds is not None:
        a = chunking.aligned_starts(own.where(F.lower("doctype").isin(*FILINGS)), bounds, cfg.tolerance).agg(F.count(F.lit(1)).alias("n"), F.count_if("aligned").alias("ok")).first()
        out["alignment"] = share(a["ok"], a["n"]) if a["n"] else 1.0
    return out


def dedupe_quality(docs: DataFrame, before: DataFrame, after: DataFrame) -> Metrics:
    """Chunks (doc_id, seq_no, text, word_count) before and after duplicates went: the share that went, how alike distant chunks of a document are, and how
    much of the documents' words is left."""
    had = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("had"))
    kept = after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("word_count").alias("words"))
    facts = docs.select("doc_id", "word_count").join(had, "doc_id", "left").join(kept, "doc_id", "left")
    covered = F.when(F.col("word_count") > 0, F.coalesce("words", F.lit(0)) / F.col("word_count")).otherwise(1.0)
    facts, m = observed(facts.select(F.coalesce("had", F.lit(0)).alias("had"), F.coalesce("kept", F.lit(0)).alias("kept"), covered.alias("covered")), "dedupe", {"had": F.sum("had"), "kept": F.sum("kept")})
    p95 = ordering.percentiles(chunking.distant_similarity(after), "jaccard", {"p": ordering.floor_index(0.95)}).first()["p"]
    left = middle(facts, "covered", 1.0)
    drop(facts)
    return {"dup_ratio": share((m["had"] or 0) - (m["kept"] or 0), m["had"]), "distant_p95": p95 or 0.0, "kept_coverage": left}


# ---------------------------------------------------------------- steps 0 to 2


def baseline(inventory: DataFrame, chunks: DataFrame, seeds: int, as_of: Column) -> Metrics:
    """Inventory (publish_date, source_domain) and chunks (token_count): what the later steps are measured against."""
    age = F.datediff(as_of, F.try_to_date(F.col("publish_date"), "yyyy-MM-dd"))
    facts = inventory.select(filled("publish_date").alias("dated"), age.alias("age"), tx.blank_to_null(F.col("source_domain")).alias("domain"))
    upto = {f"age_upto_{d}": F.count_if(F.col("age") <= d) for d in (90, 180, 365)}
    facts, m = observed(facts, "baseline", {"n": F.count(F.lit(1)), "n_docs": F.count_if("dated"), **upto, "age_over_365": F.count_if(F.col("age") > 365)})
    domains = facts.select("domain").where("domain is not null").distinct().count()
    ranks = {"p50": ordering.nearest_rank(0.5), "p90": ordering.nearest_rank(0.9)}
    ages = ordering.percentiles(facts, "age", ranks).first()
    drop(facts)
    tokens, n = observed(chunks.select("token_count"), "chunk-tokens", {"n_chunks": F.count(F.lit(1))})
    sizes = ordering.percentiles(tokens, "token_count", ranks).first()
    drop(tokens)
    docs, many = m["n_docs"] or 0.0, n["n_chunks"] or 0.0
    return {
        "n_docs": docs, "dated": share(docs, m["n"]), "n_seeds": float(seeds), "n_chunks": many, "chunks_per_doc": many / docs if docs else float(many >= docs), "domains": float(domains), **{k: m[k] or 0.0 for k in (*upto, "age_over_365")},
        "age_p50": ages["p50"] or 0, "age_p90": ages["p90"] or 0, "tokens_p50": sizes["p50"] or 0, "tokens_p90": sizes["p90"] or 0,
    }


def embedding_quality(embedded: DataFrame, chunks: int, dim: int, vec_col: str = "vector") -> Metrics:
    """Vectors against the number of chunks: their length, zeros, NaN, and norms far from the others'."""
    v = F.col(vec_col)
    facts = embedded.select(vectors.l2_norm(v).alias("norm"), (F.size(v) == dim).alias("right"), F.exists(v, F.isnan).alias("nan"))
    facts, m = observed(facts, "embeddings", {"n": F.count(F.lit(1)), "right": F.count_if("right"), "zero": F.count_if(F.col("norm") == 0), "nan": F.count_if("nan")})
    h = ordering.percentiles(facts, "norm", {"low": ordering.lower_hinge, "mid": ordering.median, "high": ordering.upper_hinge}).first()
    low, mid, high = (h[k] if h[k] is not None else h["mid"] for k in ("low", "mid", "high"))
    far = 0 if mid is None else facts.where(F.abs(F.col("norm") - mid) > 4 * max(0.0, high - low)).count()
    drop(facts)
    return {"embedded": (m["n"] or 0.0) / max(1, chunks), "dim_ok": float(m["right"] == m["n"]), "zero_vectors": m["zero"] or 0.0, "bad_values": m["nan"] or 0.0, "outlier_share": share(far, m["n"])}


def index_quality(indexed: DataFrame, docs: DataFrame, chunks: int, round_trip_error: float, answers: DataFrame, confirmed: dict[str, int] | None = None) -> Metrics:
    """Indexed rows (doc_id) against the number of chunks; documents' metadata (doctype, publish_date, url, final_url, title) that is missing for them; the index's
    round trip; and the least that test queries found (answers: least_hits, least_keywords by backend). confirmed: rows that other stores say they hold."""
    whole = filled("doctype") & filled("publish_date") & (filled("final_url") | filled("url")) & filled("title")
    known = docs.groupBy("doc_id").agg(F.bool_or(whole).alias("whole"))
    m = indexed.select("doc_id").join(known, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("whole", F.lit(False))).alias("missing")).first()
    found = answers.agg(F.min("least_hits").alias("hits"), F.min("least_keywords").alias("words")).first()
    rates = {f"{name}_rate": rows / max(1, chunks) for name, rows in (confirmed or {}).items()}
    return {"indexed": m["n"] / max(1, chunks), "missing_fields": share(m["missing"], m["n"]), "round_trip_error": round_trip_error, "least_hits": found["hits"] or 0, "least_keywords": found["words"] or 0, **rates}

