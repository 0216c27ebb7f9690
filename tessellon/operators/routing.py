"""Routing of queries, re-ranking of hits, and diversity of their domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import dates
from tessellon.functions import text as tx

# Rules (key words, backend, reason) in order, the personas' backends, and words of definitions.
RULES = [
    (["results", "earnings", "fiscal", "guidance", "gaap", "non-gaap", "rpo", "10-k", "10-q", "8-k"], "pinecone", "PR_QUERY"),
    (["api", "apis", "endpoint", "schema", "developer", "example"], "weaviate", "FILTER_MATCH"),
    (["definition", "what is", "overview"], "faiss", "DEFINITION"),
]
PERSONA_BACKEND = {"vp_sales_ops": "pinecone", "cio": "weaviate", "vp_customer_experience": "faiss"}
DEFINING = ["what is", "define", "definition", "overview"]
WEIGHTS = {"similarity": 0.5, "recency": 0.3, "diversity": 0.2}


def decide(query: Column, persona: Column | None = None, rules=None, bias=None) -> Column:
    """struct(backend, reason): the first rule whose key word occurs anywhere in the query, else the persona's backend, else the
    short or defining query's, else the default."""
    q = F.lower(F.coalesce(query, F.lit("")))
    pick = lambda backend, reason: F.struct(F.lit(backend).alias("backend"), F.lit(reason).alias("reason"))
    short = (F.regexp_count(q, F.lit(r"[^\s\p{Z}]+")) <= 4) | tx.contains_any(q, DEFINING)
    cases = [(tx.contains_any(q, keys), pick(backend, reason)) for keys, backend, reason in (RULES if rules is None else rules)]
    if persona is not None:
        cases += [(persona == name, pick(backend, "PERSONA_BIAS")) for name, backend in (PERSONA_BACKEND if bias is None else bias).items()]
    (test, value), *more = [*cases, (short, pick("faiss", "DEFAULT_SHORT_FAISS"))]
    out = F.when(test, value)
    for test, value in more:
        out = out.when(test, value)
    return out.otherwise(pick("weaviate", "DEFAULT_WEAVIATE"))


def similarity(score: Column, kind: str = "neg_distance") -> Column:
    """1 / (1 + |score|), right for negative distances; scores that are similarities stand as they are with kind "similarity"."""
    s = F.coalesce(score.try_cast("double"), F.lit(-1.0))
    return s if kind == "similarity" else 1 / (1 + F.abs(s))


def rescore(hits: DataFrame, as_of: Column, weights: dict[str, float] | None = None, kind: str = "neg_distance", bonus: float = 0.1) -> DataFrame:
    """hits (query_id, in_rank, score, day, domain) with their final score. The first hit of each known domain gets the bonus."""
    w = {"similarity": 0.6, "recency": 0.3, "diversity": 0.1} | (weights or {})
    first = F.row_number().over(Window.partitionBy("query_id", "domain").orderBy("in_rank")) == 1
    new = F.when(first & (F.coalesce("domain", F.lit("")) != ""), bonus).otherwise(0.0)
    final = w["similarity"] * similarity(F.col("score"), kind) + w["recency"] * dates.recency(F.col("day"), as_of) + w["diversity"] * new
    return hits.withColumn("final", final)


def capped(scored: DataFrame, k: int = 10, cap: int = 2) -> DataFrame:
    """All hits in their new order: the first k of those that are among their domain's best `cap`, then the rest by score.
    A missing domain is a domain of its own; cap 0 is no cap."""
    best = [F.col("final").desc(), F.col("in_rank")]
    own = F.row_number().over(Window.partitionBy("query_id", F.coalesce("domain", F.lit(""))).orderBy(*best))
    s = scored.withColumn("own", own).withColumn("fits", (F.col("own") <= cap) | F.lit(cap <= 0))
    nth = F.row_number().over(Window.partitionBy("query_id", "fits").orderBy(*best))
    s = s.withColumn("chosen", F.col("fits") & (nth <= max(1, k)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("chosen").desc(), *best))
    return s.withColumn("out_rank", place).drop("own", "fits")


def merge_diverse(main: DataFrame, others: list[DataFrame], as_of: Column, k: int = 10, cap: int = 2, least: int = 3, take: int = 30, weights=None) -> DataFrame:
    """Hits of queries whose first k hold fewer than `least` domains are joined by the first `take` hits of further backends, one after the
    other until enough domains are there; of a chunk's hits the first backend's stays. Columns query_id, chunk_id, in_rank,
    score, day, domain."""
    keep = ["query_id", "chunk_id", "in_rank", "score", "day", "domain"]
    pool = main.select(*keep, F.lit(0).alias("source"))
    state = capped(rescore(pool, as_of, weights), k, cap)
    for place, other in enumerate(others, 1):
        few = state.where(F.col("out_rank") <= k).groupBy("query_id").agg(F.countDistinct(F.nullif("domain", F.lit(""))).alias("domains")).where(F.col("domains") < least).select("query_id")
        more = other.where(F.col("in_rank") <= take).join(few, "query_id", "left_semi").select(*keep, F.lit(place).alias("source"))
        pool = pool.unionByName(more)
        once = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("source", "in_rank"))
        pool = pool.withColumn("once", once).where("once = 1").drop("once")
        pool = pool.withColumn("in_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "in_rank")))
        state = capped(rescore(pool, as_of, weights), k, cap)
    return state
