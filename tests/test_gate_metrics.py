"""Gate metrics on small tables worked out by hand, on empty tables and on nulls; the states of step 2."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessellon.operators import gate_metrics, gates

RAW = "source_bucket string, notes string, http_status int, sha256_raw string, doctype string, visible_date date, rss_pubdate date"
DOC = (
    "doc_id string, company string, doctype string, title string, publish_date string, url string, final_url string, source_domain string, section string, topic string, persona_tags array<string>, language string, text string, "
    "word_count int, token_count int, ingestion_ts timestamp, hash_sha256 string, sec_item_coverage_ratio double, ending string, pdf_page_map string, before_len int, after_len int"
)
CHUNK = "doc_id string, seq_no int, text string, token_count long, word_count long, start_char int"


def as_of():
    return F.lit("2025-09-08").cast("date")


def doc(**other):
    row = dict(
        doc_id="a", company="c", doctype="press", title="t", publish_date="2025-01-01", url="u", final_url="f", source_domain="d", section="s", topic="x", persona_tags=["p"], language="en", text="H1: text", word_count=300, token_count=300,
        ingestion_ts=datetime.datetime(2025, 1, 1), hash_sha256="h", sec_item_coverage_ratio=None, ending=".raw.html", pdf_page_map=None, before_len=100, after_len=98,
    ) | other
    return tuple(row.values())


def test_collection(spark):
    day = datetime.date
    rows = [
        ("sec", None, 200, "a", "10-K", None, None), ("sec", None, 200, "a", "10-K", None, None), ("newsroom", "feed=corporate", 200, " ", "press", day(2025, 9, 1), None), ("newsroom", "feed=product", 404, " ", "press", None, day(2024, 1, 1)),
        ("newsroom", "feed=product", None, None, "press", None, None), ("product", "", 200, "b", "product", None, None), (None, None, 200, "c", None, None, None),
    ]
    got = gate_metrics.collection(spark.createDataFrame(rows, RAW), as_of())
    assert got == {"sec_docs": 2, "ir_docs": 0, "newsroom_docs": 3, "least_feed": 1, "other_docs": 1, "http_ok": 5 / 7, "dup_rate": 2 / 7, "within_12mo": 0.5, "within_24mo": 1.0}


def test_documents(spark):
    rows = [
        doc(), doc(doc_id="b", title=" "), doc(doc_id="b", publish_date="1998-12-31", persona_tags=[]), doc(doc_id="c", publish_date="2025-09-09", topic=None), doc(doc_id="d", publish_date="x", persona_tags=None, language=None),
        doc(doc_id="e", doctype="10-K", sec_item_coverage_ratio=0.5, word_count=100, ending=".pdf", text="none", publish_date=""), doc(doc_id="f", doctype="8-K", word_count=None, ending=".pdf", pdf_page_map="m", text=None),
    ]
    docs = spark.createDataFrame(rows, DOC)
    got = gate_metrics.metadata_quality(docs, as_of())
    assert got == {"required": 2 / 7, "span_coverage": 0.25, "topic": 6 / 7, "persona": 5 / 7, "unique_ids": 0.0, "invalid_dates": 3}
    got = gate_metrics.normalization(docs, 12, 2, {"press": (600, 0.99)})
    assert got == {"coverage": 0.7, "english": 6 / 7, "too_short": 7, "press_retention_gap": pytest.approx(-0.01), "headings": 5 / 7, "page_map_missing": 1}


def test_chunks_and_duplicates(spark):
    docs = spark.createDataFrame([doc(doc_id="a", token_count=1360, word_count=8), doc(doc_id="b", doctype="10-K", token_count=0, word_count=0), doc(doc_id="n", token_count=10, word_count=4)], DOC)
    rows = [("a", 0, "one two three four", 600, 4, 0), ("a", 1, "one two", 90, 2, 10), ("a", 2, "one two three four", 80, 4, 40), ("b", 0, "x", 1, 1, 60), ("b", 1, "y", 1, 1, 300)]
    chunks = spark.createDataFrame(rows, CHUNK)
    sizes = spark.createDataFrame([("press", 700, 200)], "doctype string, median_tokens int, iqr_tokens int")
    bounds = spark.createDataFrame([("a", 0), ("b", 20), ("b", 100)], "doc_id string, pos int")
    got = gate_metrics.chunk_quality(docs, chunks, sizes, bounds)
    # a: two chunks are due, and three are within 1.6 times two, rounded up; n: one is due, and none is within 0.6 times one, rounded down; b: none is due
    assert got == {"count_ok": 2 / 3, "press_envelope": 2 / 3, "adjacent_jaccard": 0.5, "alignment": 0.5}
    got = gate_metrics.dedupe_quality(docs, chunks, chunks.where("not (doc_id = 'a' and seq_no = 2)"))
    assert got == {"dup_ratio": 0.2, "distant_p95": 0.0, "kept_coverage": 0.75}
    assert gate_metrics.dedupe_quality(docs, chunks, chunks)["distant_p95"] == 1.0


def test_steps(spark):
    docs = spark.createDataFrame([doc(), doc(doc_id="b", publish_date="2023-09-08", source_domain="e"), doc(doc_id="c", publish_date="soon", source_domain=" "), doc(doc_id="d", publish_date=None)], DOC)
    chunks = spark.createDataFrame([("a", k, "t", 100 * k, 1, 0) for k in range(5)], CHUNK)
    got = gate_metrics.baseline(docs, chunks, 7, as_of())
    assert got == {
        "n_docs": 3, "dated": 0.75, "n_seeds": 7, "n_chunks": 5, "chunks_per_doc": 5 / 3, "domains": 2, "age_upto_90": 0, "age_upto_180": 0, "age_upto_365": 1, "age_over_365": 1, "age_p50": 250, "age_p90": 731, "tokens_p50": 200, "tokens_p90": 400,
    }
    v = spark.createDataFrame([([1.0, 0.0],)] * 9 + [([0.0, 0.0],), ([float("nan"), 0.0],), ([1.0],)], "vector array<float>")
    got = gate_metrics.embedding_quality(v, 24, 2)
    assert got["embedded"] == 0.5 and (got["dim_ok"], got["zero_vectors"], got["bad_values"]) == (0.0, 1, 1)
    answers = spark.createDataFrame([("x", 4, 1), ("y", 2, 3)], "backend string, least_hits long, least_keywords int")
    got = gate_metrics.index_quality(spark.createDataFrame([("a",), ("c",), ("zz",), ("d",)], "doc_id string"), docs, 5, 0.25, answers, {"pinecone": 4})
    assert got == {"indexed": 0.8, "missing_fields": 0.5, "round_trip_error": 0.25, "least_hits": 2, "least_keywords": 1, "pinecone_rate": 0.8}


def test_empty_tables(spark):
    docs, chunks, none = spark.createDataFrame([], DOC), spark.createDataFrame([], CHUNK), spark.createDataFrame([], RAW)
    assert set(gate_metrics.collection(none, as_of()).values()) == {0}
    assert gate_metrics.metadata_quality(docs, as_of())["required"] == 0 and gate_metrics.normalization(docs, 0, 0, {})["coverage"] == 0
    sizes = spark.createDataFrame([], "doctype string, median_tokens int, iqr_tokens int")
    assert gate_metrics.chunk_quality(docs, chunks, sizes)["press_envelope"] == 1 and gate_metrics.dedupe_quality(docs, chunks, chunks)["dup_ratio"] == 0
    assert gate_metrics.baseline(docs, chunks, 0, as_of())["n_docs"] == 0
    assert gate_metrics.embedding_quality(spark.createDataFrame([], "vector array<float>"), 0, 2)["embedded"] == 0


def test_observed_metrics_cost_no_scan_of_their_own(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "long")
    facts, got = gate_metrics.observed(spark.read.parquet(str(tmp_path / "t")).select(counted("id").alias("id")), "facts", {"n": F.count(F.lit(1)), "total": F.sum("id")})
    assert got == {"n": 1000.0, "total": 499500.0} and seen.value == 1000 and facts.count() == 1000


@pytest.mark.parametrize("values, state", [
    ({}, "GREEN"), ({"indexed": 0.975}, "AMBER"), ({"indexed": 0.975, "missing_fields": 0.025}, "RED"), ({"indexed": 0.5}, "RED"), ({"least_hits": 2}, "AMBER"), ({"least_hits": 2, "round_trip_error": 0.005}, "RED"), ({"round_trip_error": 0.005}, "RED"),
    ({"indexed": 0.975, "least_keywords": 0}, "AMBER"),
])
def test_state_of_step_2(spark, values, state):
    good = {"pinecone_rate": 1, "weaviate_rate": 1, "indexed": 1, "missing_fields": 0, "round_trip_error": 0, "least_hits": 10, "least_keywords": 2}
    judged = gates.checks(gate_metrics.frame(spark, good | values), gates.rules_frame(spark, [r for r in gates.RULES if r.gate == "S2"]))
    assert gates.states(judged).first()["status"] == state
