"""Readers of raw stores and documents, files by record, and rules from files."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tessellon.operators import gates, routing
from tessellon.plans import config
from tessellon.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().toString()


def test_raw_store(spark, tmp_path):
    side = {"a": 200, "b": 404, "c": 200, "d": 200}
    for k, status in side.items():
        (tmp_path / f"{k}.meta.json").write_text(json.dumps({"doc_id": k, "http_status": status, "final_url": f"https://{k}", "fetched_at": "2025-01-01T00:00:00"}, indent=2))
    os.mkdir(tmp_path / "deep")
    (tmp_path / "deep" / "a2.meta.json").write_text(json.dumps({"doc_id": "a", "http_status": 500, "final_url": "later", "fetched_at": "2025-02-01T00:00:00"}))
    (tmp_path / "broken.meta.json").write_text("{")
    for name, body in {"a.pdf": b"pdf", "a.raw.html": b"html \xff", "b.raw.html": b"b", "c.json": b"{}", "c.pdf": b"", "c.raw.html": b"", "e.pdf": b"lone"}.items():
        (tmp_path / name).write_bytes(body)
    paths = {r["doc_id"]: r["ending"] for r in readers.payload_paths(spark, str(tmp_path)).collect()}
    assert paths == {"a": ".raw.html", "b": ".raw.html", "c": ".json", "e": ".pdf"}
    found = readers.eligible_raw(spark, str(tmp_path))
    assert {r["doc_id"]: bytes(r["content"]) for r in found.collect()} == {"a": b"html \xff", "c": b"{}"}
    lines = plan(found.select("doc_id", "content")).split("== Physical Plan ==")[-1].splitlines()
    assert any("MapInArrow" in x for x in lines) and not any(re.search(r"\bcontent#", x.split(", [")[-1] if "MapInArrow" in x else x) for x in lines[[k for k, x in enumerate(lines) if "MapInArrow" in x][0] + 1 :])
    docs = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string")
    met = {r["doc_id"]: (r["side_http_status"], r["side_final_url"]) for r in readers.with_sidecars(docs, readers.sidecars(spark, str(tmp_path))).collect()}
    assert met == {"a": (500, "later"), "b": (404, "https://b"), "z": (None, None)}


def test_large_payloads_come_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "READ_BYTES", 5)
    for k in range(7):
        (tmp_path / f"f{k}").write_bytes(b"x" * k)
    rows = spark.createDataFrame([(k, f"file:{tmp_path}/f{k}") for k in range(7)], "k int, path string").coalesce(1)
    assert [(r["k"], len(r["content"])) for r in readers.with_content(rows).collect()] == [(k, k) for k in range(7)]
    assert readers.with_content(rows.limit(0)).count() == 0


def test_documents_and_their_malformed_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"doc_id": "a", "title": "old", "persona_tags": ["x"]}, indent=2))
    (tmp_path / "2.json").write_text(json.dumps({"doc_id": "a", "title": "new", "text": "two\nlines"}, indent=2))
    (tmp_path / "3.json").write_text('{"doc_id": ')
    good, bad = readers.documents(spark, str(tmp_path))
    assert [(r["doc_id"], r["title"], r["text"]) for r in good.collect()] == [("a", "new", "two\nlines")] and bad.count() == 1 and good.columns == [f.split()[0] for f in readers.NORMALIZED.split(", ")]


def test_eval_seed_and_its_fallback(spark, tmp_path):
    got = readers.eval_seed(spark, str(tmp_path / "none.jsonl"))
    assert got.count() == 45 and got.groupBy("persona").count().count() == 3 and got.where("eval_id is not null").count() == 0
    (tmp_path / "seed.jsonl").write_text('{"eval_id": "e", "persona": "cio", "query_text": "q"}\nbroken\n')
    assert [(r["eval_id"], r["persona"]) for r in readers.eval_seed(spark, str(tmp_path / "seed.jsonl")).collect()] == [("e", "cio")]


def test_files_by_record_change_only_if_they_must(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    df = spark.createDataFrame([("a", "ü", 1), ("b", None, 2)], "name string, text string, n int").withColumn("body", writers.json_body("name", "text", "n"))
    assert {r["name"]: r["written"] for r in writers.record_files(df, folder).collect()} == {"a": True, "b": True}
    assert (tmp_path / "out" / "a").read_text() == json.dumps({"name": "a", "text": "ü", "n": 1}, ensure_ascii=False, indent=2)
    before = os.stat(tmp_path / "out" / "a").st_mtime_ns
    again = df.withColumn("body", F.when(F.col("name") == "b", "other").otherwise(F.col("body")))
    assert {r["name"]: r["written"] for r in writers.record_files(again, folder).collect()} == {"a": False, "b": True}
    assert os.stat(tmp_path / "out" / "a").st_mtime_ns == before and (tmp_path / "out" / "b").read_text() == "other" and sorted(os.listdir(tmp_path / "out")) == ["a", "b"]


def test_gate_report_as_json(spark):
    checks = gates.checks(spark.createDataFrame([("m", 2.0)], "metric string, value double"), gates.rules_frame(spark, [gates.Rule("G", "1", "m", 1), gates.Rule("G", "2", "none", 1)]))
    got = json.loads(writers.report(checks, "G", "FAIL"))
    assert got["summary"] == {"PASS": 1, "WARN": 0, "FAIL": 1} and [c["status"] for c in got["checks"]] == ["PASS", "FAIL"] and got["checks"][1]["actual"] is None


ROUTER = {
    "weights": {"similarity": 0.5, "recency": 0.3, "diversity": 0.2}, "persona_bias": {"cio": "weaviate"}, "fallback_order": ["faiss", "weaviate", "pinecone"], "top_k_default": 7,
    "rules": [{"if": {"has_keywords": ["Gaap", "rpo"]}, "then": {"backend": "pinecone", "reason": "PR"}}, {"if": {"has_keywords": ["what is"]}, "then": {"backend": "faiss", "reason": "DEF"}}],
}


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_router_from_a_file(spark, tmp_path, kind):
    path = tmp_path / f"router.{kind}"
    if kind == "yaml":
        yaml = pytest.importorskip("yaml")
        path.write_text("# rules\n" + yaml.safe_dump(ROUTER))
    else:
        path.write_text(json.dumps(ROUTER, indent=2))
    made = config.router(config.load(spark, str(path)))
    assert made.top_k == 7 and made.weights["diversity"] == 0.2
    d = spark.createDataFrame([("GAAP what is", "x"), ("What is it", "cio"), ("one two three four five", "cio"), ("one two three four five", None), ("ab", None)], "q string, p string")
    got = [tuple(r[0]) for r in d.select(made.decide(F.col("q"), F.col("p"))).collect()]
    assert got == [("pinecone", "PR"), ("faiss", "DEF"), ("weaviate", "PERSONA_BIAS"), ("weaviate", "DEFAULT_WEAVIATE"), ("faiss", "DEFAULT_SHORT_FAISS")]


def test_an_empty_file_has_the_defaults(spark, tmp_path):
    (tmp_path / "c.json").write_text("")
    made = config.router(config.load(spark, str(tmp_path / "c.json")))
    assert made == config.Router() and made.weights["similarity"] == 0.6
    d = spark.createDataFrame([("gaap", "cio"), ("one two three four five", "cio")], "q string, p string")
    assert [r[0]["reason"] for r in d.select(made.decide(F.col("q"), F.col("p"))).collect()] == ["DEFAULT_SHORT_FAISS", "DEFAULT_WEAVIATE"]
    assert routing.PERSONA_BACKEND["cio"] == "weaviate"


@pytest.mark.parametrize("change, place", [
    ({"weights": {"similarity": "x"}}, "weights.similarity"), ({"weights": {"other": 1}}, "weights.other"), ({"weights": {"recency": -1}}, "weights"), ({"persona_bias": {"cio": "lucene"}}, "persona_bias.cio"), ({"rules": {}}, "rules"),
    ({"rules": [{"if": {"has_keywords": []}, "then": {"backend": "faiss", "reason": "r"}}]}, r"rules\[0\].if.has_keywords"), ({"rules": [{"if": {"has_keywords": ["a"]}, "then": {"backend": "x", "reason": "r"}}]}, r"rules\[0\].then.backend"),
    ({"fallback_order": ["faiss", "faiss"]}, "fallback_order"), ({"top_k_default": 0}, "top_k_default"),
])
def test_what_is_wrong_is_named(change, place):
    with pytest.raises(config.ConfigError, match=f"^{place}"):
        config.router(ROUTER | change)


def test_other_rules():
    assert config.tag_rules({"topics": {"T": ["Ab", "c"], "U": ["d"]}}, "topics") == [("T", ["ab", "c"]), ("U", ["d"])]
    made = config.chunking({"tokenizer": "cl100k_base", "target_tokens": 100, "overlap_tokens": 20, "short_doc_threshold_tokens": 50, "boundary_tolerance_chars": 5})
    assert (made.target, made.overlap, made.short, made.tolerance, made.least) == (100, 20, 50, 5, 120)
    with pytest.raises(config.ConfigError, match="overlap_tokens"):
        config.chunking({"overlap_tokens": 900})
    rules = config.gate_rules({"gates": {"S1": {"G1-04": {"metric": "outlier_share", "high": 0.005, "warn_high": 0.015}}}})
    assert rules == [gates.Rule("S1", "G1-04", "outlier_share", None, 0.005, None, 0.015)] and rules[0] in gates.RULES
    for wrong in ({"metric": "m"}, {"metric": "m", "low": 2, "high": 1}, {"low": 1}, {"metric": "m", "low": 1, "warn_low": 2}, {"metric": "m", "high": 1, "other": 1}):
        with pytest.raises(config.ConfigError, match=r"gates\.G\.1"):
            config.gate_rules({"gates": {"G": {"1": wrong}}})
