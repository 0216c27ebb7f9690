"""Quality gates: metrics against thresholds, and the state of a family of checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check passes if its metric lies in [low, high]; outside of these but in [warn_low, warn_high] it warns."""

    gate: str
    id: str
    metric: str
    low: float | None = None
    high: float | None = None
    warn_low: float | None = None
    warn_high: float | None = None


# The gates' checks and thresholds.
RULES = [
    Rule("G01", "COL-001", "sec_docs", 6), Rule("G01", "COL-002", "ir_docs", 16), Rule("G01", "COL-003", "newsroom_docs", 24), Rule("G01", "COL-004", "least_feed", 10),
    Rule("G01", "COL-005", "other_docs", 9, 11), Rule("G01", "COL-006", "http_ok", 0.99), Rule("G01", "COL-007", "dup_rate", None, 0.05), Rule("G01", "COL-008", "within_24mo", 0.70), Rule("G01", "COL-009", "within_12mo", 0.40),
    Rule("G02", "STD-001", "coverage", 0.98), Rule("G02", "STD-002", "english", 0.95), Rule("G02", "STD-003", "too_short", None, 0), Rule("G02", "STD-004", "press_retention_gap", -0.05), Rule("G02", "STD-005", "headings", 0.90), Rule("G02", "STD-006", "page_map_missing", None, 0),
    Rule("G03", "META-001", "required", 0.98), Rule("G03", "META-002", "span_coverage", 0.75), Rule("G03", "META-003", "topic", 0.90), Rule("G03", "META-004", "persona", 0.60), Rule("G03", "META-005", "unique_ids", 1), Rule("G03", "META-006", "invalid_dates", None, 0),
    Rule("G04", "CHK-001", "count_ok", 0.90), Rule("G04", "CHK-002", "press_envelope", 0.80), Rule("G04", "CHK-003", "adjacent_jaccard", 0.12, 0.22), Rule("G04", "CHK-004", "alignment", 0.90),
    Rule("G05", "DED-001", "dup_ratio", None, 0.15), Rule("G05", "DED-002", "distant_p95", None, 0.30), Rule("G05", "DED-003", "kept_coverage", 0.90),
    Rule("G06", "LNK-001", "link_ok", 1), Rule("G06", "LNK-002", "url_collisions", None, 0), Rule("G06", "LNK-003", "allowlisted", 1),
    Rule("G07", "EVAL-001", "seed_docs_found", 1), Rule("G07", "EVAL-002", "seed_chunks_found", 1), Rule("G07", "EVAL-003", "least_persona_share", 0.25),
    Rule("G08", "FIN-001", "required_final", 0.98), Rule("G08", "FIN-002", "allowlisted_final", 1), Rule("G08", "FIN-003", "dup_final", None, 0.15),
    Rule("S0", "G0-01", "n_docs", 80), Rule("S0", "G0-02", "dated", 0.98), Rule("S0", "G0-03", "n_seeds", 40), Rule("S0", "G0-04", "chunks_per_doc", 1), Rule("S0", "G0-05", "domains", 3),
    Rule("S1", "G1-01", "embedded", 1, 1), Rule("S1", "G1-02", "dim_ok", 1), Rule("S1", "G1-03a", "zero_vectors", None, 0), Rule("S1", "G1-03b", "bad_values", None, 0), Rule("S1", "G1-04", "outlier_share", None, 0.005, None, 0.015),
    Rule("S2", "G2-01", "pinecone_rate", 0.98, None, 0.97), Rule("S2", "G2-02", "weaviate_rate", 0.98, None, 0.97), Rule("S2", "G2-03", "indexed", 0.98, None, 0.97), Rule("S2", "G2-04", "missing_fields", None, 0.02, None, 0.03),
    Rule("S2", "G2-05", "round_trip_error", None, 1e-3, None, 0.01), Rule("S2", "G2-06", "least_hits", 3, None, 2), Rule("S2", "G2-07", "least_keywords", 1),
    Rule("S3", "G3-01", "valid_calls", 1), Rule("S3", "G3-02", "error_codes", 1), Rule("S3", "G3-03", "timeouts", None, 0.01),
    Rule("S4", "DIV-001", "domains_mean", 2.4, None, 2.3), Rule("S4", "FRS-001", "mean_age", None, 540), Rule("S4", "EMP-001", "empty_rate", None, 0),
    Rule("S5", "G5-01", "cards", 5), Rule("S5", "G5-02", "card_domains", 4), Rule("S5", "G5-03", "session_ms", None, 30_000), Rule("S5", "G5-04", "dangling_points", None, 0),
    Rule("S6", "G6-01", "critical_flags", None, 0), Rule("S6", "G6-02", "rounds", None, 2),
    Rule("S7", "G7-01", "recall_10", 0.80), Rule("S7", "G7-02", "ndcg_5", 0.60), Rule("S7", "G7-03", "eval_domains", 3), Rule("S7", "G7-04", "eval_age", None, 540),
]



def rules_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    rows = [(r.gate, r.id, r.metric, *(None if v is None else float(v) for v in (r.low, r.high, r.warn_low, r.warn_high))) for r in rules]
    return spark.createDataFrame(rows, "gate string, id string, metric string, low double, high double, warn_low double, warn_high double")


def checks(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics (metric, value) against rules: gate, id, metric, actual, threshold, status. A rule whose metric is missing or null fails."""
    r = rules.join(metrics, "metric", "left")
    v = F.col("value")
    inside = lambda low, high: (F.col(low).isNull() | (v >= F.col(low))) & (F.col(high).isNull() | (v <= F.col(high)))
    warned = (F.col("warn_low").isNotNull() | F.col("warn_high").isNotNull()) & (F.col("warn_low").isNull() | (v >= F.col("warn_low"))) & (F.col("warn_high").isNull() | (v <= F.col("warn_high")))
    status = F.when(v.isNull(), "FAIL").when(inside("low", "high"), "PASS").when(warned, "WARN").otherwise("FAIL")
    bound = F.concat_ws(" and ", F.concat(F.lit(">="), F.col("low").cast("string")), F.concat(F.lit("<="), F.col("high").cast("string")))
    return r.select("gate", "id", "metric", v.alias("actual"), "low", "high", bound.alias("threshold"), status.alias("status"))


def states(found: DataFrame) -> DataFrame:
    """gate and status. G families pass or fail. Steps are GREEN without failures and warnings, RED with failures, AMBER with warnings alone; in
    step 0 a lone failure within a tenth of its threshold is AMBER, and in step 7 a lone failure other than that of its first check. Step 2 is AMBER if
    of its first four checks one alone doesn't pass, and that warns, or if these and the fifth pass and the sixth warns; else RED unless all pass."""
    bound = F.coalesce("low", "high")
    near = F.abs(F.col("actual") - bound) <= 0.1 * F.abs(bound)
    failed, warned = F.col("status") == "FAIL", F.col("status") == "WARN"
    stores = F.col("id").isin("G2-01", "G2-02", "G2-03", "G2-04")
    g = found.groupBy("gate").agg(
        F.count_if(failed).alias("fails"), F.count_if(warned).alias("warns"), F.count_if(failed & F.coalesce(near, F.lit(False))).alias("near"), F.count_if(failed & F.col("id").endswith("-01")).alias("first"),
        F.count_if(stores & (failed | warned)).alias("missed"), F.count_if(stores & warned).alias("closely"), F.count_if((F.col("id") == "G2-05") & (failed | warned)).alias("fifth"), F.count_if((F.col("id") == "G2-06") & warned).alias("sixth"),
    )
    spared = (F.col("fails") == 1) & (((F.col("gate") == "S0") & (F.col("near") == 1)) | ((F.col("gate") == "S7") & (F.col("first") == 0)))
    step = F.when(spared, "AMBER").when(F.col("fails") > 0, "RED").when(F.col("warns") > 0, "AMBER").otherwise("GREEN")
    indexes = ((F.col("missed") == 1) & (F.col("closely") == 1)) | ((F.col("missed") == 0) & (F.col("fifth") == 0) & (F.col("sixth") == 1))
    second = F.when(F.col("fails") + F.col("warns") == 0, "GREEN").when(indexes, "AMBER").otherwise("RED")
    status = F.when(F.col("gate").startswith("G"), F.when(F.col("fails") > 0, "FAIL").otherwise("PASS")).when(F.col("gate") == "S2", second).otherwise(step)
    return g.select("gate", "fails", "warns", status.alias("status"))


def with_prior(metrics: DataFrame, prior: DataFrame) -> DataFrame:
    """metrics, and an earlier report's values for those that are missing."""
    p = prior.select("metric", F.col("value").alias("before"))
    return metrics.join(p, "metric", "full").select("metric", F.coalesce("value", "before").alias("value"))


#: The backends' documented latency budgets in ms.
BUDGETS = {"faiss": 300.0, "weaviate": 1000.0, "pinecone": 1500.0}


def derived_rules(domains: float, age_p50: float, p95: dict[str, float]) -> list[Rule]:
    """Checks whose thresholds come from the baseline: evaluated domains and their age, the routed hits' age (which warns up to a tenth above), and each
    backend's latency budget, the lesser of the documented one and 1.2 times what was seen."""
    fresh = float(max(365, int(age_p50)))
    rules = [
        Rule("S7", "G7-03", "eval_domains", max(3.0, 0.75 * domains / 10)), Rule("S7", "G7-04", "eval_age", None, max(540.0, age_p50)),
        Rule("S4", "FRS-001", "mean_age", None, fresh, None, fresh * 1.1),
    ]
    for name, seen in sorted(p95.items()):
        budget = min(BUDGETS[name], seen * 1.2)
        rules.append(Rule("S3", f"G3-03-{name}", f"latency_{name}", None, budget, None, budget * 1.1))
    return rules
