"""Steps whose work may not grow with what they don't need: one computation of an input, bounded groups."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.operators import cards, dedupe, lexical_index, normalize, ordering


def test_percentiles_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counting(x):
        seen.add(1)
        return x

    df = spark.range(100, numPartitions=2).select((F.col("id") % 3).alias("g"), counting(F.when(F.col("id") % 3 > 0, F.col("id"))).alias("x"))
    got = ordering.percentiles(df, "x", {"p": ordering.upper_median, "m": ordering.median}, ["g"]).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(0, None, None), (1, 49, 49.0), (2, 50, 50.0)]
    assert seen.value == 100


def test_cards_within_reach(spark):
    rng = random.Random(5)
    rows = []
    for session in range(12):
        names = ["", *(f"d{k}" for k in range(rng.choice([1, 2, 3, 40])))]
        for place in range(rng.choice([3, 8, 400])):
            rows.append((f"s{session}", place, f"c{rng.randrange(300)}", rng.choice([0.6, 0.7, 0.9]), rng.choice(names[:2]) if place < 6 else rng.choice(names)))
    fixed = {"title": "t", "summary": "s", "url": "u", "date": "", "evidence_snippet": "e", "doc_id": "1"}
    frame = pd.DataFrame([{"session": s, "place": p, "id": i, "confidence": c, "source_domain": d} | fixed for s, p, i, c, d in rows])
    docs = [("7", "press", "T", "u", None, "text", "other"), ("8", "wiki", "T", "u", None, "text", "d0"), ("9", "press", "T", "u", None, "text", "third")]
    docs = spark.createDataFrame(docs, "doc_id string, doctype string, title string, url string, publish_date string, text string, source_domain string")
    given = spark.createDataFrame(frame)
    spare = [{"id": f"synth::{k}::card", "source_domain": d, "confidence": 0.6} for k, d in (("7", "other"), ("8", "d0"), ("9", "third"))]
    want = {(s, k + 1, c["id"], c["source_domain"]) for s, own in frame.groupby("session") for k, c in enumerate(cards._pick(own.sort_values("place").to_dict("records"), spare, 5, 4))}
    got = cards.select_cards(given, docs).select("session", "card_no", "id", "source_domain").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert cards._within_reach(given, 5, 4).groupBy("session").count().agg(F.max("count")).first()[0] <= 50


def test_pages_reach_python_in_small_batches(spark, capsys):
    pages = spark.createDataFrame([("<p>a &amp; b</p>",), (None,)], "html string")
    for f, want in ((normalize.html_text, "a & b"), (normalize.html_lines, "a & b"), (normalize.full_text, "a & b"), (lambda h: normalize.payloads(h, F.lit(".html"), F.lit("x")), "a & b")):
        df = pages.select(f(F.col("html")).alias("t"))
        assert [r.t for r in df.collect()] == [want, ""]
        df.explain()
        assert "ArrowEvalPython" not in capsys.readouterr().out


def test_terms_in_python_are_the_same(spark):
    texts = ["", None, "A b-cd/ef_gh 12ab34 2024-03", "x" * 45, "Ünï ﬁx ﬃ ΑΣ İstanbul ß", *(f"a{c}b {c}{c} x" for c in list(tx._KNOWN)[::7]), *(f"q{c}r" for c in tx.SEVERAL)]
    low = F.lower(F.coalesce("t", F.lit("")))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(low.alias("low"), tx.terms(F.col("t")).alias("terms")).collect()
    assert [tx.terms_of(r.low) for r in rows] == [r.terms for r in rows]


def test_terms_are_hashed_in_step(spark):
    words = ["ab", "", "bg:ab_cdefghij", "x" * 44, "ab"]
    want = spark.createDataFrame([(w,) for w in words], "w string").select(vx.bucket(F.col("w"), 768), vx.sign(F.col("w"))).collect()
    got = lexical_index.Components(768).of(pa.array(["no", *words])[1:])
    assert [(g // 2, -1 if g % 2 else 1) for g in got.tolist()] == [tuple(r) for r in want]
    assert not len(lexical_index.Components(768).of(pa.array([], pa.string())))


@pytest.mark.parametrize("group", [1 << 20, 30_000])
def test_a_text_of_many_pairs_is_sent_for_its_family(spark, monkeypatch, group):
    monkeypatch.setattr(dedupe, "GROUP_SHINGLES", group, raising=False)
    rng = random.Random(9)
    texts = []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(300)]
        for _ in range(90):
            at = rng.sample(range(300), 2)
            texts.append([f"v{rng.random()}"[3:] if k in at else w for k, w in enumerate(words)])
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    d = spark.createDataFrame([(str(1000 + k), " ".join(t)) for k, t in enumerate(texts)], "doc_id string, text string")
    kept, staged = {}, dedupe.staged
    monkeypatch.setattr(dedupe, "staged", lambda df, name="stage": kept.setdefault(name, staged(df, name)))
    monkeypatch.setattr(dedupe, "drop", lambda *frames: None)
    got = {(int(r["id_a"]) - 1000, int(r["id_b"]) - 1000): round(r["jaccard"], 9) for r in dedupe.links(d).collect()}
    assert got == {p: round(j, 9) for p, j in likeness.items() if j >= 0.85} and len(got) > 11_000
    sent = kept["dealt"].select("group", F.explode(F.array("id_a", "id_b")).alias("id")).distinct().count()
    assert sent == 270 if group > 30_000 else 270 < sent <= 3 * 270  # not 24,000, two for each pair


def test_sets_are_not_stored(spark, monkeypatch):
    names, staged = [], dedupe.staged
    monkeypatch.setattr(dedupe, "staged", lambda df, name="stage": names.append((name, df.columns)) or staged(df, name))
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b"), (4, None)], "doc_id long, text string")
    assert [tuple(r) for r in dedupe.links(d).collect()] == [(1, 2, 1.0)]
    assert names and not any("s" in columns for _, columns in names)
