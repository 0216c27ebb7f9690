"""Operators on tiny tables: edge cases and invariants."""

import random
import statistics

from pyspark.sql import functions as F

from tessellon.functions import stats, vectors
from tessellon.operators import cards, chunking, dedupe, evaluation, gates, metadata, normalize, retrieval, routing
from tessellon.sources import readers, writers


def test_page_text():
    html = '<html><nav>n</nav><article><h1>T</h1><p>a<p>b &amp; c<script>var x="</p>";</script><div class="share x">s</div></article><footer>f</footer>'
    assert normalize.page_text(html) == "H1: T a b & c"
    assert normalize.page_text(html, keep_lines=True) == "H1: T\na\nb & c"
    assert normalize.page_text(None) == "" and normalize.page_text("plain") == "plain"


def test_references_without_their_end_stay():
    assert normalize.page_text("<h1>a&amp</h1><p>b &lt; c &copy;") == "H1: a&amp b < c ©"
    assert normalize.page_text("x &ampy; && &#65; &#66 &nope; <script>a && b</script>") == "x &ampy; && A &#66 &nope;"
    assert normalize.page_text("<script>a && b &lt</script>c", remove=()) == "a && b &lt c"


def test_canonical(spark):
    rows = [('<link href="https://a/x?utm_source=1" rel="canonical">',), ('<meta content="https://b" property="og:url">',), ('<a data-share-url="https://c">',), ("<p>",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(normalize.canonical_url(F.col("h"))).collect()]
    assert got == ["https://a/x", "https://b", "https://c", None]


def test_chunks_cover_every_character(spark):
    rng = random.Random(1)
    docs = [(k, " ".join("w" * rng.randint(1, 9) for _ in range(n))) for k, n in enumerate([0, 1, 349, 350, 800, 801, 1500, 2300])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for doc, text in docs:
        got = sorted((r["start_char"], r["end_char"]) for r in chunking.windows(d).where(F.col("doc_id") == doc).collect())
        if not text:
            assert not got
            continue
        assert got[0][0] == 0 and got[-1][1] == len(text) - 1
        assert all(b[0] <= a[1] + 1 for a, b in zip(got, got[1:], strict=False))


def test_snapped_starts(spark):
    d = spark.createDataFrame([(2000, [0, 650, 1340])], "n int, b array<int>")
    got = d.select(chunking.snapped_starts(F.col("n"), F.lit(800), F.lit(680), F.col("b"))).first()[0]
    assert got == [0, 650, 1340]


def test_item_spans(spark):
    d = spark.createDataFrame([(1, "intro\nItem 1. Business\nx\nItem 1A. Risk Factors\nItem 2.02 Results"), (2, "none")], "doc_id long, text string")
    got = [(r["label"], r["title"], r["start_char"], r["end_char"]) for r in chunking.item_spans(d).orderBy("start_char").collect()]
    assert [g[:3] for g in got] == [("Item 1", "Business", 6), ("Item 1A", "Risk Factors", 25), ("Item 2.02", "Results", 47)]
    assert got[0][3] == 24


def test_near_pairs_and_components(spark):
    base = [f"w{k}" for k in range(40)]
    docs = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "x", "y"])), (4, "a b c d"), (5, "other words " * 9), (6, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word_count", F.length("text"))
    pairs = dedupe.near_pairs(d)
    assert {(r["id_a"], r["id_b"]) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r["id"], r["component"]) for r in dedupe.components(pairs).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {r["doc_id"] for r in dedupe.kept(d, pairs).collect()} == {3, 4, 5, 6}
    assert dedupe.near_pairs(d, exempt="doc_id = 2").count() == 1


def test_long_chain_components(spark):
    n = 60
    order = list(range(n))
    random.Random(5).shuffle(order)
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)], "id_a long, id_b long")
    got = dedupe.components(pairs).collect()
    assert len(got) == n and {r["component"] for r in got} == {0}


def test_routing(spark):
    d = spark.createDataFrame([("GAAP results", "cio"), ("capital", "cio"), ("hello there", "cio"), ("x", None), ("one two three four five", None), (None, None)], "q string, p string")
    got = [tuple(r[0]) for r in d.select(routing.decide(F.col("q"), F.col("p"))).collect()]
    assert got == [("pinecone", "PR_QUERY"), ("weaviate", "FILTER_MATCH"), ("weaviate", "PERSONA_BIAS"), ("faiss", "DEFAULT_SHORT_FAISS"), ("weaviate", "DEFAULT_WEAVIATE"), ("faiss", "DEFAULT_SHORT_FAISS")]


def greedy(rows, k, cap):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    chosen, n = [], {}
    for r in rows:
        if len(chosen) < k and (cap <= 0 or n.get(r[2] or "", 0) < cap):
            chosen.append(r)
            n[r[2] or ""] = n.get(r[2] or "", 0) + 1
    return [r[0] for r in chosen + [r for r in rows if r not in chosen]]


def test_domain_cap_is_the_greedy_choice(spark):
    rng = random.Random(2)
    for cap in (0, 1, 2):
        rows = [(k, rng.randint(0, 5) / 5, rng.choice(["a", "b", None])) for k in range(15)]
        d = spark.createDataFrame([(1, *r) for r in rows], "query_id long, in_rank long, final double, domain string")
        got = [r["in_rank"] for r in routing.capped(d, 4, cap).orderBy("out_rank").collect()]
        assert got == greedy(rows, 4, cap)


def test_rescore_kinds(spark):
    d = spark.createDataFrame([(1, 1, "0.5", None, None)], "query_id long, in_rank long, score string, day date, domain string")
    as_of = F.lit("2025-01-01").cast("date")
    assert abs(routing.rescore(d, as_of).first()["final"] - (0.6 / 1.5 + 0.3 * 0.3)) < 1e-12
    assert abs(routing.rescore(d, as_of, kind="similarity").first()["final"] - (0.6 * 0.5 + 0.3 * 0.3)) < 1e-12


def test_nearest_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(9)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    one = {tuple(r) for r in retrieval.nearest(v, q, 3).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in retrieval.nearest(v, q, 3).collect()} == one


def test_nearest_nulls_lengths_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 20)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng, nan, inf = random.Random(4), float("nan"), float("inf")
    some = [[rng.choice([0.1, 0.7, -0.3]) for _ in range(3)] for _ in range(40)] + [[0.5, 0.5, 0.5]] * 30
    some += [None, [0.1, None, 0.2], [0.1], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [], [1e30, 1e30, 0.0]]
    rng.shuffle(some)
    v = spark.createDataFrame(list(enumerate(some)), "vec_id long, embedding array<float>")
    q = v.select((F.col("vec_id") + 1000).alias("query_id"), F.col("embedding").alias("query_vec"))
    d2 = vectors.squared_distance(F.col("embedding"), F.col("query_vec"))
    want = v.crossJoin(q).select("query_id", "vec_id", d2.alias("d2"))
    want = retrieval.top_k(want, ["query_id"], [F.col("d2").asc_nulls_last(), F.col("vec_id")], 5)
    rows = lambda df: sorted(map(str, df.select("query_id", "rank", "vec_id", "d2").collect()))
    got = retrieval.nearest(v, q, 5)
    assert rows(got) == rows(want)
    # nothing is broadcast, and no expression goes over pairs of vectors
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_gain_of_rank_zero(spark):
    r = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "query_id long, rank long")
    assert [x[0] for x in r.orderBy("query_id").select(evaluation.gain(F.col("rank"))).collect()] == [float("inf"), 1.0, 0.0]


def test_gate_bands(spark):
    rules = gates.rules_frame(spark, [gates.Rule("S1", "G1-04", "m", None, 0.005, None, 0.015), gates.Rule("G01", "a", "none", 1), gates.Rule("S0", "G0-01", "n", 100)])
    m = spark.createDataFrame([("m", 0.005), ("n", 95.0)], "metric string, value double")
    got = {r["id"]: r["status"] for r in gates.checks(m, rules).collect()}
    assert got == {"G1-04": "PASS", "a": "FAIL", "G0-01": "FAIL"}
    m = spark.createDataFrame([("m", 0.015), ("n", 95.0)], "metric string, value double")
    states = {r["gate"]: r["status"] for r in gates.states(gates.checks(m, rules)).collect()}
    assert states == {"S1": "AMBER", "G01": "FAIL", "S0": "AMBER"}


def test_recall_and_gain(spark):
    r = spark.createDataFrame([(1, 1), (2, 5), (3, 6), (4, None)], "query_id long, rank long")
    got = evaluation.recall_and_gain(r).first()
    assert (got["recall_1"], got["recall_5"], got["recall_10"]) == (0.25, 0.5, 0.75)
    assert abs(got["ndcg_5"] - (1 + 1 / 2.584962500721156) / 4) < 1e-9


def test_flags_and_negotiation(spark):
    body = "Guaranteed double results.\n" + "\n".join("- " + "word " * 40 for _ in range(5))
    m = spark.createDataFrame([(body, "", None, "Card")], "body string, unsubscribe_block string, company_info_block string, first_title string")
    first = m.select(*cards.flags(F.col("body"), F.col("unsubscribe_block"), F.col("company_info_block"))).first()
    assert first["critical"] == ["MISSING_UNSUBSCRIBE", "MISSING_COMPANY_INFO", "UNCITED_CLAIM", "PROHIBITED_PHRASE"]
    assert "EXCESS_LENGTH" in first["warning"]
    last = cards.negotiate(m).first()
    assert last["unsubscribe_block"] and last["company_info_block"] and last["body"].count("\n- ") <= 3


def test_card_choice():
    c = lambda k, d, conf=0.7: {"id": k, "source_domain": d, "confidence": conf}
    got = cards._pick([c(1, "a"), c(2, "a"), c(3, "a"), c(4, "a"), c(5, "a"), c(6, "b")], [c(7, "z", 0.6), c(8, "y", 0.6)], 5, 4)
    assert len(got) == 5 and len({x["source_domain"] for x in got}) == 4
    assert cards._pick([], [], 5, 4) == []


def test_link_states_and_fields(spark):
    d = spark.createDataFrame([("https://x.y/1?utm_a=1", None, None, False), ("https://ok.org/", None, None, False), ("https://x.y/2", "https://z/2", 200, False)], "url string, side_url string, side_status int, has_payload boolean")
    got = [(r["final_url"], r["link_ok"], r["status_code"]) for r in metadata.link_state(d, ["ok.org"]).collect()]
    assert got == [("https://x.y/1", False, 0), ("https://ok.org/", False, 0), ("https://x.y/2", False, 0)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.meta.json").write_text('{"doc_id": "a", "http_status": 200}')
    (tmp_path / "b.meta.json").write_text('{"doc_id": "b", "http_status": 404}')
    (tmp_path / "a.raw.html").write_text("<p>x")
    (tmp_path / "a.pdf").write_text("pdf")
    got = readers.eligible_raw(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], bytes(r["content"])) for r in got] == [("a", b"<p>x")]
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "1", "seq_no": 2}\nbroken\n')
    good, bad = readers.json_records(spark, str(tmp_path / "c.jsonl"), readers.CHUNK)
    assert (good.count(), bad.count()) == (1, 1)
    writers.csv_with_header(spark.createDataFrame([(1, ["a", "b"])], "k long, tags array<string>"), str(tmp_path / "out"))
    assert readers.csv_with_header(spark, str(tmp_path / "out"), "k long, tags string").first()["tags"] == "a,b"
    feed = spark.createDataFrame([("<rss><item><title>T</title><link>u</link><pubDate>d</pubDate></item></rss>",)], "xml string")
    assert tuple(readers.feed_items(feed).first()) == ("u", "T", "d")


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, word_count long")
    assert dedupe.near_pairs(d).count() == 0 and chunking.windows(d).count() == 0
    assert dedupe.kept(d, dedupe.near_pairs(d)).count() == 0


def test_all_containers_of_a_kind_are_read():
    html = "<html><body><nav>n</nav><article><h1>One</h1><p>a</p></article><p>between</p><article>b<article>c</article>d</article></body></html>"
    assert normalize.page_text(html) == "H1: One a b d c"
    assert normalize.page_text("<main>m</main><article>a</article>") == "a"
    assert normalize.page_text("<p>x</p>") == "x"


def test_link_states(spark):
    rows = [
        (1, "http://a.example.org/x?utm_source=q", "https://a.example.org/y", 200, True),
        (2, "http://a.example.org/x", "https://a.example.org/y", 200, False),
        (3, "http://a.example.org/x", "https://else.net/y", 200, True),
        (4, "http://else.net/x", "https://a.example.org/y?gclid=3", 404, True),
        (5, "http://else.net/x", None, 404, True),
        (6, "http://else.net/x", None, None, None),
    ]
    d = spark.createDataFrame(rows, "id long, url string, side_url string, side_status int, has_payload boolean")
    got = {r["id"]: (r["final_url"], r["link_ok"], r["status_code"]) for r in metadata.link_state(d, ["example.org"]).collect()}
    assert got == {
        1: ("https://a.example.org/y", True, 200), 2: ("http://a.example.org/x", False, 0), 3: ("http://a.example.org/x", True, 200),
        4: ("https://a.example.org/y", True, 404), 5: ("http://else.net/x", False, 404), 6: ("http://else.net/x", False, 0),
    }


def test_titles_of_items(spark):
    d = spark.createDataFrame([(1, "ITEM 1A the risk of it\nItem 7.\nItem 7A Other\nItem 8 Financial Data")], "doc_id long, text string")
    got = [(r["label"], r["title"]) for r in chunking.item_spans(d).orderBy("start_char").collect()]
    assert got == [("Item 1A", "Risk Factors"), ("Item 7", "Management’s Discussion and Analysis"), ("Item 7A", "Other"), ("Item 8", "Financial Statements")]


def test_hinges_of_a_column(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 500, 1001):
        values = sorted(rng.choice([rng.random(), 0.5, 0.25]) for _ in range(n))
        df = spark.createDataFrame([(v,) for v in values], "x double")
        half = n // 2
        want = tuple(map(statistics.median, (values[:half] or values, values, values[n - half :] if half else values))) if n else (0.0, 0.0, 0.0)
        assert stats.hinge_values(df, "x") == want


def test_marks_of_a_text_of_many_lines(spark):
    """Starts, headings and boundaries of a text of 200,000 lines, in time that follows its length."""
    import time

    begun = time.time()
    n = 200_000
    d = spark.createDataFrame([("a", "seven c\n" * n), ("b", "")], "doc_id string, text string")
    starts = chunking.line_starts(d)
    assert starts.where("doc_id = 'a'").agg(F.count("*"), F.max("pos"), F.max("line")).first()[:] == (n + 2, 8 * n + 1, n + 1)
    chunks = spark.range(0, 8 * n, 680).select(F.lit("a").alias("doc_id"), F.col("id").alias("start_char"))
    got = chunking.aligned_starts(chunks, starts.where("pos % 16 = 0"))
    assert got.where("delta <> least(start_char % 16, 16 - start_char % 16)").count() <= 1 and got.count() == chunks.count()
    heads = chunking.with_heads(chunks, starts.where("line % 2 = 0").select("doc_id", "pos", F.col("line").cast("string").alias("title")))
    last = F.floor(F.col("start_char") / 16) * 2
    assert heads.where(F.col("local_heads")[0] != last.cast("string")).count() == 0 and heads.where("start_char >= 16").where(F.col("local_heads")[1] != (last - 2).cast("string")).count() == 0
    marks = starts.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("b"))
    found = d.where("doc_id = 'a'").join(marks, "doc_id").select(chunking.snapped_starts(F.length("text"), F.lit(800), F.lit(681), F.col("b"))).first()[0]
    assert found[:3] == [0, 680, 1360] and found[-1] + 800 >= 8 * n
    assert time.time() - begun < 90


def test_near_links_lose_nothing_among_frequent_passages(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "MOST_FREQUENT", 30)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 999)}" for _ in range(60)] + passage
        texts += [words, words[: rng.randint(80, 90)], [rng.choice(("x", w)) if rng.random() < 0.03 else w for w in words], words]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["id_a"], r["id_b"]): round(r["jaccard"], 9) for r in dedupe.near_pairs(d).collect()}
    assert got == {p: round(j, 9) for p, j in likeness.items() if j >= 0.85}
    own = dedupe._prefixes(dedupe.shingle_sets(d, "doc_id", "text", 5), 0.85)
    assert own.where("size(own) <> n - ceil(0.85 * n - 1e-9) + 1").count() == 0


def test_windows_count_a_text_once(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = chunking.windows(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") < 10  # an inlined count stood there 336 times
