"""Scalar functions against values worked out by hand or in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessellon.functions import dates, stats, urls, vectors
from tessellon.functions import text as tx
from tessellon.operators import ordering


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'array<string>'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "slug"), [("Hello,  World!", "hello-world"), ("--A--b", "a-b"), ("", ""), ("é", ""), ("x" * 90, "x" * 80)])
def test_slug(spark, text, slug):
    assert one(spark, tx.slugify(F.col("t")), t=text) == slug


def test_word_counts(spark):
    for text in ["", "a", "naïve café", "x-y z_1", "  ", "日本 語", None]:
        assert one(spark, tx.word_count(F.col("t")), t=text) == len(re.findall(r"\b\w+\b", text or ""))
        assert one(spark, tx.token_count(F.col("t")), t=text) == len((text or "").split())


def grade(text):
    words = re.findall(r"\b\w+\b", text)
    sents = max(1, len([s for s in re.split(r"[.!?]+", text) if s.strip()]))
    syl = max(1, sum(len(re.findall(r"[aeiouyAEIOUY]", w)) or 1 for w in words))
    return 0.39 * (max(1, len(words)) / sents) + 11.8 * (syl / max(1, len(words))) - 15.59


@pytest.mark.parametrize("text", ["", "One. Two three!", "Queue rhythm?? 42 bcd"])
def test_readability(spark, text):
    assert one(spark, tx.readability_grade(F.col("t")), t=text) == pytest.approx(grade(text))


def test_shingles_and_jaccard(spark):
    assert one(spark, tx.shingles(F.split("t", " ")), t="a b c d e f") == ["a b c d e", "b c d e f"]
    assert one(spark, tx.shingles(F.split("t", " ")), t="a b c d") == []
    both = tx.jaccard(F.split("t", " "), F.split("u", " "))
    assert one(spark, both, t="a b c", u="b c d") == 0.5
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), t="") == 0.0


def test_normalize_and_terms(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t=" Déjà-vu/2024  œuf ") == "deja vu 0 uf"
    assert one(spark, tx.normalize_text(F.col("t")), t="ﬁne ² Ａ ½ №7") == "fine 0 a 0 No0"
    assert one(spark, tx.terms(F.col("t")), t="Ab cd e") == ["ab", "cd", "bg:ab_cd"]
    assert one(spark, tx.terms(F.col("t")), t="") == []


def fnv(text, seed=vectors.SEED):
    h = 0xCBF29CE484222325 ^ seed
    for c in text.encode():
        h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def test_fnv_limbs(spark):
    rng = random.Random(3)
    texts = ["", "a", "bg:a_b", *("".join(rng.choice("abcz019_:") for _ in range(rng.randint(1, 30))) for _ in range(50))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vectors.fnv1a(F.col("t")).alias("h"), vectors.bucket(F.col("t"), 768).alias("b"), vectors.sign(F.col("t")).alias("s")).collect()
    for r in rows:
        h = fnv(r["t"])
        assert (r["h"]["hi"] << 32 | r["h"]["lo"], r["b"], r["s"]) == (h, h % 768, 1 if h % 2 == 0 else -1)


def test_embedding_is_a_unit_vector(spark):
    d = spark.createDataFrame([(1, "alpha beta alpha"), (2, "")], "id long, text string")
    sparse = vectors.sparse_embedding(d, "id", tx.terms(F.col("text")), 64)
    dense = {r["id"]: r["vector"] for r in vectors.dense(sparse, "id", d.select("id"), 64).collect()}
    assert all(math.isclose(sum(x * x for x in v), 1.0) for v in dense.values())
    assert set(dense[2]) == {64**-0.5}


@pytest.mark.parametrize(
    ("text", "day"),
    [("Wed, 05 Mar 2025 23:30:00 -0500", "2025-03-05"), ("2025-03-05T23:30:00-05:00", "2025-03-05"), ("2025-03-05", "2025-03-05"), ("Mar 5, 2025", "2025-03-05"), ("March 5, 2025", "2025-03-05"), ("03/05/2025", "2025-03-05"), ("soon", None), ("2025-13-40", None), (None, None)],
)
def test_days(spark, text, day):
    got = one(spark, dates.parse_day(F.col("t")), t=text)
    assert (got and got.isoformat()) == day


def test_utc_day(spark):
    assert one(spark, dates.utc_day(F.col("t")), t="Wed, 05 Mar 2025 23:30:00 -0500").isoformat() == "2025-03-06"


@pytest.mark.parametrize(
    ("url", "clean"),
    [("https://a.b/c?utm_source=x&q=1#f", "https://a.b/c?q=1#f"), ("https://a.b/c?gclid=1", "https://a.b/c"), ("http://A.b:80/?x=", "http://A.b:80/?x="), ("/p?fbclid=1&z", "/p?z")],
)
def test_urls(spark, url, clean):
    assert one(spark, urls.strip_tracking(F.col("u")), u=url) == clean


def test_hosts_and_keys(spark):
    assert one(spark, urls.host(F.col("u")), u="http://A.b:80/x") == "a.b:80"
    assert one(spark, urls.feed_key(F.col("u")), u="http://a.b/c/Default.aspx?x#y") == "https://a.b/c"
    assert one(spark, urls.in_domains(F.col("u"), ["b.c"]), u="a.b.c") and not one(spark, urls.in_domains(F.col("u"), ["b.c"]), u="ab.c")


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5])
def test_percentiles(spark, n):
    values = [float((k * 7) % 11) for k in range(n)]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    wanted = {"a": ordering.nearest_rank(0.9), "b": ordering.floor_index(0.95), "c": ordering.even_index(0.5), "d": ordering.upper_median}
    r = ordering.percentiles(d, "x", wanted).first()
    s = sorted(values)
    want = (s[math.ceil(0.9 * n) - 1], s[int(0.95 * (n - 1))], s[round(0.5 * (n - 1))], s[n // 2]) if n else (None,) * 4
    assert tuple(r) == want


def test_exact_sum_in_any_order(spark):
    rows = [1e15, 0.01] + [0.06] * 300 + [-1e15, None]
    total = lambda r: spark.createDataFrame([(x,) for x in r], "x double").coalesce(1).select(stats.exact_sum(F.col("x"))).first()[0]
    assert total(rows) == total(rows[::-1]) == 18.01
    assert total([1e30, 1.0]) == 1e30 and total([float("inf"), 1.0]) == float("inf") and total([None]) is None
