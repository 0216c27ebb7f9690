"""Importance resampling against its definition."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessellon.llm import common, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score double, rank int, row int"


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(docs, target, buckets=10_000):
    def counts(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (s_all + buckets) / ((s[k] + 1.0) * (t_all + buckets)))) for k in range(buckets)]
    rows = []
    for doc, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    order = sorted((k for k, r in enumerate(rows) if r[4]), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(order[: 25 * len(order) // 100])}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(rows)]


def texts(n, seed):
    rng = random.Random(seed)
    pool = ["A", "the", "Straße", "日本語", "x" * 64, "y" * 65, "z" * 200, "it", "Don't", "e.g.", "12", *map(str, range(60))]
    return ["  ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1.0, 2, 3) for d, t in docs], SCHEMA)


def test_hashes_are_crc32():
    for text in [*texts(50, 1), "", " ", "one", "w" * 300 + " tail", "a " + "b" * 70]:
        plain = text.encode().translate(common._WORD_BYTES)
        one, two, _ = resample.feature_hashes(plain)
        w, f = features(text)
        assert one.tolist() + two.tolist() == [zlib.crc32(x.encode()) for x in f] and len(one) == len(w)


def test_long_texts_in_blocks(monkeypatch):
    many = [t.encode() for t in texts(20, 2)] + [b"", b"long " * 500, b"q" * 3000, b" " * 900]
    plain = [t.translate(common._WORD_BYTES) for t in many]

    def total():
        n, w, sums = np.zeros(len(plain), int), np.zeros(len(plain), int), np.zeros(len(plain), int)
        for buckets, doc, words in resample.blocks(plain):
            n += np.bincount(doc, minlength=len(plain))
            w[: len(words)] += words
            np.add.at(sums, doc, buckets)
        return n.tolist(), w.tolist(), sums.tolist()

    whole = total()
    assert whole[1] == [len(features(t.decode())[0]) for t in many] and whole[0] == [len(features(t.decode())[1]) for t in many]
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(resample, "BLOCK", size)
        assert total() == whole


def test_tournament():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        tree = resample.Tournament([iter(r) for r in runs])
        assert list(tree) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("ranges, runs", [(10**6, 10**6), (30, 10), (1, 3)])
def test_draw_by_definition(spark, monkeypatch, ranges, runs):
    monkeypatch.setattr(resample, "RANGE_ROWS", ranges)
    monkeypatch.setattr(resample, "RUN_ROWS", runs)
    docs = [*enumerate(texts(220, 3)), (-4, None), (500, ""), (501, "word " * 30), (502, "big words here " * 30_000)]
    target = [*texts(20, 4), None, ""]
    df = frame(spark, docs).repartition(5)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(brute(docs, target), key=lambda r: r[0])


def test_repeated_and_null_ids_and_ties(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 5)
    text = "some words that are the same again and again " * 4
    docs = [(7, text)] * 30 + [(None, text)] * 12 + [(k, text) for k in range(20)]
    got = [tuple(r) for r in resample.resample(frame(spark, docs), spark.createDataFrame([], "text string")).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, []), key=str)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, len(docs) // 4 + 1))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert resample.resample(none, none).collect() == []
    few = resample.resample(frame(spark, [(1, "two words")]), none).collect()
    assert [tuple(r)[1:3] + (r["rank"],) for r in few] == [(3, brute([(1, "two words")], [])[0][2], None)]
