"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessellon.llm import common, components, decontaminate, fingerprint, licenses, line_dedup, near_dup, pieces, pii, quality, token_store, toxicity

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, `__odd name` int"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def words(x):
    return WORD.findall(lower(x))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every awkward case; ids, texts and columns that clash with names in use."""
    passage = " ".join(f"passage{k} common" for k in range(40))
    texts = [
        (1, "Plain first line of the text here.\nSecond line with five more words in it."), (2, None), (3, ""), (None, "no id at all but some words to read"), (4, passage), (5, passage), (5, passage), (None, None),
        (6, passage + " and a tail"), (7, "word " * 3000), (8, "é ü ñ 日本語 ▁ 😀\t\x0b end\n\n"), (9, "password = hunter2abc99 mail me@x.org; +1 (614) 555-8001; card 4111 1111 1111 1111; host 10.0.0.1"), (10, "All rights reserved. CC BY cc-by General Public License"),
        (11, "<|endoftext|> it's 12 O'Neil’s ﬁ İ K"),
    ]
    return spark.createDataFrame([(i, t, None, "s", None, "n", 1.0, 7) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---------------------------------------------------------------- shared parts


def test_hash_words_sees_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Z.é\n") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    hashes, counts = common.hash_texts([t.encode() for t in texts])
    assert counts.tolist() == [len(words(t)) for t in texts]
    known = {}
    for w, h in zip([w for t in texts for w in words(t)], hashes.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_contracted_edges_connect_the_same_nodes():
    rng = np.random.default_rng(5)
    for nodes, edges in ((1, 3), (40, 20), (60, 200), (500, 260)):
        a, b = rng.integers(0, nodes, (2, edges))
        least = {int(v): int(v) for v in (*a, *b)}
        for _ in range(nodes):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        got = dict(zip(*(c.tolist() for c in components.contracted(a, b)), strict=True))
        assert got == {v: r for v, r in least.items() if v != r}


def test_overlaps_are_the_overlap_of_each():
    rng = np.random.default_rng(6)
    bags = [near_dup.folded(rng.integers(0, 30, k).astype(np.uint64)) for k in (0, 1, 5, 0, 40, 80)]
    for a in bags:
        assert near_dup.overlaps(a, bags).tolist() == [near_dup.overlap(a, b) for b in bags]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        assert a == b or (got.get(a, a) == find(a) and got.get(b, b) == find(b))


@pytest.mark.parametrize("most", [2, 5, 100])
def test_sorted_lists_find_all_pairs(most):
    rng = random.Random(most)
    rows = sorted((rng.randint(0, 20), k) for k in range(200))
    lists = common.SortedLists(["key", "node"], most, lambda r, i, j: np.ones(len(i), bool))
    pairs, handed = set(), []
    for at in range(0, 200, 17):
        part = rows[at : at + 17]
        r, i, j, _, h = lists.add({"key": np.array([p[0] for p in part]), "node": np.array([p[1] for p in part])})
        pairs |= {(int(r["node"][a]), int(r["node"][b])) for a, b in zip(i, j, strict=True)}
        handed += r["node"][h].tolist()
    r, i, j, _, h = lists.add({"key": np.empty(0, np.int64), "node": np.empty(0, np.int64)}, last=True)
    pairs |= {(int(r["node"][a]), int(r["node"][b])) for a, b in zip(i, j, strict=True)}
    handed += r["node"][h].tolist()
    by = collections.defaultdict(list)
    for key, node in rows:
        by[key].append(node)
    want = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :] if len(v) <= most or k == 0}
    assert pairs == want and sorted(handed) == sorted(n for v in by.values() if len(v) > most for n in v)


# ---------------------------------------------------------------- 1


def test_pieces_match_the_model_and_round_trip(spark, odd, none):
    import sentencepiece

    path = pieces.public_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, dropped = pieces.Encoder(path, 0.0, 1, 1), pieces.Encoder(path, 0.3, 5, 4)
    texts = [r["text"] for r in odd.collect() if r["text"] is not None] + ["  a  b ", "x" * 300, " ", "e.g. 1.5, don't_x 3²."]
    for t in texts:
        ids = np.frombuffer(plain.encode(t), "<u2").tolist()
        assert "▁" in t or ids == sp.encode(t)
        for key in ("a", "b"):
            assert dropped.model.decode(np.frombuffer(dropped.encode(t, key), "<u2").tolist()) == t
    many = {dropped.encode("international development", str(k)) for k in range(40)}
    assert len(many) > 1 and dropped.encode("same", "k") == dropped.encode("same", "k")
    rows = pieces.round_trip(odd, path).collect()
    assert len(rows) == odd.count() and all(r["lossless"] for r in rows)
    assert pieces.encode(none, path).count() == 0
    back = pieces.decode(pieces.encode(odd, path), path)
    assert sorted(map(str, (r["text"] for r in back.collect()))) == sorted(map(str, (r["text"] for r in odd.collect())))


def test_short_and_long_agendas_agree():
    model = pieces.PieceModel(pieces.public_model())
    rng = random.Random(4)
    for _ in range(300):
        unit = list("▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))))
        for limit in (0, 1 << 62):
            assert model._merge_short(list(unit), limit, 99) == model._merge_long(unit, limit, 99)


def brute_agenda(model, unit, draw):
    """The agenda by its definition: the best pair that is a piece and isn't skipped, leftmost among equals; each that comes up takes a bit."""
    symbols, skipped, asked = list(unit.replace(" ", pieces.BLANK)), set(), 0
    while True:
        some = [(model.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in model.rank and k not in skipped]  # noqa: B905
        if not some:
            return model._ids(symbols), asked
        _, k = min(some)
        asked += 1
        if draw >> (asked - 1) & 1:
            skipped.add(k)
            continue
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        # a skipped candidate comes up again once one of its symbols has changed
        skipped = {q if q < k else q - 1 for q in skipped if q not in (k - 1, k, k + 1)}


def test_dropout_by_the_definition():
    model = pieces.PieceModel(pieces.public_model())
    assert model.pairs is not None
    rng = random.Random(31)
    letters = "etaoinshrdlu" * 3 + "ABC.,-'09é日\u0378😀 "
    for k in range(3000):
        unit = " " * rng.randint(0, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(1, pieces.SHORT - 3)))
        draw = sum(1 << b for b in range(63) if rng.random() < (0.0, 0.1, 0.5)[k % 3]) | 1 << 63
        assert model.drawn(unit, draw) == brute_agenda(model, unit, draw)
        symbols, asked = model._merge_drawn(list(unit.replace(" ", pieces.BLANK)), draw)
        assert (model._ids(symbols), asked) == model.drawn(unit, draw)


def test_agendas_in_arrays_by_the_definition():
    model, rng = pieces.PieceModel(pieces.public_model()), random.Random(8)
    agenda = pieces.Agenda(model)
    letters = "etaoinshrdlu" * 3 + "ABC.,-'09é日\u0378😀 "
    units, draws = [], []
    for k in range(12_000):
        units.append(" " * rng.randint(0, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(1, pieces.SHORT - 2))))
        draws.append(sum(1 << b for b in range(63) if rng.random() < (0.0, 0.1, 0.5, 1.0)[k % 4]) | 1 << 63)
    flat, many, asked = agenda.run(units, np.array(draws, np.uint64))
    compared = 0
    for unit, draw, end, n, count in zip(units, draws, np.cumsum(many).tolist(), many.tolist(), asked.tolist(), strict=True):
        ids, came_up = brute_agenda(model, unit, draw)
        assert count == came_up
        if max(flat[end - n : end]) < agenda.pieces:
            assert flat[end - n : end].tolist() == ids
            compared += 1
    assert compared > 3000


def test_every_occurrence_has_its_own_dropout():
    """Shares of segmentations are those of independent draws, and their number isn't bound; what is kept has no bearing."""
    path, rng = pieces.public_model(), random.Random(3)
    coder, small = pieces.Encoder(path, 0.1, 7, 100_000), pieces.Encoder(path, 0.1, 7, 1)
    for unit in (" of", " the", " development", " x" + "development" * 3):
        plain = coder.model.segment(unit)
        n = 20_000 if len(unit) < 20 else 2000
        seen, want = collections.Counter(), collections.Counter()
        for doc in range(n // 100):
            got = coder.encode("a" + unit * 100, str(doc))
            assert doc or got == small.encode("a" + unit * 100, str(doc))
        for place, draw in enumerate(coder.draws("k", n)):
            _, mask = coder.plain[unit]
            seen[coder.dropped(unit, draw, mask, "k", place) if draw & mask else coder.plain[unit][0]] += 1
            want[coder.plain.packed(coder.model.segment(unit, 0.1, rng.getrandbits(64)))] += 1
        assert max(abs(seen[k] - want[k]) for k in seen | want) < 5 * n**0.5
        assert unit == " of" or len(seen) > 4
        assert 0 < seen[coder.plain.packed(plain)] < n
    texts = {coder.encode("international " * 200, str(doc)) for doc in range(3)}
    assert len(texts) == 3
    short = [coder.encode(" development", str(k)) for k in range(2000)]
    assert len(set(short)) > 4


# ---------------------------------------------------------------- 2, 3


def test_pairs_beat_single_terms():
    """Label 1 only where two terms meet: no sum of single weights can say that."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted({1 if a else 2, 3 if b else 4, *rng.integers(10, 60, 4).tolist()}), np.int32))
        y.append(float(a and b))
    y = np.array(y)
    model = toxicity.train(rows, y, epochs=30)
    z = np.array([model.logit(np.array([model.slots[t] for t in r.tolist() if t in model.slots], int)) for r in rows])
    assert ((z > 0) == (y == 1)).mean() > 0.97


@needs_tables
def test_scores_on_odd_rows(spark, odd, none):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    tox, good = toxicity.train_from(docs, labels, F.lit(True)), quality.train_from(docs, labels, F.lit(True))
    for module, model in ((toxicity, tox), (quality, good)):
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(none, model).count() == 0
    assert set(quality.keep_good(odd, good).columns) == set(odd.columns)
    empty = labels.where("false")
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in quality.score(odd, quality.train_from(docs, empty, F.lit(True))).collect())
    assert toxicity.score(odd, toxicity.train_from(docs, empty, F.lit(True))).count() == odd.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize(("op", "label", "least"), [(toxicity.op2, "toxic", 0.95), (quality.op3, "quality", 0.98)])
def test_held_out_accuracy(spark, op, label, least):
    sf = "/root/testdata/sf0.1"
    p = op(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (p.predicted == p[label]).mean() > least


def test_pairwise_sums_by_definition():
    """The machine's score: bias, weights, and the inner product of every pair of vectors."""
    rng = np.random.default_rng(3)
    model = toxicity.FactorizationMachine({}, 0.3, rng.normal(size=30), rng.normal(size=(30, 8)))
    for n in (0, 1, 2, 9):
        active = rng.choice(30, n, replace=False)
        pairs = sum(float(model.vectors[a] @ model.vectors[b]) for k, a in enumerate(active) for b in active[:k])
        assert math.isclose(model.logit(active), 0.3 + model.weights[active].sum() + pairs, abs_tol=1e-9)


def test_toxicity_scores_by_definition(spark):
    words_of = ["vile", "crowd", "plain", "words", "here", "Vileness", "crowded"]
    slots = {b: k for k, b in enumerate(sorted({t for w in words_of[:5] for t in toxicity.terms(w.encode())}))}
    rng = np.random.default_rng(4)
    model = toxicity.FactorizationMachine(slots, -0.2, rng.normal(size=len(slots)), rng.normal(size=(len(slots), 8)))
    texts = ["", None, "vile crowd", "Vileness, crowded! plain plain", "nothing known", " ".join(words_of)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k, text in enumerate(texts):
        active = sorted({slots[t] for w in words(text) for t in toxicity.terms(w.encode()) if t in slots})
        z = -0.2 + sum(model.weights[active]) + sum(float(model.vectors[a] @ model.vectors[b]) for a in active for b in active if a < b)
        assert math.isclose(got[k], 1 / (1 + math.exp(-z)), abs_tol=1e-9)


def test_scores_are_weighted_marginals():
    rng = np.random.default_rng(5)
    model = quality.Chain(rng.normal(size=3 * quality.FEATURES) / 4, rng.normal(size=(2, 2)), rng.normal(size=2), (1.3, -0.4))
    texts = [b"One line. Of text\nBUY NOW!!! 50% $$$\n\nand, more", b"", b"x", b"a a a a\n| b | 7 |"]
    scores, good, bad = quality.judged(model, texts)
    ids, counts, _ = quality.bins(texts)
    ends = np.cumsum(counts)
    for k, text in enumerate(texts):
        unary = model.unary(ids[ends[k] - counts[k] : ends[k]])
        total, share = 0.0, np.zeros(counts[k])
        for path in itertools.product((0, 1), repeat=int(counts[k])):
            s = model.start[path[0]] + sum(u / 2 if p else -u / 2 for u, p in zip(unary, path, strict=True)) + sum(model.links[a, b] for a, b in itertools.pairwise(path))
            total += math.exp(s)
            share += math.exp(s) * np.array(path)
        share /= total
        weight = np.array([len(x) + 1 for x in text.split(b"\n")])
        raw = min(max((share * weight).sum() / weight.sum(), 1e-3), 1 - 1e-3)
        assert math.isclose(scores[k], 1 / (1 + math.exp(-(1.3 * math.log(raw / (1 - raw)) - 0.4))), abs_tol=1e-9)
        assert (good[k], bad[k]) == ((share >= 0.5).sum(), (share < 0.5).sum())


def test_lines_of_both_labels_within_a_document():
    rng = random.Random(17)
    nice = lambda: " ".join(rng.choice("the river flows along old stone walls towards town".split()) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["BUY", "$$$", "50%", "|||", "CLICK!!!", "BUY"]) for _ in range(6))
    texts, y = [], []
    for _ in range(300):
        bad = rng.random() < 0.4
        texts.append("\n".join(junk() if bad and rng.random() < 0.95 else nice() for _ in range(rng.randint(3, 9))).encode())
        y.append(0.0 if bad else 1.0)
    model = quality.train(texts, np.array(y))
    kinds = [[nice, junk][k // 4 % 2] for k in range(12)]
    good, _, _ = quality.line_labels(model, ["\n".join(k() for k in kinds).encode() for _ in range(20)])
    right = (good.reshape(20, 12) >= 0.5) == np.array([k is nice for k in kinds])
    assert right.mean() > 0.9


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    unary, links, start = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal(size=2)
    got, _ = quality.forward_backward(unary, np.array([4, 3]), links, start)
    for at, n in ((0, 4), (4, 3)):
        total, good = 0.0, np.zeros(n)
        for path in np.ndindex(*(2,) * n):
            s = start[path[0]] + sum(unary[at + k] * (path[k] - 0.5) for k in range(n)) + sum(links[a, b] for a, b in zip(path, path[1:], strict=False))
            total += np.exp(s)
            good += np.exp(s) * np.array(path)
        assert np.allclose(got[at : at + n], good / total)


# ---------------------------------------------------------------- 4


def brute_windows(texts, items, window=13):
    found = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            found[tuple(w[k : k + n])].add(item)
    out = []
    for text in texts:
        w, hit, its = words(text), set(), set()
        for n in {len(q) for q in found}:
            for k in range(len(w) - n + 1):
                if (q := tuple(w[k : k + n])) in found:
                    hit |= set(range(k, k + n))
                    its |= found[q]
        out.append((len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def brute_longest(text, items, window=13):
    """From, to, item and place of the longest run of words that the text shares with an item, of a window or more."""
    w, best = words(text), []
    for item, other in items:
        v = words(other)
        n = min(window, len(v))
        for p in range(len(w) - n + 1 if n else 0):
            for q in range(len(v) - n + 1):
                if w[p : p + n] == v[q : q + n]:
                    m = n
                    while p + m < len(w) and q + m < len(v) and w[p + m] == v[q + m]:
                        m += 1
                    best.append((-m, p, item, q))
    m, p, item, q = min(best, default=(None,) * 4)
    return (p, p - m, item, q) if best else (None,) * 4


def test_windows_by_brute_force_in_blocks(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    vocab = "aa bb cc dd ee".split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    items = [(str(k), " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 13, 20])))) for k in range(25)]
    items += [("x", " ".join(texts[3].split()[:16])), ("x", " ".join(texts[3].split()[:16])), ("y", texts[9]), ("two", " ".join(texts[3].split()[:15])), ("runs", " ".join(texts[9].split()[2:30]))]
    texts += [" ".join(texts[3].split()[:15] + texts[9].split()[4:24]), "aa " * 40]
    items.append(("same", "aa " * 20))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute_windows(texts, items)
    for size in (8_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(decontaminate.matches(docs, bench), "doc_id").collect()}
        assert [got[k][:5] for k in range(len(texts))] == want
        assert [got[k][5:] for k in range(len(texts))] == [brute_longest(t, items) for t in texts]
    bench = spark.createDataFrame([(None, "passage3 common passage4 common passage5 common passage6 common passage7 common passage8 common passage9"), ("e", None)], "item_id string, text string")
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontaminate.remove_contaminated(none, bench).count() == 0
    assert decontaminate.remove_contaminated(odd, bench.where("false")).count() == odd.count()


# ---------------------------------------------------------------- 5


def test_licenses(spark, odd, none):
    docs = spark.createDataFrame(
        [(1, "x CC  by y\ncc.By! all RIGHTS reserved"), (2, "ccc by\nacc by"), (3, "General  public\nLicense"), (4, "Licensed under the Apache License, Version 2.0"), (5, "Licensed under the License"), (6, "Licensed under CC BY-NC 4.0."), (7, None), (8, "éCC BY K"), (9, "cc by cc by")], "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        w, places, labels = words(r["text"]), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(g["labels"].split(","))
    assert got[4]["labels"] == "apache-2.0" and got[5]["labels"] == "" and got[6]["labels"] == "cc-by,cc-by-nc-4.0"
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_template_join_finds_every_block(spark):
    """The filters lose nothing: brute force over random blocks and templates."""
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(14)]
    templates = [(" ".join(rng.sample(vocab, rng.randint(2, 9))), f"t{k}") for k in range(6)]
    texts = ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14))) for _ in range(3)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.template_matches(docs, "doc_id", "text", templates, 0.8)
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"))
    best = {r["doc_id"]: r["best"] for r in got.join(keys, "dk").collect()}
    for k, text in enumerate(texts):
        hits = [len(set(t.split()) & set(line.split())) / len(set(t.split())) for t, _ in templates for line in text.split("\n") if len(set(t.split()) & set(line.split())) >= -int(-len(set(t.split())) * 80 // 100)]
        assert (k in best) == bool(hits)


def test_all_templates_of_a_block(spark):
    t = dict((label, text) for text, label in reversed(licenses.TEMPLATES))
    rows = [
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0", "apache-2.0,mit"), ("some words " * 400 + t["bsd"] + " more words" * 400 + " " + t["mpl-2.0"], "bsd,mpl-2.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), (t["lgpl"], "gpl,lgpl"), (t["unlicense"] + "\n" + t["proprietary"], "proprietary,unlicense"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser Public License", "lgpl"), (t["gpl"], "gpl"),
    ]
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[k]["labels"] for k in range(len(rows))] == [labels for _, labels in rows]


@pytest.mark.parametrize("width", [1, 3, 7, 12])
def test_wrapped_templates(spark, width):
    """A notice over two or more lines, after other words and with comment marks and blank lines between, has its one-line labels."""
    texts = []
    for text, _ in licenses.TEMPLATES:
        w = ["x"] * 2 + text.split() + ["y"] * 3
        texts.append("\n# \n # ".join(" ".join(w[k : k + width]) for k in range(0, len(w), width)))
    near = ["you may not use\n" + "filler " * 30 + "this file except in compliance with the License", "Licensed\n" * 40, "a\nb", "\n"]
    docs = spark.createDataFrame(list(enumerate([*texts, *near])), "doc_id long, text string")
    plain = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    want = {r["doc_id"]: r["labels"] for r in licenses.scan(plain).collect()}
    assert {k: got[k]["labels"] for k in want} == want and all(label in want[k].split(",") for k, (_, label) in enumerate(licenses.TEMPLATES))
    assert [got[len(texts) + k]["labels"] for k in range(len(near))] == [""] * len(near)


def test_lines_beyond_number(spark):
    """Time grows with the number of lines, not with its square: a text of 200,000 lines with a notice over its last ones."""
    text = "licensed words of no notice\n" * 200_000 + "Licensed under the Apache\nLicense, Version 2.0"
    begun = time.time()
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["labels"] == "apache-2.0" and time.time() - begun < 120


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_fingerprints(spark, odd, none, monkeypatch, per_range):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", per_range)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    texts = [r["text"] or "" for r in rows]
    want = []
    for k, (r, t) in enumerate(zip(rows, texts, strict=True)):
        e = fingerprint.edited(t, texts[(k + 1) % len(texts)])
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.to_text(fingerprint.sketches([t])[0]), fingerprint.to_text(fingerprint.sketches([e])[0])))
    got = [tuple(r)[:5] for r in fingerprint.fingerprint_pairs(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprint.fingerprint_pairs(none).count() == 0


def test_containment_of_unequal_texts():
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    part, other = long[500:1300], [f"v{k}" for k in range(800)]
    a, b, c = fingerprint.sketches([" ".join(x) for x in (long, part, other)])
    assert fingerprint.containment(a, b) > 0.97 and fingerprint.containment(a, c) < 0.03
    assert np.array_equal(fingerprint.merge(b, c), np.union1d(b, c))
    assert np.array_equal(fingerprint.from_text(fingerprint.to_text(a)), a)


# ---------------------------------------------------------------- 7


def bag(text):
    w = words(text)
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    total = sum((a | b).values())
    return shared / total if total else 1.0


def brute_classes(texts, threshold=0.8):
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(bags)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def variants(rng, n, length, edits):
    base = [f"w{rng.randint(0, 900)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(10)
    pairs = []
    for _ in range(60):
        a = [f"w{rng.randint(0, 30)}" for _ in range(60)]
        b = a[: rng.randint(10, 60)] + [f"x{rng.randint(0, 30)}" for _ in range(rng.randint(0, 30))]
        pairs += [" ".join(a), " ".join(b * rng.choice([1, 1, 3]))]
    _, runs, many = near_dup._text_parts([p.encode() for p in pairs])
    sig = near_dup.signatures(*near_dup.multisets(runs, many))
    gaps = [(sig[k] == sig[k + 1]).mean() - similarity(bag(pairs[k]), bag(pairs[k + 1])) for k in range(0, len(pairs), 2)]
    assert abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 0.2


@pytest.mark.parametrize(("most", "held"), [(2, 2000), (2, 3), (32, 2000)])
def test_near_duplicate_classes(spark, odd, none, monkeypatch, most, held):
    monkeypatch.setattr(near_dup, "MOST", most)
    monkeypatch.setattr(near_dup, "HELD", held)
    rng = random.Random(11)
    texts = variants(rng, 40, 120, 6) + variants(rng, 25, 60, 2) + variants(rng, 10, 400, 30) + ["same words here now again"] * 4 + ["", "", "a b"]
    rng.shuffle(texts)
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want
    kept = near_dup.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    if held < 2000:
        got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs, bits_apart=128).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_near_duplicates_on_odd_rows(spark, odd, none):
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    ids = [i for i, _ in got]
    assert ids.count(5) == 0 and 4 in ids and 6 not in ids and len([1 for _, t in got if not t]) == 1
    assert near_dup.near_duplicates(odd).count() == odd.count()
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_one(none).count() == 0


# ---------------------------------------------------------------- 8


def test_perfect_hash():
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = np.unique(common.mix64(np.arange(n, dtype=np.uint64) + np.uint64(5)))
        at = token_store.find_slots(keys, token_store.perfect_hash(keys), n)
        assert np.array_equal(np.sort(at), np.arange(n))


def test_store_round_trip_and_lookup(spark, odd, none, tmp_path, monkeypatch):
    import tokenizers

    monkeypatch.setattr(token_store, "ROWS_PER_SHARD", 4)
    monkeypatch.setattr(token_store, "KEYS_PER_PART", 5)
    path = token_store.public_tokenizer("word_bpe_49k.json")
    folder = f"file://{tmp_path}/store"
    entries, before, parts = token_store.write(odd, folder, path, 2)
    tok = tokenizers.Tokenizer.from_file(path)
    rows = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for doc, ids in rows:
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r["doc_id"], before[r["shard"]] + r["offset"], r["n"], r["ids_crc32"]) for r in token_store.read_back(entries.select("doc_id", "ordinal"), folder, parts).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    keys = np.array([token_store.key_hash(7, 0), token_store.key_hash(12345, 0)], np.uint64)
    found = token_store.lookup(folder, parts, keys)
    assert found["shard"][1] == -1
    assert token_store.read_ids(folder, *(int(found[c][0]) for c in ("shard", "offset", "n"))).tolist() == dict((d, i) for d, i in rows if d == 7)[7]
    assert token_store.write(none, f"file://{tmp_path}/none", path, 2)[0].count() == 0


def test_ids_by_run_are_the_tokenizers(spark):
    import tokenizers

    path = token_store.public_tokenizer("word_bpe_49k.json")
    tok, runs = tokenizers.Tokenizer.from_file(path), token_store.RunIds(path, "<u2")
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(rng.choice("aBz'sSt ’.,!<|>\n\t09²ªßÉéñ́Kİ日😀\xa0\x1c_-") for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(runs.of(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# ---------------------------------------------------------------- 9

_BASE = {k: re.compile(p) for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))}


def base_spans(x):
    out = []
    for kind, pattern in _BASE.items():
        for m in pattern.finditer(x):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(13)
    for _ in range(20_000):
        x = "".join(rng.choice("a.@1 2+-(9)0.é25%") for _ in range(rng.randint(0, 50)))
        assert pii.joined(base_spans(x)) == pii.joined(pii.spans(x)[0]), repr(x)


def test_spans_on_odd_rows(spark, odd, none):
    model = pii.train(pii.count_patterns(odd))
    rows = {r["doc_id"]: r for r in pii.find(odd, model).collect()}
    assert (rows[9]["n_email"], rows[9]["n_ip"], rows[9]["n_card"], rows[9]["n_phone"]) == (1, 1, 1, 1)
    assert rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert set(pii.joined(base_spans([r["text"] for r in odd.collect() if r["doc_id"] == 9][0])).split(",")) <= set(rows[9]["spans"].split(","))
    assert pii.find(none, pii.train({})).count() == 0


def test_reliabilities_rank_labelers():
    """A labeler that goes with the others is trusted more than one that votes at random."""
    counts = {"1+++++0bb": 500, "1++-++0bb": 500, "1--+--0bb": 500, "1-----0bb": 500}
    p, trust = pii.aggregate(counts)
    assert p["1++-++0bb"] > 0.9 > 0.1 > p["1--+--0bb"] and trust["ip"]["pattern"] > trust["ip"]["context"] + 0.2


def test_classifier_decides_on_every_candidate(spark):
    """Candidates that fail their pattern are added where the classifier says so, and a secret runs to the end of its token."""
    texts = ["card 4111 1111 1111 1112", "host 10.0.0.999", "call +1 614 5558", "token=" + "aB3" * 150 + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for weight, want in ((9.0, ["card:5:24", "ip:5:15", "phone:5:16", "secret:6:456"]), (-9.0, [""] * 4)):
        got = {r["doc_id"]: r["spans"] for r in pii.find(docs, pii.SpanModel({"all": weight}, {})).collect()}
        assert [got[k] for k in range(4)] == want


# ---------------------------------------------------------------- 10


def brute_lines(docs):
    """Texts with lines taken out that resemble an earlier line; docs in their order."""
    seen, out = [], []
    for text in docs:
        keep = []
        for line in (text or "").split("\n"):
            w = set(words(line))
            if len(w) >= line_dedup.MIN_WORDS:
                gone = any(5 * len(w & v) >= 4 * len(w | v) for v in seen)
                seen.append(w)
                if gone:
                    continue
            keep.append(line)
        out.append("\n".join(keep))
    return out


@pytest.mark.parametrize(("light", "most", "blocks"), [(1024, 16_384, 4), (2, 3, 4), (2, 3, 0), (3, 1000, 4), (1000, 2, 0)])
def test_lines_by_brute_force(spark, monkeypatch, light, most, blocks):
    monkeypatch.setattr(line_dedup, "LIGHT", light)
    monkeypatch.setattr(line_dedup, "MOST", most)
    monkeypatch.setattr(line_dedup, "BLOCKS", blocks)
    rng = random.Random(14)
    pool = variants(rng, 30, 40, 5) + variants(rng, 20, 250, 40) + variants(rng, 20, 8, 1) + variants(rng, 10, 110, 20)
    texts = ["\n".join([*(rng.choice(pool) for _ in range(rng.randint(0, 6))), *([""] * rng.randint(0, 2)), "short line"]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts)


def test_line_whose_earlier_partner_has_gone(spark):
    """X goes by Z, its best partner, before X is held against Y; Y's nearest are all later lines of the same document."""
    texts = []
    for d in range(8):
        c, p, q, r, s = ([f"{x}{d}n{k}" for k in range(n)] for x, n in (("c", 32), ("p", 4), ("q", 4), ("r", 4), ("s", 4)))
        often = [f"h{d}n{k}" for k in range(10)]
        fill = [" ".join([*often, *(f"f{d}n{k}m{j}" for j in range(10))]) for k in range(30)]
        z, x, y = c + p + r, c + p + q, c + q + s
        texts.append("\n".join([*map(" ".join, (z, x, y, *([*y, h] for h in often))), *fill]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts)


@pytest.mark.parametrize(("held", "asked"), [(40, 3), (500, 20_000)])
def test_lines_in_pieces(spark, monkeypatch, held, asked):
    """Buckets that come in pieces, several blocks of open nodes, sets of more than BIG words."""
    for name, value in (("HELD", held), ("BUCKET", 200), ("ASKED", asked), ("BLOCKS", 1000), ("BIG", 60), ("PIVOTS", 2)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(15)
    pool = variants(rng, 12, 40, 5) + variants(rng, 8, 65, 7) + variants(rng, 6, 200, 20) + variants(rng, 4, 900, 80)
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").distinct()
    rows = sorted((r["doc_id"], r["k"], r["text"]) for r in docs.select("*", line_dedup.doc_key("doc_id", "text").alias("k")).collect())
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted(zip([r[0] for r in rows], brute_lines([r[2] for r in rows]), strict=True))


def test_lines_of_documents_out_of_order(spark):
    """A repeated line counts from its least doc_id, though a batch shows it under a greater one first."""
    rows = []
    for g in range(8):
        c, p, q, r, s = ([f"{x}{g}n{k}" for k in range(n)] for x, n in (("c", 32), ("p", 4), ("q", 4), ("r", 4), ("s", 4)))
        first, again, last = (" ".join(x) for x in (c + p + r, c + p + q, c + q + s))
        rows += [(10 * g + 9, again), (10 * g + 2, again), (10 * g + 5, last), (10 * g + 1, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[k] for k, _ in sorted(rows)] == brute_lines([t for _, t in sorted(rows)])


@pytest.mark.parametrize(("light", "most"), [(1024, 16_384), (2, 3)])
def test_short_lines(spark, monkeypatch, light, most):
    """Lines of one word or more: equal sets, and four words beside these and a fifth."""
    monkeypatch.setattr(line_dedup, "LIGHT", light)
    monkeypatch.setattr(line_dedup, "MOST", most)
    texts = ["Read more\na b c d e\n\n--", "read MORE!\nmore: read\nx\na b c d", "x\nx y\nk l m n", "k l m n o\nk l m\nmore\n--", "l m k\n\nread\nk l m p", "Read more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want, seen = [], []
    for text in texts:
        keep = []
        for line in text.split("\n"):
            w = set(words(line))
            if not w or not any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                keep.append(line)
            seen.append(w)
        want.append("\n".join(keep))
    assert [got[k] for k in range(len(texts))] == want
    assert got[1] == "x" and got[3] == "k l m\nmore\n--" and got[5] == ""


def test_lines_on_odd_rows(spark, odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "__tess_gone"]
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(rows) == odd.count() and (2, None) in rows and (3, "") in rows
    assert rows.count((5, "")) == 2 and (6, "") in rows  # copies and a variant of document 4's one line
    assert line_dedup.dedup_lines(none).count() == 0


# ---------------------------------------------------------------- pipeline


@needs_tables
def test_pipeline_stages(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = common.stage(stage(spark, docs, SF), name)
        assert name == "encode" or docs.columns == before
    assert docs.columns == ["doc_id", "n_pieces", "ids"]
    assert corpus_pipeline.run(spark, SF).count() > 0


@needs_tables
def test_pipeline_by_brute_force(spark):
    """The pipeline's rows are those that stages worked out one text at a time leave, and its pieces spell their texts."""
    table_of = lambda name: table(spark, name)
    docs = sorted((r["doc_id"], r["text"]) for r in table_of("documents").collect())
    model = quality.train_from(table_of("documents"), table_of("labels"), ~quality.in_fold(F.col("doc_id"), 5, 0))
    kept = [(i, t) for i, t in docs if quality.document_scores(model, [t.encode()])[0] >= quality.THRESHOLD]
    lines = brute_lines([t for _, t in kept])
    roots = brute_classes(lines)
    texts = {kept[k][0]: lines[k] for k in range(len(kept)) if roots[k] == k}
    items = [(str(r["item_id"]), r["text"]) for r in table_of("benchmark").collect()]
    clean = {i: t for (i, t), found in zip(texts.items(), brute_windows(list(texts.values()), items), strict=True) if not found[4]}
    before = set(spark.sparkContext._jvm.java.io.File(common.shared_folder(spark).removeprefix("file:") + "/tessellon").list())
    got = common.stage(corpus_pipeline.run(spark, SF), "pipeline")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(got, pieces.public_model()).collect()} == clean
    assert all(r["n_pieces"] == len(r["ids"]) for r in got.collect()) and len(docs) > len(kept) > len(texts) > len(clean) > 0
    # all but the last stage's input and this result is deleted
    left = set(spark.sparkContext._jvm.java.io.File(common.shared_folder(spark).removeprefix("file:") + "/tessellon").list()) - before
    assert {n.rsplit("-", 1)[0] for n in left} == {"decontaminate", "pipeline"}


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
