"""Document quality by a linear-chain conditional random field over lines (operator 3).

Each line gets figures (length, symbols, capitals, repeated words, digits, bars, marks and so on) cut into bins; a line's
potential sums the weights of its own bins and of both neighbours' bins, and a 2 x 2 table scores neighbouring labels. Forward-backward
gives each line's probability of being good; their mean, weighted by the lines' lengths (in bytes, plus one), is
the document's raw score, which a logistic curve fitted on the training rows turns into a probability.

Training reads a bounded sample of labelled rows (``rows``, 6,000 by default, with the smallest seeded hash of doc_id). Only documents have labels: the
chain first takes them for their lines' labels, then hides these and learns them by expectation-maximisation, so that a document can have
lines of both labels. Every document is scored over all its lines, whose labels are counted. A null or empty text is one empty line. Without
both labels to learn from, all weights are 0 and scores 0.5. Texts are read whole, however many or long their lines; an empty table gives an empty
result; all rows that repeat a doc_id are scored, and one is learned from. keep_good passes on all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common
from tessellon.llm.toxicity import in_fold, labelled

TRAIN_ROWS = 6_000
THRESHOLD = 0.3
#: How far a bad and a good document's label is believed of each of its lines.
TRUST = (0.85, 0.98)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SYMBOLS = b"#$%&*@^~=<>{}[]\\_+/`"
_NOT = {c: bytes(set(range(256)) - set(c)) for c in (_LETTERS, _UPPER, _DIGITS, _SYMBOLS, b"|", b"!", b",;:")}
_SHARES = [0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]
#: Upper edges of the bins of each figure.
EDGES = [
    np.array(e)
    for e in (
        [0, 1, 4, 9, 19, 39, 79, 159],  # words
        _SHARES,  # symbols by byte
        _SHARES,  # capitals by letter
        [0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.999],  # distinct words by word
        _SHARES,  # words equal to the one before
        [2, 3, 4, 5, 6, 8, 11, 16],  # letters by word
        _SHARES,  # digits by byte
        _SHARES,  # bars by byte
        _SHARES,  # exclamation marks by byte
        _SHARES,  # other marks within sentences
        [0.2, 0.4, 0.6, 0.7, 0.8, 0.9],  # letters by byte
        [0, 1, 2],  # end: none, full stop, other mark
    )
]
WIDTH = 1 + max(len(e) for e in EDGES)
#: Rows of the weight table: the line itself, the one before, the one after; the last bin of a neighbour's figure is "no such line".
FEATURES = len(EDGES) * (WIDTH + 1)


def line_figures(line: bytes) -> tuple[float, ...]:
    n, tokens = len(line), line.split()
    k = len(tokens)
    count = lambda kind: len(line.translate(None, _NOT[kind]))
    letters = count(_LETTERS)
    some, has = max(1, n), max(1, k)
    end = line[-1:]
    return (
        k, count(_SYMBOLS) / some, count(_UPPER) / max(1, letters), len(set(tokens)) / has if k else 1.0,
        sum(map(bytes.__eq__, tokens, tokens[1:])) / has, letters / has, count(_DIGITS) / some, count(b"|") / some,
        count(b"!") / some, count(b",;:") / some, letters / some, 1 if end == b"." else 2 if end in b"!?" and end else 0,
    )


def bins(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (lines x 3 figures), number of lines of each text, and the lines' weights."""
    split = [(t or b"").split(b"\n") for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    figures = np.array([line_figures(x) for s in split for x in s], float).reshape(-1, len(EDGES))
    own = np.stack([np.searchsorted(e, figures[:, i], "left") for i, e in enumerate(EDGES)], 1)
    ends = np.cumsum(counts)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ends - counts], last[ends - 1] = True, True
    before = np.where(first[:, None], WIDTH, np.roll(own, 1, 0))
    after = np.where(last[:, None], WIDTH, np.roll(own, -1, 0))
    base = np.arange(len(EDGES)) * (WIDTH + 1)
    ids = np.concatenate([own + base, before + base + FEATURES, after + base + 2 * FEATURES], 1)
    return ids.astype(np.int32), counts, np.array([len(x) + 1 for s in split for x in s], float)


@dataclass
class Chain:
    weights: np.ndarray  # by feature: evidence for good
    links: np.ndarray  # 2 x 2 scores of neighbouring labels (0 bad, 1 good)
    start: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def unary(self, ids: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[ids].sum(1), -30, 30)


def forward_backward(unary: np.ndarray, counts: np.ndarray, links: np.ndarray, start: np.ndarray):
    """P(good) of every line, and the expected neighbours' table, for chains laid end to end."""
    order = np.argsort(-counts, kind="stable")
    at = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    psi = np.exp(np.stack([-unary, unary], 1) / 2)
    table = np.exp(links)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    steps = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(steps + 1)]  # chains with more than t lines
    for t in range(steps):
        here = at[: live[t]] + t
        a = psi[here] * (np.exp(start) if t == 0 else alpha[here - 1] @ table)
        alpha[here] = a / a.sum(1, keepdims=True)
    pair = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        here = at[: live[t + 1]] + t
        onward = psi[here + 1] * beta[here + 1]
        joint = alpha[here][:, :, None] * table * onward[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = onward @ table.T
        beta[here] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pair


def line_labels(model: Chain, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the number of lines of each text, and the lines' weights."""
    ids, counts, weight = bins(texts)
    return forward_backward(model.unary(ids), counts, model.links, model.start)[0], counts, weight


def judged(model: Chain, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each text, and how many of its lines are good and bad."""
    if not texts:
        return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    good, counts, weight = line_labels(model, texts)
    begins = np.cumsum(counts) - counts
    raw = np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)
    fine = np.add.reduceat((good >= 0.5).astype(np.int64), begins)
    return 1 / (1 + np.exp(-(model.curve[0] * _logit(raw) + model.curve[1]))), fine, counts - fine


def document_scores(model: Chain, texts: list[bytes | None]) -> np.ndarray:
    return judged(model, texts)[0]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_curve(p: np.ndarray, y: np.ndarray, l2: float = 0.02) -> tuple[float, float]:
    """Slope and shift of a logistic curve from raw scores to labels, both labels weighing alike."""
    x = np.stack([_logit(p), np.ones(len(p))], 1)
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (each * (q - y)) + l2 * (w - [1.0, 0.0])
        h = (x * (each * q * (1 - q))[:, None]).T @ x + l2 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return max(float(w[0]), 0.05), float(w[1])


def train(texts: list[bytes], y: np.ndarray, steps: int = 400, rate: float = 0.05, l2: float = 1e-3, seed: int = 7, trust: tuple[float, float] = TRUST) -> Chain:
    """First every line has its document's label; then line labels are hidden, and a document's label speaks for each of its lines
    with the odds of trust (bad, good): expectation-maximisation over them, a batch at a time."""
    model = Chain(np.zeros(3 * FEATURES), np.zeros((2, 2)), np.zeros(2))
    if len(y) == 0 or y.min() == y.max():
        return model
    ids, counts, _ = bins(texts)
    starts = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    flat = lambda: np.concatenate([model.weights, model.links.ravel(), model.start])
    x = flat()
    m, s, step = np.zeros_like(x), np.zeros_like(x), 0
    voice = np.array([-np.log(trust[0] / (1 - trust[0])), np.log(trust[1] / (1 - trust[1]))])
    rounds = max(10, -(-steps * 200 // len(y)))
    for turn in range(2 * rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 200):
            mine = order[at : at + 200]
            lines = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in mine])
            own, n, label = ids[lines], counts[mine], y[mine]
            unary = model.unary(own)
            good, pair = forward_backward(unary, n, model.links, model.start)
            if turn < rounds:
                truth, seen = np.repeat(label, n), np.zeros((2, 2))
                np.add.at(seen, (label.astype(int), label.astype(int)), n - 1)
            else:
                truth, seen = forward_backward(unary + np.repeat(voice[label.astype(int)], n), n, model.links, model.start)
            g = np.zeros_like(x)
            each = np.repeat(1 / n, n)  # a document counts once, however many lines it has
            g[: 3 * FEATURES] = np.bincount(own.ravel(), np.repeat((good - truth) * each, own.shape[1]), 3 * FEATURES)
            g[3 * FEATURES : -2] = ((pair - seen) / n.mean()).ravel()
            first = np.cumsum(n) - n
            g[-2:] = [(truth[first] - good[first]).sum(), (good[first] - truth[first]).sum()]
            g = g / len(mine) + l2 * x
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            model = Chain(x[: 3 * FEATURES], x[3 * FEATURES : -2].reshape(2, 2), x[-2:])
    raw = np.concatenate([document_scores(model, texts[i : i + 500]) for i in range(0, len(texts), 500)])
    model.curve = fit_curve(raw, y)
    return model


def train_from(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, label: str = "quality") -> Chain:
    source = docs.select("doc_id", common.as_bytes("text").alias("text"))
    got = labelled(source, labels, label, learn, rows).select(F.coalesce("text", F.lit(b"")), "y").toLocalIterator()
    got = sorted((bytes(t), y) for t, y in got)
    return train([t for t, _ in got], np.array([y for _, y in got], float))


def _judged(model: Chain, batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """Scores, and numbers of good and bad lines."""
    parts = [judged(model, [])]
    for part in common.slices(batch, column, 2_000_000):
        texts = common.pylist(part, column)
        parts.append(judged(model, [t.encode() if isinstance(t, str) else t for t in texts]))
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def score(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _judged(shared.value, batch, "text"))], ["id", "score", "good_lines", "bad_lines"])

    return docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, good_lines long, bad_lines long")


def keep_good(docs: DataFrame, model: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all their columns, without those that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        common.use_only()
        for batch in batches:
            yield batch.filter(pa.array(_judged(shared.value, batch, text_col)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = in_fold(F.col("doc_id"), 5, 0)
    model = train_from(docs, labels, ~held)
    got = score(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "good_lines", "bad_lines")
