"""Toxicity by a factorization machine over hashed terms (operator 2).

Terms of a text are its distinct words and their beginnings of 3 to 7 characters, hashed to 2**20 buckets. The machine keeps the
buckets that tell the two labels apart (chi-square over the training rows), a weight for each, and a vector whose
inner products are the weights of pairs, so an insult beside a mention can count for more than both alone.

Training reads a bounded sample of labelled rows (``rows``, 10,000 by default), those with the smallest seeded hash of their doc_id; every
document is scored, whole, however long its text. Null and empty texts have no terms and get the machine's base rate. Repeated doc_ids in labels
count once, with the greater label, and of documents with one doc_id the one with the least hash is learned from; all rows are scored. Null labels and
null doc_ids aren't learned from. An empty table gives an empty result; other columns of the documents have no bearing. Without both labels to learn from, the score is the
share of label 1 (0.5 if there is no row).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

BUCKETS = 1 << 20
TRAIN_ROWS = 10_000
THRESHOLD = 0.7


def terms(word: bytes) -> tuple[int, ...]:
    letters = word.decode(errors="replace")
    parts = [b"w" + word, *(f"{k}{letters[:k]}".encode() for k in range(3, 8) if len(letters) >= k)]
    return tuple(xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts)


@lru_cache(maxsize=1)
def known_terms() -> Terms:
    """One for each Python worker."""
    return Terms()


class Terms(dict):
    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = terms(word)
        return got


common.cache("terms", known_terms.cache_clear)


@dataclass
class FactorizationMachine:
    slots: dict[int, int]  # bucket -> row of the weights
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, active: np.ndarray) -> float:
        v = self.vectors[active]
        return float(self.bias + self.weights[active].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())


def select_terms(rows: list[np.ndarray], y: np.ndarray, keep: int, least: float) -> np.ndarray:
    """The buckets with the largest chi-square of presence against the label."""
    n, n1 = len(y), y.sum()
    a = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t] or [np.empty(0, np.int32)]), minlength=BUCKETS).astype(float)
    df = np.bincount(np.concatenate(rows), minlength=BUCKETS).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (a * n - df * n1) ** 2 / (df * (n - df) * n1 * (n - n1))
    chi = np.where((df >= 3) & np.isfinite(chi), chi, 0)
    top = np.argsort(-chi, kind="stable")[:keep]
    return top[chi[top] >= least]


def train(rows: list[np.ndarray], y: np.ndarray, rank: int = 8, keep: int = 2048, least: float = 10.0, epochs: int = 20, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    prior = float(np.log(base / (1 - base)))
    if len(y) == 0 or y.min() == y.max():
        return FactorizationMachine({}, prior, np.zeros(1), np.zeros((1, rank)))
    buckets = select_terms(rows, y, keep, least)
    slots = {int(b): i for i, b in enumerate(buckets)}
    pad = len(slots)
    active = [np.array([slots[b] for b in r.tolist() if b in slots], np.int64) for r in rows]
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(pad + 1), rng.normal(0, 0.01, (pad + 1, rank)), prior
    v[pad] = 0
    each = np.where(y == 1, max(1.0, ((1 - base) / base) ** 0.5), 1.0)  # the rarer label counts more
    gw, gv, gb = np.full(pad + 1, 1e-2), np.full((pad + 1, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            mine = order[at : at + 128]
            width = max(1, max(len(active[i]) for i in mine))
            idx = np.full((len(mine), width), pad)
            for k, i in enumerate(mine):
                idx[k, : len(active[i])] = active[i]
            vi = v[idx]
            s = vi.sum(1)
            z = b + w[idx].sum(1) + 0.5 * (s**2 - (vi**2).sum(1)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) * each[mine] / len(mine)
            dw, dv = l2 * w, l2 * v
            np.add.at(dw, idx, g[:, None])
            np.add.at(dv, idx, g[:, None, None] * (s[:, None, :] - vi))
            dw[pad], dv[pad] = 0, 0
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            b -= rate * g.sum() / np.sqrt(gb)
    return FactorizationMachine(slots, b, w, v)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """text and y of a bounded sample of the labelled rows that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__tess_y"))
    sample = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(rows)
    # at most `rows` rows of 12 bytes: bounded, so it is broadcast; of rows that repeat a doc_id one counts
    met = docs.join(F.broadcast(sample), "doc_id")
    one = F.min_by(F.struct("text", F.col("__tess_y").alias("y")), F.coalesce(F.xxhash64("text"), F.lit(0))).alias("one")
    return met.groupBy("doc_id").agg(one).select("one.text", "one.y")


def train_from(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, label: str = "toxic") -> FactorizationMachine:
    def run(batches: Iterator[pa.RecordBatch]):
        known = known_terms()
        for batch in batches:
            found = [np.unique(np.array([t for w in set(common.words(x)) for t in known[w]], "<i4")).tobytes() for x in common.pylist(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["terms", "y"])

    source = docs.select("doc_id", common.as_bytes("text").alias("text"))
    got = labelled(source, labels, label, learn, rows).mapInArrow(run, "terms binary, y int").collect()
    # order by content, so that the result doesn't depend on the order of tasks
    got = sorted((bytes(r["terms"]), r["y"]) for r in got)
    return train([np.frombuffer(t, "<i4") for t, _ in got], np.array([y for _, y in got], float))


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    class Slots(dict):
        def __missing__(self, word):
            if len(self) > 400_000:
                self.clear()
            have = shared.value.slots
            got = self[word] = tuple({have[t] for t in terms(word) if t in have})
            return got

    def run(batches: Iterator[pa.RecordBatch]):
        known, model = Slots(), shared.value
        base = model.logit(np.empty(0, np.int64))
        for batch in batches:
            out = []
            for part in common.slices(batch, "text"):
                for text in common.pylist(part, "text"):
                    active = set()
                    for slots in map(known.__getitem__, set(common.words(text))):
                        if slots:
                            active.update(slots)
                    out.append(model.logit(np.array(sorted(active), np.int64)) if active else base)
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = in_fold(F.col("doc_id"), 3, 1)
    model = train_from(docs, labels, ~held)
    got = score(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
