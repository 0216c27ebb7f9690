"""Document fingerprints: threshold-scaled sketches of word shingles (operator 6).

A text's five-word shingles are hashed to 32 bits; its fingerprint keeps every distinct hash below 2**32 / SCALE, in ascending
order, as 8 hex digits each. Sketches of parts merge by union, and since the threshold is the same for all texts, the share of the
smaller sketch that the larger one holds estimates containment however unequal the texts are.

A text of fewer than five words is one shingle; an empty or null text has an empty fingerprint. A text none of whose hashes
falls below the threshold keeps its smallest hash alone, so that equal texts always have equal fingerprints and others
don't share an empty one. Two empty fingerprints are alike (1), an empty one and another aren't (0).

Documents are ordered by descending doc_id, null ids last, ties by text (rows equal in both follow each other). They are dealt to ranges of
doc_id, a task each; the first document of each range is also sent to the range before it, so that every document meets its next one. A lone
document is its own next one; an empty table gives an empty result. A task streams its range and holds two documents at a time, so a very long text
is bounded by the worker's memory alone. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

SCALE = 4
LIMIT = np.uint64((1 << 32) // SCALE)
ROWS_PER_RANGE = 20_000


def sketches(texts: list[str]) -> list[np.ndarray]:
    hashes, counts = common.hash_texts([t.encode() for t in texts])
    runs, many = common.shingle_runs(hashes, counts)
    runs = runs >> np.uint64(32)
    low = runs < LIMIT
    ends = np.cumsum(many)
    kept = np.concatenate([[0], np.cumsum(low)])
    small = runs[low].astype(np.uint32)
    out = []
    for end, n in zip(ends.tolist(), many.tolist(), strict=True):
        mine = small[kept[end - n] : kept[end]]
        if not len(mine) and n:
            mine = runs[end - n : end].min(keepdims=True).astype(np.uint32)
        out.append(np.unique(mine))
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def merge(*parts: np.ndarray) -> np.ndarray:
    """The sketch of texts together; a lone hash above the threshold counts only where nothing is below it."""
    both = np.unique(np.concatenate(parts))
    low = both[both < LIMIT]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, copy, id, text) dealt and sorted so that each row with copy 0 is followed by its next document's row."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    rows = ids.count()
    cuts = common.bounds(ids, "id", -(-rows // ROWS_PER_RANGE))
    heads = ids.groupBy(common.range_of(F.col("id"), cuts).alias("r")).agg(F.max("id").alias("head")).orderBy("r").collect()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("range", common.range_of(F.col("id"), cuts))
    if not heads:
        return source.select("range", F.lit(0).alias("copy"), "id", "text")
    # the head of range r also ends the next higher filled range; the highest head ends the lowest range
    filled = [h["r"] for h in heads]
    ends = {r: filled[(k + 1) % len(filled)] for k, r in enumerate(filled)}
    size = len(cuts) + 1
    head = {h["r"]: h["head"] for h in heads}
    head_of = F.expr("array(" + ",".join(f"{head[r]}L" if head.get(r) is not None else "cast(null as long)" for r in range(size)) + ")")
    end_of = F.expr("array(" + ",".join(str(ends.get(r, 0)) for r in range(size)) + ")")
    is_head = F.col("id").eqNullSafe(F.element_at(head_of, F.col("range") + 1))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))
    also = F.struct(F.element_at(end_of, F.col("range") + 1).alias("range"), F.lit(1).alias("copy"))
    dealt = source.withColumn("to", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("to.range").alias("range"), F.col("to.copy").alias("copy"), "id", "text")
    return dealt.repartitionById(size, F.col("range")).sortWithinPartitions("range", "copy", F.col("id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        held = None  # the last row: range, copy, id, text, sketch
        for batch in batches:
            for part in common.slices(batch, "text", 2_000_000):
                rows = list(zip(*(common.pylist(part, c) for c in ("range", "copy", "id", "text")), strict=True))
                rows = [(*r, s) for r, s in zip(rows, sketches([r[3] for r in rows]), strict=True)]
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and a[1] == 0]
                texts = [edited(a[3], b[3]) for a, b in pairs]
                made = sketches(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([to_text(a[4]) for a, _ in pairs], pa.string()), pa.array([to_text(m) for m in made], pa.string()),
                    pa.array([containment(a[4], m) for (a, _), m in zip(pairs, made, strict=True)], pa.float64()),
                    pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64()),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
