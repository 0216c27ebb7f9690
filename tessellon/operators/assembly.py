"""Documents to titled chunks: windows within items, starts moved to headings, the title before each text."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.operators.chunking import ChunkConfig
from tessellon.operators.metadata import FILINGS
from tessellon.sources.readers import CHUNK

_HEAD = re.compile(r"\s*(h[1-3]):(.*)", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"\S+")


def heads(text: str) -> list[tuple[int, int, str]]:
    """Place, level and title of the lines that are marked as headings."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        if got := _HEAD.match(line):
            out.append((at, int(got[1][1]), got[2].strip()))
        at += len(line)
    return out


def _nearest(bounds: list[int], want: int, tolerance: int, after: int = -1) -> int | None:
    """The bound nearest to a place within the tolerance and beyond `after`, the lesser of two as near."""
    lo, hi = bisect.bisect_left(bounds, max(want - tolerance, after + 1)), bisect.bisect_right(bounds, want + tolerance)
    return min(bounds[lo:hi], key=lambda b: (abs(b - want), b), default=None)


def _tokens(text: str) -> int:
    return len(_PART.findall(text))


def spans_of(text: str, first: int, last: int, bounds: list[int], cfg: ChunkConfig) -> list[tuple[int, int]]:
    """First and last character of each chunk between two places."""
    size = last - first + 1
    per_token = size / max(1, _tokens(text[first : last + 1]))
    width, stride = (max(1, round(per_token * n)) for n in (cfg.target, cfg.target - cfg.overlap))
    own = [b for b in bounds if first <= b <= last]
    out, at = [], first
    while at <= last:
        end = min(last, at + width - 1)
        out.append((at, end))
        if end == last:
            break
        moved = _nearest(own, at + stride, cfg.tolerance, at)
        at = at + stride if moved is None else moved
    out = [(a if (b := _nearest(bounds, a, cfg.tolerance)) is None else b, e) for a, e in out]
    if len(out) > 1:
        (a, e), (c, f) = out[-2:]
        tail = _tokens(text[c : f + 1])
        if tail < cfg.least and _tokens(text[a : e + 1]) + tail <= int(1.2 * cfg.target):
            out[-2:] = [(a, f)]
    return out


def chunks_of(text: str, title: str, tokens: int, items: list[tuple[int, int]], cfg: ChunkConfig) -> list[tuple[int, int, str, list[str]]]:
    """First and last character, text and the two headings before it of each chunk. items: the parts that are cut by themselves."""
    marks = heads(text)
    h1 = next((t for _, level, t in marks if level == 1), "")
    before = "\n".join(dict.fromkeys(x for x in (title, h1) if x)).strip()
    if tokens < cfg.short or not text.strip():
        spans, local = [(0, max(0, len(text) - 1))], False
    else:
        lower = [at for at, level, _ in marks if level > 1]
        bounds = sorted({*lower, *(a for a, _ in items)})
        parts = [(a, min(b, len(text) - 1)) for a, b in items] or [(0, len(text) - 1)]
        spans, local = [s for a, b in parts for s in spans_of(text, a, b, bounds, cfg)], True
    out = []
    for a, b in spans:
        body = re.sub(r"\n{3,}", "\n\n", text[a : b + 1])
        near = [t for at, level, t in marks if level > 1 and at <= a][-2:][::-1] if local else []
        out.append((a, b, f"{before}\n\n{body}".strip() if before else body, near))
    return out


def assemble(docs: DataFrame, company: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks with ids, counts and a snapshot of the document's metadata. docs: doc_id, title, text, doctype, publish_date, url, final_url, topic,
    persona_tags, token_count (0 or null: counted here) and item_spans (array of structs start_char, end_char; of filings alone they are used). A null text is an empty one,
    which is one chunk; so is a text of fewer than `short` tokens."""
    lead = docs.select("*", F.when(F.lower("doctype").isin(*FILINGS), F.col("item_spans")).alias("_items"), F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(tx.token_count(F.col("text"))).alias("_tokens"))
    kind = "doc_id string, seq_no int, start_char int, end_char int, text string, local_heads array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, title, text, tokens, items in zip(frame["doc_id"], frame["title"], frame["text"], frame["_tokens"], frame["_items"], strict=True):
                parts = [(int(s["start_char"]), int(s["end_char"])) for s in (items if items is not None else [])]
                rows += [(doc, k, *c) for k, c in enumerate(chunks_of(text or "", title or "", int(tokens), parts, cfg))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq_no", "start_char", "end_char", "text", "local_heads"])

    found = lead.select("doc_id", "title", "text", "_tokens", "_items").mapInPandas(run, kind)
    snapshot = F.struct(
        F.lit(company).alias("company"), "doctype", F.coalesce("publish_date", F.lit("")).alias("date"), F.coalesce(tx.blank_to_null(F.col("final_url")), F.col("url"), F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("persona_tags", F.array().cast("array<string>")).alias("persona_tags"),
    )
    c = found.join(docs.select("doc_id", snapshot.alias("metadata_snapshot")), "doc_id")
    c = c.withColumn("chunk_id", F.format_string("%s::chunk%04d", "doc_id", "seq_no")).withColumn("word_count", tx.word_count(F.col("text")).cast("int")).withColumn("token_count", tx.token_count(F.col("text")).cast("int"))
    return c.select(*(name.split()[0] for name in CHUNK.split(", ")))


def end_flags(chunks: DataFrame) -> DataFrame:
    """chunks with is_first and is_last within their document."""
    w = Window.partitionBy("doc_id").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return chunks.withColumn("is_first", F.col("seq_no") == F.min("seq_no").over(w)).withColumn("is_last", F.col("seq_no") == F.max("seq_no").over(w))


def size_envelope(chunks: DataFrame, baselines: DataFrame, kind: str = "doctype", target: int = 800, least: int = 350) -> DataFrame:
    """By kind: chunks, and the share whose token_count lies within the baseline's median plus or minus its spread (baselines: kind,
    median_tokens, iqr_tokens; a median of 0 or above twice the target, and a missing spread, count as the target). A document's last chunk may be
    shorter."""
    median = F.when(F.col("median_tokens").between(1, 2 * target), F.col("median_tokens")).otherwise(target)
    c = end_flags(chunks).join(F.broadcast(baselines), kind, "left").withColumn("mid", median).withColumn("iqr", F.coalesce(F.nullif("iqr_tokens", F.lit(0)), F.lit(target)))
    fits = (F.col("token_count") <= F.col("mid") + F.col("iqr")) & (F.col("is_last") | (F.col("token_count") >= F.greatest(F.lit(least), F.col("mid") - F.col("iqr"))))
    return c.groupBy(kind).agg(F.count("*").alias("chunks"), (F.count_if(fits) / F.count("*")).alias("share"))


def first_baselines(docs: DataFrame, kind: str, order: Column, columns: list[str], k: int = 3) -> DataFrame:
    """By kind: whole medians of the columns over its first k rows."""
    first = docs.withColumn("_place", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("_place") <= k)
    return first.groupBy(kind).agg(F.count("*").alias("docs"), *(F.floor(F.median(c)).cast("long").alias(f"median_{c}") for c in columns))
