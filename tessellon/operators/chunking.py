"""Documents to overlapping windows, and spans of titled items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as tx


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 800
    overlap: int = 120
    short: int = 350
    tolerance: int = 50
    least: int = 120


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """df with further columns that are computed once a row: Catalyst would repeat a column's expression wherever it is named."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def windows(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seq_no, start_char, end_char (inclusive), text, token_count and word_count of each window.

    Closed form: a text of len characters and n tokens has cpt = len / n characters by token; windows are round(cpt * target) wide and
    start every round(cpt * (target - overlap)) characters. A last window of fewer than `least` tokens joins the one before if
    both have 1.2 * target tokens or fewer. A text of fewer than `short` tokens is one window; an empty one has none."""
    t = F.col(text_col)
    d = docs.where(F.length(t) > 0).select(F.col(id_col).alias("id"), t.alias("t"))
    d = _once(d, F.length("t").alias("len"), tx.token_count(F.col("t")).alias("n"))
    cpt = F.col("len") / F.greatest(F.col("n"), F.lit(1))
    d = d.withColumn("win", F.greatest(F.lit(1), F.bround(cpt * cfg.target)).cast("int")).withColumn("step", F.greatest(F.lit(1), F.bround(cpt * (cfg.target - cfg.overlap))).cast("int"))
    many = F.when((F.col("n") < cfg.short) | (F.col("len") <= F.col("win")), 1).otherwise(1 + F.ceil((F.col("len") - F.col("win")) / F.col("step"))).cast("int")
    d = d.withColumn("k", many)
    piece = lambda i: F.struct(i.alias("seq_no"), (i * F.col("step")).alias("start"), F.when(F.col("k") == 1, F.col("len")).otherwise(F.least(F.col("len"), i * F.col("step") + F.col("win"))).alias("stop"))
    d = _once(d, F.transform(F.sequence(F.lit(0), F.col("k") - 1), piece).alias("pieces"))
    last, prior = F.element_at("pieces", -1), F.try_element_at("pieces", F.lit(-2))
    tokens = lambda p: tx.token_count(F.substring(F.col("t"), p["start"] + 1, p["stop"] - p["start"]))
    d = _once(d, F.when(F.col("k") > 1, tokens(last)).alias("tail"))
    joins = F.coalesce(F.col("tail") < cfg.least, F.lit(False)) & (F.col("tail") + tokens(prior) <= int(1.2 * cfg.target))
    both = F.struct(prior["seq_no"].alias("seq_no"), prior["start"].alias("start"), last["stop"].alias("stop"))
    d = d.withColumn("pieces", F.when(joins, F.concat(F.slice("pieces", F.lit(1), F.greatest(F.col("k") - 2, F.lit(0))), F.array(both))).otherwise(F.col("pieces")))
    out = d.select("id", "t", F.explode("pieces").alias("p"))
    body = F.substring(F.col("t"), F.col("p.start") + 1, F.col("p.stop") - F.col("p.start"))
    out = _once(out, body.alias("text")).select(F.col("id").alias(id_col), F.col("p.seq_no").alias("seq_no"), F.col("p.start").alias("start_char"), (F.col("p.stop") - 1).alias("end_char"), "text")
    return out.withColumn("token_count", tx.token_count(F.col("text"))).withColumn("word_count", tx.word_count(F.col("text")))


def snapped_starts(length: Column, win: Column, step: Column, bounds: Column, tolerance: int = 50) -> Column:
    """Starts of windows when a start may move to a heading: each next start is the bound (bounds: ascending) nearest to start + step within the
    tolerance and after the start, the lesser of two, else start + step, until a window reaches the end."""

    def of(n: int, win: int, step: int, marks: np.ndarray) -> list[int]:
        out = [0]
        while out[-1] + win < n:
            at, want = out[-1], out[-1] + step
            low, high = np.searchsorted(marks, [max(at + 1, want - tolerance), want + tolerance + 1])
            near = marks[low:high]
            out.append(int(near[np.argmin(np.abs(near - want))]) if len(near) else want)
        return out

    @F.pandas_udf("array<int>")
    def starts(n: pd.Series, win: pd.Series, step: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([of(*row[:3], np.asarray(row[3], np.int64)) for row in zip(n, win, step, marks, strict=True)])

    return starts(length, win, step, bounds)


def line_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 0) and pos of every line of a text, and of the end after its last one."""
    d = docs.select(id_col, F.posexplode(F.concat(F.split(text_col, "\n", -1), F.array(F.lit("")))).alias("line", "t"))
    before = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return d.select(id_col, F.col("line").cast("long").alias("line"), F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)).alias("pos"))


def _with_marks(chunks: DataFrame, marks: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """chunks (mark is false) and marks (pos and other columns) of a document together, by place, marks first where places are equal; and their order."""
    both = chunks.withColumns({"_at": F.col("start_char").cast("long"), "_mark": F.lit(1)}).unionByName(marks.withColumns({"_at": F.col("pos").cast("long"), "_mark": F.lit(0)}), allowMissingColumns=True)
    return both, Window.partitionBy(id_col).orderBy("_at", "_mark")


def with_heads(chunks: DataFrame, heads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """chunks with local_heads: the titles of the last two headings (id, pos, title) at or before each start, the nearest first. A document is gone through once, by place."""
    prior = F.lag("title").over(Window.partitionBy(id_col).orderBy("pos", "title"))
    both, order = _with_marks(chunks, heads.select(id_col, "pos", F.array_compact(F.array("title", prior)).alias("local_heads")), id_col)
    last = F.last("local_heads", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    none = F.array().cast("array<string>")
    return both.withColumn("local_heads", F.coalesce(last, none)).where("_mark = 1").drop("_at", "_mark", "pos")


def aligned_starts(chunks: DataFrame, bounds: DataFrame, tolerance: int = 50, id_col: str = "doc_id") -> DataFrame:
    """chunks of documents that have bounds (id, pos) with delta, how far their start is from the nearest, and whether that is within the tolerance. A document is gone
    through twice, by place."""
    both, order = _with_marks(chunks, bounds.select(id_col, "pos"), id_col)
    back = Window.partitionBy(id_col).orderBy(F.desc("_at"), "_mark")
    sofar = lambda w: F.last("pos", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_below", sofar(order)).withColumn("_above", sofar(back)).where("_mark = 1")
    delta = F.least(F.col("_at") - F.col("_below"), F.col("_above") - F.col("_at"))
    return met.withColumn("delta", delta).where("delta is not null").withColumn("aligned", F.col("delta") <= tolerance).drop("_at", "_mark", "pos", "_below", "_above")


# Items that have titles of their own, and the word in a line's title that leaves it in place of them.
TITLES = {"Item 1": ("Business", "business"), "Item 1A": ("Risk Factors", "risk"), "Item 7": ("Management’s Discussion and Analysis", "discussion"), "Item 7A": ("Market Risk", "risk"), "Item 8": ("Financial Statements", "financial")}


def item_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, title, start_char, end_char (inclusive) of the items whose lines say "Item 1A" and the like, by start. Items of TITLES
    have its title unless the line has another one."""
    d = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("len"), F.posexplode(F.split(text_col, "\n", -1)).alias("k", "line"))
    by_line = Window.partitionBy("id").orderBy("k")
    d = d.withColumn("start", F.sum(F.length("line") + 1).over(by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("line") - 1)
    found = r"(?i)\bitem[\s ]*(\d+(?:\.\d+)?)(?:\s*([ab])(?![a-z]))?\.?\s*(.*)$"
    d = d.where(F.col("line").rlike(found))
    label = F.concat(F.lit("Item "), F.regexp_extract("line", found, 1), F.upper(F.regexp_extract("line", found, 2)))
    d = d.select("id", "len", "start", label.alias("label"), F.trim(F.regexp_extract("line", found, 3)).alias("title"))
    fixed = F.col("title")
    for name, (title, word) in TITLES.items():
        fixed = F.when((F.col("label") == name) & ((F.col("title") == "") | F.lower("title").contains(word)), title).otherwise(fixed)
    d = d.withColumn("title", fixed)
    after = F.lead("start").over(Window.partitionBy("id").orderBy("start"))
    return d.select(F.col("id").alias(id_col), "label", "title", F.col("start").cast("long").alias("start_char"), (F.coalesce(after, F.col("len")) - 1).cast("long").alias("end_char"))


def span_coverage(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    sums = spans.groupBy(id_col).agg(F.sum(F.col("end_char") - F.col("start_char") + 1).alias("covered"), F.count("*").alias("items"))
    out = docs.select(id_col, F.length(text_col).alias("len")).join(sums, id_col, "left")
    return out.select(id_col, F.coalesce("items", F.lit(0)).alias("items"), (F.coalesce("covered", F.lit(0)) / F.greatest(F.col("len"), F.lit(1))).alias("coverage"))


def adjacent_similarity(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Similarity of each chunk's words with the next one's: stop words and the 120 words nearest the seam left out."""
    avoid = F.array(*map(F.lit, tx.STOP))
    w = F.filter(tx.ascii_words(F.col("text")), lambda x: ~F.array_contains(avoid, x))
    c = chunks.select(id_col, "seq_no", w.alias("w"))
    c = c.withColumn("w2", F.lead("w").over(Window.partitionBy(id_col).orderBy("seq_no"))).where("w2 is not null")
    left = F.when(F.size("w") > 120, F.slice("w", F.lit(1), F.size("w") - 120)).otherwise(F.col("w"))
    right = F.when(F.size("w2") > 120, F.slice("w2", F.lit(121), F.size("w2"))).otherwise(F.col("w2"))
    return c.select(id_col, "seq_no", tx.jaccard(F.array_distinct(left), F.array_distinct(right)).alias("jaccard"))


def distant_similarity(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Similarity of chunks of a document that aren't neighbours, by word sets."""
    c = chunks.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("seq_no")).alias("rn"), F.array_distinct(tx.ascii_words(F.col("text"))).alias("w"))
    a, b = c.alias("a"), c.alias("b")
    both = a.join(b, (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("b.rn") >= F.col("a.rn") + 2))
    return both.select(F.col(f"a.{id_col}").alias(id_col), F.col("a.rn").alias("left_no"), F.col("b.rn").alias("right_no"), tx.jaccard(F.col("a.w"), F.col("b.w")).alias("jaccard"))
