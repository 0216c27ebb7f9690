"""Connected components by alternating large and small stars (Kiveris et al. 2014), on DataFrames. Before each exchange the edges of
a block, at most EDGES of them, are replaced by stars that connect the same nodes: few blocks need few rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm import common

#: About so many edges are held and contracted together.
EDGES = 500_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges that isn't the least of its component here, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in common.gathered(batches, common.longs(["a", "b"]), EDGES):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in contracted(rows["a"], rows["b"])], ["a", "b"])


def _shorter(edges: DataFrame) -> DataFrame:
    """Edges a > b, each once, that connect what the edges (longs, in any order) connect."""
    return common.stage(edges.where("a <> b").mapInArrow(_blocks, "a long, b long").distinct(), "edges")


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links each node's neighbours to the least of them. Sums by key come first, so a hub's edges meet the least
    node in a join that can be split, never in one list."""
    if both_ways:  # large star: a node's greater neighbours move to the least node around it
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # small star: a is the greater end; it and its lesser neighbours move to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
        moved = moved.select(F.col("s.b").alias("a"), F.col("s.m").alias("b"))
    return moved.where("a <> b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each greater end has one edge and is no lesser end: then the edges are nodes and roots."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    seen = ends.groupBy("v").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return seen.where("ups > 0 and n > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in the edges (columns a, b: longs, in any order) that is no root itself."""
    now = _shorter(edges.select("a", "b"))
    while not _are_stars(now):
        then = _shorter(_star(_star(now, True), False))
        common.drop_stage(now.sparkSession, now)
        now = then
    return common.leaving(now.select(F.col("a").alias("node"), F.col("b").alias("root")), now)
