"""Values at places of a whole column's order; operators/ordering.py has percentiles by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def values_at(df: DataFrame, x: str, places: Callable[[int], list[int]], cuts: int = 256) -> dict[int, float]:
    """The values of a column at places (from 0, given its size) of its ascending order, without one task holding the column: counts by
    range name the ranges that hold the places, and only these ranges' values are put in order. Nulls are left out."""
    values = df.select(F.col(x).alias("x")).where("x is not null")
    edges = sorted(set(values.approxQuantile("x", [i / cuts for i in range(1, cuts)], 1 / (4 * cuts))))
    part = F.coalesce(F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, c: n + F.when(c < F.col("x"), 1).otherwise(0)), F.lit(0)) if edges else F.lit(0)
    counts = {r["part"]: r["n"] for r in values.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    wanted, before, out = places(sum(counts.values())), 0, {}
    for k in sorted(counts):
        mine = [p for p in wanted if before <= p < before + counts[k]]
        if mine:
            w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            tally = values.where(part == k).groupBy("x").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
            for p in mine:
                out[p] = tally.where(F.col("upto") > p - before).agg(F.min("x").alias("x")).first()["x"]
        before += counts[k]
    return out


def hinge_values(df: DataFrame, x: str) -> tuple[float, float, float]:
    """Tukey's lower hinge, the median and the upper hinge of a whole column; zeros for an empty one."""

    def middle(first: int, n: int) -> tuple[int, int]:
        return first + (n - 1) // 2, first + n // 2

    def halves(n: int) -> list[tuple[int, int]]:
        return [middle(0, n // 2) if n > 1 else middle(0, n), middle(0, n), middle(n - n // 2, n // 2) if n > 1 else middle(0, n)]

    size = 0

    def places(n: int) -> list[int]:
        nonlocal size
        size = n
        return sorted({p for pair in halves(n) for p in pair}) if n else []

    at = values_at(df, x, places)
    return tuple((at[a] + at[b]) / 2 for a, b in halves(size)) if size else (0.0, 0.0, 0.0)


def exact_sum(x: Column) -> Column:
    """Sum of doubles that doesn't hang on the order of rows: of their first twelve decimals, or, where one is too large for that, NaN or infinite, the usual sum."""
    exact = x.try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(x), F.try_sum(exact).cast("double")).otherwise(F.sum(x))
