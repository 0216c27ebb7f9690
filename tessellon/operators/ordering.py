"""Places in an order, found without a task that holds the order: numbering, percentiles, shuffles, draws and deals.

Rows are cut into ranges of the order (groups first, then the order within them). What stands before a range is a number for each range;
within a range places are counted by a window over that range's part of a group. So no window runs over all rows or over a whole
group, however large. Of a group that goes over several ranges, only the first group of a range can have begun before: that is all that is
carried from range to range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.plans.session import staged

Places = Callable[[Column], list[Column]]
#: Draws of a sample that are sent to all tasks at once; more are joined by an exchange.
FEW_DRAWS = 100_000


def _ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """df with _range, staged: the cuts come from a sample, so they are made once."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(parts, *(F.col(c) for c in by), *order).withColumn("_range", F.spark_partition_id()), "ranged")


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _carried(ranged: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """_range, _group (the range's first group) and _offset (what stands of it in earlier ranges): a row for each range."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    parts = ranged.groupBy("_range", group.alias("_group")).agg(F.sum(weight).alias("w"))
    ends = parts.groupBy("_range").agg(F.min("_group").alias("first"), F.max(F.struct("_group", "w")).alias("last")).orderBy("_range").collect()
    rows, held, sofar = [], None, 0
    for r in ends:
        goes_on = held is not None and all(map(_same, held, r["first"]))
        rows.append((r["_range"], r["first"], sofar if goes_on else 0))
        alone = all(map(_same, r["first"], r["last"]["_group"]))
        held, sofar = r["last"]["_group"], r["last"]["w"] + (sofar if goes_on and alone else 0)
    kind = parts.schema["_group"].dataType.simpleString()
    return ranged.sparkSession.createDataFrame(rows, f"_range int, _group {kind}, _offset long")


def placed(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), weight: str | None = None, place: str = "place") -> DataFrame:
    """df with the number of rows (or the sum of a column of longs) that stand before each row in its group, by `order`, which should leave no ties."""
    own = F.col(weight) if weight else F.lit(1)
    ranged = _ranged(df, order, by)
    carried = _carried(ranged, by, own)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    w = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(own).over(w), F.lit(0)).cast("long")
    numbered = ranged.withColumn(place, here).join(F.broadcast(carried), "_range")
    return numbered.withColumn(place, F.col(place) + F.when(group.eqNullSafe(F.col("_group")), F.col("_offset")).otherwise(0)).drop("_range", "_group", "_offset")


# ---------------------------------------------------------------- percentiles


def nearest_rank(p: float) -> Places:
    """The ceil(p n)-th smallest value."""
    return lambda n: [F.ceil(F.lit(p) * n) - 1]


def floor_index(p: float) -> Places:
    """The value at index floor(p (n - 1))."""
    return lambda n: [F.floor(F.lit(p) * (n - 1))]


def even_index(p: float) -> Places:
    """The value at index p (n - 1), halves rounded to even."""
    return lambda n: [F.bround(F.lit(p) * (n - 1))]


def upper_median(n: Column) -> list[Column]:
    """The value at index n // 2."""
    return [F.floor(n / 2)]


def median(n: Column) -> list[Column]:
    return [F.floor((n - 1) / 2), F.floor(n / 2)]


def _half(n: Column, first: Column) -> list[Column]:
    size = F.floor(n / 2)
    return [F.when(size > 0, first + p) for p in median(size)]


def lower_hinge(n: Column) -> list[Column]:
    """Tukey's: the median of the lower half, the middle value left out."""
    return _half(n, F.lit(0))


def upper_hinge(n: Column) -> list[Column]:
    return _half(n, n - F.floor(n / 2))


def percentiles(df: DataFrame, x: str, wanted: dict[str, Places], by: Sequence[str] = ()) -> DataFrame:
    """A row for each group with the values at the wanted places of its ascending order of x (nulls left out); of two places the mean.
    Equal values are counted before they are ordered, so a value that most rows have is one row. Only the counts are staged and read again; df is computed once."""
    own = [f"_by{k}" for k in range(len(by))]
    counted = df.select(*by, F.col(x).alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_n"))
    numbered = placed(counted, [F.col("_x")], by, "_n", "_before").select(*(F.col(c).alias(o) for c, o in zip(by, own, strict=True)), "_x", "_n", "_before")
    sizes = numbered.groupBy(*own).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_size")).select(*(F.col(o).alias(c) for c, o in zip(by, own, strict=True)), "_size")
    match = F.lit(True)
    for k, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    met = sizes.join(numbered, match, "left") if by else numbered.crossJoin(F.broadcast(sizes))
    at = lambda p: F.max(F.when((p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")), F.col("_x")))
    figures = []
    for name, places in wanted.items():
        values = [at(p) for p in places(F.col("_size"))]
        figures.append((values[0] if len(values) == 1 else (values[0].cast("double") + values[1].cast("double")) / 2).alias(name))
    return met.groupBy(*by).agg(*figures)


# ---------------------------------------------------------------- shuffles, draws, deals


def seeded(*keys: str | Column, seed: int = 7) -> Column:
    """A seeded order that any engine can repeat: the digest of the seed and the keys."""
    return F.sha1(F.concat_ws("/", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)))


def shuffled(df: DataFrame, id_col: str, seed: int = 42, by: Sequence[str] = (), place: str = "place") -> DataFrame:
    """df with each row's place (from 0) in a seeded shuffle, of each group if groups are given."""
    return placed(df.withColumn("_h", seeded(id_col, seed=seed)), [F.col("_h"), F.col(id_col)], by, place=place).drop("_h")


def with_replacement(rows: DataFrame, order: str, n: int, seed: int = 42) -> DataFrame:
    """n seeded draws from rows numbered by their order (draw, and the row drawn), repeatable in any engine: draw k takes the row at the digest of
    seed and k, as a number, modulo the number of rows."""
    size = rows.count()
    if not size:
        return rows.select(F.lit(0).cast("long").alias("draw"), "*").limit(0)
    digest = F.conv(F.left(seeded("id", seed=seed), F.lit(12)), 16, 10).cast("long")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (digest % size).alias("_place"))
    draws = F.broadcast(draws) if n <= FEW_DRAWS else draws
    return draws.join(placed(rows, [F.col(order)], place="_place"), "_place").drop("_place")


def round_robin(rows: DataFrame, order: Sequence[Column], names: Sequence[str], column: str) -> DataFrame:
    """rows with names dealt out in turn, in the given order."""
    dealt = placed(rows, order, place="_place")
    return dealt.withColumn(column, F.element_at(F.array(*map(F.lit, names)), (F.col("_place") % len(names) + 1).cast("int"))).drop("_place")
