"""Hashed embeddings and vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 64-bit offset basis of FNV-1a, and the seed mixed into it.
_BASIS, SEED = 0xCBF29CE484222325, 0x9E3779B9
_LOW32 = 0xFFFFFFFF


def fnv1a(text: Column, seed: int = SEED) -> Column:
    """The hash's upper and lower 32 bits (struct hi, lo) of an ASCII text. Two limbs keep all products within a long: the
    prime is 2**40 + 435."""
    start = _BASIS ^ seed
    state = F.struct(F.lit(start >> 32).cast("long").alias("hi"), F.lit(start & _LOW32).cast("long").alias("lo"))

    def step(s: Column, c: Column) -> Column:
        x = s["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        low = x * F.lit(435).cast("long")
        hi = s["hi"] * F.lit(435).cast("long") + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(hi.bitwiseAND(_LOW32).alias("hi"), low.bitwiseAND(_LOW32).alias("lo"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), state, step)


def bucket(text: Column, dim: int, seed: int = SEED) -> Column:
    h = fnv1a(text, seed)
    return ((h["hi"] * F.lit((1 << 32) % dim).cast("long") + h["lo"]) % dim).cast("int")


def sign(text: Column, seed: int = SEED) -> Column:
    """+1 for an even hash, -1 for an odd one."""
    return F.when(fnv1a(text, seed)["lo"] % 2 == 0, 1).otherwise(-1)


def sparse_embedding(df: DataFrame, id_col: str, terms: Column, dim: int = 768) -> DataFrame:
    """id, idx, value: signed term counts by bucket, of unit length. A text without terms has no rows (its vector is uniform).
    Terms are counted before they are hashed, so each distinct one is hashed once for a text."""
    counted = df.select(id_col, F.explode(terms).alias("term")).groupBy(id_col, "term").count()
    h = counted.withColumn("h", fnv1a(F.col("term")))
    idx = ((F.col("h.hi") * F.lit((1 << 32) % dim).cast("long") + F.col("h.lo")) % dim).cast("int")
    signed = h.select(id_col, idx.alias("idx"), (F.col("count") * F.when(F.col("h.lo") % 2 == 0, 1).otherwise(-1)).alias("v"))
    sums = signed.groupBy(id_col, "idx").agg(F.sum("v").alias("v")).where("v <> 0")
    norms = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return sums.join(norms, id_col).select(id_col, "idx", (F.col("v") / F.col("norm")).alias("value"))


def dense(df: DataFrame, id_col: str, ids: DataFrame, dim: int = 768) -> DataFrame:
    """id and vector (array<double>) from sparse rows; ids without rows get the uniform vector."""
    maps = df.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    value = lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))
    vector = F.when(F.col("m").isNull(), F.array_repeat(F.lit(dim**-0.5), dim)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value))
    return ids.join(maps, id_col, "left").select(id_col, vector.alias("vector"))


def squared_distance(a: Column, b: Column) -> Column:
    """Of two float arrays, summed as doubles in order."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
