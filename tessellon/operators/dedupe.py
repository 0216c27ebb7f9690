"""Exact and near duplicates of texts by shingle sets, their groups, and the rows that stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.plans.session import drop, staged

#: Frequent shingles that all tasks know; others are ordered as rare ones.
MOST_FREQUENT = 100_000
#: Shingles of texts that are compared in one group, about (a text counts as LEAST_SHINGLES at least), and rows that are broadcast at most.
GROUP_SHINGLES, LEAST_SHINGLES, FEW = 1 << 20, 512, 1_000_000


def exact_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest, members and least id of texts that occur more than once."""
    return docs.groupBy(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("members"), F.min(id_col).alias("first_id")).where("members > 1")


def _shingles(text: Column, k: int) -> Column:
    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(k))))
        return F.when(F.size(w) >= k, F.array_sort(F.array_distinct(every)))

    return tx.let(tx.ascii_words(text), runs)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, exempt: str | None = None) -> DataFrame:
    """id and s (hashes of the distinct shingles in ascending order) of texts of k words or more."""
    rows = docs.where(f"not ({exempt})") if exempt else docs
    return rows.select(F.col(id_col).alias("id"), _shingles(F.col(text_col), k).alias("s")).where("s is not null")


def near_links(docs: DataFrame, threshold: float = 0.85, k: int = 5, id_col: str = "doc_id", text_col: str = "text", exempt: str | None = None, posting_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """id_a < id_b and jaccard of texts whose shingle sets are that alike, one text (the least id) standing for all with an equal set; and
    these copies (id_a, id_b, jaccard 1). Together they join whatever the pairs of all texts join.

    Only a prefix of each set is joined, where frequent shingles come last, so common passages don't pair everything with everything; exact counts then
    come from the sets of the pairs that remain. Sets are larger than their texts, so they aren't stored: those of candidates are computed once more. posting_cap, off
    by default, drops shingles in more texts than that, which can lose pairs. Texts that fulfil `exempt` (a condition in SQL) are left out."""
    rows = docs.where(f"not ({exempt})") if exempt else docs
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    same = [F.xxhash64("s").alias("h"), F.hash("s").alias("h2")]
    if posting_cap:
        heads = staged(shingle_sets(texts, "id", "text", k), "sets")
        marks, first = heads.select("id", *same), _capped_prefixes(heads, threshold, posting_cap)
    else:
        # texts without a set are left out in _prefixes: a condition on sets would compute them twice
        heads = staged(_prefixes(texts.select("id", _shingles(F.col("text"), k).alias("s")).select("id", "s", *same), threshold), "heads")
        marks, first = heads, heads
    one = marks.groupBy("h", "h2").agg(F.min("id").alias("id"))
    copies = marks.select("id", "h", "h2").join(one.withColumnRenamed("id", "id_a"), ["h", "h2"]).where("id <> id_a")
    copies = staged(copies.select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard")), "copies")
    prefix = first.join(_few(copies.select(F.col("id_b").alias("id"))), "id", "left_anti").select("id", "n", F.posexplode("own").alias("at", "s"))
    a, b = prefix.alias("a"), prefix.alias("b")
    lengths = (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
    # what the sets have in common at most, if this is the first that they share
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    enough = room >= F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-6
    if posting_cap:
        enough = F.lit(True)
    named = [F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in ("id", "n")]
    candidates = staged(a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.id") < F.col("b.id")) & lengths & enough).select(*named).distinct(), "candidates")
    drop(heads)
    pairs = _compared(texts, candidates, threshold, k)
    drop(candidates)
    return pairs, copies


def _few(rows: DataFrame) -> DataFrame:
    """Rows that are broadcast if they aren't many, so that what they are joined to need not be exchanged."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _compared(texts: DataFrame, candidates: DataFrame, threshold: float, k: int) -> DataFrame:
    """id_a, id_b and jaccard of the candidates (id_a, n_a, id_b, n_b) that are that alike. Candidates of one family (texts with the same least text within two steps) are compared in
    one group, large families in several by blocks of their texts, so a set is sent about once however many pairs it is in."""
    sides = candidates.select(F.col("id_a").alias("id"), F.col("n_a").alias("n"), F.col("id_b").alias("other")).union(candidates.select("id_b", "n_b", "id_a"))
    near = sides.groupBy("id").agg(F.first("n").alias("n"), F.min("other").alias("other")).select("id", "n", F.least("id", "other").alias("family"))
    further = sides.select("id", "other").join(near.select(F.col("id").alias("other"), F.col("family").alias("further")), "other").groupBy("id").agg(F.min("further").alias("further"))
    weight = F.greatest("n", F.lit(LEAST_SHINGLES)).cast("long")
    near = staged(near.join(further, "id").select("id", F.least("family", "further").alias("family"), weight.alias("weight")), "families")
    blocks = near.groupBy("family").agg(F.ceil(F.sum("weight") / GROUP_SHINGLES).cast("int").alias("blocks"))
    place = near.join(blocks, "family").select("id", F.struct("family", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).alias("place"))
    groups = max(1, -(-(near.agg(F.sum("weight")).first()[0] or 0) // GROUP_SHINGLES))
    dealt = candidates.select("id_a", "id_b").join(place.toDF("id_a", "place_a"), "id_a").join(place.toDF("id_b", "place_b"), "id_b")
    dealt = staged(dealt.select(F.pmod(F.xxhash64("place_a", "place_b"), F.lit(groups)).cast("int").alias("group"), "id_a", "id_b"), "dealt")
    wanted = dealt.select(F.col("id_a").alias("id"), "group").union(dealt.select("id_b", "group")).groupBy("id").agg(F.collect_set("group").alias("groups"))
    sets = texts.join(_few(wanted), "id").select("id", "groups", _shingles(F.col("text"), k).alias("s")).select(F.explode("groups").alias("group"), "id", "s")

    def compare(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        lists, ids = sets.column("s").combine_chunks(), sets.column("id").combine_chunks()
        values, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        a, b = (pc.index_in(pairs.column(c), value_set=ids).to_numpy() for c in ("id_a", "id_b"))
        order = np.argsort(a, kind="stable")
        shared = np.zeros(len(a), np.int64)
        for own in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
            one = values[ends[a[own[0]]] - size[a[own[0]]] : ends[a[own[0]]]]
            others = np.concatenate([values[ends[j] - size[j] : ends[j]] for j in b[own]])
            met = one[np.minimum(np.searchsorted(one, others), len(one) - 1)] == others
            shared[own] = np.add.reduceat(met.astype(np.int64), np.cumsum(size[b[own]]) - size[b[own]])
        jaccard = shared / (size[a] + size[b] - shared)
        return pa.table([pairs.column("id_a"), pairs.column("id_b"), pa.array(jaccard)], ["id_a", "id_b", "jaccard"]).filter(pa.array(jaccard >= threshold))

    # twice as many tasks as groups, so that few tasks have several
    both = [d.repartition(2 * groups, "group").groupBy("group") for d in (dealt, sets)]
    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in ("id_a", "id_b"))
    pairs = staged(both[0].cogroup(both[1]).applyInArrow(compare, f"{kinds}, jaccard double"), "links")
    drop(near, dealt)
    return pairs


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """id, n and own, the first n - ceil(threshold n) + 1 shingles of each set, and further columns as they are; rows without a set are left out. All sets have one order, so two that are
    that alike share one of these, whatever the order: frequent shingles, as known from a sixteenth of the texts, go last by their number there, and others by hash. A set is cut where
    it is read."""
    # explode() would add a condition on s, for which all texts' sets are computed
    often = sets.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).select(F.explode_outer("s").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    rows = often.orderBy(F.desc("c"), "s").limit(MOST_FREQUENT).collect()
    known = np.array(sorted((r["s"], r["c"]) for r in rows if r["s"] is not None), np.int64).reshape(-1, 2)
    shared = sets.sparkSession.sparkContext.broadcast(known)
    further = [c for c in sets.columns if c not in ("id", "s")]

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        lists, known = part.column(1), shared.value
        values = lists.flatten().to_numpy()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        often = np.zeros(len(values), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known[:, 0], values), len(known) - 1)
            often = np.where(known[place, 0] == values, known[place, 1], 0)
        ordered = values[np.lexsort((values, often, owner))]
        room = (n - np.ceil(threshold * n - 1e-9) + 1).astype(np.int64)
        own = ordered[np.arange(len(values)) - (np.cumsum(n) - n)[owner] < room[owner]]
        ends = np.concatenate([[0], np.cumsum(room)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(own)), *part.columns[2:]], ["id", "n", "own", *further])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield cut(part.filter(part.column(1).is_valid()))

    more = "".join(f", {c} {sets.schema[c].dataType.simpleString()}" for c in further)
    return sets.select("id", "s", *further).mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, n int, own array<bigint>{more}")


def _capped_prefixes(sets: DataFrame, threshold: float, posting_cap: int) -> DataFrame:
    """As _prefixes, by the shingles' true numbers, without those in more texts than the cap or in one alone."""
    rows = sets.select("id", F.size("s").alias("n"), F.xxhash64("s").alias("h"), F.hash("s").alias("h2"), F.explode("s").alias("s"))
    df = rows.groupBy("s").agg(F.countDistinct("h", "h2").alias("df")).where(F.col("df").between(2, posting_cap))
    met = rows.join(df, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))
    room = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    return met.select("id", "n", F.slice("own", F.lit(1), room)["s"].alias("own"))


def near_pairs(docs: DataFrame, threshold: float = 0.85, k: int = 5, id_col: str = "doc_id", text_col: str = "text", exempt: str | None = None, posting_cap: int | None = None) -> DataFrame:
    """All pairs of near_links, those of copies among each other and with others included: as many as the texts' groups have. For groups
    and for what stays, links() is enough."""
    pairs, copies = near_links(docs, threshold, k, id_col, text_col, exempt, posting_cap)
    ids = copies.select("id_a").distinct().select(F.col("id_a").alias("rep"), F.col("id_a").alias("id")).union(copies.select("id_a", "id_b"))
    a, b = ids.select("rep", F.col("id").alias("x")), ids.select("rep", F.col("id").alias("y"))
    within = a.join(b, "rep").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("jaccard"))
    across = pairs.join(a.withColumnRenamed("rep", "id_a"), "id_a", "left").join(b.withColumnRenamed("rep", "id_b"), "id_b", "left")
    x, y = F.coalesce("x", "id_a"), F.coalesce("y", "id_b")
    return across.select(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"), "jaccard").union(within)


def links(docs: DataFrame, **how) -> DataFrame:
    """id_a, id_b and jaccard of links that join the same groups as all pairs do, with the same least and greatest similarity."""
    pairs, copies = near_links(docs, **how)
    return pairs.union(copies)


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """id and component (least id) of every id in the pairs. Labels spread along the pairs and jump to their label's own label in each round, so
    the number of rounds grows with the logarithm of a chain's length."""
    edges = staged(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(F.col(b), F.col(a))).distinct(), "edges")
    labels, before = edges.select(F.col("x").alias("id")).distinct().withColumn("component", F.col("id")), None
    while True:
        around = edges.join(labels, edges["y"] == labels["id"]).groupBy("x").agg(F.min("component").alias("m"))
        near = labels.join(around, labels["id"] == around["x"]).select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        near = staged(near, "near")
        jump = near.select(F.col("id").alias("component"), F.col("component").alias("further"))
        then = staged(near.join(jump, "component").select("id", F.col("further").alias("component"), "old"), "labels")
        drop(near, *([before] if before else []))
        if then.where("component <> old").limit(1).count() == 0:
            drop(edges)
            return then.select("id", "component")
        labels, before = then.select("id", "component"), then


def groups(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", day: str | None = None, words: str = "word_count", found: DataFrame | None = None) -> DataFrame:
    """canonical id, members, and the least and greatest similarity within each group of near duplicates. Canonical is the row with the
    earliest day (null last), then the most words, then the least id. found: the pairs' components, where they are there already."""
    found = components(pairs) if found is None else found
    canon = _canonical(docs, found, id_col, day, words)
    scores = pairs.join(found, pairs["id_a"] == found["id"]).groupBy("component").agg(F.min("jaccard").alias("jaccard_min"), F.max("jaccard").alias("jaccard_max"))
    return canon.join(scores, "component")


def _canonical(docs: DataFrame, found: DataFrame, id_col: str, day: str | None, words: str) -> DataFrame:
    order = F.struct(F.coalesce(F.col(day).cast("string"), F.lit("9999-12-31")) if day else F.lit(""), -F.col(words), F.col(id_col))
    members = found.join(docs.select(F.col(id_col), order.alias("o")), found["id"] == F.col(id_col)).drop(id_col)
    return members.groupBy("component").agg(F.min_by("id", "o").alias("canonical_id"), F.count("*").alias("members"))


def kept(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", day: str | None = None, words: str = "word_count") -> DataFrame:
    """docs without the members of groups that aren't canonical."""
    found = components(pairs)
    canon = _canonical(docs, found, id_col, day, words).select("component", "canonical_id")
    gone = found.join(canon, "component").where("id <> canonical_id").select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")


def largest_groups(found: DataFrame, k: int = 5) -> DataFrame:
    """component and members of the k largest groups, ties by component."""
    return found.groupBy("component").agg(F.count("*").alias("members")).orderBy(F.col("members").desc(), "component").limit(k)


def low_coverage(coverage: DataFrame, least: float = 0.9, k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The k documents of the least coverage below `least`, ties by id."""
    return coverage.where(F.col("coverage") < least).orderBy("coverage", id_col).limit(k)
