"""Near-duplicate documents by BagMinHash (operator 7).

A text is the multiset of its five-word shingles (a shorter text is one shingle). Its signature has 128 slots. Each shingle
drives Poisson processes over the levels of its weight, one for each dyadic block of levels 0-1, 1-2, 2-4, 4-8 and so
on; a point's place within its block is found by halving, and it counts if that level is below the weight. Points come in ascending
order, each falls to a slot, and a slot keeps its least point; a process ends once its points exceed all
slots' values. Two signatures agree in a slot with the weighted Jaccard similarity's probability (Ertl 2018).

32 bands of 4 slots propose pairs (a pair at similarity 0.8 is missed with probability 5e-8); multiset overlap over the shingles themselves
verifies them. Texts with equal words are one node, so copies are never paired. Within a band's list of more
than MOST nodes all are paired with the first; after verified links have been joined to components, nodes outside the main component of
long lists that share nodes (a family) are compared with the family's other nodes, in blocks, until they are linked to them or all likely
ones have been verified, so no link is lost to a list's length and links are not multiplied by it. A task holds at most about HELD of these nodes; more
are dealt to several tasks, each of which reads the family. One bit of each slot travels with a node, and pairs whose 128 bits put the
similarity far below the threshold (4.7 standard deviations) are not verified; with bits_apart=128 all that a band proposes are.

A class is a connected component of verified links. Null and empty texts have no shingles: they form one class. A null
doc_id is no class's id unless the class has no other; rows with equal doc_id and text count as one document. Texts are read whole, so a worker's
memory must hold the longest one's shingles; an empty table gives an empty result. Columns named __tess_* are the operator's own; all others are passed
on by keep_one. docs is read several times: pass a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common
from tessellon.llm.components import components

SLOTS, BANDS = 128, 32
THRESHOLD = 0.8
MOST = 32
#: Nodes of a family outside its main component that a task holds, with their multisets.
HELD = 2000
#: Of 128 one-bit samples, at most so many differ at similarity 0.8: the mean 12.8 and 4.7 standard deviations (3.4).
BITS_APART = 29


def multisets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their weights, and the number of distinct ones of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    weights = np.diff(np.concatenate([at, [len(h)]]))
    return h[at], weights, np.bincount(o[at], minlength=len(counts))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """One row of SLOTS values for each text; infinite where a text has no elements."""
    texts = len(counts)
    least = np.full((texts, SLOTS), np.inf)
    worst = np.full(texts, np.inf)  # the greatest value of each row: a process beyond it has ended
    flat = least.ravel()
    owner = np.repeat(np.arange(texts), counts)
    block, low = 0, 0
    with np.errstate(over="ignore"):
        while True:
            alive = np.flatnonzero(weights > low)
            if not len(alive):
                return least
            width = 1 if low == 0 else low
            state = common.mix64(elements[alive] + np.uint64((seed * 64 + block) * 0x9E3779B97F4A7C15 % (1 << 64)))
            x, own, w, step = np.zeros(len(alive)), owner[alive], weights[alive], 0
            while len(x):
                step += 1
                draw = common.mix64(state + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
                x = x - np.log(_uniform(draw)) / width
                go = x < worst[own]
                state, x, own, w, draw = state[go], x[go], own[go], w[go], draw[go]
                more = common.mix64(draw + np.uint64(0x632BE59BD9B4E019))
                hit = own * SLOTS + (more & np.uint64(SLOTS - 1)).astype(np.int64)
                value = x
                if width > 1:  # the point's level, by halving the block: each bit picks a half
                    level = low + ((more >> np.uint64(40)).astype(np.int64) & (width - 1))
                    counted = level < w
                    hit, value = hit[counted], x[counted]
                better = value < flat[hit]
                np.minimum.at(flat, hit[better], value[better])
                if better.any():
                    rows = np.unique(hit[better] // SLOTS)
                    worst[rows] = least[rows].max(1)
            low = 1 if low == 0 else low * 2
            block += 1


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, SLOTS // BANDS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(77), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(bits.shape[2]):
            out = common.mix64(out + bits[:, :, k])
    return out


def one_bits(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.packbits((common.mix64(signature.view(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view("<u8")
    return packed[:, 0].astype(np.uint64).view(np.int64), packed[:, 1].astype(np.uint64).view(np.int64)


def _text_parts(texts: list[bytes | None]):
    """Nodes (hash of the words in turn), shingle hashes laid end to end, and the number of shingles of each text."""
    hashes, counts = common.hash_texts(texts)
    ends = np.cumsum(counts)
    raw = hashes.tobytes()
    nodes = [xxhash.xxh3_64_intdigest(raw[8 * (e - n) : 8 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    return np.array(nodes, np.uint64).view(np.int64), *common.shingle_runs(hashes, counts)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node (hash of the words), row and row2 (hashes of id and text), n (shingles), x, y (one bit of each slot) and band hashes (binary) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        common.use_only()
        for batch in batches:
            for part in common.slices(batch, "text", 1_500_000):
                nodes, runs, many = _text_parts(common.pylist(part, "text"))
                # copies side by side are signed once
                _, first, again = np.unique(nodes, return_index=True, return_inverse=True)
                ends = np.cumsum(many)
                mine = np.concatenate([np.arange(ends[i] - many[i], ends[i]) for i in first])
                elements, weights, counts = multisets(runs[mine.astype(np.int64)], many[first])
                got = signatures(elements, weights, counts)
                x, y = one_bits(got)
                bands = [b.tobytes() if n else b"" for b, n in zip(band_hashes(got).astype("<u8"), many[first], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(nodes), pa.array(many.astype(np.int64)), pa.array(x[again]), pa.array(y[again]), pa.array([bands[k] for k in again], pa.binary())], ["id", "row", "row2", "node", "n", "x", "y", "bands"])

    source = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), common.as_bytes(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, row long, row2 int, node long, n long, x long, y long, bands binary")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """96 bits that tell rows of other ids or texts apart."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.hash(F.col(text_col), F.col(id_col)).alias("row2")]


def _postings(batches):
    for batch in batches:
        bands = common.pylist(batch, "bands")
        has = np.array([len(b) > 0 for b in bands], bool)
        keys = np.frombuffer(b"".join(bands), "<i8")
        cols = [np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy()[has], BANDS) for c in ("node", "n", "x", "y")]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, cols)], ["key", "node", "n", "x", "y"])


def likely(bits_apart: int):
    """Whether the lengths allow the similarity, and at most so many bits differ."""

    def keep(rows, i, j):
        short, long = np.minimum(rows["n"][i], rows["n"][j]), np.maximum(rows["n"][i], rows["n"][j])
        return (short >= THRESHOLD * long) & (common.bits_apart(rows, i, j) <= bits_apart)

    return keep


_COLUMNS = ["key", "node", "n", "x", "y"]


def _pairs(batches, most: int, bits_apart: int):
    """kind 0: pair with the list's first; 1: other pair of a short list; 2: row of a long list."""
    lists = common.SortedLists(_COLUMNS, most, likely(bits_apart))

    def out(got):
        rows, i, j, first, handed = got
        kind = np.concatenate([np.where(first, 0, 1), np.full(len(handed), 2)]).astype(np.int32)
        a, b = rows["node"][i], rows["node"][j]
        zero = np.zeros(len(i), np.int64)
        cols = [np.concatenate([zero, rows["key"][handed]]), np.concatenate([np.maximum(a, b), rows["node"][handed]]), np.concatenate([np.minimum(a, b), np.zeros(len(handed), np.int64)])]
        cols += [np.concatenate([zero, rows[c][handed]]) for c in ("n", "x", "y")]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols)], ["kind", "key", "a", "b", "n", "x", "y"])

    for rows in common.gathered(batches, common.longs(_COLUMNS)):
        yield out(lists.add(rows))
    yield out(lists.add({c: np.empty(0, np.int64) for c in _COLUMNS}, last=True))


def folded(run: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: its second and further equal elements get hashes of their own."""
    run = np.sort(run)
    again = np.concatenate([[False], run[1:] == run[:-1]])
    if again.any():
        at = np.arange(len(run))
        turn = at - np.maximum.accumulate(np.where(again, 0, at))
        with np.errstate(over="ignore"):
            run = np.sort(np.where(again, common.mix64(run + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), run))
    return run


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two folded multisets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return shared / (len(a) + len(b) - shared)


def overlaps(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """overlap of a with each of the others."""
    sizes = np.array([len(o) for o in others])
    if not len(a):
        return (sizes == 0).astype(float)
    flat = np.concatenate(others)
    equal = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    shared = np.diff(np.concatenate([[0], np.cumsum(equal)])[np.concatenate([[0], np.cumsum(sizes)])])
    return shared / (len(a) + sizes - shared)


class Families:
    """Links between components within families of rows that arrive by family and chunk, those that ask first. Every row that asks is
    compared with every row of its family whose bits make the similarity likely, nearest first, unless links found so far have already
    brought the two together; of two that may both ask, the lesser node does. Holds a chunk's asking rows, and a batch."""

    def __init__(self, bits_apart: int):
        self.now, self.held, self.parent, self.likely = None, [], {}, likely(bits_apart)

    def _root(self, r: int) -> int:
        path = []
        while (up := self.parent.get(r, r)) != r:
            path.append(r)
            r = up
        for q in path:
            self.parent[q] = r
        return r

    def _link(self, left: dict, right: dict):
        step = max(1, 1_000_000 // max(1, len(right["node"])))
        both = {c: np.concatenate([left[c], right[c]]) for c in ("node", "n", "x", "y", "root", "closed")}
        bags = [np.frombuffer(bag, "<u8") for bag in (*left["bag"], *right["bag"])]
        known, place = np.unique(both["root"], return_inverse=True)
        root = np.array([self._root(r) for r in known.tolist()], np.int64)[place]
        width = len(left["node"])
        for at in range(0, width, step):
            i, j = np.divmod(np.arange(min(step, width - at) * len(right["node"])), len(right["node"]))
            i, j = i + at, j + width
            ok = root[i] != root[j]
            ok &= both["closed"][j] | (both["node"][i] < both["node"][j])
            i, j = i[ok], j[ok]
            ok = self.likely(both, i, j)
            i, j = i[ok], j[ok]
            for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                if len(some):
                    yield from self._ask(both, bags, root, int(i[some[0]]), j[some])

    def _ask(self, both: dict, bags: list[np.ndarray], root: np.ndarray, a: int, rest: np.ndarray):
        """Links of row a to these rows, nearest first; those that links have brought to it since are left out."""
        rest = rest[np.argsort(common.bits_apart(both, np.full(len(rest), a), rest), kind="stable")]
        take = 16
        while len(rest := rest[root[rest] != root[a]]):
            # so many that they hold at most about a million shingles
            size = max(1, min(take, int(np.searchsorted(np.cumsum(both["n"][rest[:take]]), 1 << 20))))
            some, rest, take = rest[:size], rest[size:], take * 4
            for b in some[overlaps(bags[a], [bags[k] for k in some.tolist()]) >= THRESHOLD].tolist():
                less, more = sorted((int(root[a]), int(root[b])))
                if less != more:
                    self.parent[more] = less
                    root[root == more] = less
                    yield int(both["node"][a]), int(both["node"][b])

    def add(self, batch: pa.RecordBatch):
        cols = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("family", "chunk", "asks", "node", "n", "x", "y", "root", "closed")}
        cols["bag"] = np.array([*common.pylist(batch, "bag"), None], object)[:-1]
        new = np.zeros(batch.num_rows, bool)
        for c in ("family", "chunk", "asks"):
            new[1:] |= cols[c][1:] != cols[c][:-1]
        for at in np.split(np.arange(batch.num_rows), np.flatnonzero(new)):
            if not len(at):
                continue
            now = cols["family"][at[0]], cols["chunk"][at[0]]
            if now != self.now:
                self.now, self.held, self.parent = now, [], {}
            mine = {c: v[at] for c, v in cols.items()}
            if cols["asks"][at[0]]:
                self.held.append(mine)
            else:
                for other in self.held:
                    yield from self._link(other, mine)


def _family_links(batches, bits_apart: int):
    families = Families(bits_apart)
    for batch in batches:
        found = list(families.add(batch))
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def bags_of(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node and bag (folded multiset, binary) of these nodes, staged. A table of fixed size keeps most other texts out early."""
    table = docs.sparkSession.sparkContext.broadcast(common.bloom(nodes))

    def keep(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 1_500_000):
                found, runs, many = _text_parts(common.pylist(part, "text"))
                ends = np.cumsum(many)
                # copies side by side count once
                mine = [k for k in np.unique(found, return_index=True)[1] if common.in_bloom(table.value, found[k : k + 1])[0]]
                bags = [folded(runs[ends[k] - many[k] : ends[k]]).astype("<u8").tobytes() for k in mine]
                yield pa.RecordBatch.from_arrays([pa.array(found[mine] if mine else found[:0]), pa.array(bags, pa.binary())], ["node", "bag"])

    rows = docs.select(common.as_bytes(text_col).alias("text")).mapInArrow(keep, "node long, bag binary")
    return common.stage(rows.groupBy("node").agg(F.first("bag").alias("bag")), "bags")


def verify(pairs: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) of nodes whose multisets overlap by the threshold or more."""

    def alike(batches):
        for batch in batches:
            ok = [overlap(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= threshold for a, b in zip(common.pylist(batch, "bag_a"), common.pylist(batch, "bag_b"), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    both = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    both = both.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(alike, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_apart: int = BITS_APART) -> DataFrame:
    """id, row, row2 and node of every row, and root: the node that stands for its class."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    n = common.tasks(spark)
    staged: list[DataFrame] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        staged.append(common.stage(df, name))
        return staged[-1]

    def rooted(edges: DataFrame) -> DataFrame:
        found = components(edges)
        staged.extend(common.left_by(found))
        return found

    signed = stage(sign(docs, id_col, text_col), "signed")
    contents = signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "x", "y", "bands")))
    postings = contents.mapInArrow(_postings, "key long, node long, n long, x long, y long")
    dealt = postings.repartition(n, "key").sortWithinPartitions("key", "node")
    most, held = MOST, HELD
    found = stage(dealt.mapInArrow(lambda batches: _pairs(batches, most, bits_apart), "kind int, key long, a long, b long, n long, x long, y long"), "near-pairs")
    common.reclaim(spark)
    pairs = found.where("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind"))
    pairs = stage(pairs, "pairs")
    rows = found.where("kind = 2").select(F.col("a").alias("node"), "n", "x", "y", "key")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(rows.select("node"))
    bags = bags_of(named, docs, text_col)
    staged.append(bags)
    links = stage(verify(pairs.where("kind = 0").select("a", "b"), bags), "links")
    roots = rooted(links)
    # pairs of short lists that the first links haven't brought together
    at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    rest = pairs.where("kind = 1").select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(stage(verify(rest, bags), "links"))
    # long lists that share nodes are one family, whose nodes meet once
    heads = rows.groupBy("key").agg(F.min("node").alias("b"))
    family = rooted(rows.join(heads, "key").select(F.col("node").alias("a"), "b")).select("node", F.col("root").alias("family"))
    members = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "x", "y"))).join(family, "node")
    roots = rooted(links)
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = members.groupBy("family", "root").count()
    mains = sizes.groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    members = members.join(mains, "family").withColumn("closed", F.col("root") == F.col("main"))
    chunks = members.where("not closed").groupBy("family").agg(F.ceil(F.count("*") / held).cast("int").alias("chunks"))
    # a node comes to all chunks of its family, and an open one asks in one of them
    role = lambda chunk, asks: F.struct(chunk.cast("int").alias("chunk"), F.lit(asks).alias("asks"))
    member = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: role(c, False))
    asker = F.when(F.col("closed"), F.slice(member, 1, 0)).otherwise(F.array(role(F.pmod(F.xxhash64("node"), F.col("chunks")), True)))
    members = members.join(chunks, "family").withColumn("role", F.explode(F.concat(asker, member))).join(bags, "node")
    members = members.select("family", "role.chunk", "role.asks", "node", "n", "x", "y", "root", "closed", "bag")
    members = members.repartition(n, "family", "chunk").sortWithinPartitions("family", "chunk", F.desc("asks"), "node")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(stage(members.mapInArrow(lambda batches: _family_links(batches, bits_apart), "a long, b long"), "links"))
    out = signed.select("id", "row", "row2", "node").join(rooted(links), "node", "left")
    out = common.stage(out.select("id", "row", "row2", "node", F.coalesce("root", "node").alias("root")), "classes")
    common.drop_stage(spark, *staged)
    common.reclaim(spark)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_apart: int = BITS_APART) -> DataFrame:
    """doc_id, class_id (the class's least doc_id) and whether the document stays, for every row."""
    found = classes(docs, id_col, text_col, bits_apart)
    least = found.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    out = found.join(least, "root")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("stays"), "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all their columns, with one row of each class: that with the least doc_id (nulls last), ties by the words' and the row's hash; of rows
    equal in doc_id and text that with the least hash over all columns. Texts are dealt out once, by the row's hash."""
    found = classes(docs, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "row", "row2"))
    keepers = found.groupBy("root").agg(first.alias("k")).select(F.col("k.row").alias("__tess_row"), F.col("k.row2").alias("__tess_row2"))
    row, row2 = row_keys(id_col, text_col)
    keys = ["__tess_row", "__tess_row2"]
    # the join and the choice among repeated rows have the same keys, so texts are exchanged once
    kept = docs.withColumns(dict(zip(keys, (row, row2), strict=True))).join(keepers.hint("merge"), keys, "left_semi")
    every = F.struct(*(f"`{c}`" for c in docs.columns))
    one = kept.groupBy(*keys).agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("__tess_one"))
    return common.leaving(one.select(*(F.col("__tess_one").getField(c).alias(c) for c in docs.columns)), found)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "stays")
