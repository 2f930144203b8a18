"""Near-duplicate documents by SetSketch: banded register values find candidates, a joint likelihood estimate sifts them, full shingle sets confirm.

1. One pass over the texts: the set of word shingles, its 128-bit digest and its sketch. Equal sets make a class;
   from here on a class is one node, so thousands of copies cost no more than one.
2. Four registers of 16 bits make a band. At Jaccard 0.75 one of the 30 bands agrees but for one pair in 100,000.
3. In each bucket the pairs whose estimate is `plausible` or more (five standard errors below the threshold) are joined;
   a bucket gives at most one edge a member, however many pairs it holds. Components of these edges are families.
4. The full sets of each family's members, one a class, give the exact links and components (`family_links`).
Buckets larger than a block are cut into blocks, and every pair of blocks is one task's work; larger families are joined
block by block, then what that left apart: no member is dropped, and a task's memory is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import among, bitmaps, heavy_join, materialize, pieces, small_batches, trim

SHINGLE, BANDS, WIDTH = 5, 30, 4
REGISTERS = BANDS * WIDTH
BASE, RATE = 1.001, 20.0
BLOCK = 750
NULL_ID = -(2**63)
SEEDS = np.random.default_rng(20).integers(1, 2**63, (2, REGISTERS), np.uint64) | np.uint64(1)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit values; empty without words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    index = coded.indices.to_numpy(zero_copy_only=False)
    word = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[index] if len(index) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(sizes)])]
    w = hashed[index[word]] if len(index) else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = min(b - a, SHINGLE)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        z = np.full(b - a - n + 1, n, np.uint64)
        for k in range(n):
            z = (z ^ w[a + k : b - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(29)
        out.append(np.unique(z))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Register values, one row a set: floor(1 - log_b(x)) of the least of exponential variates, cut to 16 bits."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        chosen, size = [], 0
        while at < len(full) and (not chosen or size + len(sets[full[at]]) <= 40_000):
            size += len(sets[full[at]])
            chosen.append(full[at])
            at += 1
        flat = np.concatenate([sets[i] for i in chosen])
        starts = np.cumsum([0] + [len(sets[i]) for i in chosen[:-1]])
        least = np.empty((len(chosen), REGISTERS), np.uint64)
        for r in range(REGISTERS):
            z = (flat ^ SEEDS[0, r]) * SEEDS[1, r]
            z ^= z >> np.uint64(31)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            least[:, r] = np.minimum.reduceat(z, starts)
        x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
        out[chosen] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches, at the greatest likelihood of how many registers are larger, smaller and equal, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    grid = np.linspace(0, 1, 81)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u[:, None] - (1 - u[:, None]) * grid), p(1 - u[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more[:, None] * log(up) + less[:, None] * log(down) + (a.shape[1] - more - less)[:, None] * log(1 - up - down)
    return grid[np.arange(len(grid)), score.argmax(1)]


def linked(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(member, first of its component) for all but the first ones. near(i, others) says which of the others have a link with i; each member asks only about those not yet reached."""
    rest, out = np.arange(size), []
    while len(rest):
        root, front, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            front += rest[hit].tolist()
            out += [(int(x), root) for x in rest[hit]]
            rest = rest[~hit]
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted stream; many small runs come cut from one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if last is not None and (k[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    trim()


def in_blocks(rows: DataFrame, n_blocks: str) -> DataFrame:
    """Adds i and j: a member goes to every pair of blocks that has its own; one block is the pair (0, 0)."""
    own = F.pmod(F.xxhash64("row"), F.col(n_blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col(n_blocks) < 2, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), (F.col(n_blocks) - 1).cast("int")), lambda x: x != F.col("own")))))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")


def block_count(amount: str, block: int) -> Column:
    """Into how many blocks an amount is cut: one if it fits into a block, else so many that a pair of blocks does."""
    return F.when(F.col(amount) <= block, 1).otherwise(F.ceil(2 * F.col(amount) / block))


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, t, n, c1, c2, sketch): a row a document; t hashes its text, c1 and c2 digest its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, texts in pieces(batch.column("text"), 4 << 20):
                sets = shingles(texts)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                rows = sketches(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(sets))), batch.column("doc_id").slice(first, len(sets)).cast(pa.int64()), batch.column("t").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "doc_id", "t", "n", "c1", "c2", "sketch"])
                at += len(sets)

    small_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "row long, doc_id long, t long, n long, c1 long, c2 long, sketch binary"), "sketches")


def plausible_edges(nodes: DataFrame, plausible: float, block: int) -> DataFrame:
    """(a, b): what joins the members of each bucket whose estimates are plausible."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            keys = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int64).reshape(n, BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("row").to_numpy(), BANDS))], ["band", "key", "row"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["band", "key", "i", "j"]):
            row, n, of = t["row"].to_numpy(), t["n"].to_numpy().astype(np.float64), t["band"][0].as_py()
            s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(len(row), REGISTERS)
            if len(row) == 2 and (s[0].view(np.int64) == s[1].view(np.int64)).argmax() < of:
                continue  # the two met in an earlier band, and were compared there

            def near(i: int, others: np.ndarray, s=s, n=n) -> np.ndarray:
                fit = np.minimum(n[others], n[i]) >= plausible * np.maximum(n[others], n[i])
                fit[fit] = (s[others[fit]] == s[i]).sum(1) >= (plausible - 0.1) * REGISTERS
                if fit.any():
                    x = others[fit]
                    fit[fit] = estimate(s[x], np.broadcast_to(s[i], (len(x), REGISTERS)), n[x], np.full(len(x), n[i])) >= plausible
                return fit

            if out := linked(len(row), near):
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], ["a", "b"])

    placed = materialize(nodes.select("row", "sketch").mapInArrow(band, "band int, key long, row long"), "bands")
    sizes = placed.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = heavy_join(placed, materialize(sizes.withColumn("blocks", block_count("size", block)), "buckets"), ["band", "key"], "size", placed.count())
    met = in_blocks(met, "blocks").join(nodes.select("row", "n", "sketch"), "row").select("band", "key", "i", "j", "row", "n", "sketch")
    return met.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "row").mapInArrow(join, "a long, b long")


def exact_edges(docs: DataFrame, members: DataFrame, numerator: int, denominator: int, label: str, largest_broadcast: int = 200_000) -> DataFrame:
    """(a, b): links that join the exact components of each group (fam, i, j) of members: (fam, row, doc_id, t, c1, c2, i, j).

    Members find their texts by doc_id and the text's hash, so null or repeated doc_ids are no hot key; of copies that
    one task meets, one is passed on. Where members are too many to be broadcast, a bit of each one's hash is, so that
    hardly any text is shuffled but theirs.
    """
    wanted = members.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), "t", "c1", "c2", "fam", "row", "i", "j")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("t"), "text")
    if (n := wanted.count()) <= largest_broadcast:  # 70 bytes a row
        wanted = F.broadcast(wanted)
    else:
        slot = F.pmod(F.xxhash64("_id", "t"), F.lit(min(1 << 28, 16 << n.bit_length()))).alias("slot")  # 35 MB at most
        texts = among(texts.select("*", slot), "slot", materialize(bitmaps(wanted.select(slot)), f"{label}-bits")).drop("slot")
    found = texts.join(wanted, ["_id", "t"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for batch in batches:
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("fam", "i", "j", "row")), strict=True))
            new = [k for k, key in enumerate(keys) if key not in met and not met.add(key)]
            batch = batch.take(pa.array(new, pa.int64()))
            for first, texts in pieces(batch.column("text"), 4 << 20):
                got, part = shingles(texts), batch.slice(first, len(texts))
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in got), np.int64).reshape(-1, 2)
                own = (digest[:, 0] == part.column("c1").to_numpy()) & (digest[:, 1] == part.column("c2").to_numpy())
                out = pa.RecordBatch.from_arrays([*(part.column(x) for x in ("fam", "i", "j", "row")), pa.array([s.tobytes() for s in got], pa.binary())], ["fam", "i", "j", "row", "set"])
                yield out.filter(pa.array(own))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["fam", "i", "j"]):
            row, first = np.unique(t["row"].to_numpy(), return_index=True)
            own = [np.frombuffer(t["set"][int(k)].as_py(), np.uint64) for k in first]
            size = np.array([len(s) for s in own], np.int64)
            value, place = np.unique(np.concatenate(own), return_inverse=True)
            owner = np.repeat(np.arange(len(own)), size)[np.argsort(place, kind="stable")]
            ends = np.cumsum(np.bincount(place, minlength=len(value)))
            places = np.split(place, np.cumsum(size)[:-1])

            def near(i: int, others: np.ndarray, owner=owner, ends=ends, places=places, size=size) -> np.ndarray:
                p = places[i]
                n = ends[p] - np.where(p > 0, ends[p - 1], 0)
                at = np.arange(n.sum()) + np.repeat(ends[p] - n - (np.cumsum(n) - n), n)
                shared = np.bincount(owner[at], minlength=len(size))[others]
                return denominator * shared >= numerator * (size[others] + size[i] - shared)

            if out := linked(len(row), near):
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], ["a", "b"])

    placed = found.mapInArrow(sets, "fam long, i int, j int, row long, set binary").repartition("fam", "i", "j").sortWithinPartitions("fam", "i", "j", "row")
    return materialize(placed.mapInArrow(join, "a long, b long"), label)


def family_links(docs: DataFrame, sized: DataFrame, percent: int, block: int) -> DataFrame:
    """(row, root): the exact components of every family; sized: (row, doc_id, t, n, c1, c2, fam).

    1. Each family is cut into blocks that fit a task (most are one), and each block is joined by itself.
    2. Of a family of several blocks, the first member of each component that 1 found stands for it; these are joined.
    3. A link between two components that remain can only have an end outside the family's largest one. So what is
       outside is compared with all members, block by block; the inside of the largest is not compared again.
    Rows that move are in proportion to the family's members times blocks of members outside its largest component.
    """
    sizes = sized.groupBy("fam").agg(F.count("*").alias("size"), F.sum("n").alias("all")).withColumn("blocks", F.greatest(block_count("size", block), block_count("all", 2_000_000)))
    sizes = materialize(sizes.select("fam", "size", F.col("size").alias("members"), "blocks"), "family-blocks")
    members = materialize(heavy_join(sized, sizes, ["fam"], "size", sized.count()), "members")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    inside = exact_edges(docs, members.withColumn("i", own).withColumn("j", F.col("i")), percent, 100, "links-inside")
    if not sizes.filter("blocks > 1").take(1):
        return inside.select(F.col("a").alias("row"), F.col("b").alias("root"))
    large = materialize(members.filter("blocks > 1").join(inside.select(F.col("a").alias("row"), "b"), "row", "left").select(*members.columns, F.coalesce("b", "row").alias("first")), "large-families")
    heads = large.filter("row = first").drop("blocks", "members")
    head_sizes = heads.groupBy("fam").agg(F.count("*").alias("size"), F.sum("n").alias("all")).withColumn("blocks", F.greatest(block_count("size", block), block_count("all", 2_000_000))).select("fam", "size", "blocks")
    heads = materialize(in_blocks(heavy_join(heads, materialize(head_sizes, "head-blocks"), ["fam"], "size", heads.count()), "blocks"), "heads")
    between = exact_edges(docs, heads, percent, 100, "links-between")
    joined = components(between, "heads-joined")
    large = large.join(joined.select(F.col("row").alias("first"), "root"), "first", "left").withColumn("root", F.coalesce("root", "first"))
    large = materialize(large, "large-joined")
    parts = large.groupBy("fam", "root").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
    whole = parts.groupBy("fam").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("size"), F.sum("all").alias("all"), F.max(F.struct("k", "root", "all")).alias("most"))
    whole = whole.filter(F.col("size") > F.col("most.k")).select("fam", "main", "size", (F.col("size") - F.col("most.k")).alias("out"), (F.col("all") - F.col("most.all")).alias("out_all"))
    whole = whole.withColumn("slices", F.greatest(block_count("out", block // 2), block_count("out_all", 1_000_000)).cast("int")).drop("out", "out_all")
    left = heavy_join(large, materialize(whole, "families-left"), ["fam"], "size", large.count())
    left = left.withColumn("own", own).withColumn("slice", F.when(F.col("root") != F.col("main"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("slices")).cast("int")))
    every = F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))
    with_own = left.withColumn("i", F.explode(every)).withColumn("j", F.col("own"))
    with_others = left.filter("slice is not null").withColumn("i", F.col("slice")).withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda x: x != F.col("own"))))
    met = materialize(with_own.unionByName(with_others), "members-left")
    across = exact_edges(docs, met, percent, 100, "links-across")
    small = inside.join(large.select(F.col("row").alias("a")), "a", "left_anti").select(F.col("a").alias("row"), F.col("b").alias("root"))
    edges = inside.join(large.select(F.col("row").alias("a")), "a", "left_semi").unionByName(between).unionByName(across)
    return small.unionByName(components(edges, "large-linked"))


def near_duplicates(docs: DataFrame, percent: int = 75, plausible: float | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: links are pairs of sets with 100 * intersection >= percent * union.

    Words: runs of what isn't ASCII white space, A-Z lower-cased. Texts of fewer than five words are one shingle.
    Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows are in one class, and each
    is returned; component_id is the least non-null doc_id of the component (null if it has none), kept says
    that a row has that doc_id. Rows of one doc_id with different texts are different nodes. Very long texts are read
    whole, some MB of them at once. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    least = plausible if plausible is not None else percent / 100 - 0.2
    rows = scan(docs)
    full = rows.filter("n > 0")
    classes = materialize(full.groupBy("c1", "c2").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("doc_id").alias("first")), "classes")
    nodes = materialize(full.join(classes.select("row"), "row", "left_semi"), "nodes")
    family = components(plausible_edges(nodes, least, block), "families")
    family = materialize(family.unionByName(family.select(F.col("root").alias("row"), "root").distinct()), "families")
    sized = nodes.select("row", "doc_id", "t", "n", "c1", "c2").join(family, "row").withColumnRenamed("root", "fam")
    found = family_links(docs, sized, percent, block)
    rooted = classes.join(found, "row", "left").select("c1", "c2", "copies", "first", F.coalesce("root", "row").alias("root"))
    rooted = materialize(rooted, "rooted")
    least_id = rooted.groupBy("root").agg(F.count("*").alias("k"), F.min("first").alias("component_id"))
    named = heavy_join(rooted, least_id, ["root"], "k", rooted.count()).select("c1", "c2", "copies", "component_id")
    out = heavy_join(full.select("doc_id", "n", "c1", "c2"), materialize(named, "named"), ["c1", "c2"], "copies", rows.count())
    out = out.select("doc_id", "n", "component_id").unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
