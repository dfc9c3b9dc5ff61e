"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints in Gray order have long common bit patterns with their neighbours. The index sorts a group of fingerprints
by Gray rank and builds upper nodes over runs of `FAN` nodes: a node keeps the mask of the bits on which everything
below it agrees and their pattern. A search goes down from the top; on each step only bits that no upper node has
decided are compared, the differences are accumulated, and a whole run is left as soon as they exceed the radius.

Groups are dealt out so that none is unbounded and no link is lost:

* `deal_exact`: the undecided bits are cut into radius + 1 blocks; two fingerprints within the radius agree on one of
  them at least, so equal block values meet in a group. Block values that hold too many fingerprints are cut again.
* `deal_sampled`, for wide fingerprints and radii beyond that: tables of sampled bits, as many as the target recall needs.

From a group come only the edges of a spanning forest, never all pairs. `links_by_key` does the same for groups of any
size: it cuts them into blocks and compares blocks with each other, without pairs that are connected already.

`copy_groups` takes the groups of near fingerprints as candidates only; texts are linked where the exact Jaccard
similarity of their shingle sets reaches the threshold.
"""

from __future__ import annotations

import math
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridpulse.llm.common import Scratch, bits_for, free_name, mix, slices
from gridpulse.llm.components import components

FAN = 8
GROUP = 4096
PAIRS = 1 << 20  # that are compared at a time
BLOCK_TEXTS, BLOCK_CHARS = 512, 4_000_000  # that are compared in one group


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes. Counts are summed eight bytes at a time."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).view(np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), 255):
        total += bits[at : at + 255].sum(0).view(np.uint8)
    return int(np.packbits(total * 2 > len(hashes)).view(">u8")[0])


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text in their order; none for a text without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    width = min(shingle, len(parts))
    ends = ends[width - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(line[a:b], 42) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(ends))


def majorities(hashes: np.ndarray, words: int) -> list[int]:
    if not len(hashes):
        return [0] * words
    return [bit_majority(hashes if w == 0 else mix(hashes + np.uint64(w))) for w in range(words)]


def fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """`words` fingerprint words of a text; all zero for a text without words."""
    return majorities(shingle_hashes(text, shingle), words)


def _columns(words: int) -> list[str]:
    return [f"f{w}" for w in range(words)]


def fingerprints(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """doc_id and the fingerprint words f0, f1, ... of every whole text."""
    names = _columns(words)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([fingerprint(t, shingle, words) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(prints[:, w].view(np.int64)) for w in range(words))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def set_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, text_hash, set_hash and the fingerprint words of the set of shingles of every text."""
    import xxhash

    names = _columns(words)
    fields = ["doc_id", "text_hash", "set_hash", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in part.column("text").to_pylist()]
            marks = np.array([[xxhash.xxh64_intdigest(s.tobytes(), 7), *majorities(s, words)] for s in sets], dtype=np.uint64)
            made = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in marks.T]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text_hash"), *made], names=fields)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the Gray code sequence."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(step))
    return x


class GrayIndex:
    """Index over distinct fingerprints, an array (n, words) of uint64."""

    def __init__(self, prints: np.ndarray):
        order = np.lexsort(tuple(gray_rank(prints[:, w]) for w in reversed(range(prints.shape[1]))))
        self.order, self.prints = order, prints[order]
        pattern, mask = self.prints, np.full_like(self.prints, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(pattern, mask)]
        while len(pattern) > FAN:
            cut = np.arange(0, len(pattern), FAN)
            lead = np.repeat(pattern[cut], np.diff(np.append(cut, len(pattern))), axis=0)
            mask = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), cut, axis=0)
            pattern = pattern[cut] & mask
            self.levels.append((pattern, mask))

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs i < j within the radius, for blocks of i."""
        n, top = len(self.prints), len(self.levels) - 1
        chunk = max(8, PAIRS // max(1, n))
        for at in range(0, n, chunk):
            query = np.arange(at, min(n, at + chunk))
            nodes = len(self.levels[top][0])
            i, node = np.repeat(query, nodes), np.tile(np.arange(nodes), len(query))
            seen = np.zeros((len(i), 1), dtype=np.uint64)
            off = np.zeros(len(i), dtype=np.int64)
            for level in range(top, -1, -1):
                pattern, mask = self.levels[level]
                fresh = mask[node] & ~seen
                off = off + np.bitwise_count((self.prints[i] ^ pattern[node]) & fresh).sum(1, dtype=np.int64)
                last = np.minimum((node + 1) * FAN**level, n) - 1
                keep = (off <= radius) & (last > i)
                i, node, off = i[keep], node[keep], off[keep]
                if level == 0:
                    break
                below = len(self.levels[level - 1][0])
                seen = np.repeat(mask[node], FAN, axis=0)
                i, off = np.repeat(i, FAN), np.repeat(off, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < below
                i, node, off, seen = i[real], node[real], off[real], seen[real]
            yield i, node


def forest(size: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each element's component."""
    root = np.arange(size)
    for a, b in links:
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while not np.array_equal(root, up := root[root]):
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return root


def _blocks(mask: int, count: int, width: int = 64) -> list[int]:
    """The bits outside `mask` in `count` runs, each added to the mask."""
    free = [b for b in range(width) if not mask >> b & 1]
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal_exact(prints: DataFrame, radius: int, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(bin, f0): every two fingerprints within the radius share a bin; bins hold about `group` rows."""
    masks, rows, dealt, depth = [0], prints.select("f0", F.lit(0).cast("long").alias("mask")), None, 0
    while True:
        longer = {m: _blocks(m, radius + 1) for m in masks}
        masks = sorted({x for xs in longer.values() for x in xs})
        choice = F.create_map(*[F.lit(x) for m, xs in longer.items() for x in (_signed(m), [_signed(x) for x in xs])])
        rows = rows.select("f0", F.explode(choice[F.col("mask")]).alias("mask")).distinct() if depth else rows.select(
            "f0", F.explode(F.array(*[F.lit(_signed(x)) for x in masks])).alias("mask"))
        rows = scratch.write(rows.withColumn("key", F.xxhash64("mask", F.col("f0").bitwiseAND(F.col("mask")))), f"deal-{depth}")
        hot = scratch.write(rows.groupBy("key").count().where(F.col("count") > group).select("key"), f"hot-{depth}")
        crowded = hot.count() > 0
        bins = 1 << bits_for(rows.count(), group)
        calm = (rows.join(hot, "key", "left_anti") if crowded else rows).select(
            F.concat_ws("-", F.lit(depth), F.pmod(F.col("key"), F.lit(bins))).alias("bin"), "f0")
        dealt = calm if dealt is None else dealt.unionByName(calm)
        if not crowded:
            return dealt
        rows, depth = rows.join(hot, "key", "left_semi").select("f0", "mask"), depth + 1


def deal_sampled(prints: DataFrame, words: int, radius: int, scratch: Scratch, recall: float, group: int = GROUP // 8) -> DataFrame:
    """(bin, f0, ...): two fingerprints at the radius share a bin with probability `recall` at least.

    A bin is a table of sampled bits and their values. All tables have the same number of bits, however many rows a bin
    holds: more bits for crowded bins would lower the recall in them. `links_by_key` takes bins of any size.
    """
    names = _columns(words)
    bits = max(1, bits_for(prints.count(), group))
    agree = 1 - radius / (64 * words)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    draw = np.random.default_rng(11)
    picks = [draw.permutation(64 * words)[:bits] for _ in range(tables)]

    def key(pick):
        out = [F.shiftleft(F.shiftrightunsigned(names[b // 64], int(b % 64)).bitwiseAND(F.lit(1)), i) for i, b in enumerate(pick)]
        total = out[0]
        for x in out[1:]:
            total = total.bitwiseOR(x)
        return total

    rows = prints.select(*names, F.posexplode(F.array(*[key(p) for p in picks])).alias("table", "key"))
    return scratch.write(rows.select(F.concat_ws("-", "table", "key").alias("bin"), *names), "tables")


def group_edges(dealt: DataFrame, words: int, radius: int) -> DataFrame:
    """Spanning edges (fingerprint words, root's words) of every bin."""
    names = _columns(words)
    fields = [*names, *(f"r_{n}" for n in names)]

    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(np.stack([table.column(n).to_numpy().view(np.uint64) for n in names], axis=1), axis=0)
        index = GrayIndex(prints)
        root = forest(len(prints), index.links(radius))
        far = np.flatnonzero(root != np.arange(len(root)))
        out = np.concatenate([index.prints[far], index.prints[root[far]]], axis=1).view(np.int64)
        return pa.table({f: pa.array(out[:, i]) for i, f in enumerate(fields)})

    return dealt.groupBy("bin").applyInArrow(run, ", ".join(f"{f} long" for f in fields))


#: Index pairs of linked rows of a table; with a mask, of a row under it and one outside.
Compare = Callable[[pa.Table, "np.ndarray | None"], Iterator[tuple[np.ndarray, np.ndarray]]]


def near_prints(words: int, radius: int) -> Compare:
    """Rows whose fingerprints differ in `radius` bits at most."""

    def links(table, left=None):
        prints = np.stack([table.column(n).to_numpy().view(np.uint64) for n in _columns(words)], axis=1)
        if left is None:
            index = GrayIndex(prints)
            for i, j in index.links(radius):
                yield index.order[i], index.order[j]
            return
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        chunk = max(1, PAIRS // max(1, len(b)))
        for at in range(0, len(a), chunk):
            off = sum(np.bitwise_count(prints[a[at : at + chunk], None, w] ^ prints[b, w]).astype(np.int16) for w in range(words))
            i, j = np.nonzero(off <= radius)
            yield a[at + i], b[j]

    return links


def near_sets(shingle: int, similarity: float) -> Compare:
    """Rows whose texts have shingle sets of at least that Jaccard similarity. Texts without words are equal."""

    def links(table, left=None):
        sets = [np.unique(shingle_hashes(t, shingle)) for t in table.column("text").to_pylist()]
        size = np.array([len(s) for s in sets])
        empty = np.flatnonzero(size == 0)
        if len(empty) > 1:
            yield empty[1:], np.full(len(empty) - 1, empty[0])
        name, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        listed = row[np.argsort(of, kind="stable")]
        first, begin = np.cumsum(count) - count, np.cumsum(size) - size
        for i in range(len(sets)) if left is None else np.flatnonzero(left):
            has = of[begin[i] : begin[i] + size[i]]
            has = has[count[has] > 1]
            n = count[has]
            at = np.repeat(first[has] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(listed[at], minlength=len(sets))
            near = (common * (1 + similarity) >= similarity * (size[i] + size) - 1e-9) & (common > 0)
            near &= np.arange(len(sets)) > i if left is None else ~left
            j = np.flatnonzero(near)
            yield np.full(len(j), i), j

    return links


def _spanning(table: pa.Table, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    node = table.column("node").to_numpy()
    root = forest(len(node), links)
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"u": pa.array(node[far], pa.int64()), "v": pa.array(node[root[far]], pa.int64())})


def links_by_key(rows: DataFrame, links: Compare, scratch: Scratch, most: int, heavy: int) -> DataFrame:
    """Edges (u, v) between nodes that connect all linked rows of equal `key`; rows are (key, node, weight, ...).

    A group of the plan has about `most` rows or the weight `heavy`. Crowded keys are cut into blocks; what is connected
    inside the blocks, and then between one row of each connected part, need not be compared any more. Rows outside the
    largest part of their key are compared with all rows of other parts, block by block, so no link is left out.
    """
    n_blocks = lambda n, w: F.greatest(F.ceil(n / most), F.ceil(w / heavy), F.lit(1)).cast("int")
    carried = [c for c in rows.columns if c != "key"]

    def inside(table: pa.Table) -> pa.Table:
        return _spanning(table, links(table, None))

    def across(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        pairs = links(table, table.column("left").to_numpy(zero_copy_only=False))
        return _spanning(table, ((i[part[i] != part[j]], j[part[i] != part[j]]) for i, j in pairs))

    def in_blocks(some: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
        cut = some.join(sizes, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(F.lit(salt), "key", "node"), F.col("blocks")), F.lit(0)))
        return cut.drop("blocks").groupBy("key", "block").applyInArrow(inside, "u long, v long")

    def sized(some: DataFrame) -> DataFrame:
        return some.groupBy("key").agg(n_blocks(F.count("*"), F.sum("weight")).alias("blocks")).where("blocks > 1")

    sizes = scratch.write(sized(rows), "crowds")
    edges = scratch.write(in_blocks(rows, sizes, 1), "inside")
    if not sizes.count():
        return edges
    crowd = scratch.write(rows.join(sizes, "key", "left_semi"), "crowd")

    def parts() -> DataFrame:
        return crowd.join(components(edges, scratch), "node", "left").select("key", *carried, F.coalesce("root", "node").alias("part"))

    one = parts().groupBy("key", "part").agg(F.min(F.struct(*carried)).alias("x")).select("key", "x.*")
    one = scratch.write(one, "leaders")
    edges = edges.unionByName(scratch.write(in_blocks(one, sized(one), 2), "between"))
    cut = scratch.write(parts(), "parts")
    by_part = cut.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    total = by_part.groupBy("key").agg(
        F.count("*").alias("parts"), F.max(F.struct("n", "w", "part")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    total = scratch.write(total.where("parts > 1").select(
        "key", F.col("main.part").alias("main"), n_blocks(F.col("n"), F.col("w")).alias("blocks"),
        n_blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("sides")), "mains")
    both = cut.join(total, "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), "node"), F.col(c)).cast("int")
    side = both.where("part <> main").select("key", *carried, "part", F.lit(True).alias("left"), place("sides").alias("i"), upto("blocks").alias("j"))
    full = both.select("key", *carried, "part", F.lit(False).alias("left"), upto("sides").alias("i"), place("blocks").alias("j"))
    last = side.unionByName(full).groupBy("key", "i", "j").applyInArrow(across, "u long, v long")
    return edges.unionByName(scratch.write(last, "across"))


def near_groups(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 2, recall: float = 0.97) -> DataFrame:
    """doc_id, f0 ... (fingerprint words), component_id (smallest doc_id reachable) of every row.

    With one word and a small radius the links are exact. NULL and empty texts have the fingerprint zero and are linked
    like others; rows with a NULL doc_id link others, and their group has a NULL component_id where it has no other row.
    Repeated rows come back repeated. Extra columns are not carried. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    names = _columns(words)
    rows = scratch.write(fingerprints(docs, shingle, words), "prints")
    distinct = scratch.write(
        rows.groupBy(*names).agg(F.min("doc_id").alias("first"))
        .withColumn("node", F.col("f0") if words == 1 else F.xxhash64(*names)), "distinct")
    dealt = deal_exact(distinct, radius, scratch) if words == 1 else deal_sampled(distinct, words, radius, scratch, recall)
    edges = group_edges(dealt, words, radius)
    node = (lambda cs: F.col(cs[0])) if words == 1 else (lambda cs: F.xxhash64(*cs))
    links = edges.select(node(names).alias("u"), node([f"r_{n}" for n in names]).alias("v"))
    roots = scratch.write(components(links, scratch), "roots")
    member = distinct.join(roots, "node")
    best = member.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = scratch.write(member.join(best, "root").select(*names, "component_id"), "linked")
    alone = distinct.join(roots, "node", "left_anti").select(*names, F.col("first").alias("component_id"))
    return rows.join(linked.unionByName(alone), names).select("doc_id", *names, "component_id")


#: Near copies: sets of five-word shingles with a Jaccard similarity of 0.8. Candidates have 256-bit fingerprints. A cosine
#: similarity c of the sets makes a share acos(c) / pi of the bits differ. Two sets of one size with a Jaccard similarity
#: of 0.8 have c = 0.89 and differ in 38 of 256 bits on average; a standard deviation is 5.7 bits, so 49 bits find 97 of
#: 100 such pairs. Unrelated texts differ in 128.
NEAR = {"shingle": 5, "words": 4, "radius": 49}
SIMILARITY = 0.8


def copy_groups(docs: DataFrame, shingle: int, words: int, radius: int, similarity: float, recall: float = 0.97) -> DataFrame:
    """doc_id, text_hash and component of every row: components of texts whose shingle sets are that similar.

    Candidates are the components of fingerprints within the radius; all pairs of texts in one are verified.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    names = _columns(words)
    rows = scratch.write(set_prints(docs, shingle, words), "prints")
    sets = scratch.write(
        rows.groupBy("set_hash", *names).agg(F.min("text_hash").alias("text_hash")).withColumn("node", F.xxhash64(*names)), "sets")
    prints = scratch.write(sets.select("node", *names).distinct(), "distinct")
    dealt = deal_sampled(prints, words, radius, scratch, recall)
    bins = dealt.select(F.xxhash64("bin").alias("key"), F.xxhash64(*names).alias("node"), F.lit(1).alias("weight"), *names)
    near = components(links_by_key(bins, near_prints(words, radius), scratch, GROUP, GROUP), scratch)
    held = sets.join(near, "node", "left").select(F.coalesce("root", "node").alias("key"), F.col("set_hash").alias("node"), "text_hash")
    held = scratch.write(held, "held")
    several = scratch.write(held.join(held.groupBy("key").count().where("count > 1"), "key", "left_semi"), "several")
    # one row speaks for all copies of a text, so that they do not meet in one task
    speakers = rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).join(several, "text_hash")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(scratch.write(speakers, "speakers"), ["doc_id", "text_hash"]).dropDuplicates(["text_hash"])
    texts = texts.select("key", "node", F.length("text").alias("weight"), "text")
    same = links_by_key(scratch.write(texts, "texts"), near_sets(shingle, similarity), scratch, BLOCK_TEXTS, BLOCK_CHARS)
    roots = scratch.write(components(same, scratch).select(F.col("node").alias("set_hash"), "root"), "roots")
    return rows.join(roots, "set_hash", "left").select("doc_id", "text_hash", F.coalesce("root", "set_hash").alias("component"))


def one_of_each(docs: DataFrame, shingle: int = NEAR["shingle"], words: int = NEAR["words"], radius: int = NEAR["radius"]) -> DataFrame:
    """docs with one row of each group of near copies, that with the smallest doc_id; all columns stay.

    Rows with a NULL doc_id take no part and stay. Rows are judged by their own text, also where a doc_id repeats: the kept
    row of a group is that with the least (doc_id, hash of the text), and of equal pairs of these one stays.
    """
    named = docs.where("doc_id is not null")
    groups = copy_groups(named, shingle, words, radius, SIMILARITY)
    text_hash = free_name(docs, "text_hash")
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", F.col("k.text_hash").alias(text_hash))
    keys = ["doc_id", text_hash]
    out = named.withColumn(text_hash, F.xxhash64("text")).join(kept, keys, "left_semi").dropDuplicates(keys)
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))
