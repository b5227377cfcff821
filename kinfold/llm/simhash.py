"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, connected components.

Two fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` blocks of their bits,
so each is sent to one shard per pair of blocks (6 shards for radius 2, 28 for 6); a shard holds
what agrees on two blocks and searches itself with a BK-tree, children keyed by their integer
distance to the parent and only edges within the radius followed. A shard that holds more than
``SPLIT`` is dealt out again on as many blocks of the other bits; for radius 2 it then holds one
distinct fingerprint per value of the 16 bits left at most. The trees may search further than the
radius that shards are laid out for (``reach``): they then also find those pairs within reach that
agree on two blocks by chance. A shard emits links enough to connect what it holds, one less than
fingerprints, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, dealt_join, fresh, hot_keys, save, small_batches

#: Distinct fingerprints of one shard beyond which it is dealt out again.
SPLIT = 20_000


def _words(text: str) -> list[bytes]:
    """Words of the text's UTF-8 with A-Z lower: bytes split at space and 0x09 to 0x0D only."""
    return text.encode().lower().split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (XXH64, seed 42); 0 without words."""
    import xxhash

    own = _words(text or "")
    if not own:
        return 0
    n = max(1, len(own) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = np.array([digest(b" ".join(own), 42)], np.uint64)
    else:
        parts = [own[k : k + n] for k in range(shingle)]
        hashes = np.fromiter((digest(b" ".join(p), 42) for p in zip(*parts)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


class BKTree:
    """Fingerprints by Hamming distance: a node's children are keyed by their distance to it.

    A node is ``[fp, tag, children, whole]``; ``whole`` says that its subtree was connected when last
    added to, so a search passes by one that it is connected to.
    """

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def link_then_add(self, fp: int, tag: int, top, join) -> None:
        """``join`` the tag to those of nodes within the radius (``top`` names a tag's class), then insert."""
        if self.root is None:
            self.root = [fp, tag, {}, True]
            return
        radius, stack, mine = self.radius, [self.root], tag
        while stack:
            node = stack.pop()
            if node[3] and mine != tag and top(node[1]) == mine:
                continue
            d = (node[0] ^ fp).bit_count()
            if d <= radius and join(tag, node[1]):
                mine = top(tag)
            least, most = d - radius, d + radius
            for k, child in node[2].items():
                if least <= k <= most:
                    stack.append(child)
        mine, node = top(tag), self.root
        while node is not None:
            if node[3] and top(node[1]) != mine:
                node[3] = False
            d = (node[0] ^ fp).bit_count()
            if not d:
                return
            last, node = node[2], node[2].get(d)
        last[d] = [fp, tag, {}, True]


def shard_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of one shard as all their near pairs would."""
    tree, parent, out = BKTree(radius), list(range(len(fps))), []

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(k: int, other: int) -> bool:
        a, b = top(k), top(other)
        if a == b:
            return False
        parent[max(a, b)] = min(a, b)
        out.append((fps[k], fps[other]))
        return True

    for k, fp in enumerate(fps):
        tree.link_then_add(fp & 0xFFFFFFFFFFFFFFFF, k, top, join)
    return out


def _cut(bits: int, n: int) -> list[tuple[int, int]]:
    """First place and end of ``n`` blocks of a number of bits, as even as can be."""
    return [(bits * k // n, bits * (k + 1) // n) for k in range(n)]


def _deal(fps: DataFrame, blocks: list[tuple[int, int]], value: str, tag) -> DataFrame:
    """Rows ``fp, shard, pick``: one for each pair of blocks of ``value``."""
    cut = F.array(*(F.shiftrightunsigned(value, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in blocks))
    choices = [F.struct(F.lit(n).alias("c"), F.col("cut")[a].alias("v0"), F.col("cut")[b].alias("v1")) for n, (a, b) in enumerate(combinations(range(len(blocks)), 2))]
    return fps.select("fp", tag.alias("old"), cut.alias("cut")).select("fp", "old", F.explode(F.array(*choices)).alias("new")).select("fp", F.xxhash64("old", "new").alias("shard"), F.col("new.c").alias("pick"))


def _rest(blocks: list[tuple[int, int]]):
    """The bits outside the two blocks picked, moved together."""
    places = [[*blocks[a], *blocks[b]] for a, b in combinations(range(len(blocks)), 2)]
    p = [f"element_at(array({','.join(str(x[k]) for x in places)}), pick + 1)" for k in range(4)]
    low = f"(fp & (shiftleft(1L, {p[0]}) - 1))"
    middle = f"shiftleft(shiftrightunsigned(fp, {p[1]}) & (shiftleft(1L, {p[2]} - {p[1]}) - 1), {p[0]})"
    high = f"if({p[3]} = 64, 0L, shiftleft(shiftrightunsigned(fp, {p[3]}), {p[0]} + {p[2]} - {p[1]}))"
    return F.expr(f"{low} | {middle} | {high}")


def links(fps: DataFrame, radius: int = 2, reach: int | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints, enough to connect all within ``radius``.

    With a greater ``reach`` the trees search that far: links of up to ``reach`` bits come too,
    though beyond ``radius`` not all of them.

    Shards are keyed by a 64-bit hash of their block values; a clash only joins two shards, which
    cannot add a false link as every link is measured.
    """
    if not 0 <= radius <= 6:
        raise ValueError("shards are laid out for a radius of 6 at most")
    reach = radius if reach is None else max(radius, reach)
    n_blocks = max(4, radius + 2)
    blocks = _cut(64, n_blocks)
    dealt = save(_deal(fps.select("fp").distinct(), blocks, "fp", F.lit(0)), "shards")
    sizes = dealt.groupBy("shard").count()
    large = sizes.where(F.col("count") > SPLIT).select("shard")
    fine = dealt
    if large.limit(1).count():
        fine = dealt.join(large, "shard", "left_anti")
        again = dealt.join(large, "shard", "left_semi")
        again = again.withColumn("rest", _rest(blocks))
        fine = save(fine.unionByName(_deal(again, _cut(64 - 2 * (64 // n_blocks), n_blocks), "rest", F.col("shard"))), "fine-shards")
    alone = fine.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard")

    def run(batches):
        held: list[int] = []
        now = None
        for batch in batches:
            out = []
            for shard, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    if len(held) > 1:
                        out += shard_links(held, reach)
                    held, now = [], shard
                held.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
        out = shard_links(held, reach) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    busy = fine.select("shard", "fp").join(alone, "shard", "left_semi")
    return busy.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node each node of ``edges`` (``a, b``) is connected to.

    Alternating large-star and small-star steps, each a partially aggregated minimum and a join
    that deals out the edges of hubs, until no edge changes; every step is written to the shared
    folder.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _digest(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = dealt_join(both.where("b > a"), least.drop("n"), "a", hot_keys(least, "a", "n", 2 * state[0])).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = save(large, "large-star")
        low = save(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        pairs = dealt_join(large, low.drop("n"), "a", hot_keys(low, "a", "n", state[0]))
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = save(small.where("a <> b").distinct(), "small-star")
        before, state = state, _digest(now)
        if state == before:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def least_of_class(least: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``key, component_id`` by ``least`` (``key, least``) and the roots of linked keys.

    Only linked keys are joined; a class of many of them is a hub like any other.
    """
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    linked = save(roots.join(least, F.col("node") == F.col(key)).select("root", key, "least"), "linked")
    low = save(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "classes")
    total = low.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = dealt_join(linked.select("root", key), low.select("root", "component_id"), "root", hot_keys(low, "root", "n", total)).select(F.col(key).alias("_key"), "component_id")
    return least.join(named, F.col(key) == F.col("_key"), "left").select(key, F.when(F.col("_key").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the least ``doc_id`` reachable over links of at most ``radius`` differing
    bits, itself included. Texts without words (null ones too) have fingerprint zero and link like
    any other. A null id takes the component's least id, null if there is none; repeated rows
    repeat. An empty table gives no row.
    """
    marks = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = save(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    classes = least_of_class(least, components(links(marks, radius)), "fp")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return dealt_join(marks, classes, "fp", hot_keys(least, "fp", "n", total)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component: the one of the least id.

    Rows that share an id are one document; it stays if any of them is its component's least.
    Repeated rows (same id and text) are kept once. Rows without an id are always kept. An empty
    table stays empty.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, shingle, radius), id_col, text_col)


#: Ids of documents to drop that are broadcast at most (8 bytes each, or a string's length).
BROADCAST_IDS = 4_000_000


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without those whose ``component_id`` in ``found`` is another document's id.

    The ids to drop are broadcast if their number allows, so that no text is moved; else rows that
    have an id are shuffled by it.
    """
    found = found.where("doc_id is not null")
    byid = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    byid = save(byid.where("n > 1 or not kept"), "copies")
    name = fresh(docs.columns, "gone")
    gone = byid.where("not kept").select(F.col("doc_id").alias(name))
    if gone.count() <= BROADCAST_IDS:
        left = docs.join(F.broadcast(gone), col(id_col) == col(name), "left_anti")
    else:
        left = docs.where(col(id_col).isNotNull()).join(gone.hint("shuffle_hash"), col(id_col) == col(name), "left_anti").unionByName(docs.where(col(id_col).isNull()))
    again = byid.where("n > 1 and kept").select(F.col("doc_id").alias(name))
    if again.isEmpty():
        return left
    same = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    once = left.join(same, col(id_col) == col(name), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(same, col(id_col) == col(name), "left_anti").unionByName(once)
