"""Near-duplicates by SimHash, BK-trees and the exact resemblance (Jaccard) of word shingles.

Operator 5 at a wider radius comes first: its SimHash fingerprints, BK-trees over shards of them that
find the links within ``RADIUS`` bits and most of those within ``REACH``, the linked sets compared
whole, and connected components of those that resemble each other by ``similarity``.

No radius is sure to hold all such pairs, so an exact way finds what is not connected by then. Each
distinct shingle set puts its shingles in one global order, rare before common. Two sets that resemble
each other share one of their first ``n - ceil(similarity * n) + 1`` shingles, so sets that meet in
such a prefix are the candidates and none is missed; lengths and the place of the shared shingle rule
most of them out, and tallies of the hashes give a bound on what two sets share, before the sets
themselves are compared. Which shingles are common is estimated on a sample, which sets the order
only. Candidates are first compared with one set of each bucket, and only those not connected by then
with all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, dealt_join, hot_keys, save, small_batches
from kinfold.llm.simhash import _signed, _words, components, fingerprint, keep_least, least_of_class
from kinfold.llm.simhash import links as near_fingerprints

#: One text in so many is counted for the order; shingles counted so often there are common, and so many are held.
SAMPLE, COMMON, HELD = 16, 6, 200_000
#: Differing bits of two fingerprints within which all links are found to compare sets by, and as far as trees search.
RADIUS, REACH = 6, 11
#: Comparisons with one set beyond which they are dealt out, and keys broadcast at most (8 bytes each).
DEAL, BROADCAST_KEYS = 1_000, 4_000_000


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes (XXH64, seed 42) in rising order; a shorter text is one shingle."""
    import xxhash

    own = _words(text or "")
    if not own:
        return np.zeros(0, np.uint64)
    parts = [own[k : len(own) - size + 1 + k] for k in range(size)] if len(own) > size else [[w] for w in own]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), 42) for p in zip(*parts)), np.uint64))


def least_shared(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def resembles(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def tally(own: np.ndarray) -> bytes:
    """How many hashes end in each bit pattern, about four of them a pattern; empty if a byte is too little."""
    width = 1 << max(3, (len(own) // 4).bit_length())
    counts = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_resemble(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """False only if two tallies rule out that their sets resemble each other."""
    if not (len(a) and len(b)):
        return True
    width = min(len(a), len(b))
    a, b = (x.reshape(-1, width).sum(axis=0, dtype=np.int64) for x in (a, b))
    both = int(np.minimum(a, b).sum())
    return both >= similarity * (int(a.sum()) + int(b.sum()) - both) - 1e-9


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles in the global order: by count (0 if not common), then by hash."""
    count = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        count = np.where(common[at] == own, counts[at], 0)
    return own[np.argsort(count, kind="stable")][: len(own) - least_shared(len(own), similarity) + 1]


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            own = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], names=["token"])

    sample = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(run, "token long")
    top = sample.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(HELD).toArrow()
    token = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy()[order]


def _sets(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``doc_id, text, key, fp, n, tally, prefix`` for every row (``doc_id, text``): ``key`` is the set's hash, ``fp`` the SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, size))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        common, counts = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [shingles(t, size) for t in texts]
            first = [prefix(s, common, counts, similarity) if len(s) else s for s in own]
            offsets = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes(), 42)) for s in own], pa.int64()),
                    pa.array([_signed(fingerprint(t)) for t in texts], pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array([tally(s) for s in own], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64))),
                ],
                names=["doc_id", "text", "key", "fp", "n", "tally", "prefix"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type}, text string, key long, fp long, n long, tally binary, prefix array<long>")


def _small(keys: DataFrame) -> DataFrame:
    """A saved table of keys, to be broadcast if their number allows, so that texts stay in place."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _compared(pairs: DataFrame, sets: DataFrame, held: str, made, test) -> DataFrame:
    """Those of the pairs ``a, b`` that pass ``test`` on what ``made`` makes of the column ``held``."""
    pairs = save(pairs.distinct(), "candidates")
    need = save(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "needed")
    own = save(sets.select("key", held).join(_small(need), "key", "left_semi"), held)
    busy = F.broadcast(save(pairs.groupBy("a").agg(F.ceil(F.count("*") / DEAL).alias("deals")).where("deals > 1"), "busy"))
    deals = F.coalesce("deals", F.lit(1))
    left = own.withColumnRenamed("key", "a").join(busy, "a", "left").select("a", F.col(held).alias("ha"), F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("deal"))
    dealt = pairs.join(busy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), deals).alias("deal"))

    def run(batches):
        last, mine = None, None
        for batch in batches:
            out = []
            for a, b, ha, hb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if a != last:
                    last, mine = a, made(ha)
                if test(mine, made(hb)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    right = own.select(F.col("key").alias("b"), F.col(held).alias("hb"))
    return dealt.join(right, "b").join(left, ["a", "deal"]).select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _may(similarity: float):
    """Whether rows l and r of one shingle can be a pair that meets there first."""
    ln, rn = (F.shiftright(c, 32) for c in ("l.place", "r.place"))
    rest = F.least(*(n - F.col(c).bitwiseAND(0xFFFFFFFF) for n, c in ((ln, "l.place"), (rn, "r.place"))))
    return (F.least(ln, rn) >= similarity * F.greatest(ln, rn) - 1e-6) & (rest >= similarity / (1 + similarity) * (ln + rn) - 1e-6)


def _fingerprint_pairs(sets: DataFrame, radius: int, reach: int) -> DataFrame:
    """Pairs ``a, b`` of sets to compare: those of one fingerprint, and of linked ones, by its least set."""
    own = save(sets.select("key", "fp"), "fingerprints")
    least = save(own.groupBy("fp").agg(F.min("key").alias("a"), F.count("*").alias("n")), "least")
    near = save(near_fingerprints(least, radius, reach), "near-fingerprints")
    need = save(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "needed")
    named = save(least.select("fp", "a").join(_small(need), "fp", "left_semi"), "named")
    left, right = (named.select(F.col("fp").alias(c), F.col("a").alias(f"key_{c}")) for c in "ab")
    pairs = near.join(_small(left), "a").join(_small(right), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    several = save(least.where("n > 1").select("fp", "a"), "shared")
    return pairs.unionByName(own.join(_small(several), "fp").where("key <> a").select("a", F.col("key").alias("b")))


def links(sets: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """Links ``a, b`` between distinct sets (``key, text, fp, n, tally, prefix``), enough to connect all pairs that resemble."""

    def resembling(pairs: DataFrame) -> DataFrame:
        pairs = _compared(pairs, sets, "tally", lambda x: np.frombuffer(x, np.uint8), lambda a, b: may_resemble(a, b, similarity))
        return _compared(pairs, sets, "text", lambda x: shingles(x, size), lambda a, b: resembles(a, b, similarity))

    step = math.log(1 / similarity) if similarity < 1 else 1.0
    rows = sets.select("key", F.shiftleft("n", 32).alias("n"), F.posexplode("prefix").alias("pos", "token")).select("token", "key", (F.col("n") + F.col("pos")).alias("place"))
    met = rows.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token")
    rows = save(rows.join(met, "token", "left_semi"), "prefixes")
    rows = rows.withColumn("class", F.floor(F.log(F.shiftright("place", 32)) / step))
    found = save(resembling(_fingerprint_pairs(sets, radius, reach)), "near")
    for turn in ("least", "mixed", "all"):
        left = rows.join(components(found), F.col("key") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "key").alias("root"))
        apart = left.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        left = save(left.join(apart, "token", "left_semi"), "apart")
        if left.isEmpty():
            break
        if turn == "all":
            pairs = left.alias("l").join(left.alias("r"), "token").where("l.key < r.key and l.root <> r.root")
        else:
            rank = F.col("key") if turn == "least" else F.xxhash64("key", "token")
            heart = left.groupBy("token", "class").agg(F.min_by(F.struct("key", "place", "root"), rank).alias("c")).select("token", "class", "c.*")
            pairs = heart.alias("l").join(left.alias("r"), ["token", "class"]).where("l.key <> r.key and l.root <> r.root")
        pairs = pairs.where(_may(similarity)).select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))
        found = save(resembling(pairs).unionByName(found), "near")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """One row per document: ``doc_id, component_id``, the least ``doc_id`` reachable over links.

    Texts link whose ``size``-word shingles resemble each other by ``similarity`` or more, which is
    measured on the whole sets: first on those that the BK-trees find (all within ``radius`` bits, most
    within ``reach``), then on those that only a shared prefix leads to. Words are those of ``simhash``.
    Texts without words (null ones too) are copies of each other. A null id takes the component's least id; repeated rows repeat.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and 1 at most")
    small_batches(docs.sparkSession)
    marks = _sets(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), size, similarity)
    marks = save(marks.withColumn("row", F.monotonically_increasing_id()), "sets")
    least = save(marks.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("n")), "keys")
    copies = save(marks.select("row").join(least, "row", "left_anti"), "copies")
    sets = marks.where("n > 0").join(_small(copies), "row", "left_anti")
    classes = least_of_class(least, components(links(sets, size, similarity, radius, reach)), "key")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return dealt_join(marks.select("doc_id", "key"), classes, "key", hot_keys(least, "key", "n", total)).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = RADIUS, reach: int = REACH) -> DataFrame:
    """``docs`` with one document of each component, as ``simhash.deduplicate`` keeps them."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, size, similarity, radius, reach), id_col, text_col)
