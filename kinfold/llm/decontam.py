"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test texts.

Normalising keeps every byte's place (letters lower, all else that is no word character blank), so
a match in the normalised text is a place in the original one. The automaton is a trie over word
numbers that holds each window of ``window`` consecutive item words, with the items it is from, in
flat arrays: its edges are sorted keys ``node, word``, a node's number is its edge's place, and what
follows a prefix only one window has is compared with that window, so it needs no nodes of its own.

It runs in the failureless form: every word of a text starts a walk, and all walks of a batch are
taken in step, so that numpy does them; a walk is ``window`` words long at most and most end at
once, at a table of the word pairs windows start with. All texts are scanned once.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, fresh, save, small_batches, widened

#: Bytes of item text one automaton is built from. Beyond it items are dealt to several automata,
#: which take turns, each with a pass of its own; a worker never holds more than one.
SHARD_BYTES = 64 << 20
#: Words scanned at a time.
WORDS = 1 << 20

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def normalise(text: str) -> bytes:
    """UTF-8 of ``text`` with A-Z lower and all that is in no word blank; as long as the original."""
    return text.encode().translate(_TABLE)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two word numbers."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def build(items, window: int) -> dict:
    """The automaton of ``(id, text)`` pairs (null ids: hits without a name) as plain arrays."""
    vocab: dict[bytes, int] = {}
    parts, owner, size = [], [], []
    for n, (_, text) in enumerate(items):
        own = normalise(text or "").split()
        if own:
            parts.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in own), np.int32, len(own)))
            owner.append(n)
            size.append(len(own))
    tokens = np.concatenate([*parts, np.zeros(0, np.int32)])
    size = np.array(size, np.int64)
    length = np.minimum(size, window)
    count = size - length + 1
    # A pattern is a window: where it starts, its words, and its item.
    first = np.cumsum(size) - size
    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    length, item = np.repeat(length, count).astype(np.int16), np.repeat(np.array(owner, np.int32), count)
    keys, leaf, leaf_size = [], [np.array([-1])], [np.zeros(1, np.int16)]
    out_node, out_item = [], []
    live, node, made = np.arange(len(start)), np.zeros(len(start), np.int64), 0
    for d in range(window):
        if not len(live):
            break
        level, where, n = np.unique(node << 32 | tokens[start[live] + d], return_inverse=True, return_counts=True)
        keys.append(level)
        child = made + 1 + where
        made += len(level)
        alone = n[where] == 1
        ends = length[live] == d + 1
        tail = np.full(len(level), -1)
        tail[where[alone]] = start[live[alone]]
        leaf.append(tail)
        width = np.zeros(len(level), np.int16)
        width[where[alone]] = length[live[alone]]
        leaf_size.append(width)
        named = ends | alone
        out_node.append(child[named])
        out_item.append(item[live[named]])
        go = ~named
        live, node = live[go], child[go]
    keys = np.concatenate([*keys, np.zeros(0, np.int64)])
    out = np.unique(np.concatenate([*out_node, np.zeros(0, np.int64)]) << 32 | np.concatenate([*out_item, np.zeros(0, np.int32)]))
    ends = np.searchsorted(out >> 32, np.arange(made + 2))
    roots = np.zeros(len(vocab), np.int32)
    n_roots = int(np.searchsorted(keys, 1 << 32))
    roots[keys[:n_roots]] = np.arange(1, n_roots + 1)
    long = length > 1
    pairs = np.unique(_pair(tokens[start[long]], tokens[start[long] + 1]))
    bits = max(12, int(4 * len(pairs)).bit_length())
    seen = np.zeros(1 << bits, bool)
    seen[pairs & np.uint64((1 << bits) - 1)] = True
    return {
        "vocab": b" ".join(vocab), "names": [None if k is None else str(k) for k, _ in items], "tokens": tokens, "keys": keys, "roots": roots,
        "leaf": np.concatenate(leaf).astype(np.int32), "leaf_size": np.concatenate(leaf_size), "ends": ends.astype(np.int32),
        "out": (out & 0xFFFFFFFF).astype(np.int32), "seen": seen, "window": window,
    }


class Scanner:
    def __init__(self, made: dict):
        self.__dict__.update(made)
        self.number = {w: k for k, w in enumerate(made["vocab"].split())}.get

    def numbers(self, text: str | None) -> np.ndarray:
        """The text's words by their number; -1: in no item."""
        own = normalise(text or "").split()
        return np.fromiter(map(self.number, own, repeat(-1)), np.int32, len(own))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of word numbers followed by ``window`` times -1: where windows occur, their words, their nodes."""
        at, node, size = [], [], []

        def note(where, nodes, n):
            at.append(where)
            node.append(nodes)
            size.append(np.broadcast_to(n, where.shape))

        pos = np.flatnonzero(ids >= 0)
        cur = self.roots[ids[pos]]
        ok = cur > 0
        pos, cur = pos[ok], cur[ok].astype(np.int64)
        for d in range(1, self.window + 1):
            if not len(pos):
                break
            # Here a walk stands d words in, at node ``cur``.
            single = self.leaf[cur] >= 0
            whole = (self.ends[cur + 1] > self.ends[cur]) & ~single
            if whole.any():
                note(pos[whole], cur[whole], d)
            done = single & (self.leaf_size[cur] == d)
            if done.any():
                note(pos[done], cur[done], d)
            go = ~done
            if d == 1:
                ahead = ids[pos + 1]
                go &= (ahead >= 0) & self.seen[_pair(ids[pos], ahead) & np.uint64(len(self.seen) - 1)]
            lone = go & single
            if lone.any():
                p, c = pos[lone], cur[lone]
                base, n = self.leaf[c], self.leaf_size[c]
                for k in range(d, self.window):
                    same = (k >= n) | (ids[p + k] == self.tokens[np.minimum(base + k, len(self.tokens) - 1)])
                    if not same.all():
                        p, c, base, n = p[same], c[same], base[same], n[same]
                    if not len(p):
                        break
                if len(p):
                    note(p, c, n)
            go &= ~single
            pos, cur = pos[go], cur[go]
            ahead = ids[pos + d]
            ok = ahead >= 0
            pos, key = pos[ok], cur[ok] << 32 | ahead[ok]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[place] == key
            pos, cur = pos[ok], place[ok] + 1
        if not at:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(at), np.concatenate(size).astype(np.int64), np.concatenate(node)

    def scan(self, texts: list) -> list:
        """Per text: its number of words, the hit words as merged ranges, and the items' names."""
        out: list = [None] * len(texts)
        rows: list = []
        held = 0
        for k, text in enumerate(texts):
            rows.append((k, self.numbers(text)))
            held += len(rows[-1][1])
            if held > WORDS or k == len(texts) - 1:
                self._scan_rows(rows, out)
                rows, held = [], 0
        return out

    def _scan_rows(self, rows: list, out: list) -> None:
        gap = np.full(self.window, -1, np.int32)
        ids = np.concatenate([x for _, own in rows for x in (own, gap)])
        first = np.cumsum([0, *(len(own) + self.window for _, own in rows)])
        for k, own in rows:
            out[k] = (len(own), [], [])
        at, size, node = self.hits(ids) if len(self.keys) else (np.zeros(0, np.int64),) * 3
        if not len(at):
            return
        cover = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + size, minlength=len(ids) + 1)
        inside = np.concatenate([[False], np.cumsum(cover) > 0])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        of = np.searchsorted(first, begin, side="right") - 1
        found = np.unique((np.searchsorted(first, at, side="right") - 1) << 32 | node)
        doc, node = found >> 32, found & 0xFFFFFFFF
        for n in np.unique(of).tolist():
            k, own = rows[n]
            mine = of == n
            ranges = np.stack([begin[mine], end[mine]], axis=1) - first[n]
            lo, hi = np.searchsorted(doc, [n, n + 1])
            items = {i for v in node[lo:hi].tolist() for i in self.out[self.ends[v] : self.ends[v + 1]].tolist()}
            out[k] = (len(own), ranges.tolist(), sorted({self.names[i] for i in items} - {None}))


_built: list = []


def _scanner(shared) -> Scanner:
    """The automaton of a broadcast shard; a worker keeps the last one it made."""
    value = shared.value
    if not (_built and _built[0] is value):
        _built.clear()
        _built.extend((value, Scanner(value)))
    return _built[1]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items that have a text, and how many automata they need."""
    items = benchmark.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, 1 if size <= SHARD_BYTES else -(-2 * size // SHARD_BYTES)


def _scan(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, finish, schema):
    """Hand each batch of ``docs`` to ``finish`` with its texts' word counts, ranges and items.

    With one automaton that is one pass. With more, the rows get a key and are written once, each
    automaton's hits are written beside them, and the last pass joins them by that key.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    small_batches(spark)
    items, n = _items(benchmark, item_col, item_text_col)

    def shard(k: int):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("text", "id").toArrow()
        return spark.sparkContext.broadcast(build(list(zip(own["id"].to_pylist(), own["text"].to_pylist())), window))

    if n == 1:
        only = shard(0)

        def run(batches):
            scanner = _scanner(only)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield finish(batch, [(t, *f) for t, f in zip(texts, scanner.scan(texts))])

        return docs.mapInArrow(run, schema)

    row = fresh(docs.columns, "row")
    kept = save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    pair = pa.list_(pa.int64())
    parts = []
    for k in range(n):
        shared = shard(k)

        def find(batches, shared=shared):
            scanner = _scanner(shared)
            for batch in batches:
                out = [(key, r, i) for key, (_, r, i) in zip(batch.column(0).to_pylist(), scanner.scan(batch.column(1).to_pylist())) if r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pair)), pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["row", "ranges", "items"]
                )

        parts.append(save(kept.select(col(row), col(text_col)).mapInArrow(find, "row long, ranges array<array<long>>, items array<string>"), "hits"))
        shared.unpersist()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    key, ranges, names = (fresh([*docs.columns, row], c) for c in ("hit_row", "hit_ranges", "hit_items"))
    whole = whole.groupBy(F.col("row").alias(key)).agg(F.flatten(F.collect_list("ranges")).alias(ranges), F.array_distinct(F.flatten(F.collect_list("items"))).alias(names))
    joined = kept.join(whole, col(row) == col(key), "left").drop(row, key)
    width = len(docs.columns)

    def close(batches):
        for batch in batches:
            found = []
            for text, r, i in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()):
                found.append((text, len(normalise(text or "").split()), merged(r or []), sorted(i or [])))
            yield finish(batch.select(list(range(width))), found)

    return joined.mapInArrow(close, schema)


def merged(ranges) -> list[list[int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    A word inside any occurrence of a window is hit; an item of fewer words is one window. ``spans``
    are the hit passages as character ranges of the original text. Null or empty texts have no
    words; items without a word or text match nothing, items without an id count as hits only.
    ``items_sha256`` of no item is that of the empty string.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def finish(batch, found):
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([n for _, n, _, _ in found], pa.int64()),
                pa.array([sum(b - a for a, b in r) for _, _, r, _ in found], pa.int64()),
                pa.array([len(i) for *_, i in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for *_, i in found]),
                pa.array([bool(r) for _, _, r, _ in found]),
                pa.array([[{"start": a, "end": b} for a, b in spans(text, r)] for text, _, r, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )

    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return _scan(narrow, benchmark, "text", item_col, item_text_col, window, finish, schema)


def spans(text: str | None, ranges) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(normalise(text))]
    raw = text.encode()
    return [(len(raw[: places[a][0]].decode()), len(raw[: places[b - 1][1]].decode())) for a, b in ranges]


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit: float = 0.5, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all their columns, the benchmark's passages cut out of the texts.

    A document of which more than ``max_hit`` of the words are hit goes, as what is left is no text
    of its own. Others stay, whole where nothing is hit. ``length_col``, if there is such a
    column, is set to the new length. Null texts stay null.
    """
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None
    flag = fresh(docs.columns, "cut_text")

    def finish(batch, found):
        texts, keep = [], []
        for k, (text, n, r, _) in enumerate(found):
            if r and sum(b - a for a, b in r) > max_hit * n:
                continue
            keep.append(k)
            for a, b in reversed(spans(text, r)):
                text = text[:a] + text[b:]
            texts.append(text)
        out = batch.take(pa.array(keep, pa.int64())) if len(keep) < len(found) else batch
        return out.append_column(flag, pa.array(texts, pa.string()))

    cut = _scan(docs, benchmark, text_col, item_col, item_text_col, window, finish, widened(docs, **{flag: "string"}))
    changed = ~col(text_col).eqNullSafe(col(flag))
    out = [col(flag).alias(c) if k == at else (F.when(changed, F.length(col(flag))).otherwise(col(c)).cast(docs.schema[k].dataType).alias(c) if k == size else col(c)) for k, c in enumerate(docs.columns)]
    return cut.select(*out)
