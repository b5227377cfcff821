"""Line dedup by distinct-site spread.

Each line hash carries a HyperLogLog sketch of the sites it is on; sketches merge by aggregation.
Lines estimated clearly above the threshold are spread widely, clearly below are not, and those near
it get an exact distinct count. A widely spread line is boilerplate if it also is in ``min_texts``
different texts: a page that is copied around, with some edits, keeps its prose. The first
occurrence of a boilerplate line (least document id, then least position) stays, all others go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, dealt_join, fresh, hot_keys, save, small_batches, widened

#: log2 of the sketch's registers, and how far from the threshold an estimate decides alone.
LG_K, BAND = 10, 0.25
#: Boilerplate lines broadcast at most (16 bytes each); with more, lines are joined by shuffle.
BROADCAST_LINES = 1_000_000


#: White space around a line that does not count.
SPACE = " \t\n\x0b\x0c\r"


def _key(line: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(line.encode(), 7)
    return h - (1 << 64) if h >> 63 else h


def line_sites(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``doc_id, site, copy, lines``: per document its text's hash and its distinct line hashes."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            copies, lines = [], []
            for text in batch.column(2).to_pylist():
                copies.append(_key(text or ""))
                own = {s for line in (text or "").split("\n") if (s := line.strip(SPACE))}
                lines.append([_key(s) for s in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(copies, pa.int64()), pa.array(lines, pa.list_(pa.int64()))],
                names=["doc_id", "site", "copy", "lines"],
            )

    narrow = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(site_col).cast("string"), F.lit("")).alias("site"), col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, site string, copy long, lines array<long>")


def boilerplate(docs: DataFrame, min_sites: int = 10, min_texts: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``line, first_id``: hashes of boilerplate lines and the document that keeps each; and what
    :func:`line_sites` gives of ``docs``, saved."""
    seen = save(line_sites(docs, id_col, text_col, site_col), "line-sites")
    texts = seen.groupBy("copy", "site").agg(F.first("lines").alias("lines"))
    pairs = save(texts.select("site", F.explode("lines").alias("line")).groupBy("line", "site").agg(F.count("*").alias("n")), "pairs")
    spread = pairs.groupBy("line").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch")).where(F.col("rows") > 1 if min_sites > 1 else F.lit(True))
    spread = save(spread.select("line", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = pairs.join(near.select("line", F.col("n").alias("all")), "line").groupBy("line").agg(F.countDistinct("site").alias("sites"), F.first("all").alias("n")).where(F.col("sites") >= min_sites)
    wide = save(spread.where(F.col("sites") > min_sites * (1 + BAND)).select("line", "n").unionByName(exact.select("line", "n")), "wide")
    own = seen.select("doc_id", "copy", F.explode("lines").alias("line"))
    if wide.count() <= BROADCAST_LINES:
        holders = own.join(F.broadcast(wide.select("line")), "line")
    else:
        total = pairs.agg(F.sum("n")).first()[0]
        holders = dealt_join(own, wide.select("line"), "line", hot_keys(wide, "line", "n", total))
    found = holders.groupBy("line").agg(F.min("doc_id").alias("first_id"), F.countDistinct("copy").alias("texts"), F.count("*").alias("n"))
    return save(found.where(F.col("texts") >= min_texts).select("line", "first_id", "n"), "boilerplate"), seen


def _with_copy(docs: DataFrame, name: str, text_col: str) -> DataFrame:
    """``docs`` with the text's hash in a column ``name``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.append_column(name, pa.array([_key(t or "") for t in batch.column(at).to_pylist()], pa.int64()))

    return docs.mapInArrow(run, widened(docs, **{name: "long"}))


def deduplicate(docs: DataFrame, min_sites: int = 10, min_texts: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", length_col: str | None = "n_chars", counts: bool = False) -> DataFrame:
    """``docs`` with all their columns, cross-site boilerplate lines cut out of the texts: those on
    ``min_sites`` sites and in ``min_texts`` different texts, or more.

    Lines compare without surrounding white space; blank lines are never boilerplate. Each
    boilerplate line stays in one place: the first in the document of the least id. Null sites are
    one site; null texts stay null, and rows without an id keep none of the lines. Rows that
    repeat the first document's id keep the line too. A document all of whose lines are cut keeps
    its row, with an empty text. White space is that of ASCII (space and U+0009 to U+000D).
    ``length_col``, if there is one, is set to the new length.
    ``counts`` adds ``n_lines`` and ``n_removed`` (non-blank lines, and those cut).
    """
    spark = docs.sparkSession
    small_batches(spark)
    found, seen = boilerplate(docs, min_sites, min_texts, id_col, text_col, site_col)
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)
    flag, total, cut = (fresh(docs.columns, c) for c in ("kept_text", "n_lines", "n_removed"))
    n = found.count()
    if n <= BROADCAST_LINES:
        table = found.toArrow()
        shared = spark.sparkContext.broadcast(dict(zip(table["line"].to_pylist(), table["first_id"].to_pylist())))
        mine, source = None, docs
    else:  # each text is handed the boilerplate lines it has, by its hash, whatever its ids
        shared = None
        mine = fresh(docs.columns, "own_lines")
        name = fresh([*docs.columns, mine], "own_copy")
        copies = seen.groupBy(F.col("copy").alias(name)).agg(F.first("lines").alias("lines"), F.count("*").alias("n"))
        rows = copies.select(name, F.explode("lines").alias("line"))
        own = dealt_join(rows, found.select("line", "first_id"), "line", hot_keys(found, "line", "n", seen.agg(F.sum(F.size("lines"))).first()[0] or 0))
        own = own.groupBy(name).agg(F.collect_set(F.struct("line", "first_id")).alias(mine))
        source = dealt_join(_with_copy(docs, name, text_col), copies.select(name).join(own, name, "left"), name, hot_keys(copies, name, "n", seen.count())).select(*docs.columns, mine)

    def run(batches):
        for batch in batches:
            texts, lines, removed = [], [], []
            own = batch.column(batch.schema.get_field_index(mine)).to_pylist() if mine else None
            for k, (doc, text) in enumerate(zip(batch.column(key).to_pylist(), batch.column(at).to_pylist())):
                first = shared.value if shared else {r["line"]: r["first_id"] for r in own[k] or ()}
                held, kept, n = set(), [], 0
                parts = text.split("\n") if text is not None else []
                for line in parts:
                    s = line.strip(SPACE)
                    n += bool(s)
                    h = _key(s) if s and first else None
                    if h is None or h not in first:
                        kept.append(line)
                    elif doc is not None and first[h] == doc and h not in held:
                        held.add(h)
                        kept.append(line)
                texts.append(None if text is None else text if len(kept) == len(parts) else "\n".join(kept))
                lines.append(n)
                removed.append(len(parts) - len(kept))
            out = batch.drop_columns([mine]) if mine else batch
            yield out.append_column(flag, pa.array(texts, pa.string())).append_column(total, pa.array(np.array(lines, np.int64))).append_column(cut, pa.array(np.array(removed, np.int64)))

    made = source.mapInArrow(run, widened(docs, **{flag: "string", total: "long", cut: "long"}))
    out = []
    for k, c in enumerate(docs.columns):
        if k == at:
            out.append(col(flag).alias(c))
        elif c == length_col:
            out.append(F.when(col(cut) > 0, F.length(col(flag))).otherwise(col(c)).cast(docs.schema[k].dataType).alias(c))
        else:
            out.append(col(c))
    return made.select(*out, *([col(total).alias("n_lines"), col(cut).alias("n_removed")] if counts else []))
