"""Packing by concatenate-and-cut.

The token streams of all documents, each closed by an end id, are laid end to end and cut into
fixed windows. Pass one makes each document's ids once and its offset within its task; prefix sums
over the tasks' totals turn that into an offset in the whole stream; pass two cuts every document
at the window borders on its own, so no row waits for another and no group is ever gathered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import bpe
from kinfold.llm.common import col, save, small_batches


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``part, local, doc_id, n_tokens, ids``, written to the shared folder.

    ``local`` counts the ids before the document within its task. Null text is empty. ``ids`` are
    unsigned little-endian, of the width the vocabulary needs.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(batches):
        enc = bpe.encoder(bpe.default_path(tokenizer))
        part, local = TaskContext.get().partitionId(), 0
        closing = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [x + closing for x in enc.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            start = local + np.cumsum(n) - n
            local += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int64)), pa.array(start), batch.column(0), pa.array(n), pa.array(ids, pa.binary())],
                names=["part", "local", "doc_id", "n_tokens", "ids"],
            )

    return save(narrow.mapInArrow(run, f"part long, local long, doc_id {id_type}, n_tokens long, ids binary"), "tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``at``: the ids before the document in the whole stream.

    The windowed table has one row per task of pass one, whatever the number of documents.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("_base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("_base") + F.col("local")).drop("_base")


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The boundary records: one row per piece of a document within one window.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``. Sequences are the
    windows ``[length * k, length * (k + 1))`` of the stream, so only the last one is short. A null
    or empty text is the end id alone; repeated rows are packed as often as they occur; an empty
    table gives no piece.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    placed = with_offsets(token_table(docs, tokenizer, end_id, id_col, text_col)).select("doc_id", "at", "n_tokens", "ids")

    def run(batches):
        for batch in batches:
            out: list = [[] for _ in range(7)]
            keep: list = []
            for row, (at, n, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                width = len(raw) // n
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    own = wide[4 * start : 4 * (start + size)]
                    keep.append(row)
                    for c, v in zip(out, (start, size, zlib.crc32(own), n, seq, offset, raw[width * start : width * (start + size)])):
                        c.append(v)
                    start += size
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def sequences(packed: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids array<int>, n_tokens, boundaries``.

    Padded with ``pad_id`` to ``length``, except where the size already is a power of two. One
    group is one window, so it holds at most ``length`` ids.
    """

    def run(key, table):
        rows = sorted(zip(table["offset"].to_pylist(), table["length"].to_pylist(), table["ids"].to_pylist()))
        ids = np.concatenate([np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int32) for _, n, raw in rows])
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(length - n, pad_id, np.int32)])
        return pa.table({
            "sequence_id": [key[0].as_py()], "n_tokens": pa.array([n], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int32())), "boundaries": pa.array([[o for o, _, _ in rows]], pa.list_(pa.int64())),
        })

    narrow = packed.select("sequence_id", "offset", "length", "ids")
    return narrow.groupBy("sequence_id").applyInArrow(run, "sequence_id long, n_tokens long, ids array<int>, boundaries array<long>")
