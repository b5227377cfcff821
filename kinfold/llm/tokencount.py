"""Token counts without token ids.

Pieces are counted once per distinct pre-token and joined to each document's pre-token
frequencies. Pre-tokens that make up at least one in ``HOT`` of all occurrences, of which there are
``HOT`` at most, are broadcast and summed where the document is read, the long ones under a digest;
what remains is joined by shuffle, so no vocabulary is too large and no key of the join is hot.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import bpe
from kinfold.llm.common import col, save, small_batches

#: Most pre-tokens that can be broadcast, and the characters beyond which a digest stands for one.
HOT, HOT_CHARS = 1_000_000, 32
#: Distinct pre-tokens a task holds, and characters it reads, before it passes their counts on.
HELD, HELD_CHARS = 300_000, 1 << 28
BLOCK = 256


def pretoken_table(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``pretoken, freq, n``: each distinct pre-token, how often it occurs, the ids it makes."""

    def split(batches):
        enc, held, read = bpe.encoder(bpe.default_path(tokenizer)), Counter(), 0

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pretoken", "freq"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(enc.pretokens(text))
                read += len(text)
                if len(held) > HELD or read > HELD_CHARS:
                    yield flush()
                    read = 0
        yield flush()

    def count(batches):
        enc = bpe.encoder(bpe.default_path(tokenizer))
        for batch in batches:
            yield batch.append_column("n", pa.array(enc.count(batch.column(0).to_pylist()), pa.int64()))

    texts = docs.select(col(text_col).alias("text")).where("text is not null")
    distinct = texts.mapInArrow(split, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return save(distinct.mapInArrow(count, "pretoken string, freq long, n long"), "pretokens")


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null text counts as empty (0 bytes, 0 ids). Repeated rows give repeated results, null ids stay
    null, an empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    table = pretoken_table(docs, tokenizer, text_col)
    total = table.agg(F.sum("freq")).first()[0] or 0
    name = F.when(F.length("pretoken") <= HOT_CHARS, F.col("pretoken")).otherwise(F.concat(F.lit("\0"), F.sha2("pretoken", 256)))
    hot = table.where(F.col("freq") * HOT >= total).select(name.alias("pretoken"), "n").toArrow()
    shared = spark.sparkContext.broadcast((hot["pretoken"].to_pylist(), np.asarray(hot["n"], np.int32)))

    def run(batches):
        enc = bpe.encoder(bpe.default_path(tokenizer))
        known = dict(zip(shared.value[0], shared.value[1].tolist()))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(k, BLOCK)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                sums, rest = [], []
                for text in texts:
                    freq = Counter(enc.pretokens(text))
                    total, cold = enc.specials(text), []
                    for piece, f in freq.items():
                        n = known.get(piece if len(piece) <= HOT_CHARS else "\0" + hashlib.sha256(piece.encode()).hexdigest())
                        if n is None:
                            cold.append({"pretoken": piece, "f": f})
                        else:
                            total += n * f
                    sums.append(total)
                    rest.append(cold)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(texts))), rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("pretoken", pa.string()), ("f", pa.int64())]))),
                    ],
                    names=["row", "doc_id", "n_bytes", "hot", "cold"],
                )
                row += len(texts)

    schema = f"row long, doc_id {id_type}, n_bytes long, hot long, cold array<struct<pretoken:string,f:long>>"
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    found = save(narrow.mapInArrow(run, schema), "frequencies")
    cold = found.select("row", F.inline("cold")).join(table.select("pretoken", "n"), "pretoken")
    more = cold.groupBy("row").agg(F.sum(F.col("f") * F.col("n")).alias("more"))
    tokens = F.col("hot") + F.coalesce("more", F.lit(0))
    return found.drop("cold").join(more, "row", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
