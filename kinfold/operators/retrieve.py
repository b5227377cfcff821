"""Exact cosine nearest neighbours of a query set in a labelled gallery.

The gallery never moves: queries are broadcast in blocks of bounded size, each gallery task keeps
its own best ``k`` per query by a blocked matrix product, and only these are shuffled and ranked.
With more than one block both sides are written once first, the queries by block, so that a block's
pass reads its own queries and the stored gallery, whatever made them; what a pass found is written
too and its broadcast given up, so blocks never add up, and the plan of the result has one scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.shared import new_path, staged

#: Bytes of query vectors broadcast at a time.
BLOCK_BYTES = 64 << 20
#: Similarities are ranked at this many decimals, so that equal vectors tie in any partitioning.
DECIMALS = 12
#: Gallery rows and queries multiplied at a time.
ROWS, QUERIES = 4096, 1024
UNKNOWN = "Unknown class."


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.empty((0, 0))


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows have a length at all."""
    norm = np.sqrt((m * m).sum(axis=1)) if m.size else np.zeros(len(m))
    ok = norm > 0
    return m[ok] / norm[ok, None] if m.size else m[ok], ok


def _block(rows: DataFrame):
    """Queries with a direction, as (ids, unit matrix)."""
    table = rows.toArrow()
    unit, ok = unit_rows(_matrix(table["vec"]))
    return table["query_id"].filter(pa.array(ok)).to_pylist(), unit


def top_k(
    queries: DataFrame, gallery: DataFrame, k: int = 5, query_id: str = "image_id", gallery_id: str = "image_id", query_vec: str = "fv", gallery_vec: str = "fv", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``query_id, gallery_id, similarity, rank`` of each query's ``k`` most similar gallery rows.

    Ranked by similarity, then by id, both descending; fewer rows where the gallery is smaller.
    Null and zero vectors have no direction: they match nothing and are matched by nothing.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec")).where("vec is not null")
    g = gallery.select(F.col(gallery_id).alias("gallery_id"), F.col(gallery_vec).alias("vec")).where("vec is not null")
    q_type, g_type = q.schema["query_id"].dataType.simpleString(), g.schema["gallery_id"].dataType.simpleString()
    schema = f"query_id {q_type}, gallery_id {g_type}, similarity double"
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    parts = -(-size["n"] * max(1, size["d"] or 1) * 8 // block_bytes)
    if parts <= 1:
        shared = spark.sparkContext.broadcast(_block(q)) if parts else None
        found = g.mapInArrow(_scorer(shared, k), schema) if parts else spark.createDataFrame([], schema)
    else:  # by a hash of the id; the driver and the executors hold one block at a time and never the set
        q = staged(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "queries", "block")
        g = staged(g, "gallery")
        path = new_path(spark, "found")
        for p in range(parts):
            shared = spark.sparkContext.broadcast(_block(q.where(F.col("block") == p).select("query_id", "vec")))
            g.mapInArrow(_scorer(shared, k), schema).write.parquet(f"{path}/{p}")
            shared.destroy()
        found = spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in range(parts)))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("gallery_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _best_of(sims: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among each row's k best; of equals, the earlier ones."""
    if sims.shape[1] <= k:
        return np.ones(sims.shape, bool)
    last = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k][:, None]
    over, level = sims > last, sims == last
    return over | (level & (np.cumsum(level, axis=1) <= k - over.sum(axis=1, keepdims=True)))


def _scorer(shared, k: int):
    def run(batches):
        ids, unit = shared.value
        best: list = [[] for _ in ids]  # per query: (similarity, id), the k best so far
        floor = np.full(len(ids), -np.inf)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                matrix, ok = unit_rows(_matrix(rows.column(1)))
                if not len(matrix):
                    continue
                names = np.array(rows.column(0).filter(pa.array(ok)).to_pylist(), dtype=object)
                order = np.argsort(names, kind="stable")[::-1]  # of equals, the greatest id comes first
                matrix, names = matrix[order], names[order]
                for q in range(0, len(ids), QUERIES):
                    sims = np.round(unit[q : q + QUERIES] @ matrix.T, DECIMALS) + 0.0
                    hit = _best_of(sims, k) & (sims >= floor[q : q + QUERIES, None])
                    for row in np.flatnonzero(hit.any(axis=1)):
                        near = np.flatnonzero(hit[row])
                        best[q + row] = sorted([*best[q + row], *zip(sims[row, near].tolist(), names[near])], reverse=True)[:k]
                        if len(best[q + row]) == k:
                            floor[q + row] = best[q + row][-1][0]
        out = [(ids[row], name, sim) for row, own in enumerate(best) for sim, name in own]
        if out:
            q, g, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.infer_type(ids)), pa.array(g, kind), pa.array(s, pa.float64())], names=["query_id", "gallery_id", "similarity"])

    return run


def missing_labels(gallery: DataFrame, labels: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Gallery rows without a label: what an inner join would lose unseen."""
    return gallery.join(labels, id_col, "left_anti")


def with_labels(gallery: DataFrame, labels: DataFrame, id_col: str = "image_id", identity_col: str = "identity", require: bool = True) -> DataFrame:
    """The gallery with its labels; raises if ``require`` and any is missing. Of several labels of
    an id the greatest counts."""
    own = labels.groupBy(id_col).agg(F.max(identity_col).alias(identity_col))
    if require and (lost := missing_labels(gallery, own, id_col).limit(1).collect()):
        raise KeyError(f"no label for {lost[0][id_col]}")
    return gallery.join(own, id_col)


def classify(queries: DataFrame, gallery: DataFrame, labels: DataFrame, top_n: int = 5, id_col: str = "image_id", vec: str = "fv", identity_col: str = "identity") -> DataFrame:
    """Predictions: ``image_id, predicted_class, top_n`` with the matches best first."""
    near = top_k(queries, gallery, top_n, id_col, id_col, vec, vec)
    named = near.join(labels.groupBy(id_col).agg(F.max(identity_col).cast("string").alias("class")), F.col("gallery_id") == F.col(id_col)).select("query_id", "rank", "similarity", "class")
    return as_predictions(named)


def as_predictions(named: DataFrame) -> DataFrame:
    """``query_id, rank, similarity, class`` rows gathered into one row per query (k rows at most)."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "similarity", "class")))
    rows = named.groupBy(F.col("query_id").alias("image_id")).agg(ranked.alias("m"))
    return rows.select("image_id", F.element_at("m", 1)["class"].alias("predicted_class"), F.transform("m", lambda x: F.struct(x["similarity"].alias("similarity"), x["class"].alias("class"))).alias("top_n"))


def open_set(predictions: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``image_id, similarity, decision``: the best class if similar enough, else unknown."""
    best = F.element_at("top_n", 1)
    return predictions.select(
        "image_id", best["similarity"].alias("similarity"), F.when(best["similarity"] >= threshold, best["class"]).otherwise(UNKNOWN).alias("decision")
    )
