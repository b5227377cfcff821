"""Fisher vectors: each bag's gradient sums under a mixture, power- and length-normalised.

Sums are associative, so a task adds up its part of every bag and the parts are added by bag; a
bag of any size is never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import l2_norm, l2_normalize, power_normalize
from kinfold.operators.gmm import GMMModel
from kinfold.operators.retrieve import _matrix

#: Bags a task holds sums of before it passes them on, and ways a bag's parts are first added.
HELD, SALT = 4096, 32


def _terms(x: np.ndarray, model: GMMModel) -> np.ndarray:
    """Per vector, its summands of all mean gradients (by component), then of all variance gradients."""
    gamma, _ = model.posterior(x)
    diff = x[:, None, :] - model.means
    first = gamma[:, :, None] * diff / np.sqrt(model.variances)
    second = gamma[:, :, None] * (diff**2 - model.variances) / (2 * model.variances**1.5)
    return np.concatenate([first.reshape(len(x), -1), second.reshape(len(x), -1)], axis=1)


def gradients(vectors: DataFrame, model: GMMModel, id_col: str = "image_id", vec: str = "reduced") -> DataFrame:
    """``image_id, n, grad``: the number of vectors of each bag and its raw gradient sums.

    Bags without vectors have no row; null vectors are left out.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        salt = TaskContext.get().partitionId() % SALT
        held: dict = {}

        def flush(kind):
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(held), kind), pa.array([salt] * len(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([g for _, g in held.values()], pa.list_(pa.float64()))],
                names=["image_id", "salt", "n", "grad"],
            )
            held.clear()
            return made

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                ids, where = np.unique(np.array([str(v) for v in rows.column(0).to_pylist()]), return_inverse=True)
                first = {}
                for name, v in zip(where, rows.column(0).to_pylist()):
                    first.setdefault(int(name), v)
                sums = np.zeros((len(ids), 2 * shared.value.means.size))
                np.add.at(sums, where, _terms(_matrix(rows.column(1)), shared.value))
                for j, n in enumerate(np.bincount(where)):
                    old = held.get(first[j])
                    held[first[j]] = (int(n), sums[j]) if old is None else (old[0] + int(n), old[1] + sums[j])
                if len(held) > HELD:
                    yield flush(kind)
        if held:
            yield flush(kind)

    rows = vectors.select(F.col(id_col).alias("image_id"), F.col(vec).alias("v")).where("v is not null")
    parts = rows.mapInArrow(run, f"image_id {id_type}, salt int, n long, grad array<double>")
    return _added(_added(parts, "image_id", "salt"), "image_id")


def _added(parts: DataFrame, *by: str) -> DataFrame:
    gathered = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list("grad").alias("all"))
    whole = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, g: F.zip_with(a, g, lambda x, y: x + y))
    return gathered.select(*by, "n", whole.alias("grad"))


def fisher_vectors(vectors: DataFrame, model: GMMModel, id_col: str = "image_id", vec: str = "reduced") -> DataFrame:
    """``image_id, fv``: signed square roots of the gradient sums, scaled to length 1.

    A bag whose sums are all zero has no direction and no row; :func:`skipped` tells of such bags.
    """
    rows = gradients(vectors, model, id_col, vec).select("image_id", power_normalize(F.col("grad")).alias("p")).where(l2_norm(F.col("p")) > 0)
    return rows.select("image_id", l2_normalize(F.col("p")).alias("fv"))


def skipped(catalog: DataFrame, encoded: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Catalog items without a Fisher vector."""
    return catalog.join(encoded, id_col, "left_anti")


def bag_sizes(vectors: DataFrame, id_col: str = "image_id") -> DataFrame:
    return vectors.groupBy(id_col).agg(F.count("*").alias("n"))
