"""Whitening PCA from distributed moments: one pass over the vectors, eigenvectors on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.retrieve import _matrix
from kinfold.schema import widened


def moments(vectors: DataFrame, vec: str = "desc") -> DataFrame:
    """``i, j, n, si, sj, m`` for i <= j: counts, sums of both elements, sums of their products.

    A task sends one row per pair of elements whatever its rows, and these combine before the
    shuffle. Null vectors are left out.
    """

    def run(batches):
        n, s, m = 0, None, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            if s is None:
                s, m = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
            n += len(x)
            s += x.sum(axis=0)
            m += x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n, np.int64)), pa.array(s[i]), pa.array(s[j]), pa.array(m[i, j])],
                names=["i", "j", "n", "si", "sj", "m"],
            )

    rows = vectors.select(F.col(vec).alias("v")).where("v is not null")
    parts = rows.mapInArrow(run, "i int, j int, n long, si double, sj double, m double")
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("si").alias("si"), F.sum("sj").alias("sj"), F.sum("m").alias("m"))


def mean_vector(vectors: DataFrame, vec: str = "desc") -> DataFrame:
    """``i, mean`` per element."""
    return moments(vectors, vec).where("i = j").select("i", (F.col("si") / F.col("n")).alias("mean"))


def covariance(vectors: DataFrame, vec: str = "desc") -> DataFrame:
    """``i, j, cov`` for i <= j: the sample covariance; NaN with fewer than two vectors."""
    n = F.col("n")
    cov = F.when(n > 1, (F.col("m") - F.col("si") * F.col("sj") / n) / F.when(n > 1, n - 1)).otherwise(float("nan"))
    return moments(vectors, vec).select("i", "j", cov.alias("cov"))


@dataclass
class PCAModel:
    """``mean`` (d), ``loadings`` (p, d) by falling variance, ``variances`` (p), ``ratios`` (all d)."""

    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    ratios: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened scores; components without variance score 0."""
        scale = np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1.0)), 0.0)
        return (x - self.mean) @ self.loadings.T * scale

    def to_rows(self, spark: SparkSession) -> DataFrame:
        p = len(self.variances)
        table = pa.table({
            "pc": pa.array(np.arange(1, p + 1, dtype=np.int32)), "variance": pa.array(self.variances), "loading": pa.array(list(self.loadings), pa.list_(pa.float64())),
            "mean": pa.array([self.mean] * p, pa.list_(pa.float64())), "ratios": pa.array([self.ratios] * p, pa.list_(pa.float64())),
        })
        return spark.createDataFrame(table)

    @staticmethod
    def from_rows(rows: DataFrame) -> PCAModel:
        got = rows.orderBy("pc").toArrow()
        return PCAModel(
            np.array(got["mean"][0].as_py()), np.array(got["loading"].to_pylist()), np.array(got["variance"].to_pylist()), np.array(got["ratios"][0].as_py())
        )


def fit(vectors: DataFrame, n_components: int, vec: str = "desc") -> PCAModel:
    """Fit on all vectors. Each loading's largest element is positive, so fits repeat.

    The driver holds the d x d covariance, a bound set by the vectors' width and not their number.
    """
    got = moments(vectors, vec).toArrow()
    if not got.num_rows:
        raise ValueError("no vectors to fit on")
    i, j, n = (got[c].to_numpy() for c in ("i", "j", "n"))
    d = int(i.max()) + 1
    if n_components > min(d, int(n[0])):
        raise ValueError(f"{n_components} components of {n[0]} vectors of width {d}")
    total = int(n[0])
    mean, m = np.zeros(d), np.zeros((d, d))
    diagonal = i == j
    mean[i[diagonal]] = got["si"].to_numpy()[diagonal] / total
    m[i, j] = m[j, i] = got["m"].to_numpy()
    cov = (m - total * np.outer(mean, mean)) / max(1, total - 1)
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = np.maximum(values[::-1], 0.0), vectors_[:, ::-1].T
    sign = np.sign(vectors_[np.arange(d), np.abs(vectors_).argmax(axis=1)])
    vectors_ = vectors_ * np.where(sign == 0, 1.0, sign)[:, None]
    trace = values.sum()
    return PCAModel(mean, vectors_[:n_components], values[:n_components], values / trace if trace > 0 else values)


def transform(vectors: DataFrame, model: PCAModel, vec: str = "desc", out: str = "reduced") -> DataFrame:
    """``vectors`` with the whitened scores in ``out``; null stays null. ``vec`` is dropped."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    at = vectors.columns.index(vec)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            made: list = [None] * len(ok)
            if ok.any():
                scores = shared.value.project(_matrix(column.drop_null()))
                for row, s in zip(np.flatnonzero(ok), scores):
                    made[row] = s
            yield batch.drop_columns([vec]).append_column(out, pa.array(made, pa.list_(pa.float64())))

    return vectors.mapInArrow(run, widened(vectors.drop(vec), out, "array<double>"))


def explained_variance(spark: SparkSession, model: PCAModel) -> DataFrame:
    """``pc, ratio`` over all components, largest first."""
    n = len(model.ratios)
    return spark.createDataFrame(pa.table({"pc": pa.array(np.arange(1, n + 1, dtype=np.int64)), "ratio": pa.array(model.ratios)}))


def optimal_components(model: PCAModel, threshold: float = 0.95) -> int:
    """Fewest components whose ratios reach ``threshold``; one more than all if none do."""
    return int(np.searchsorted(np.cumsum(model.ratios), threshold)) + 1
