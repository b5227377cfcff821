"""Diagonal-covariance Gaussian mixtures by expectation-maximisation.

An iteration broadcasts the parameters, sums each task's sufficient statistics in numpy, and
combines them per component and element; the driver sees K x D numbers. Vectors of ``LOCAL_BYTES``
at most are fetched once instead and iterated over on the driver, by the same sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.retrieve import _matrix
from kinfold.schema import widened

#: Added to every variance; log-likelihood gain per vector below which fitting stops; most rounds.
REG, TOL, MAX_ITER = 1e-6, 1e-3, 100
#: Distinct vectors the starting means are chosen from.
INIT_SAMPLE = 10_000
#: Bytes of vectors up to which fitting takes place on the driver, without a job per round.
LOCAL_BYTES = 16 << 20


@dataclass
class GMMModel:
    """``weights`` (k), ``means`` (k, d), ``variances`` (k, d)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, per vector and component."""
        inv = 1 / self.variances
        square = (x * x) @ inv.T - 2 * x @ (self.means * inv).T + (self.means**2 * inv).sum(axis=1)
        return np.log(self.weights) - 0.5 * (np.log(2 * np.pi * self.variances).sum(axis=1) + square)

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities, and each vector's log-likelihood."""
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        part = np.exp(joint - top)
        whole = part.sum(axis=1, keepdims=True)
        return part / whole, (top + np.log(whole))[:, 0]

    def to_rows(self, spark: SparkSession) -> DataFrame:
        table = pa.table({
            "k": pa.array(np.arange(len(self.weights), dtype=np.int32)), "weight": pa.array(self.weights),
            "mu": pa.array(list(self.means), pa.list_(pa.float64())), "var": pa.array(list(self.variances), pa.list_(pa.float64())),
        })
        return spark.createDataFrame(table)

    @staticmethod
    def from_rows(rows: DataFrame) -> GMMModel:
        got = rows.orderBy("k").toArrow()
        return GMMModel(*(np.array(got[c].to_pylist()) for c in ("weight", "mu", "var")))


def _sums(x: np.ndarray, model: GMMModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums of responsibilities, of vectors and squares under them, and of log-likelihoods."""
    g, own = model.posterior(x)
    return g.sum(axis=0), g.T @ x, g.T @ (x * x), float(own.sum())


def _next(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, ll: float) -> tuple[GMMModel, float]:
    total = n.sum()
    if not total:
        raise ValueError("no vectors to fit on")
    own = np.maximum(n, 10 * np.finfo(float).eps)[:, None]
    mean = s1 / own
    return GMMModel(n / total, mean, np.maximum(s2 / own - mean**2, 0.0) + REG), ll / total


def _statistics(vectors: DataFrame, model: GMMModel, vec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k, d = model.means.shape

    def run(batches):
        n, s1, s2, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            more = _sums(x, shared.value)
            n, s1, s2, ll = n + more[0], s1 + more[1], s2 + more[2], ll + more[3]
        c, i = np.indices((k, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.ravel().astype(np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(np.repeat(n, d)), pa.array(s1.ravel()), pa.array(s2.ravel()), pa.array(np.full(k * d, ll))],
            names=["k", "i", "n", "s1", "s2", "ll"],
        )

    parts = vectors.select(F.col(vec).alias("v")).where("v is not null").mapInArrow(run, "k int, i int, n double, s1 double, s2 double, ll double")
    got = parts.groupBy("k", "i").agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2", "ll"))).toArrow()
    out = {c: np.zeros((k, d)) for c in ("n", "s1", "s2", "ll")}
    at = got["k"].to_numpy(), got["i"].to_numpy()
    for c, m in out.items():
        m[at] = got[c].to_numpy()
    return out["n"][:, 0], out["s1"], out["s2"], float(out["ll"][0, 0])


def em_step(vectors: DataFrame, model: GMMModel, vec: str = "reduced") -> tuple[GMMModel, float]:
    """The next parameters, and the mean log-likelihood under the given ones."""
    return _next(*_statistics(vectors, model, vec))


def initial(vectors: DataFrame, k: int, seed: int = 42, vec: str = "reduced") -> GMMModel:
    """Start from k-means over a bounded sample: the distinct vectors of least hash."""
    rows = vectors.select(F.col(vec).alias("v")).where("v is not null")
    total = rows.count()
    share = max(1, min(1 << 20, (2 * INIT_SAMPLE << 20) // max(1, total)))
    rank = F.xxhash64(F.col("v"), F.lit(seed))
    some = rows.where(F.pmod(rank, F.lit(1 << 20)) < share).distinct().orderBy(rank, "v").limit(INIT_SAMPLE)
    return _start(_matrix(some.toArrow()["v"]), k, seed)


def _start(x: np.ndarray, k: int, seed: int) -> GMMModel:
    """k-means++ and k-means over the distinct vectors ``x``, in whatever order they are."""
    x = x[np.lexsort(x.T[::-1])] if len(x) else x
    if len(x) < k:
        raise ValueError(f"{len(x)} different vectors for {k} components")
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < k:  # k-means++: far vectors are likelier
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() else x[rng.integers(len(x))])
    c = np.array(centers)
    for _ in range(25):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    size = np.array([(near == j).sum() for j in range(k)], float)
    var = np.array([x[near == j].var(axis=0) if size[j] > 1 else x.var(axis=0) for j in range(k)]) + REG
    return GMMModel(np.maximum(size, 1) / np.maximum(size, 1).sum(), c, var)


def fit(vectors: DataFrame, k: int = 2, seed: int = 42, vec: str = "reduced", start: GMMModel | None = None, max_iter: int = MAX_ITER, tol: float = TOL) -> GMMModel:
    """Fit until the mean log-likelihood gains less than ``tol``. Vectors too many for the driver are
    kept in memory or on disk between rounds and let go at the end."""
    rows = vectors.select(vec).where(F.col(vec).isNotNull()).persist()
    try:
        size = rows.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
        small = size["n"] * (size["d"] or 0) * 8 <= LOCAL_BYTES
        model, before = start or initial(rows, k, seed, vec), -np.inf
        x = _matrix(rows.toArrow()[vec]) if small else None
        for _ in range(max_iter):
            model, now = _next(*_sums(x, model)) if small else em_step(rows, model, vec)
            if abs(now - before) < tol:
                break
            before = now
        return model
    finally:
        rows.unpersist()


def responsibilities(vectors: DataFrame, model: GMMModel, vec: str = "reduced", out: str = "gamma") -> DataFrame:
    """``vectors`` with each row's responsibilities; null vectors get null. ``vec`` is dropped."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    at = vectors.columns.index(vec)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            made: list = [None] * len(ok)
            if ok.any():
                for row, g in zip(np.flatnonzero(ok), shared.value.posterior(_matrix(column.drop_null()))[0]):
                    made[row] = g
            yield batch.drop_columns([vec]).append_column(out, pa.array(made, pa.list_(pa.float64())))

    return vectors.mapInArrow(run, widened(vectors.drop(vec), out, "array<double>"))
