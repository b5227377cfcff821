"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear
hinge-loss model fitted by dual coordinate descent, with a calibrated score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, save, small_batches

#: Hashed feature space: indicators of words and word pairs, behind the places of shape marks.
BITS = 18
SHAPES = 1_000
#: Labelled documents the model is fitted on at most (about; by a hash of the id), and features of
#: them, four bytes each, that reach the driver: with long documents, fewer are fitted on.
SAMPLE, FEATURES = 6_000, 16_000_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_known: dict[str, int] = {}


def _word_hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        import xxhash

        if len(_known) > 500_000:
            _known.clear()
        h = _known[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), 5)
    return h


def features(text: str | None) -> np.ndarray:
    """Indices of the features a text has: hashed n-grams, and bins of its overall figures."""
    toks = _TOKEN.findall(text or "")
    marks = []
    if toks:
        n = len(toks)
        distinct = len(set(toks))
        letters = sum(map(str.isalpha, toks))
        upper = sum(map(str.isupper, toks))
        length = len(text)
        symbols = sum(map(text.count, "#*$%&|<>"))
        shouts = text.count("!")
        figures = (distinct / n, letters / n, upper / n, 20 * symbols / length, 20 * shouts / length, sum(a == b for a, b in zip(toks, toks[1:])) / n)
        marks = [k * 64 + min(40, int(v * 20)) for k, v in enumerate(figures)]
        marks.append(700 + min(30, int(np.log2(n))))
    else:
        marks = [999]
    if not toks:
        return np.array(marks, np.int64)
    h = np.fromiter(map(_word_hash, map(str.lower, toks)), np.uint64, len(toks))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    grams = np.concatenate([h, pairs]) & np.uint64((1 << BITS) - 1)
    return np.concatenate([np.array(marks, np.int64), np.unique(grams).astype(np.int64) + SHAPES])


SIZE = SHAPES + (1 << BITS)


@dataclass
class Model:
    """Weights already multiplied by the ratios, a bias, and the score's scale and shift."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def score(self, text: str | None) -> float:
        f = features(text)
        z = self.scale * self.margin(f) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum() / np.sqrt(len(f)) + self.bias)


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> Model:
    """Fit on feature lists and 0/1 labels; one label only, or none, gives a constant score."""
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(SIZE), 0.0, 0.0, prior)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    train = [rows[k] for k in np.flatnonzero(~held)]
    y = np.where(labels[~held] == 1, 1.0, -1.0)
    count = {s: np.full(SIZE, smooth) for s in (1.0, -1.0)}
    for f, s in zip(train, y):
        count[s][f] += 1
    docs = {s: float((y == s).sum()) for s in count}
    ratio = np.log((count[1.0] / (docs[1.0] + 2 * smooth)) / (count[-1.0] / (docs[-1.0] + 2 * smooth)))
    ratio[(count[1.0] + count[-1.0]) <= 2 * smooth + 1] = 0.0  # seen once: no evidence
    values = [ratio[f] / np.sqrt(len(f)) for f in train]
    norm = np.array([v @ v + 1.0 for v in values])
    cost = np.where(y > 0, c * len(y) / (2 * docs[1.0]), c * len(y) / (2 * docs[-1.0]))
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    order, rng = np.arange(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            f, v = train[i], values[i]
            grad = y[i] * (w[f] @ v + b) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                b += step
    model = Model(w * ratio, b, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    model.scale, model.shift = _calibrate(np.array([model.margin(rows[k]) for k in check]), labels[check])
    return model


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift (Newton's method), with smoothed targets against overconfidence."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, r = p * (1 - p) + 1e-9, p - target
        h = np.array([[(d * margin**2).sum() + 1e-6, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        s = np.linalg.solve(h, [(r * margin).sum(), r.sum()])
        a, b = a - s[0], b - s[1]
        if np.abs(s).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, budget: int = FEATURES) -> Model:
    """Fit on at most about ``sample`` labelled documents with ``budget`` features in all, the first
    by a hash of the id.

    Rows without id, label or text are not learned from; of several labels of an id the least
    counts. Only feature indices of the sample reach the driver.
    """
    small_batches(docs.sparkSession)
    own = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    rank = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(1 << 20))
    n = own.count()
    chosen = own.where(rank < min(1 << 20, max(1, (sample << 20) // max(1, n))))
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            f = [features(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(f, pa.list_(pa.int32()))], names=["id", "label", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = save(texts.select("id", "text", "label").mapInArrow(run, f"id {kind}, label int, f array<int>").withColumn("rank", rank), "features")
    sizes = made.select("rank", F.size("f").alias("n")).orderBy("rank").toArrow()
    within = np.cumsum(sizes["n"].to_numpy()) <= budget if sizes.num_rows else np.ones(0, bool)
    last = int(sizes["rank"].to_numpy()[within][-1]) if within.all() and len(within) else int(sizes["rank"].to_numpy()[~within][0]) - 1 if len(within) else -1
    table = made.where(F.col("rank") <= last).drop("rank").toArrow()
    order = np.argsort(np.array([str(i) for i in table["id"].to_pylist()]), kind="stable") if table.num_rows else []
    lists = table["f"].combine_chunks()
    rows = [np.asarray(lists[int(k)].values) for k in order]
    return fit(rows, np.asarray(table["label"], np.int64)[order] if table.num_rows else np.empty(0, np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, score, predicted``.

    Null and empty texts get a score too, that of a text without features. Null ids and repeated
    rows pass through; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            s = np.array([m.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, predicted int")
