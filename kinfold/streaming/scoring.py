"""Scoring of a stream of items against a static index: stateless, so no watermark is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.retrieve import DECIMALS, UNKNOWN, _matrix, unit_rows

#: Bytes of gallery vectors that may be held by every worker.
GALLERY_BYTES = 256 << 20
#: Rows of a batch multiplied with the gallery at a time.
ROWS = 256


def score_stream(stream: DataFrame, gallery: DataFrame, threshold: float = 0.4, id_col: str = "image_id", vec: str = "fv", identity_col: str = "identity") -> DataFrame:
    """``image_id, similarity, decision`` per row of the stream; vectors without direction are unknown.

    The gallery's size is measured and must fit ``GALLERY_BYTES``; a larger one is scored per
    micro-batch with :func:`foreach_batch_scorer`.
    """
    size = gallery.agg(F.coalesce(F.sum(F.size(vec) * F.lit(8)), F.lit(0)).alias("b")).first()["b"]
    if size > GALLERY_BYTES:
        raise ValueError(f"the gallery has {size} bytes of vectors; use foreach_batch_scorer")
    table = gallery.select(F.col(id_col).alias("g"), F.col(identity_col).cast("string").alias("c"), F.col(vec).alias("v")).where("v is not null").orderBy("g").toArrow()
    unit, ok = unit_rows(_matrix(table["v"]))
    shared = gallery.sparkSession.sparkContext.broadcast((unit, np.array(table["c"].to_pylist(), dtype=object)[ok]))
    kind = stream.schema[id_col].dataType.simpleString()

    def run(batches):
        unit, names = shared.value
        for batch in batches:
            column = batch.column(1)
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            sims, classes = np.full(len(ok), np.nan), np.full(len(ok), UNKNOWN, dtype=object)
            if ok.any() and len(unit):
                q, fine = unit_rows(_matrix(column.drop_null()))
                at = np.flatnonzero(ok)[fine]
                for k in range(0, len(at), ROWS):
                    s = np.round(q[k : k + ROWS] @ unit.T, DECIMALS)
                    best = s.shape[1] - 1 - np.argmax(s[:, ::-1], axis=1)  # of equals, the greatest id
                    sims[at[k : k + ROWS]] = top = s[np.arange(len(s)), best]
                    classes[at[k : k + ROWS]] = np.where(top >= threshold, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sims, pa.float64(), mask=np.isnan(sims)), pa.array(classes.tolist(), pa.string())], names=["image_id", "similarity", "decision"])

    return stream.select(F.col(id_col).alias("image_id"), F.col(vec).alias("v")).mapInArrow(run, f"image_id {kind}, similarity double, decision string")


def foreach_batch_scorer(gallery: DataFrame, sink, threshold: float = 0.4):
    """A ``foreachBatch`` function that scores each micro-batch by the blocked exact search."""
    from kinfold.operators.retrieve import classify, open_set

    def score(batch: DataFrame, epoch: int) -> None:
        sink(open_set(classify(batch, gallery, gallery, 1), threshold), epoch)

    return score
