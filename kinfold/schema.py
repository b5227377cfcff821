"""Schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CATALOG = "image_id string, identity string, path string"
DESCRIPTORS = "image_id string, desc_idx int, desc array<float>"
PCA_MODEL = "pc int, variance double, loading array<double>, mean array<double>"
GMM_MODEL = "k int, weight double, mu array<double>, var array<double>"
GALLERY = "image_id string, identity string, fv array<float>"
MATCH = "struct<similarity:double,class:string>"
PREDICTIONS = f"image_id string, predicted_class string, top_n array<{MATCH}>"
REPORT = "class string, precision double, recall double, f1 double, support long"
CONFUSION = "true_class string, predicted_class string, count long"


def widened(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column, which may be null."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])
