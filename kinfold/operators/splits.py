"""Closed-set splits: every identity with two items or more is in both parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_filter(catalog: DataFrame, prefixes: list[str], path_col: str = "path") -> DataFrame:
    """Rows whose path starts with any of the prefixes (pushed to the scan); no prefix keeps none."""
    return catalog.where(reduce(lambda a, b: a | b, (F.col(path_col).startswith(p) for p in prefixes), F.lit(False)))


def closed_set_split(catalog: DataFrame, train_share: float = 0.8, seed: int = 42, id_col: str = "image_id", identity_col: str = "identity") -> DataFrame:
    """``catalog`` with a column ``split`` of ``train`` or ``test``.

    Within an identity of n items the first ``clamp(round(share * n), 1, n - 1)`` in an order set by
    a seeded hash of the id train; a single item trains. The order depends on ids alone, so it does
    not change with partitioning. An identity's items are numbered within 256 ranges of the hash,
    behind the counts of the ranges before, so no task orders all items of a large identity.
    """
    taken = {c.lower() for c in catalog.columns}
    part, before, size, digest = (f"split_{c}" for c in ("part", "before", "size", "digest"))
    if taken & {part, before, size, digest}:
        raise ValueError("columns named split_* are used inside")
    rows = catalog.withColumn(digest, F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))).withColumn(part, F.coalesce(F.substring(digest, 1, 2), F.lit("")))
    own = Window.partitionBy("identity")
    counts = rows.groupBy(F.col(identity_col).alias("identity"), F.col(part).alias("range")).agg(F.count("*").alias("n"))
    counts = counts.select(
        "identity", "range", F.sum("n").over(own).alias(size), F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)
    )
    counts = counts.select(F.col("identity").alias("split_identity"), F.col("range").alias("split_range"), size, before)
    joined = rows.join(counts, rows[identity_col].eqNullSafe(counts["split_identity"]) & (rows[part] == counts["split_range"]))
    at = F.col(before) + F.row_number().over(Window.partitionBy(identity_col, part).orderBy(digest, id_col))
    quota = F.greatest(F.lit(1), F.least(F.col(size) - 1, F.floor(F.col(size) * F.lit(train_share) + 0.5)))
    return joined.select(*(rows[c] for c in catalog.columns), F.when(at <= quota, "train").otherwise("test").alias("split"))


def analyze_split(split: DataFrame, identity_col: str = "identity") -> DataFrame:
    """Per part: its items and identities."""
    return split.groupBy("split").agg(F.count("*").alias("n_images"), F.countDistinct(identity_col).alias("n_identities"))


def split_overlap(split: DataFrame, identity_col: str = "identity") -> DataFrame:
    """One row: identities in both parts, in training only, in test only."""
    parts = split.groupBy(identity_col).agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") == "test").cast("int")).alias("b"))
    count = lambda a, b, name: F.coalesce(F.sum(((F.col("a") == a) & (F.col("b") == b)).cast("long")), F.lit(0)).alias(name)
    return parts.agg(count(1, 1, "n_both"), count(1, 0, "n_train_only"), count(0, 1, "n_test_only"))
