"""Accuracy, reports and confusion of predictions against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.vectors import contains_class


def with_truth(predictions: DataFrame, truth: DataFrame, id_col: str = "image_id", identity_col: str = "identity") -> DataFrame:
    """Predictions that have a true class; items without a prediction do not count."""
    own = truth.groupBy(id_col).agg(F.max(identity_col).cast("string").alias("true_class"))
    return predictions.join(own, id_col)


def accuracy(judged: DataFrame) -> DataFrame:
    return judged.agg(F.avg((F.col("true_class") == F.col("predicted_class")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def top_n_accuracy(judged: DataFrame, n: int = 5) -> DataFrame:
    return judged.agg(F.avg(contains_class(F.col("top_n"), F.col("true_class"), n).cast("double")).alias("top_n_accuracy"), F.count("*").alias("n"))


def confusion_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("true_class", "predicted_class").agg(F.count("*").alias("count"))


def class_names(judged: DataFrame) -> DataFrame:
    """Distinct true classes, in order."""
    return judged.select(F.col("true_class").alias("class")).distinct().orderBy("class")


def per_class_report(judged: DataFrame) -> DataFrame:
    """``class, precision, recall, f1, support`` over all true or predicted classes; 0/0 is 0."""
    hit = (F.col("true_class") == F.col("predicted_class")).cast("long")
    pairs = judged.select("true_class", "predicted_class", hit.alias("hit"))
    seen = pairs.select(F.inline(F.array(
        F.struct(F.col("true_class").alias("class"), F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("p"), F.col("hit").alias("tp")),
        F.struct(F.col("predicted_class").alias("class"), F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("tp")),
    )))
    sums = seen.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("pred"), F.sum("tp").alias("tp"))
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    tp, t, p = F.col("tp"), F.col("support"), F.col("pred")
    return sums.select("class", share(tp, p).alias("precision"), share(tp, t).alias("recall"), share(2 * tp, t + p).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Rows ``macro avg`` and ``weighted avg`` of a per-class report."""
    names = ("precision", "recall", "f1")
    n = F.sum("support")
    macro = report.agg(*(F.avg(c).alias(c) for c in names), n.alias("support")).select(F.lit("macro avg").alias("average"), *names, "support")
    weighted = report.agg(*((F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in names), n.alias("support"))
    return macro.unionByName(weighted.select(F.lit("weighted avg").alias("average"), *names, "support"))


def _grid(names: DataFrame) -> DataFrame:
    """All ordered pairs of the classes of ``names``, from one array of them: no join is needed."""
    both = names.agg(F.array_sort(F.collect_set("class")).alias("all"))
    return both.select(F.explode("all").alias("true_class"), "all").select("true_class", F.explode("all").alias("predicted_class"))


def confusion_matrix(judged: DataFrame) -> DataFrame:
    """Every pair of true classes with its count, zeros too; predictions outside them drop out.

    The number of rows is the square of the number of classes, not of the items.
    """
    grid = _grid(judged.select(F.col("true_class").alias("class")).distinct())
    counts = confusion_counts(judged)
    return grid.join(counts, ["true_class", "predicted_class"], "left").select("true_class", "predicted_class", F.coalesce("count", F.lit(0)).alias("count"))


def most_confused(judged: DataFrame, top_n: int = 5) -> DataFrame:
    """The ``top_n`` pairs of different classes confused most often; ties in class order.

    Pairs never confused count too. Only the first of them in class order can be among the best,
    and these lie between the first ``2 * top_n + 1`` classes, so the full matrix is never made.
    """
    names = judged.select(F.col("true_class").alias("class")).distinct()
    counts = confusion_counts(judged).where("true_class <> predicted_class")
    seen = counts.join(names.withColumnRenamed("class", "predicted_class"), "predicted_class", "left_semi")
    first = _grid(names.orderBy("class").limit(2 * top_n + 1)).where("true_class <> predicted_class")
    none = first.join(counts, ["true_class", "predicted_class"], "left_anti").withColumn("count", F.lit(0).cast("long"))
    return seen.unionByName(none).orderBy(F.desc("count"), "true_class", "predicted_class").limit(top_n)


def summary(judged: DataFrame, n: int = 5) -> DataFrame:
    """One row: accuracy, top-n accuracy, and the number of judged items."""
    hit = (F.col("true_class") == F.col("predicted_class")).cast("double")
    return judged.agg(F.avg(hit).alias("accuracy"), F.avg(contains_class(F.col("top_n"), F.col("true_class"), n).cast("double")).alias("top_n_accuracy"), F.count("*").alias("n"))


def cumulative(ratios: DataFrame, by: str = "pc", value: str = "ratio") -> DataFrame:
    """Running total in the order of ``by`` (one row per component, a bounded table)."""
    return ratios.withColumn("cumulative", F.sum(value).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
