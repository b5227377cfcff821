"""Training, index building and prediction over descriptor tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import evaluate, fisher, gmm, pca, retrieve, splits
from kinfold.shared import staged
from kinfold.sources import tables


@dataclass
class Settings:
    """What a run is made with. 123 components and 2 mixtures suit 128-wide descriptors."""

    n_components: int = 123
    n_mixtures: int = 2
    train_share: float = 0.8
    top_n: int = 5
    threshold: float = 0.4
    seed: int = 42
    gmm_iterations: int = gmm.MAX_ITER


@dataclass
class Trained:
    pca: pca.PCAModel
    gmm: gmm.GMMModel
    gallery: DataFrame
    predictions: DataFrame
    report: DataFrame
    averages: DataFrame
    summary: DataFrame
    skipped: DataFrame


def fit_models(descriptors: DataFrame, settings: Settings) -> tuple[pca.PCAModel, gmm.GMMModel, DataFrame]:
    """The projection, the mixture fitted on the projected descriptors, and these, written once.

    Rows whose ``split`` is not ``test`` are fitted on; all are projected.
    """
    fitted = descriptors.where("split <> 'test'") if "split" in descriptors.columns else descriptors
    projection = pca.fit(fitted, settings.n_components)
    reduced = staged(pca.transform(descriptors, projection), "reduced")
    own = reduced.where("split <> 'test'") if "split" in reduced.columns else reduced
    return projection, gmm.fit(own, settings.n_mixtures, settings.seed, max_iter=settings.gmm_iterations), reduced


def encode(descriptors: DataFrame, projection: pca.PCAModel, mixture: gmm.GMMModel) -> DataFrame:
    return fisher.fisher_vectors(pca.transform(descriptors, projection), mixture)


def train(catalog: DataFrame, descriptors: DataFrame, settings: Settings | None = None) -> Trained:
    """Split, fit on the training part, classify the test part, and evaluate.

    A catalog that has a column ``split`` (``train`` or ``test``) is taken as it is split. Projected
    descriptors and Fisher vectors are made once, for both parts, and written to the shared folder.
    """
    settings = settings or Settings()
    split = catalog if "split" in catalog.columns else splits.closed_set_split(catalog, settings.train_share, settings.seed)
    split = staged(split.select("image_id", "identity", "split"), "split")
    part = split.groupBy("image_id").agg(F.max("split").alias("split"))
    projection, mixture, reduced = fit_models(descriptors.drop("split").join(part, "image_id"), settings)
    encoded = staged(fisher.fisher_vectors(reduced, mixture), "encoded").join(part, "image_id")
    train_items, test_items = split.where("split = 'train'"), split.where("split = 'test'")
    gallery = retrieve.with_labels(encoded.where("split = 'train'").drop("split"), train_items.select("image_id", "identity"))
    predictions = staged(retrieve.classify(encoded.where("split = 'test'").drop("split"), gallery, gallery, settings.top_n), "predictions")
    judged = evaluate.with_truth(predictions, test_items)
    report = evaluate.per_class_report(judged)
    return Trained(
        projection, mixture, gallery, predictions, report, evaluate.report_averages(report), evaluate.summary(judged, settings.top_n), fisher.skipped(catalog, encoded)
    )


def build_index(spark: SparkSession, catalog: DataFrame, descriptors: DataFrame, root: str, settings: Settings | None = None) -> None:
    """Fit on the full catalog's descriptors and store models and gallery under ``root``."""
    settings = settings or Settings()
    own = descriptors.drop("split").join(catalog.select("image_id"), "image_id", "left_semi")
    projection, mixture, reduced = fit_models(own, settings)
    encoded = staged(fisher.fisher_vectors(reduced, mixture), "encoded")
    tables.save_models(spark, root, projection, mixture, retrieve.with_labels(encoded, catalog.select("image_id", "identity")))


def predict(spark: SparkSession, root: str, descriptors: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``image_id, similarity, decision`` of new items against a stored index."""
    projection, mixture, gallery = tables.load_models(spark, root)
    queries = staged(encode(descriptors, projection, mixture), "queries")
    return retrieve.open_set(retrieve.classify(queries, gallery, gallery, 1), threshold)
