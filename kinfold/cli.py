"""Command line: ``python -m kinfold.cli train|index|predict``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import images, splits
from kinfold.plans import pipeline
from kinfold.shared import new_path, staged, temporary
from kinfold.sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinfold", description="Identity matching over images or descriptor tables.")
    sub = top.add_subparsers(dest="command", required=True)
    for name, about in (("train", "split, fit, evaluate"), ("index", "fit on everything and store the index")):
        p = sub.add_parser(name, help=about)
        p.add_argument("--dataset", default="parquet", help="registered dataset loader")
        p.add_argument("--root", help="folder of the dataset's catalog")
        p.add_argument("--prefix", action="append", default=[], help="keep only paths that start so; may be given again")
        p.add_argument("--descriptors", help="descriptor table; without it, descriptors are made of the catalog's images")
        p.add_argument("--images", help="folder that the catalog's paths are below")
        p.add_argument("--work", help="folder where descriptors are kept and found again by their settings")
        p.add_argument("--overwrite", action="store_true", help="make kept descriptors anew")
        p.add_argument("--keep-background", action="store_true", help="do not remove backgrounds")
        p.add_argument("--no-tone-mapping", action="store_true")
        p.add_argument("--components", type=int, default=123)
        p.add_argument("--mixtures", type=int, default=2)
        if name == "index":
            p.add_argument("--out", required=True, help="folder of the index")
        else:
            p.add_argument("--train-csv", help="metadata of a ready-made training part, with --test-csv")
            p.add_argument("--test-csv")
    p = sub.add_parser("predict", help="match the images of a folder against an index")
    p.add_argument("--index", required=True)
    p.add_argument("--images", required=True, help="folder of images")
    p.add_argument("--threshold", type=float, default=0.4)
    p.add_argument("--keep-background", action="store_true")
    p.add_argument("--no-tone-mapping", action="store_true")
    return top


def _described(found: DataFrame, args) -> DataFrame:
    """Descriptors of images, after the stages asked for."""
    return images.extract(images.preprocess(found, not args.no_tone_mapping, None if args.keep_background else images.segmenter))


def _descriptors(spark: SparkSession, catalog: DataFrame, args) -> DataFrame:
    """The table given, or one made of the catalog's images: kept below ``--work`` by what made it."""
    if args.descriptors:
        return tables.read_descriptors(spark, args.descriptors)

    def make() -> DataFrame:
        found = tables.read_images(spark, args.images)
        name = lambda c: F.substring_index(c, "/", -1)
        own = catalog.select("image_id", name("path").alias("name"), "path").withColumnRenamed("path", "below")
        named = found.drop("image_id").withColumn("name", name("path")).join(own, "name").where(F.col("path").endswith(F.col("below")))
        return _described(named.select("image_id", "content"), args)

    params = {k: getattr(args, k) for k in ("dataset", "root", "images", "prefix", "keep_background", "no_tone_mapping")} | {"train": getattr(args, "train_csv", None), "test": getattr(args, "test_csv", None)}
    return tables.materialise(spark, make, args.work or new_path(spark, "work"), "descriptors", params, args.overwrite)


def _catalog(spark: SparkSession, args) -> DataFrame:
    if getattr(args, "train_csv", None):
        return tables.with_split(tables.read_metadata(spark, args.train_csv), tables.read_metadata(spark, args.test_csv))
    found = tables.load_dataset(spark, args.dataset, args.root)
    return splits.prefix_filter(found, args.prefix) if args.prefix else found


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command != "predict":
        if bool(getattr(args, "train_csv", None)) != bool(getattr(args, "test_csv", None)):
            top.error("--train-csv and --test-csv go together")
        if not args.root and not getattr(args, "train_csv", None):
            top.error("--root or two metadata files are needed")
        if not args.descriptors and not args.images:
            top.error("--descriptors or --images is needed")
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    with temporary(spark):
        return _run(spark, args)


def _run(spark: SparkSession, args) -> int:
    if args.command == "predict":
        descriptors = staged(_described(tables.read_images(spark, args.images), args), "descriptors")
        for row in pipeline.predict(spark, args.index, descriptors, args.threshold).toLocalIterator():
            print(f"{row['image_id']}: {row['decision']} ({row['similarity']:.4f})")
        return 0
    settings = pipeline.Settings(n_components=args.components, n_mixtures=args.mixtures)
    catalog = _catalog(spark, args)
    descriptors = _descriptors(spark, catalog, args)
    if args.command == "index":
        pipeline.build_index(spark, catalog, descriptors, args.out, settings)
        return 0
    done = pipeline.train(catalog, descriptors, settings)
    row = done.summary.first()
    print(f"Accuracy: {row['accuracy']:.4f}")
    print(f"Top-{settings.top_n} accuracy: {row['top_n_accuracy']:.4f}")
    for table, name in ((done.report.orderBy("class"), "class"), (done.averages, "average")):
        print(f"{name:>24} precision    recall        f1   support")
        for r in table.toLocalIterator():
            print(f"{r[name]:>24} {r['precision']:9.4f} {r['recall']:9.4f} {r['f1']:9.4f} {r['support']:9d}")
    print(f"Without a descriptor: {done.skipped.count()}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
