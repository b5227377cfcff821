"""Catalogs, descriptor tables, images and models: how they are read, written and kept."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import schema
from kinfold.operators.gmm import GMMModel
from kinfold.operators.pca import PCAModel

_datasets: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Register a dataset's catalog loader under a name (case does not matter)."""

    def keep(loader):
        _datasets[name.lower()] = loader
        return loader

    return keep


def load_dataset(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The catalog of a registered dataset; ids are strings."""
    if name.lower() not in _datasets:
        raise KeyError(f"unknown dataset {name}; known: {', '.join(sorted(_datasets)) or 'none'}")
    return with_string_ids(_datasets[name.lower()](spark, root))


@register("csv")
def _csv(spark: SparkSession, root: str) -> DataFrame:
    return read_metadata(spark, f"{root}/metadata.csv")


@register("parquet")
def _parquet(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/catalog.parquet")


@register("images")
def _images(spark: SparkSession, root: str) -> DataFrame:
    """A folder of images in a folder per identity."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select(name.alias("image_id"), F.element_at(F.split("path", "/"), -2).alias("identity"), "path")


def with_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two ready-made parts as one catalog with a column ``split``."""
    mark = lambda df, name: with_string_ids(df).withColumn("split", F.lit(name))
    return mark(train, "train").unionByName(mark(test, "test"), allowMissingColumns=True)


def with_string_ids(catalog: DataFrame, id_col: str = "image_id") -> DataFrame:
    return catalog.withColumn(id_col, F.col(id_col).cast("string"))


def read_metadata(spark: SparkSession, path: str, columns: str = schema.CATALOG) -> DataFrame:
    """A metadata CSV with a header, under a fixed schema: ids are never read as numbers."""
    return spark.read.csv(path, header=True, schema=columns, enforceSchema=False)


def write_metadata(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").option("header", True).csv(path)


def preview(table: DataFrame, n: int = 5) -> DataFrame:
    return table.limit(n)


def read_images(spark: SparkSession, location: str, pattern: str = "*", id_from_name: bool = True) -> DataFrame:
    """``image_id, path, content`` of the files below a folder; the id is the name without suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(location)
    name = F.substring_index("path", "/", -1)
    key = F.regexp_replace(name, r"\.[^.]*$", "") if id_from_name else F.col("path")
    return files.select(key.alias("image_id"), "path", "content")


def write_images(images: DataFrame, root: str, suffix: str = ".pnm", id_col: str = "image_id", identity_col: str | None = "identity", content: str = "content") -> DataFrame:
    """Each image as a file ``<root>/<identity>/<image_id><suffix>``; ``image_id, processed_path`` (the folder).

    ``root`` is a URI or path all executors can write to. A file is replaced as a whole, so a task
    run again does no harm. Rows without content write nothing.
    """
    import pyarrow as pa

    folder = F.col(identity_col).cast("string") if identity_col else F.lit("")
    rows = images.where(F.col(content).isNotNull()).select(F.col(id_col).cast("string").alias("image_id"), F.coalesce(folder, F.lit("")).alias("folder"), F.col(content).alias("content"))

    def run(batches):
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        made = set()
        for batch in batches:
            folders = []
            for key, own, raw in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{base.rstrip('/')}/{own}".rstrip("/")
                if path not in made:
                    place.create_dir(path, recursive=True)
                    made.add(path)
                with place.open_output_stream(f"{path}/{key}{suffix}") as out:
                    out.write(raw)
                folders.append(f"{root.rstrip('/')}/{own}".rstrip("/"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folders, pa.string())], names=["image_id", "processed_path"])

    return rows.mapInArrow(run, "image_id string, processed_path string")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file of raw bytes, replaced if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """A descriptor table written by :func:`write_table`."""
    return spark.read.schema(schema.DESCRIPTORS).parquet(path)


def descriptors_from_hdf5(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Descriptors from HDF5 files with one n x d dataset per image; needs h5py on the executors."""
    import pyarrow as pa

    def run(batches):
        import h5py
        import numpy as np

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with h5py.File(path, "r") as f:
                    for key in f:
                        m = np.asarray(f[key], np.float32)
                        if len(m):
                            yield pa.RecordBatch.from_arrays([pa.array([key] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float32()))], names=["image_id", "desc_idx", "desc"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, schema.DESCRIPTORS)


def write_table(table: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    table.write.mode("overwrite").parquet(path, partitionBy=partition_by or [])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(spark: SparkSession, make: Callable[[], DataFrame], root: str, name: str, params: dict, overwrite: bool = False) -> DataFrame:
    """The table ``make`` gives, kept under a key of its parameters: other parameters, other table.

    A table counts as kept only once its writer has committed it, so a run cut short is redone.
    """
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{key}"
    if overwrite or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_models(spark: SparkSession, root: str, pca: PCAModel, gmm: GMMModel, gallery: DataFrame) -> None:
    """The index trio: PCA, mixture, and labelled Fisher vectors (stored as float)."""
    pca.to_rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/pca")
    gmm.to_rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/gmm")
    gallery.withColumn("fv", F.col("fv").cast("array<float>")).write.mode("overwrite").parquet(f"{root}/gallery")


def load_models(spark: SparkSession, root: str) -> tuple[PCAModel, GMMModel, DataFrame]:
    return PCAModel.from_rows(spark.read.parquet(f"{root}/pca")), GMMModel.from_rows(spark.read.parquet(f"{root}/gmm")), spark.read.parquet(f"{root}/gallery")
