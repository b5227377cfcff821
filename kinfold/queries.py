"""The registered queries: every operator over the driver's tables.

``documents`` stands in for a catalog (identity = lang, path = source/doc_id.jpg), ``embeddings``
for descriptors and vectors (identity = label). Searches take the rows whose id is divisible by 20
as queries against all rows; evaluations split all vectors per label, test against training part.
Bags are groups of four vectors of a label in id order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold import shared
from kinfold.functions import paths, vectors
from kinfold.operators import evaluate, fisher, gmm, images, pca, retrieve, splits
from kinfold.plans import pipeline
from kinfold.sources import tables

K, VAR = 2, 0.02


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _r(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n) for n in names})


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("image_id"), F.col("lang").alias("identity"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "embeddings")


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, identity, desc_idx, desc``: label windows of the fixture (10 labels)."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = embeddings(spark, sf_dir).withColumn("n", n)
    key = F.concat(F.col("label").cast("string"), F.lit("_"), F.floor(F.col("n") / 4).cast("string"))
    return rows.select(key.alias("image_id"), F.col("label").cast("string").alias("identity"), (F.col("n") % 4).alias("desc_idx"), F.col("embedding").alias("desc"))


def first_model(spark: SparkSession, sf_dir: str) -> gmm.GMMModel:
    """A fixed start: the first K vectors as means."""
    rows = embeddings(spark, sf_dir).orderBy("vec_id").limit(K).collect()
    mu = np.array([r["embedding"] for r in rows], np.float64)
    return gmm.GMMModel(np.full(K, 1 / K), mu, np.full(mu.shape, VAR))


def vectors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return e.select(F.col("vec_id").alias("image_id"), F.col("label").cast("string").alias("identity"), F.col("embedding").alias("fv"))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the search set against all vectors."""
    rows = vectors_table(spark, sf_dir)
    return retrieve.classify(rows.where("image_id % 20 = 0").select("image_id", "fv"), rows, rows, 5)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the test part from the training part, beside the truth."""
    split = splits.closed_set_split(vectors_table(spark, sf_dir))
    test, train = split.where("split = 'test'"), split.where("split = 'train'")
    return evaluate.with_truth(retrieve.classify(test.select("image_id", "fv"), train, train, 5), test)


# Catalog and paths


def catalog_scan(spark, sf_dir):
    return catalog(spark, sf_dir)


def catalog_prefix_filter(spark, sf_dir):
    return splits.prefix_filter(catalog(spark, sf_dir), ["src1", "src2"])


def catalog_preview(spark, sf_dir):
    return tables.preview(catalog(spark, sf_dir).orderBy(F.col("image_id").cast("long")))


def catalog_paths(spark, sf_dir):
    c = catalog(spark, sf_dir)
    directory = paths.join_path(F.lit("data/"), F.lower("identity"), F.lit("out"))
    return c.select("image_id", directory.alias("processed_path"), paths.image_path(directory, F.col("image_id")).alias("file"), paths.from_template("data/{}/db/{}.fv", F.col("identity"), F.col("image_id")).alias("fv_path"))


def path_basename(spark, sf_dir):
    return _load(spark, sf_dir, "pages").select("page_id", paths.basename(F.col("url")).alias("name"))


def label_map(spark, sf_dir):
    """Two columns as a lookup; of several rows of a key the greatest value counts."""
    c = catalog(spark, sf_dir).groupBy("image_id").agg(F.max("identity").alias("identity"))
    return c.select("image_id", F.element_at(F.create_map("image_id", "identity"), F.col("image_id")).alias("identity"))


def dataset_settings(spark, sf_dir):
    """Per dataset (source): whether images lose their background there."""
    keep = ["src3", "src7"]
    return _load(spark, sf_dir, "documents").select("source").distinct().select("source", (~F.col("source").isin(keep)).alias("remove_background"))


def file_listing(spark, sf_dir):
    """Files of a folder, with their sizes, after a table of three files was written there."""
    root = _shared(spark, "listing")
    catalog(spark, sf_dir).repartition(3).write.parquet(root)
    found = tables.read_images(spark, root, "*.parquet", id_from_name=False)
    return found.agg(F.count("*").alias("n_files"), F.min((F.length("content") > 0).cast("int")).alias("all_full"))


def metadata_csv(spark, sf_dir):
    """A catalog through the CSV writer and reader; ids come back as strings."""
    root = _shared(spark, "metadata")
    tables.write_metadata(catalog(spark, sf_dir), root)
    return tables.read_metadata(spark, root)


def _shared(spark: SparkSession, tag: str) -> str:
    return shared.new_path(spark, tag)


# Splits and labels


def closed_set_split(spark, sf_dir):
    return splits.closed_set_split(catalog(spark, sf_dir)).select("image_id", "identity", "split")


def split_rows(spark, sf_dir):
    """The catalog rows of the test part, found by their ids."""
    c = catalog(spark, sf_dir)
    return c.join(splits.closed_set_split(c).where("split = 'test'").select("image_id"), "image_id", "left_semi")


def split_analysis(spark, sf_dir):
    return splits.analyze_split(splits.closed_set_split(catalog(spark, sf_dir)))


def split_overlap(spark, sf_dir):
    return splits.split_overlap(splits.closed_set_split(catalog(spark, sf_dir)))


def _label_tables(spark, sf_dir):
    docs = _load(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "source")
    return docs, _load(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.col("quality").alias("identity"))


def label_lookup(spark, sf_dir):
    return retrieve.with_labels(*_label_tables(spark, sf_dir), require=False)


def missing_label_check(spark, sf_dir):
    return retrieve.missing_labels(*_label_tables(spark, sf_dir))


# Vector arithmetic


def _pairs(spark, sf_dir):
    """Each vector beside its successor by id."""
    e = embeddings(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.select("vec_id", "embedding").join(nxt, "vec_id")


def _elements(df: DataFrame, vec: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(vec).alias("i", "value")).select("vec_id", "i", _r("value").alias("value"))


def vector_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.size("embedding").alias("d"), _r(vectors.l2_norm(F.col("embedding"))).alias("norm"))


def power_norm(spark, sf_dir):
    return _elements(embeddings(spark, sf_dir), vectors.power_normalize(F.col("embedding")))


def l2_normalize(spark, sf_dir):
    return _elements(embeddings(spark, sf_dir), vectors.l2_normalize(F.col("embedding")))


def dot_products(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", _r(vectors.dot(F.col("embedding"), F.col("other"))).alias("dot"))


def elementwise(spark, sf_dir):
    """Differences over the square root of the other's squares plus one, raised to 1.5."""
    p = _pairs(spark, sf_dir)
    diff = vectors.subtract(F.col("embedding"), F.col("other"))
    scale = F.transform(vectors.multiply(F.col("other"), F.col("other")), lambda x: x + 1)
    return _elements(p, vectors.divide(vectors.multiply(diff, diff), vectors.raise_to(scale, 1.5)))


def flatten_blocks(spark, sf_dir):
    """Two blocks of rows, flattened one after the other."""
    p = _pairs(spark, sf_dir)
    first, second = F.array("embedding", "other"), F.array("other", "embedding")
    whole = vectors.blocks(first, second)
    return p.select("vec_id", F.posexplode(whole).alias("i", "v")).select("vec_id", "i", _r(F.col("v").cast("double")).alias("value"))


def rescale_clip(spark, sf_dir):
    """Values times 255, clipped to a byte's range, then truncated."""
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(vectors.to_bytes(F.col("embedding"))).alias("i", "value"))


def slices(spark, sf_dir):
    """Head, first and last elements, and length."""
    e = F.col("embedding").cast("array<double>")
    return embeddings(spark, sf_dir).select("vec_id", F.size(e).alias("d"), _r(vectors.total(F.slice(e, 1, 5))).alias("head"), _r(F.element_at(e, 1)).alias("first"), _r(F.element_at(e, -1)).alias("last"))


# Retrieval


def cosine_topk(spark, sf_dir):
    rows = vectors_table(spark, sf_dir)
    return _rounded(retrieve.top_k(rows.where("image_id % 20 = 0"), rows, 5), "similarity")


def top1_class(spark, sf_dir):
    return search(spark, sf_dir).select("image_id", "predicted_class")


def top_n_struct(spark, sf_dir):
    m = F.transform("top_n", lambda x: x["class"])
    return search(spark, sf_dir).select("image_id", F.array_join(m, ",").alias("classes"), _r(F.element_at("top_n", -1)["similarity"]).alias("last_similarity"))


def open_set_threshold(spark, sf_dir):
    return _rounded(retrieve.open_set(search(spark, sf_dir), 0.4), "similarity")


def stream_open_set(spark, sf_dir):
    """The search set as a stream, scored against the static gallery until the input is used up."""
    from kinfold.streaming import scoring

    gallery = vectors_table(spark, sf_dir)
    root = _shared(spark, "stream")
    gallery.where("image_id % 20 = 0").select("image_id", "fv").repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("image_id long, fv array<float>").parquet(f"{root}/in")
    run = scoring.score_stream(stream, gallery, 0.4).writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start(f"{root}/out", "parquet")
    run.awaitTermination()
    return _rounded(spark.read.parquet(f"{root}/out"), "similarity")


# Evaluation


def accuracy(spark, sf_dir):
    return _rounded(evaluate.accuracy(judged(spark, sf_dir)), "accuracy")


def top_n_accuracy(spark, sf_dir):
    return _rounded(evaluate.top_n_accuracy(judged(spark, sf_dir), 5), "top_n_accuracy")


def evaluation_summary(spark, sf_dir):
    return _rounded(evaluate.summary(judged(spark, sf_dir), 3), "accuracy", "top_n_accuracy")


def per_class_report(spark, sf_dir):
    return _rounded(evaluate.per_class_report(judged(spark, sf_dir)), "precision", "recall", "f1")


def report_averages(spark, sf_dir):
    return _rounded(evaluate.report_averages(evaluate.per_class_report(judged(spark, sf_dir))), "precision", "recall", "f1")


def formatted_summary(spark, sf_dir):
    """Accuracy figures as text of four decimals."""
    row = evaluate.summary(judged(spark, sf_dir), 5)
    return row.select(F.format_string("%.4f", "accuracy").alias("accuracy"), F.format_string("%.4f", "top_n_accuracy").alias("top_n_accuracy"))


def confusion_counts(spark, sf_dir):
    return evaluate.confusion_counts(judged(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(judged(spark, sf_dir))


def most_confused(spark, sf_dir):
    return evaluate.most_confused(judged(spark, sf_dir), 10)


def class_names(spark, sf_dir):
    return evaluate.class_names(judged(spark, sf_dir))


# PCA


def descriptor_mean(spark, sf_dir):
    return _rounded(pca.mean_vector(embeddings(spark, sf_dir), "embedding"), "mean")


def descriptor_covariance(spark, sf_dir):
    return _rounded(pca.covariance(embeddings(spark, sf_dir), "embedding"), "cov")


def stacked_descriptors(spark, sf_dir):
    """All bags as one table: rows, width, and the sum of all elements."""
    b = bags(spark, sf_dir)
    return b.agg(F.count("*").alias("n"), F.max(F.size("desc")).alias("d"), _r(F.sum(vectors.total(F.col("desc")))).alias("total"))


def _variance_shares(spark, sf_dir) -> DataFrame:
    """Elements by falling variance with their share of the total."""
    var = pca.covariance(embeddings(spark, sf_dir), "embedding").where("i = j").select("i", "cov")
    order = Window.orderBy(F.desc(F.round("cov", 12)), "i")
    whole = F.sum("cov").over(Window.partitionBy())
    return var.select(F.row_number().over(order).alias("pc"), "i", (F.col("cov") / whole).alias("ratio"))


def variance_cumsum(spark, sf_dir):
    return _rounded(evaluate.cumulative(_variance_shares(spark, sf_dir)), "ratio", "cumulative")


def variance_threshold(spark, sf_dir):
    """Fewest elements whose shares reach 0.5, 0.95 and 2 (never reached: one more than all)."""
    steps = evaluate.cumulative(_variance_shares(spark, sf_dir))
    need = lambda t: F.coalesce(F.min(F.when(F.col("cumulative") >= t, F.col("pc"))), F.count("*") + 1).cast("int")
    return steps.agg(need(0.5).alias("half"), need(0.95).alias("most"), need(2.0).alias("never"))


def _projected(spark, sf_dir, p: int = 8) -> tuple[DataFrame, pca.PCAModel]:
    e = embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("desc"))
    model = pca.fit(e, p)
    return pca.transform(e, model), model


def whitened_covariance(spark, sf_dir):
    return _rounded(pca.covariance(_projected(spark, sf_dir)[0], "reduced"), "cov")


def pca_invariants(spark, sf_dir):
    """Trace and squared Frobenius norm of the covariance, from the eigenvalues."""
    model = pca.fit(embeddings(spark, sf_dir), 64, "embedding")
    table = pa.table({"trace": [float(model.variances.sum())], "frobenius": [float((model.variances**2).sum())]})
    return _rounded(spark.createDataFrame(table), "trace", "frobenius")


def _axes(spark, sf_dir) -> DataFrame:
    """Vectors whose covariance has known eigenvalues: each id gives one of eight axes, both ways, and
    as far as its number's square; then all are mirrored, which turns the axes out of the elements'."""
    rows = embeddings(spark, sf_dir).select(F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s"), (F.col("vec_id") % 8).cast("int").alias("j"))
    far = F.col("s") * (F.col("j") + 1) * (F.col("j") + 1)
    # I - 2 w w' with w of eight equal elements: each element less a quarter of the axis's.
    return rows.select(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: far * ((i == F.col("j")).cast("double") - 0.25)).alias("desc"))


def explained_variance_cumsum(spark, sf_dir):
    model = pca.fit(_axes(spark, sf_dir), 8)
    return _rounded(evaluate.cumulative(pca.explained_variance(spark, model)), "ratio", "cumulative")


def optimal_components(spark, sf_dir):
    model = pca.fit(_axes(spark, sf_dir), 8)
    return spark.createDataFrame([(t, pca.optimal_components(model, t)) for t in (0.5, 0.95, 0.99, 1.5)], "threshold double, n_components int")


# Mixture and Fisher vectors


def _model_rows(spark, model: gmm.GMMModel) -> DataFrame:
    rows = model.to_rows(spark).select("k", "weight", F.posexplode(F.arrays_zip("mu", "var")).alias("i", "p"))
    return rows.select("k", "i", _r("weight").alias("weight"), _r("p.mu").alias("mu"), _r("p.var").alias("var"))


def gmm_responsibilities(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    rows = gmm.responsibilities(e, first_model(spark, sf_dir), "embedding")
    return rows.select("vec_id", F.posexplode("gamma").alias("k", "g")).select("vec_id", "k", _r("g").alias("gamma"))


def gmm_em_step(spark, sf_dir):
    return _model_rows(spark, gmm.em_step(embeddings(spark, sf_dir), first_model(spark, sf_dir), "embedding")[0])


def gmm_em_3(spark, sf_dir):
    return _model_rows(spark, gmm.fit(embeddings(spark, sf_dir), K, vec="embedding", start=first_model(spark, sf_dir), max_iter=3, tol=-1.0))


def gmm_fit(spark, sf_dir):
    """From start to end on two groups far apart: even ids, and odd ids moved by 100 in every element."""
    rows = embeddings(spark, sf_dir).select(F.transform("embedding", lambda x: x.cast("double") + F.col("vec_id") % 2 * 100).alias("reduced"))
    made = gmm.fit(rows, K)
    order = np.argsort(made.means[:, 0])
    return _model_rows(spark, gmm.GMMModel(made.weights[order], made.means[order], made.variances[order]))


def _grad_rows(df: DataFrame, vec: str) -> DataFrame:
    return df.select("image_id", F.posexplode(vec).alias("pos", "value")).select("image_id", "pos", _r("value").alias("value"))


def fisher_gradients(spark, sf_dir):
    return _grad_rows(fisher.gradients(bags(spark, sf_dir), first_model(spark, sf_dir), vec="desc"), "grad")


def fisher_vectors(spark, sf_dir):
    return _grad_rows(fisher.fisher_vectors(bags(spark, sf_dir), first_model(spark, sf_dir), vec="desc"), "fv")


def bag_sizes(spark, sf_dir):
    return fisher.bag_sizes(bags(spark, sf_dir))


def skipped_bags(spark, sf_dir):
    """Catalog items that have no descriptor: the catalog has all bags of each label and five more."""
    sizes = embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 3) / 4) + 4)
    items = sizes.select(F.explode(F.transform(numbers, lambda n: F.concat(F.col("label").cast("string"), F.lit("_"), n.cast("string")))).alias("image_id"))
    return fisher.skipped(items, fisher.fisher_vectors(bags(spark, sf_dir), first_model(spark, sf_dir), vec="desc"))


# Images, plans, streams


def _images(spark, sf_dir):
    """Vectors drawn as 64 x 64 gray images, so that every stage has something to read."""

    def run(batches):
        for batch in batches:
            content = []
            for v in batch.column(1).to_pylist():
                m = np.array(v).reshape(8, 8)
                m = ((m - m.min()) / max(1e-9, m.max() - m.min()) * 255).astype(np.uint8).repeat(8, axis=0).repeat(8, axis=1)
                content.append(images.encode(m[..., None].repeat(3, axis=2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["image_id", "content"])

    rows = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_id"), "embedding")
    return rows.mapInArrow(run, "image_id string, content binary")


def image_preprocess(spark, sf_dir):
    """Backgrounds cut by the border's colour: pixels left, and the sum of all pixels' values."""
    done = images.preprocess(_images(spark, sf_dir), use_tone_mapping=False, background=lambda: images.remove_background)

    def look(batches):
        for batch in batches:
            m = [images.decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int((x[..., 3] > 0).sum()) for x in m]), pa.array([int(x[..., 0].sum()) for x in m])], names=["image_id", "n_left", "total"])

    return done.where("error is null").select("image_id", "content").mapInArrow(look, "image_id string, n_left long, total long")


def image_descriptors(spark, sf_dir):
    """All 16 x 16 patches, eight pixels apart, of tone-mapped images that keep their background."""
    found = images.extract(images.preprocess(_images(spark, sf_dir), background=None, tone=lambda: images.tone_map))
    return found.select("image_id", "desc_idx", F.size("desc").alias("d"))


SETTINGS = pipeline.Settings(n_components=9)


def _separable(spark, sf_dir) -> DataFrame:
    """The bags with each label's vectors moved its own way, so that only one class is near."""
    moved = F.transform("desc", lambda x, i: x.cast("double") * 0.1 + F.when(i % 10 == F.col("identity").cast("int"), 1.0).otherwise(0.0))
    return bags(spark, sf_dir).withColumn("desc", moved)


def train_eval_pipeline(spark, sf_dir):
    b = shared.staged(_separable(spark, sf_dir), "bags")
    items = b.select("image_id", "identity").distinct()
    return _rounded(pipeline.train(items, b.select("image_id", "desc_idx", "desc"), SETTINGS).summary, "accuracy", "top_n_accuracy")


def predict_pipeline(spark, sf_dir):
    """An index of the bags, stored and loaded again, and the same bags matched against it."""
    b = shared.staged(_separable(spark, sf_dir), "bags")
    root = _shared(spark, "index")
    pipeline.build_index(spark, b.select("image_id", "identity").distinct(), b.select("image_id", "desc_idx", "desc"), root, SETTINGS)
    return _rounded(pipeline.predict(spark, root, b.select("image_id", "desc_idx", "desc")), "similarity")


_HELPERS = {"catalog", "embeddings", "bags", "first_model", "vectors_table", "search", "judged", "queries"}


def queries() -> dict:
    return {
        name: f
        for name, f in globals().items()
        if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name not in _HELPERS and not isinstance(f, type)
    }
