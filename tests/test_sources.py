import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import cli
from kinfold.functions import paths
from kinfold.operators import images
from kinfold.sources import tables
from kinfold.streaming import scoring


def test_paths(spark):
    row = spark.range(1).select(
        paths.join_path(F.lit("a/"), F.lit("b")).alias("a"), paths.join_path(F.lit("a"), F.lit("/b")).alias("b"),
        paths.basename(F.lit("x/y/z.jpg")).alias("c"), paths.from_template("./{}/100%/{}", F.lit("p"), F.lit("q")).alias("d"),
    ).first()
    assert tuple(row) == ("a/b", "/b", "z.jpg", "./p/100%/q")


def test_images_read_processed_and_described(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = np.full((48, 48, 3), 30, np.uint8)
    image[8:40, 8:40] = rng.integers(100, 255, (32, 32, 3))
    (tmp_path / "one.ppm").write_bytes(images.encode(image))
    (tmp_path / "flat.ppm").write_bytes(images.encode(np.full((32, 32, 3), 9, np.uint8)))
    (tmp_path / "bad.ppm").write_bytes(b"P6 junk")
    found = tables.read_images(spark, f"file://{tmp_path}")
    done = images.preprocess(found).cache()
    errors = {r["image_id"]: r["error"] for r in done.collect()}
    assert errors["one"] is None and errors["bad"] is not None
    got = images.extract(done).groupBy("image_id").count().collect()
    assert [r["image_id"] for r in got] == ["one"]
    assert images.extract(done).select(F.size("desc")).distinct().collect()[0][0] == 128


def test_tone_map_and_alpha():
    image = np.zeros((16, 16, 3), np.uint8)
    image[4:12, 4:12] = 200
    assert images.tone_map(image).dtype == np.uint8
    cut = images.remove_background(image)
    assert cut.shape == (16, 16, 4) and cut[0, 0, 3] == 0 and cut[8, 8, 3] == 255
    assert (images.decode(images.encode(cut)) == cut).all()


def test_materialise_is_keyed_by_parameters(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    root = f"file://{tmp_path}"
    for share in (0.8, 0.8, 0.7):
        assert tables.materialise(spark, make, root, "t", {"share": share}).count() == 3
    assert len(calls) == 2
    tables.remove(spark, f"{root}/x")


def test_registered_datasets_and_string_ids(spark, tmp_path):
    spark.createDataFrame([(7, "a", "p")], "image_id long, identity string, path string").write.parquet(f"{tmp_path}/catalog.parquet")
    assert tables.load_dataset(spark, "Parquet", f"file://{tmp_path}").first()["image_id"] == "7"
    with pytest.raises(KeyError):
        tables.load_dataset(spark, "nothing", "")


def test_stream_scoring_matches_batch(spark, tmp_path):
    gallery = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "image_id string, identity string, fv array<double>")
    rows = [("p", [5.0, 0.1]), ("q", [-1.0, -1.0]), ("r", None)]
    spark.createDataFrame(rows, "image_id string, fv array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("image_id string, fv array<double>").parquet(f"{tmp_path}/in")
    q = scoring.score_stream(stream, gallery).writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r["image_id"]: r["decision"] for r in spark.table("scored").collect()}
    assert got == {"p": "x", "q": "Unknown class.", "r": "Unknown class."}


def test_image_and_byte_sinks(spark, tmp_path):
    content = images.encode(np.full((4, 4, 3), 7, np.uint8))
    rows = spark.createDataFrame([("a", "x", bytearray(content)), ("b", "y", bytearray(content)), ("c", "y", None)], "image_id string, identity string, content binary")
    made = {r["image_id"]: r["processed_path"] for r in tables.write_images(rows, f"file://{tmp_path}/out").collect()}
    assert made == {"a": f"file://{tmp_path}/out/x", "b": f"file://{tmp_path}/out/y"}
    assert (tmp_path / "out/x/a.pnm").read_bytes() == content and not (tmp_path / "out/y/c.pnm").exists()
    catalog = tables.load_dataset(spark, "images", f"file://{tmp_path}/out")
    assert sorted((r["image_id"], r["identity"]) for r in catalog.collect()) == [("a", "x"), ("b", "y")]
    for data in (b"\x00\xffabc", b"other"):
        tables.write_bytes(spark, f"file://{tmp_path}/raw.bin", data)
        assert tables.read_bytes(spark, f"file://{tmp_path}/raw.bin") == data


def test_backgrounds_stay_where_a_dataset_keeps_them(spark):
    image = np.zeros((16, 16, 3), np.uint8)
    image[4:12, 4:12] = 200
    rows = spark.createDataFrame([("a", "one", bytearray(images.encode(image))), ("b", "two", bytearray(images.encode(image)))], "image_id string, dataset string, content binary")
    done = images.preprocess(rows, dataset_col="dataset", keep_background=("two",), background=lambda: images.remove_background)
    assert {r["image_id"]: images.decode(r["content"]).shape[2] for r in done.collect()} == {"a": 4, "b": 3}


def test_descriptors_match_a_loop_over_patches():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (50, 70, 4)).astype(np.uint8)
    image[:20, :30, 3] = 0
    gray = image[..., :3].astype(np.float32).mean(axis=2)
    dy, dx = np.gradient(gray)
    size, turn = np.hypot(dx, dy), ((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    want = []
    for y in range(0, 35, 6):
        for x in range(0, 55, 6):
            if (image[y : y + 16, x : x + 16, 3] > 0).mean() > 0.5:
                hist = np.zeros((4, 4, 8))
                for a in range(16):
                    for b in range(16):
                        hist[a // 4, b // 4, turn[y + a, x + b]] += size[y + a, x + b]
                want.append(np.minimum(hist.ravel() / np.linalg.norm(hist), 0.2))
    assert np.allclose(images.local_descriptors(image, stride=6), want, atol=1e-4)


def test_cli_from_images_to_predictions(spark, tmp_path, capsys, monkeypatch):
    rng = np.random.default_rng(4)
    for k, kind in enumerate(("fine", "coarse")):
        (tmp_path / "photos" / kind).mkdir(parents=True)
        for n in range(5):
            m = rng.integers(0, 255, (64 // (1 + 7 * k), 64 // (1 + 7 * k), 3)).astype(np.uint8).repeat(1 + 7 * k, 0).repeat(1 + 7 * k, 1)
            (tmp_path / "photos" / kind / f"{kind}{n}.ppm").write_bytes(images.encode(m))
    common = ["--dataset", "images", "--root", f"file://{tmp_path}/photos", "--images", f"file://{tmp_path}/photos", "--work", f"file://{tmp_path}/work", "--components", "8", "--keep-background"]
    monkeypatch.setattr(spark, "stop", lambda: None)
    calls = []
    extract = images.extract
    monkeypatch.setattr(images, "extract", lambda *a, **k: calls.append(1) or extract(*a, **k))
    assert cli.main(["train", *common]) == 0 and cli.main(["train", *common]) == 0
    assert len(calls) == 1 and "Accuracy: 1.0000" in capsys.readouterr().out
    assert cli.main(["index", *common, "--out", f"file://{tmp_path}/index"]) == 0
    assert cli.main(["predict", "--index", f"file://{tmp_path}/index", "--images", f"file://{tmp_path}/photos", "--keep-background"]) == 0
    lines = capsys.readouterr().out.split("\n")
    assert sum(line.split(":")[0].rstrip("0123456789") in line.split(":")[1] for line in lines if ":" in line) == 10


def test_descriptors_from_hdf5(spark, tmp_path):
    """By way of a stand-in for h5py that the workers import: the same calls over numpy's own files."""
    (tmp_path / "h5py.py").write_text(
        "import numpy as np\n"
        "class File:\n"
        "    def __init__(self, path, mode): self.data = np.load(path)\n"
        "    def __enter__(self): return self\n"
        "    def __exit__(self, *e): pass\n"
        "    def __iter__(self): return iter(self.data.files)\n"
        "    def __getitem__(self, key): return self.data[key]\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    own = {"a": np.arange(8.0).reshape(2, 4), "none": np.empty((0, 4)), "b": np.ones((1, 4))}
    with open(tmp_path / "d.h5", "wb") as f:
        np.savez(f, **own)
    rows = tables.descriptors_from_hdf5(spark, [str(tmp_path / "d.h5")]).orderBy("image_id", "desc_idx").collect()
    assert [(r["image_id"], r["desc_idx"], r["desc"]) for r in rows] == [("a", 0, [0, 1, 2, 3]), ("a", 1, [4, 5, 6, 7]), ("b", 0, [1, 1, 1, 1])]


def test_ready_made_parts(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(str(i), f"c{i % 2}", "p") for i in ids], "image_id string, identity string, path string")
    for name, ids in (("a", range(6)), ("b", range(6, 10))):
        tables.write_metadata(rows(ids), f"file://{tmp_path}/{name}")
    both = tables.with_split(tables.read_metadata(spark, f"file://{tmp_path}/a"), tables.read_metadata(spark, f"file://{tmp_path}/b"))
    assert {r["split"]: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 6, "test": 4}


def test_cli_needs_its_arguments():
    with pytest.raises(SystemExit) as e:
        cli.main(["predict"])
    assert e.value.code == 2
    for missing in (["train", "--root", "x"], ["train", "--descriptors", "d"], ["train", "--train-csv", "a", "--descriptors", "d"]):
        with pytest.raises(SystemExit) as e:
            cli.main(missing)
        assert e.value.code == 2
