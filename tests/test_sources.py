"""Files, headers, rules, sinks and the stream."""

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import ingest as I
from plumbline.operators import splits as P
from plumbline.plans import views as V
from plumbline.sources import files, metadata, rules, sinks
from plumbline.sources.headers import image_header
from plumbline.streaming import ingest as stream


def png(w, h, colour=2):
    body = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def jpeg(w, h, parts=3):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + bytes(10)
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, parts) + bytes(12)


def test_headers():
    assert image_header(png(640, 480)) == (640, 480, "PNG", "RGB")
    assert image_header(png(3, 4, 0)) == (3, 4, "PNG", "L")
    assert image_header(jpeg(100, 50, 1)) == (100, 50, "JPEG", "L")
    assert image_header(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9, "GIF", "P")
    assert image_header(b"BM" + bytes(16) + struct.pack("<iiHH", 5, -6, 1, 24)) == (5, 6, "BMP", "RGB")
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert image_header(webp) == (100, 50, "WEBP", "RGB")
    for bad in (b"", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"plain text"):
        assert image_header(bad)[:2] == (0, 0)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("cache") / "datasets"
    for d in ("alpha", "weekly/2025W40", "weekly/2025W41", "noinfo"):
        (root / d / "samples").mkdir(parents=True)
        if d != "noinfo":
            (root / d / "dataset_info.json").write_text("{}")
    (root / "alpha/samples/img_000001.png").write_bytes(png(10, 20))
    (root / "alpha/samples/img_000002.png").write_bytes(b"broken")
    (root / "alpha/sample_metadata.json").write_text(json.dumps({"img_000001.png": {"source_file": "s1"}, "img_000002.png": {}}))
    (root / "weekly/2025W40/sample_metadata.json").write_text(json.dumps([{"filename": "a.jpg", "model_name": "m"}, {"model_name": "n"}]))
    (root / "weekly/2025W41/sample_metadata.json").write_text("{not json")
    return root


def test_dataset_dirs_and_metadata(spark, tree):
    d = files.dataset_dirs(spark, str(tree))
    assert {(r["dataset"], r["iso_week"]) for r in d.collect()} == {("alpha", ""), ("weekly", "2025W40"), ("weekly", "2025W41")}
    m = metadata.sample_metadata(files.metadata_files(spark, d, str(tree)), "dataset", "text")
    assert {(r["dataset"], r["file"], r["source_file"]) for r in m.collect()} == {
        ("alpha", "img_000001.png", "s1"), ("alpha", "img_000002.png", None), ("weekly", "a.jpg", None), ("weekly", "1", None)}


def test_probe_headers(spark, tree):
    ok, bad = files.probe_headers(spark, str(tree / "alpha/samples"))
    r = ok.first()
    assert (r["width"], r["height"], r["file_format"], r["pil_mode"]) == (10, 20, "PNG", "RGB") and r["path"].endswith("img_000001.png")
    assert [x["path"].rsplit("/", 1)[1] for x in bad.collect()] == ["img_000002.png"]


def test_folder_zip_and_pool(spark, tmp_path):
    (tmp_path / "real/x").mkdir(parents=True)
    (tmp_path / "fake").mkdir()
    (tmp_path / "real/x/a.PNG").write_bytes(png(1, 1))
    (tmp_path / "fake/b.jpg").write_bytes(jpeg(1, 1))
    (tmp_path / "fake/notes.txt").write_text("no")
    assert {(r["dataset"], r["label"]) for r in files.image_pool(spark, str(tmp_path)).collect()} == {("real", 0), ("fake", 1)}
    assert {r["source_file"] for r in files.folder_items(spark, str(tmp_path), 1).collect()} == {"real/x", "fake"}
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("d/one.png", png(2, 2))
        z.writestr("two.jpg", jpeg(2, 2))
        z.writestr("readme.md", "x")
    got = files.zip_items(spark, str(tmp_path), 1)
    assert {(r["member"], r["source_file"]) for r in got.collect()} == {("d/one.png", "d"), ("two.jpg", "pack")}


def test_rules(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("datasets:\n- {name: x, media_type: real, path: p}\n- {name: y, media_type: synthetic, path: p}\n")
    (tmp_path / "b.yaml").write_text("datasets:\n- {name: x, media_type: real, path: q}\n")
    assert rules.load_registry(spark, str(tmp_path / "a.yaml")).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        rules.load_registry(spark, str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"))
    with pytest.raises(FileNotFoundError):
        rules.load_overrides(spark, str(tmp_path / "none.yaml"))
    assert all(t.count() == 0 for t in rules.load_overrides(spark, default=str(tmp_path / "none.yaml")).values())
    (tmp_path / "o.yaml").write_text("category_overrides: {x: faces}\npair_groups: [[x, y]]\ndistribution_groups: [[y, z]]\nshard_groups: [[x, y]]\n"
                                     "holdouts: {test: {fake: [y]}}\ntrain_gates: {g: {park_in: test, real: [x]}}\nextra_datasets: [{name: w}]\n")
    o = rules.load_overrides(spark, str(tmp_path / "o.yaml"))
    assert {k: v.count() for k, v in o.items()} == {"fixes": 1, "cliques": 2, "strict_cliques": 4, "shards": 2, "listed": 0, "holdouts": 1, "gates": 1, "extra": 1}
    (tmp_path / "p.yaml").write_text("types: {t: {probes: [{name: bad, label: real}]}}\n")
    with pytest.raises(ValueError, match="probe-"):
        rules.load_probes(spark, str(tmp_path / "p.yaml"))


def test_names_from_file(spark, tmp_path):
    (tmp_path / "names").write_text("one\ntwo  three\n\n")
    got = metadata.name_list(spark, ["zero", f"@{tmp_path / 'names'}"])
    assert {r["name"] for r in got.collect()} == {"zero", "one", "two", "three"}


def test_gated_write(spark, tmp_path, sf):
    rows = B.split_manifest(spark, sf)
    bad = P.split_rules(rows.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="not written"):
        sinks.write_manifest(rows, str(tmp_path / "m"), bad)
    assert not (tmp_path / "m").exists()
    sinks.write_manifest(rows, str(tmp_path / "m"), bad.filter("severity = 'warn'"))
    back = sinks.read_manifest(spark, str(tmp_path / "m")).filter("split = 'train'").select("image_id")
    assert back.count() == rows.filter("split = 'train'").count()
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().toString()


def test_reports(spark, tmp_path, sf):
    t = B.tallies(spark, sf)
    sinks.write_csv(t, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == t.count()
    sinks.write_report(t, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == t.count()
    items = B.table(spark, sf, "documents").withColumnRenamed("source", "source_file")
    for _ in range(2):
        sinks.append_provenance(items, str(tmp_path / "p"), name="n", media_type="fake", role="train", source="folder")
    assert spark.read.json(str(tmp_path / "p")).count() == 2


def test_view_plan_rules():
    base = V.ViewPlan()
    for bad in ({"view_arms": (0.5, 0.1, 0.1)}, {"codec_jpeg_p": 0.9}, {"effects": (("sparkle", 1.0),)}, {"view_b": "both"}):
        with pytest.raises(ValueError):
            base.at(bad)
    with pytest.raises(ValueError, match="may not change"):
        base.at({"jitter": False})
    assert base.at({"view_b": "deploy"}).view_b == "deploy"


def test_view_plan_streams_are_independent(spark, sf):
    rows = B.raw_manifest(spark, sf)
    a = V.view_plan(rows, V.ViewPlan(), [], 2, 1)
    b = V.view_plan(rows, V.ViewPlan(effects_p=1.0, effects=(("banding", 1.0),), codec=False), [], 2, 1)
    keep = ["image_id", "epoch", "hflip", "vflip", "view_a", "ladder_level", "jitter_factor"]
    assert a.select(*keep).exceptAll(b.select(*keep)).count() == 0
    assert a.count() == 2 * rows.count()
    semi = a.join(rows.filter("kind = 'semisynthetic'").select("image_id"), "image_id", "left_semi").filter("view_a = 'ladder'")
    assert semi.count() > 0 and semi.filter("crop_p > 0").count() == 0


def test_arm_frequencies(spark):
    u = spark.range(10000).select(((F.col("id") + 0.5) / 10000).alias("u"))
    got = {r["a"]: r["count"] for r in u.groupBy(V.pick(F.col("u"), ["none", "jpeg", "double", "webp"], [.3, .35, .1, .25]).alias("a")).count().collect()}
    assert {k: v / 10000 for k, v in got.items()} == pytest.approx({"none": .3, "jpeg": .35, "double": .1, "webp": .25}, abs=1e-3)


def test_stream_matches_batch(spark, tmp_path, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts", "event_type", "props")
    src = tmp_path / "in"
    e.filter("event_id % 2 = 0").coalesce(1).write.parquet(str(src / "a"))
    e.filter("event_id % 2 = 1").coalesce(1).write.parquet(str(src / "b"))
    s = stream.read_items(spark, str(src / "*"), e.schema)
    stream.append(stream.first_copies(s, "props", delay="60 days"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == e.select("props").distinct().count()
    tail = e.limit(1).withColumn("ts", F.lit("2024-12-01").cast("timestamp"))
    tail.write.parquet(str(src / "c"))
    c = stream.weekly_census(stream.read_items(spark, str(src / "*"), e.schema), "event_type", delay="1 day")
    stream.append(c, str(tmp_path / "census"), str(tmp_path / "ck2")).awaitTermination()
    weeks = spark.read.parquet(str(tmp_path / "census"))
    batch = e.groupBy(F.date_trunc("week", "ts").alias("week_start"), F.col("event_type").alias("model_name")).agg(F.count(F.lit(1)).alias("n"))
    a = {(r["week_start"], r["model_name"]): r["n"] for r in batch.collect()}
    b = {(r["week_start"], r["model_name"]): r["n"] for r in weeks.collect()}
    assert b and all(a[k] == v for k, v in b.items() if k in a)


def test_ingest_keeps_first_copy(spark):
    d = spark.createDataFrame([(1, "aaa", 3, "s"), (2, "aaa", 3, "t"), (3, "b", 1, "s"), (4, "ccc", 3, "s")], "id int, text string, n int, src string")
    got = I.ingest(d, content="text", size="n", order="id", min_side=2).select("id", "fname").orderBy("id").collect()
    assert [(r["id"], r["fname"]) for r in got] == [(1, "img_000000"), (4, "img_000001")]


def test_a_manifest_is_rewritten_in_place(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(100).select(F.concat(F.lit("i"), "id").alias("image_id"), F.lit("d").alias("dataset"),
                                   F.when(F.col("id") < 50, "train").otherwise("test").alias("split"))
    sinks.write_manifest(rows.repartition(8), path)
    again = spark.read.parquet(path).withColumn("split", F.when(F.col("split") == "test", "val_id").otherwise(F.col("split")))
    sinks.write_manifest(again, path)
    got = spark.read.parquet(path)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 50, "val_id": 50}
    assert len(list((tmp_path / "m" / "split=train").glob("*.parquet"))) == 1


def test_contents_are_written_as_they_came(spark, tmp_path):
    items = spark.createDataFrame([(1, b"\x00\xffA", 9), (2, b"B\n", 9), (3, b"\x00\xffA", 9), (4, b"small", 1)], "n long, content binary, side int")
    kept = I.ingest(items, content="content", size="side", order="n", min_side=5, keep_content=True)
    sinks.write_contents(kept, "content", str(tmp_path / "c"))
    assert sorted((r.fname, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("img_000000", b"\x00\xffA"), ("img_000001", b"B\n")]
