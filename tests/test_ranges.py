"""Header probes and archives read in parts."""

import struct
import zipfile

from pyspark.sql import functions as F
from test_sources import jpeg, png

from plumbline.sources import files, ranges


def far_jpeg(w, h, metadata):
    """A JPEG whose frame lies behind segments of metadata."""
    segment = b"\xff\xe1" + struct.pack(">H", 60_002) + bytes(60_000)
    whole = jpeg(w, h)
    return whole[:2] + segment * metadata + whole[2:]


def test_bytes_read(spark, tmp_path):
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    rest = bytes(1_000_000)
    kinds = {"a.png": png(640, 480), "b.gif": b"GIF89a" + struct.pack("<HH", 7, 9), "c.bmp": b"BM" + bytes(16) + struct.pack("<iiHH", 5, -6, 1, 24), "d.webp": webp,
             "e.jpg": jpeg(30, 40), "broken.png": b"nothing", "none.jpg": b"\xff\xd8" + b"\xff\xe1\xff\xff" * 3}
    for name, head in kinds.items():
        (tmp_path / name).write_bytes(head + rest)
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "far.jpg").write_bytes(far_jpeg(123, 45, 20) + rest)
    got = {r.path.rsplit("/", 1)[1]: r for r in ranges.headers(files.list_files(spark, str(tmp_path))).collect()}
    assert {k: (r.width, r.height) for k, r in got.items() if r.width} == {"a.png": (640, 480), "b.gif": (7, 9), "c.bmp": (5, 6), "d.webp": (100, 50), "e.jpg": (30, 40),
                                                                          "far.jpg": (123, 45)}
    assert all(r.read_bytes <= ranges.HEAD_BYTES for k, r in got.items() if k not in ("far.jpg", "none.jpg"))
    assert got["far.jpg"].read_bytes <= ranges.HEAD_BYTES + 30 * 10 and got["far.jpg"].file_bytes > 2_000_000
    ok, bad = files.probe_headers(spark, str(tmp_path))
    assert ok.count() == 6 and {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"broken.png", "none.jpg"}  # Spark lists no empty files
    gone = spark.createDataFrame([("/no/such/file.png", 5)], "path string, length long")
    assert ranges.headers(gone).first().width == 0


def test_one_archive_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(10_000):
            z.writestr(f"d{k % 7}/{k}.png", png(k % 90 + 1, 2))
        z.writestr("d0/notes.txt", "no")
    with zipfile.ZipFile(tmp_path / "small.ZIP", "w") as z:
        z.writestr("x.JPG", jpeg(1, 1))
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    got = files.zip_items(spark, str(tmp_path), 1, range_bytes=50_000)
    assert got.rdd.getNumPartitions() > 8
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("b")).collect()
    assert sum(r.n for r in tasks) == 10_001 and max(r.b for r in tasks) <= 50_000 and len([r for r in tasks if r.n]) > 8
    assert got.select("archive", "member").distinct().count() == 10_001
    assert {r.source_file for r in got.select("source_file").distinct().collect()} == {*(f"d{k}" for k in range(7)), "small"}
    one = ranges.zip_members(spark, str(tmp_path / "big.zip"))
    assert one.count() == 10_001 and one.filter("member = 'd0/notes.txt'").first().content == b"no"
    assert ranges.zip_members(spark, str(tmp_path / "empty.zip")).count() == 0
    assert ranges.zip_members(spark, f"file://{tmp_path}/small.ZIP").first().member == "x.JPG"
    (tmp_path / "one.png").write_bytes(png(4, 5))
    assert ranges.header(f"file://{tmp_path}/one.png")[0][:2] == (4, 5)
