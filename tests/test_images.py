import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalars as X
from tidemill.operators import images as I
from tidemill.sources import files
from tidemill.sources.files import read_images


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"\x10\x20\x30" * w for _ in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\x00\x00\x00;"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    (path / "sub").mkdir()
    (path / "a.png").write_bytes(png(10, 20))
    (path / "b.gif").write_bytes(gif(300, 100))
    (path / "sub" / "c.JPG").write_bytes(b"\xff\xd8\xff\xe0\x00\x10JFIF\x00")
    (path / "d.webp").write_bytes(b"RIFF\x24\x00\x00\x00WEBPVP8 ")
    (path / "e.png").write_bytes(b"")
    (path / "f.png").write_bytes(b"not an image")
    (path / "g.txt").write_bytes(b"ignored")
    return str(path)


def test_inventory_of_files(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in I.inventory(read_images(spark, folder)).collect()}
    assert set(got) == {"a.png", "b.gif", "c.JPG", "d.webp", "f.png"}  # Spark leaves empty files out
    assert (got["a.png"].format, got["a.png"].width, got["a.png"].height) == ("png", 10, 20)
    assert (got["b.gif"].format, got["b.gif"].width, got["b.gif"].height) == ("gif", 300, 100)
    assert got["c.JPG"].format == "jpeg" and got["c.JPG"].width is None and got["c.JPG"].extension == ".jpg"
    assert got["d.webp"].format == "webp" and got["d.webp"].problem is None
    assert got["f.png"].problem == "content"
    assert got["a.png"].file_size == len(png(10, 20))


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "path,size,want",
    [("a.PNG", 5, None), ("a.bmp", 5, "extension"), ("a.png", 0, "empty"), ("a.png", 10 * 1024 * 1024, None), ("a.png", 10 * 1024 * 1024 + 1, "too_large"), ("png", 5, "extension")],
)
def test_upload_gate(spark, path, size, want):
    assert one(spark, X.upload_problem("image", F.lit(path), F.lit(size))) == want


@pytest.mark.parametrize(
    "wanted,original,fmt,ext",
    [("original", "PNG", "png", ".png"), ("jpg", "PNG", "jpeg", ".jpg"), ("WEBP", "GIF", "webp", ".webp"), ("original", "bmp", None, None), ("tiff", "png", None, None)],
)
def test_output_format(spark, wanted, original, fmt, ext):
    target = X.output_format(F.lit(wanted), F.lit(original))
    assert one(spark, target) == fmt and one(spark, X.extension_for(target)) == ext


def test_plan(spark):
    cols = "original_format string, requested_format string, resize boolean, resize_width int, resize_height int, compression boolean, compression_quality int"
    rows = [("JPEG", "original", True, 5, 6, True, 80), ("JPEG", "png", False, None, None, True, 80), ("GIF", "gif", False, None, None, False, None)]
    a, b, c = I.format_plan(spark.createDataFrame(rows, cols)).collect()
    assert (a.operations, a.quality, a.optimize, a.result_width) == (["resize", "compression"], 80, False, 5)
    assert (b.operations, b.quality, b.optimize) == (["format_conversion", "compression"], None, True)
    assert (c.operations, c.result_format, c.processed_name) == ([], "GIF", "processed.gif")


def test_size_change(spark):
    before = spark.createDataFrame([(1, "png", 100), (2, "png", 0)], "id int, format string, size long")
    after = spark.createDataFrame([(1, 150), (2, 10)], "id int, size long")
    got = I.size_change(before, after, "id", ["format"]).first()
    assert (got.files, got.original_size, got.result_size, got.compression_ratio, got.avg_file_ratio) == (2, 100, 160, -0.6, -0.25)


def test_metadata_summary(spark):
    info = F.create_map(F.lit("dpi"), F.lit("72"), F.lit("icc"), F.lit("x"), F.lit("comment"), F.lit(None).cast("string"))
    exif = F.create_map(F.lit("271"), F.lit("Maker"), F.lit("999"), F.lit("x"))
    assert one(spark, I.metadata_summary(info, exif)) == {"dpi": "72", "exif.make": "Maker"}
    assert one(spark, I.metadata_summary(F.lit(None).cast("map<string,string>"), exif)) == {"exif.make": "Maker"}


def test_broken_bytes_become_text(spark):
    assert one(spark, X.readable_text(F.lit(bytearray(b"ok\xff")))) == "ok�"


def test_only_the_beginning_of_a_file_is_read(spark, tmp_path, folder, monkeypatch):
    """The inventory is that of whole files; content is 64 KB at most, also where only Spark can open the files."""
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "big%20ü.png").write_bytes(png(7, 9) + bytes(300_000))
    (tmp_path / "small.gif").write_bytes(gif(3, 4))
    for path in (str(folder), str(tmp_path)):
        whole = sorted(map(tuple, I.inventory(read_images(spark, path)).collect()), key=str)
        assert sorted(map(tuple, I.inventory(files.read_heads(spark, path)).collect()), key=str) == whole
    sizes = {r.length: len(r.content) for r in files.read_heads(spark, str(tmp_path)).collect()}
    assert max(sizes) > 300_000 and sizes[max(sizes)] == files.HEAD_BYTES
    monkeypatch.setattr(files, "file_system", lambda folder: None)
    again = {r.length: len(r.content) for r in files.read_heads(spark, str(tmp_path)).collect()}
    assert again == sizes


def test_files_are_listed_in_tasks_as_spark_lists_them(spark, tmp_path):
    """Nested folders, hidden and empty files, odd names; tasks follow the number of files, not a size set per file."""
    from tidemill.sources import files

    for k in range(300):
        folder = tmp_path / f"d{k % 7}" / ("deep er" if k % 2 else "x=1")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"a{k}.{['png', 'JPG', 'txt', 'jpg.bak'][k % 4]}").write_bytes(b"" if k % 11 == 0 else b"x" * k)
    for name in ("_skip.png", ".skip.png", "_k=1.png", "top #%20.gif", "t._COPYING_", "_metadata.png"):
        (tmp_path / name).write_bytes(b"abc")
    for hidden in ("_folder", ".folder"):
        (tmp_path / hidden).mkdir()
        (tmp_path / hidden / "in.png").write_bytes(b"abc")
    for glob in (files.IMAGE_GLOB, "*", "a?[0-4]*.{png,txt}"):
        whole = sorted((r.path, r.length) for r in files.read_images(spark, str(tmp_path), glob).select("path", "length").collect() if r.length)
        heads = files.read_heads(spark, str(tmp_path), glob)
        assert sorted((r.path, r.length) for r in heads.collect()) == whole and whole
        assert heads.rdd.getNumPartitions() == 1
