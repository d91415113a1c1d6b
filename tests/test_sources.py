import struct

import numpy as np
import pytest
from helpers import array_of, grid_of

from latticework.sources import codecs, files


@pytest.mark.parametrize("kind,extent,dtype", [("nrrd", (4, 3, 2), "i2"), ("web", (2, 3, 4), "u2"), ("png", (3, 5, 4), "u1"), ("png", (4, 6, 3), "u1"), ("bmp", (3, 5, 4), "u1")])
def test_round_trips(kind, extent, dtype):
    values = (np.arange(np.prod(extent)) * 7 % 251).astype(dtype)
    got, size, _ = codecs.DECODERS[kind](codecs.ENCODERS[kind](values, extent))
    if kind == "png":
        got = got.reshape(-1, 4)[:, : extent[0]].reshape(-1)
        size = (extent[0], *size[1:])
    assert size == extent and (got == values).all()


def test_web_header():
    raw = codecs.encode_web(np.arange(24, dtype="u2") * 7, (2, 3, 4), {"spacing": [2.5, 1, 1], "unit": ["mm", "", ""]})
    assert raw[4:7] == bytes([2, 2, 3]) and struct.unpack_from("<3I", raw, 7) == (2, 3, 4)
    _, _, extra = codecs.decode_web(raw)
    assert extra == {"spacing": [2.5, 1.0, 1.0], "unit": ["mm", "", ""]}


def test_raw_and_dicom_and_analyze():
    with pytest.raises(ValueError):
        codecs.decode_raw(b"abc", (2, 2))
    part = lambda g, e, vr, b: struct.pack("<HH2sH", g, e, vr, len(b)) + b
    px = np.arange(6, dtype="<u2")
    raw = bytes(128) + b"DICM" + part(2, 16, b"UI", b"1.2.840.10008.1.2.1\0") + part(0x28, 0x10, b"US", b"\2\0") + part(0x28, 0x11, b"US", b"\3\0") + part(0x28, 0x100, b"US", b"\x10\0")
    raw += part(0x28, 0x1053, b"DS", b"2.5 ") + struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OW", 0, 12) + px.tobytes()
    values, extent, extra = codecs.decode_dicom(raw)
    assert extent == (3, 2, 1) and (values == px).all() and extra["slope"] == 2.5
    head = bytearray(348)
    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 2, 3, 2, 1, 1, 0, 0, 0)
    struct.pack_into(">h", head, 70, 4)
    values, extent, _ = codecs.decode_analyze(bytes(head), px.astype(">i2").tobytes())
    assert extent == (3, 2) and values.tolist() == px.tolist()


def test_folders(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 255, (3, 5, 4))
    g = grid_of(spark, a)
    rows = files.encoded(g, "png").selectExpr("'one' as name", "content")
    assert files.save(rows, "name", str(tmp_path / "pics"), "png") == 1
    back = files.as_grid(files.read_files(spark, str(tmp_path / "pics")), (4, 5, 4))
    got = array_of(type(back)(back.df.drop("path"), back.axes, back.extent))
    assert (got[:3] == a).all() and (got[3] == 255).all()
    assert codecs.wire_frame("v1", 7, 2, 1, 1, b"ab") == b"\x02v1" + struct.pack("<QIIB", 7, 2, 1, 1) + b"ab"


def test_many_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    monkeypatch.setattr(DataFrame, "collect", None)
    rows = spark.range(1000, numPartitions=7).selectExpr("id", "cast(concat('file ', id) as binary) as content")
    folder = tmp_path / "many"
    for _ in range(2):  # a second time the same files are there
        assert files.save(rows, "id", str(folder), "txt") == 1000
    names = sorted(p.name for p in folder.iterdir())
    assert len(names) == 1001 and (folder / "_SUCCESS").exists() and not any(n.startswith(".") for n in names)
    assert all((folder / f"{k}.txt").read_bytes() == f"file {k}".encode() for k in (0, 123, 999))
    assert files.save(rows.where("id < 0"), "id", str(tmp_path / "none"), "txt") == 0


@pytest.mark.parametrize("kind", ["analyze", "nrrd"])
def test_pairs_of_files(spark, tmp_path, kind):
    a = np.random.default_rng(2).integers(-900, 900, (3, 4, 5))
    one = grid_of(spark, a)
    both = one.df.selectExpr("'one' as name", "*").union(one.df.selectExpr("'two' as name", "i0", "i1", "i2", "v + 1"))
    g = type(one)(both, one.axes, one.extent, keys=("name",))
    pairs = files.encoded_pair(g, kind, "i2", name="name", spacing=[1.0, 2.0, 2.5]).cache()
    head, image = ("hdr", "img") if kind == "analyze" else ("nhdr", "raw")
    assert files.save(pairs, "name", str(tmp_path), head, "header") == files.save(pairs, "name", str(tmp_path), image, "image") == 2
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_pairs(spark, str(tmp_path), kind).collect()}
    assert got.keys() == {f"one.{head}", f"two.{head}"}
    for k, name in enumerate(("one", "two")):
        r = got[f"{name}.{head}"]
        assert r["extent"] == [3, 4, 5] and r["dtype"] == "i2" and r["extra"]["spacing"] == "[1.0, 2.0, 2.5]"
        assert (np.array(r["payload"]).reshape((5, 4, 3)).T == a + k).all()
    (tmp_path / f"one.{image}").unlink()
    with pytest.raises(Exception, match="is missing"):
        files.read_pairs(spark, str(tmp_path), kind).collect()


def test_detached_and_odd_nrrd():
    px = np.arange(6, dtype=">i2")
    head = b"NRRD0004\r\ntype: short\r\ndimension: 2\r\nsizes: 3 2\r\nencoding: raw\r\nendian: big\r\nbyte skip: -1\r\ndatafile: ../a.raw\r\n\r\n"
    assert codecs.nrrd_target(head) == "../a.raw"
    values, extent, _ = codecs.decode_nrrd(head, b"junk" + px.tobytes())
    assert extent == (3, 2) and values.tolist() == px.tolist()
    with pytest.raises(ValueError):
        codecs.decode_nrrd(head)


@pytest.mark.parametrize("order", ["<", ">"])
def test_dicom_byte_orders_and_sequences(order):
    first = lambda b: struct.pack("<HH2sH", 2, 16, b"UI", len(b)) + b
    part = lambda g, e, vr, b: struct.pack(order + "HH2sH", g, e, vr, len(b)) + b
    long = lambda g, e, vr, n, b: struct.pack(order + "HH2sHI", g, e, vr, 0, n) + b
    item = lambda e, n, b=b"": struct.pack(order + "HHI", 0xFFFE, e, n) + b
    px = np.array([1, -2, 3, 400, 5, 6], order + "i2")
    inner = long(8, 0x1111, b"SQ", 0xFFFFFFFF, item(0xE000, 4, b"abcd") + item(0xE0DD, 0)) + part(8, 0x60, b"CS", b"MR")
    nested = long(8, 0x1110, b"SQ", 0xFFFFFFFF, item(0xE000, 0xFFFFFFFF, inner + item(0xE00D, 0)) + item(0xE000, 2, b"zz") + item(0xE0DD, 0))
    number = lambda e, n: part(0x28, e, b"US", struct.pack(order + "H", n))
    raw = bytes(128) + b"DICM" + first(b"1.2.840.10008.1.2.1\0" if order == "<" else b"1.2.840.10008.1.2.2\0") + nested
    raw += number(0x10, 2) + number(0x11, 3) + number(0x100, 16) + number(0x103, 1) + long(0x7FE0, 0x10, b"OW", 12, px.tobytes())
    values, extent, _ = codecs.decode_dicom(raw)
    assert extent == (3, 2, 1) and values.tolist() == px.tolist() and values.dtype == np.dtype("i2")


def test_wire_messages_as_columns(spark):
    df = spark.createDataFrame([("v1", 7, (2, 1, 1, bytearray(b"ab"))), ("é", 2**40 + 3, (300, 70000, 4, bytearray(b"xyz")))], "v string, i bigint, f struct<width: int, height: int, channels: int, pixels: binary>")
    got = [bytes(r[0]) for r in files.with_wire(df, "v", "i", "f").select("message").collect()]
    assert got == [codecs.wire_frame("v1", 7, 2, 1, 1, b"ab"), codecs.wire_frame("é", 2**40 + 3, 300, 70000, 4, b"xyz")]


def test_png_of_a_plane():
    values = np.arange(12, dtype="u1")
    got, size, _ = codecs.decode_png(codecs.encode_png(values, (4, 3)))
    assert size == (4, 4, 3) and got.reshape(-1, 4)[:, 0].tolist() == values.tolist()


def write_jpeg(spark, path, picture, progressive=False):
    """By the JVM's library; ``picture`` is (rows, columns) or (rows, columns, 3)."""
    jvm, (h, w) = spark._jvm, picture.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if picture.ndim == 3 else 10)
    cells = spark.sparkContext._gateway.new_array(jvm.int, picture.size)
    for k, x in enumerate(picture.ravel().tolist()):
        cells[k] = x
    image.getRaster().setPixels(0, 0, w, h, cells)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(1)  # the library's own choice of scans
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    out.close()
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(path))).getData()
    return [back.getSample(x, y, b) for y in range(h) for x in range(w) for b in range(picture.size // (w * h))]


def test_jpeg_files(spark, tmp_path):
    y, x = np.mgrid[0:11, 0:14]
    color = np.stack([x * 18, y * 23, (x + y) * 10], 2)
    want = {"plain.jpg": write_jpeg(spark, tmp_path / "plain.jpg", color), "steps.jpeg": write_jpeg(spark, tmp_path / "steps.jpeg", color, True)}
    want["grey.jpg"] = np.repeat(write_jpeg(spark, tmp_path / "grey.jpg", x * 18), 3).tolist()
    (tmp_path / "notes.txt").write_text("not read")
    rows = files.read_files(spark, str(tmp_path), "jpg").collect()
    assert {r.path.rsplit("/", 1)[1]: r.payload for r in rows} == want
    assert {(*r.extent, r.dtype) for r in rows} == {(3, 14, 11, "u1")}
    assert np.abs(np.array(want["plain.jpg"]).reshape(11, 14, 3) - color).mean() < 16  # channels stand in their order
    one = files.read_files(spark, str(tmp_path / "grey.jpg"))
    assert files.as_grid(one, (3, 14, 11)).df.count() == 3 * 14 * 11
    (tmp_path / "broken.jpg").write_bytes(b"no picture")
    with pytest.raises(Exception, match="no picture"):
        files.read_files(spark, str(tmp_path), "jpg").collect()
