"""Folders of grid files as tables, and tables of grids as files.

Reading goes through Spark's ``binaryFile`` source, so any store works and files are dealt out to
tasks. One file is decoded in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath
from posixpath import normpath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from .codecs import DECODERS, ENCODERS, decode_analyze, decode_nrrd, decode_raw, encode_analyze, encode_raw, nrrd_header, nrrd_target

FRAME = "path string, extent array<int>, dtype string, payload array<double>, extra map<string,string>"


def read_files(spark: SparkSession, path: str, kind: str | None = None, extent=None, dtype: str = "u1", offset: int = 0) -> DataFrame:
    """One row per file: (path, extent, dtype, payload in scan order, extra). The format follows the extension unless ``kind`` names it; raw files need an extent.

    JPEG files are read by themselves, with ``kind`` "jpg" or a path that ends so.
    """
    if (kind or PurePosixPath(path).suffix.lstrip(".")).lower() in ("jpg", "jpeg"):
        return read_pictures(spark, path)

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"], strict=True):
                form = kind or PurePosixPath(name).suffix.lstrip(".").lower() or "nrrd"
                if form == "raw":
                    values, size, extra = decode_raw(content, extent, dtype, offset)
                elif form in DECODERS:
                    values, size, extra = DECODERS[form](content)
                else:
                    raise ValueError(f"unknown format {form}")
                rows.append((name, list(map(int, size)), values.dtype.str[1:], values.astype(float), {k: str(v) for k, v in extra.items()}))
            yield pd.DataFrame(rows, columns=["path", "extent", "dtype", "payload", "extra"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, FRAME)


def read_pictures(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,JPG,JPEG}") -> DataFrame:
    """JPEG files (baseline or progressive) as the rows that ``read_files`` gives, always with three channels: red, green, blue.

    Spark's ``image`` source decodes them in tasks. Grey pictures get three equal channels; a file that is no picture raises.
    """

    def ordered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                if r.nChannels < 1:
                    raise ValueError(f"no picture: {r.origin}")
                px = np.frombuffer(r.data, np.uint8).reshape(-1, r.nChannels)
                px = np.repeat(px, 3, 1) if r.nChannels == 1 else px[:, 2::-1]  # the source has blue first
                rows.append((r.origin, [3, r.width, r.height], "u1", px.ravel().astype(float), {}))
            yield pd.DataFrame(rows, columns=["path", "extent", "dtype", "payload", "extra"])

    source = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", pattern)
    return source.load(path).select("image.*").mapInPandas(ordered, FRAME)


def as_grid(files: DataFrame, extent) -> Grid:
    """Cells of all files of one extent, keyed by path."""
    axes, n, cols = tuple(f"i{k}" for k in range(len(extent))), 1, []
    rows = files.where(F.col("extent") == F.array(*map(F.lit, extent))).select("path", F.posexplode("payload").alias("pos", "v"))
    for a, e in zip(axes, extent, strict=True):
        cols.append(F.expr(f"cast((pos div {n}) % {e} as int)").alias(a))
        n *= e
    return Grid(rows.select("path", *cols, "v"), axes, tuple(extent), keys=("path",))


def encoded(g: Grid, kind: str, dtype: str = "u1", **extra) -> DataFrame:
    """One file per key of a grid, as rows (keys, content)."""
    if kind not in ENCODERS:
        raise ValueError(f"unknown format {kind}")
    size = tuple(g.extent)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["content"] = [ENCODERS[kind](np.asarray(p).astype(dtype), size, extra) for p in part.pop("payload")]
            yield part

    blocks = g.blocks()
    keys = ", ".join(f"{k} {t}" for k, t in blocks.dtypes if k != "payload")
    return blocks.mapInPandas(encode, f"{keys + ', ' if keys else ''}content binary")


def save(rows: DataFrame, name: str, folder: str, suffix: str, content: str = "content") -> int:
    """Write each row's content to a file named by column ``name``, in the task that has the row. Returns the number of files.

    A file is written under another name and then moved to its own, so a file is there whole or not at all, and a task that runs twice writes the
    same files. When all are there the empty file _SUCCESS follows. ``folder`` is a place that driver and executors reach by one address, as
    an absolute path or an address that Arrow's file systems read.
    """
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{top}/.{uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                store.move(part, f"{top}/{n}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    named = rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).where(F.col(name).isNotNull())
    n = named.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    store.open_output_stream(f"{top}/_SUCCESS").close()
    return n


def encoded_pair(g: Grid, kind: str, dtype: str = "u1", name: str | None = None, **extra) -> DataFrame:
    """Two files per key of a grid, as rows (keys, header, image): ``kind`` is analyze, or nrrd whose header names the file ``name`` column + ".raw"."""
    size = tuple(g.extent)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            both = []
            for p, target in zip(part["payload"], part[name] if name else [None] * len(part), strict=True):
                values = np.asarray(p).astype(dtype)
                both.append(encode_analyze(values, size, extra) if kind == "analyze" else (nrrd_header(values, size, extra, f"{target}.raw"), encode_raw(values.astype("<" + dtype), size)))
            part = part.drop(columns="payload")
            part["header"], part["image"] = [h for h, _ in both], [i for _, i in both]
            yield part

    if kind not in ("analyze", "nrrd") or kind == "nrrd" and not name:
        raise ValueError("analyze, or nrrd with the column that names the files")
    blocks = g.blocks()
    keys = ", ".join(f"{k} {t}" for k, t in blocks.dtypes if k != "payload")
    return blocks.mapInPandas(encode, f"{keys + ', ' if keys else ''}header binary, image binary")


def read_pairs(spark: SparkSession, path: str, kind: str, headers: str | None = None) -> DataFrame:
    """One row per pair of a header and the file that has its values, as ``read_files`` gives them; ``path`` is the header's.

    ``kind`` is analyze (x.hdr beside x.img) or nrrd (*.nhdr, which names the file). Headers, which are small, tell where their values are, and are
    joined to those files by path; a header whose file is missing raises.
    """
    pattern = headers or {"analyze": "*.hdr", "nrrd": "*.nhdr"}[kind]

    def targets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names = [n[: -len("hdr")] + "img" if kind == "analyze" else f"{n.rsplit('/', 1)[0]}/{nrrd_target(c)}" for n, c in zip(part["path"], part["content"], strict=True)]
            part["target"] = [n.split(":/", 1)[0] + ":" + normpath("/" + n.split(":/", 1)[1]) if ":/" in n and "://" not in n else n for n in names]
            yield part

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, target, head, image in part[["path", "target", "content", "image"]].itertuples(index=False):
                if image is None:
                    raise ValueError(f"{target}, which {name} names, is missing")
                values, size, extra = decode_analyze(head, image) if kind == "analyze" else decode_nrrd(head, image)
                rows.append((name, list(map(int, size)), values.dtype.str[1:], values.astype(float), {k: str(v) for k, v in extra.items()}))
            yield pd.DataFrame(rows, columns=["path", "extent", "dtype", "payload", "extra"])

    load = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    heads = load(pattern).mapInPandas(targets, "path string, content binary, target string")
    images = load("*.img" if kind == "analyze" else "*").where(~F.col("path").endswith(pattern.lstrip("*"))).select(F.col("path").alias("target"), F.col("content").alias("image"))
    return heads.join(images, "target", "left").mapInPandas(decode, FRAME)


def with_wire(df: DataFrame, viewport: str, index: str, frame: str, name: str = "message") -> DataFrame:
    """Add the message that carries each rendered frame (a struct of width, height, channels, pixels): columns put together as bytes, low byte first."""

    def number(c, n: int):
        digits = F.lpad(F.hex(c.cast("long")), 2 * n, "0")
        return F.concat(*[F.unhex(F.substring(digits, 2 * k + 1, 2)) for k in reversed(range(n))])

    text = F.substring(F.encode(F.col(viewport), "UTF-8"), 1, 255)
    f = F.col(frame)
    message = F.concat(number(F.octet_length(text), 1), text, number(F.col(index), 8), number(f["width"], 4), number(f["height"], 4), number(f["channels"], 1), f["pixels"].cast("binary"))
    return df.withColumn(name, message)
