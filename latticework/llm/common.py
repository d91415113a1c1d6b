"""Helpers that the text operators share: tables, written intermediates, batches, small fits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Python workers started from now on also look for this package where the driver has it."""
    here, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [here, paths.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none a temporary folder is set once, but only on one machine: executors
    elsewhere would write their parts to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage with files that outlive a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, under fixed names; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(batches: Iterator, n_rows: int = 512, n_bytes: int = 1 << 25) -> Iterator:
    """Arrow batches cut to ``n_rows`` rows and about ``n_bytes`` bytes of text, so that a task holds few texts at a time; a longer text comes alone."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, min(at + n_rows, int(np.searchsorted(total, before + n_bytes, "right"))))
            yield batch.slice(at, end - at)
            at = end


def groups_of(batches: Iterator, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys stand together."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        name = np.stack([table.column(k).to_numpy() for k in keys], 1)
        edge = [0, *(np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(edge, edge[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(edge[-1])
    if rest is not None and rest.num_rows:
        yield rest


def smallest_reached(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the smallest of ``ids`` that it reaches over the links between places a and b."""
    label = ids.copy()
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps; returns (coefficients, intercept)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * weight.sum() / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * beta
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    coef = beta[:-1] / scale
    return coef, float(beta[-1] - coef @ mean)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: rows (node, component_id), the smallest node of each.

    Alternates large-star and small-star steps; the edges after each are written to the
    shared folder. Minima are pre-aggregated before the shuffle, and the joins back to the
    neighbours are plain equi-joins that adaptive execution splits when one node has most
    of the edges. Only a count and a checksum reach the driver. Null ends and loops are ignored.
    """
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    now, seen = written(now, "links"), None

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        else:
            both = pairs.toDF("u", "v")  # u > v
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    while True:
        after = written(star(star(now, True), False), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if state == seen or not state[0]:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(roots)
