"""Near-duplicate documents by min-max hashing.

Under each hash function both the smallest and the largest shingle are kept, so 60 functions
give 120 values of a signature. Either value agrees between two documents with a chance equal
to their Jaccard similarity, and the two are negatively correlated, so the estimate is unbiased
and varies less than that of 120 minima from 120 functions. Bands of the signature find
candidates, and every link is confirmed on the full shingle sets.

Each bucket of a band has a head, and each document is held against the heads of its buckets by
what it has more or less than they. The difference of two members of a bucket follows exactly from
their differences to its head, so what is not linked to the head is compared with the rest of
the bucket by these short lists, block by block inside tasks: full sets move once per document and head,
and no pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, groups_of, pieces, smallest_reached, texts, written

FUNCTIONS, ROWS = 60, 5
BANDS = 2 * FUNCTIONS // ROWS
BUNDLE = 1_000_000  # elements of difference lists in one block

_random = np.random.default_rng(20240229)
FACTORS = _random.integers(0, 2**64, FUNCTIONS, np.uint64) | np.uint64(1)
SHIFTS = _random.integers(0, 2**64, FUNCTIONS, np.uint64)
ODD = _random.integers(0, 2**64, 8, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(33))) * ODD[6]
    x = (x ^ (x >> np.uint64(29))) * ODD[7]
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of a shorter text the whole as one."""
    found = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        total = mixed(total * ODD[0] + h[k : len(h) - width + 1 + k] * ODD[1])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys (documents x BANDS) of non-empty sets; keys of different bands differ."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    flat = np.concatenate(sets)
    values = np.empty((len(sets), 2 * FUNCTIONS), np.uint64)
    for k in range(FUNCTIONS):
        h = (flat ^ SHIFTS[k]) * FACTORS[k]
        values[:, k] = np.minimum.reduceat(h, starts)
        values[:, FUNCTIONS + k] = np.maximum.reduceat(h, starts)
    values = mixed(values)
    bands = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
    for r in range(ROWS):
        bands = mixed(bands * ODD[2] + values[:, r::ROWS])
    return bands.view(np.int64)


def set_name(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def sign(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands); equal sets have equal set_id, empty ones null."""

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches):
            sets = [shingles(t, words) for t in part.column("text").to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            bands, names = [None] * len(sets), [None] * len(sets)
            if full:
                for k, b in zip(full, signatures([sets[k] for k in full]), strict=True):
                    bands[k], names[k] = b, set_name(sets[k])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    return texts(df).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>")


def full_sets(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of the rows (doc_id, text, set_id) whose text has the set of that name."""

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches):
            ids, sets = [], []
            for doc, text, name in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "set_id")), strict=True):
                found = shingles(text, words)
                if set_name(found) == name:
                    ids.append(doc)
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return df.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def similar(n, m, delta, percent: int):
    """Whether sets of n and m elements that differ by ``delta`` elements are similar enough."""
    return (n + m - delta) * 100 >= (n + m + delta) * percent


def overlaps(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], step: int = 2048) -> np.ndarray:
    """Numbers of elements that each list of ``first`` shares with each of ``second``; both are (elements, borders)."""
    (x, at), (y, bt) = first, second
    common = np.intersect1d(x, y)
    total = np.zeros((len(at) - 1, len(bt) - 1), np.float32)
    for k in range(0, len(common), step):
        part, sides = common[k : k + step], []
        for values, borders in (first, second):
            column = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[column] == values
            side = np.zeros((len(borders) - 1, len(part)), np.float32)
            side[np.repeat(np.arange(len(borders) - 1), np.diff(borders))[hit], column[hit]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def linked(percent: int):
    """Links among the rows of each cell: what is not linked to the head, against all of another block."""

    def run(batches: Iterator) -> Iterator:
        for cell in groups_of(batches, ["head", "i", "j"]):
            odd = cell.column("odd").combine_chunks().to_numpy(zero_copy_only=False)
            doc, n = cell.column("doc").to_numpy(), cell.column("n").to_numpy()
            delta = cell.column("delta").combine_chunks()
            a, b = np.flatnonzero(odd), np.flatnonzero(~odd)
            first, second = (lists(delta.take(pa.array(k))) for k in (a, b))
            apart = np.diff(first[1])[:, None] + np.diff(second[1])[None, :] - 2 * overlaps(first, second)
            x, y = np.nonzero(similar(n[a][:, None], n[b][None, :], apart, percent) & (doc[a][:, None] != doc[b][None, :]))
            if len(x):
                low = smallest_reached(doc, a[x], b[y])
                got = np.flatnonzero(low != doc)
                yield pa.RecordBatch.from_arrays([pa.array(doc[got]), pa.array(low[got])], ["a", "b"])

    return run


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by shingle sets with a Jaccard similarity of ``percent`` or more.

    Rows (doc_id, n_shingles, component_id, kept): one per id, component_id being the smallest id
    reachable by links and kept telling that it is the id itself. Documents without a word link
    with nothing. Rows with one id are expected to be one document (of repeated rows the one with the
    most shingles counts); a null id is left out. Other columns are not read.

    Equal sets are put together first, so that only one document of each goes further. The head of a
    bucket is the document with most company in all its buckets. Two members of a bucket are
    both linked to its head, or one of them is odd; odd ones meet all members of the head in
    cells of at most ``block`` documents (or BUNDLE elements of their difference lists) on
    either side, and a cell gives one link per document towards the smallest that it reaches.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    signed = sign(docs, words).groupBy("doc_id").agg(F.max(F.struct("n_shingles", "set_id", "bands")).alias("r")).select("doc_id", "r.*")
    signed = written(signed, "signed")
    whole = signed.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    whole = written(whole.select("set_id", F.col("r.doc_id").alias("doc"), "r.bands"), "whole")
    rows = whole.select("doc", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(rows.join(sizes, "bucket"), "shared")
    # the more company a document has over all buckets, the nearer it is to what its copies have in common
    company = shared.groupBy("doc").agg(F.sum("size").alias("company"))
    heads = shared.join(company, "doc").groupBy("bucket").agg(F.max(F.expr("struct(company, -doc as o)")).alias("r")).select("bucket", (-F.col("r.o")).alias("head"))
    pairs = written(shared.join(heads, "bucket").where("doc <> head").select("doc", "head").distinct(), "pairs")

    wanted = pairs.select("doc").union(pairs.select("head")).distinct()
    wanted = whole.join(wanted, "doc", "left_semi").select("doc", "set_id")
    sets = texts(docs).join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "set_id")
    sets = written(full_sets(sets, words).dropDuplicates(["doc_id"]), "sets")  # repeated rows have one set
    mine, theirs = sets.toDF("doc", "x"), sets.toDF("head", "y")
    stars = pairs.join(mine, "doc").join(theirs, "head")
    stars = stars.select("head", "doc", F.size("x").alias("n"), F.size("y").alias("m"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("delta"))
    stars = written(stars.withColumn("odd", ~similar(F.col("n"), F.col("m"), F.size("delta"), percent)), "stars")
    for t in (shared, pairs, sets):
        forget(t)

    weight = F.size("delta")
    odd = F.col("odd").cast("int")
    groups = stars.groupBy("head").agg(F.count(F.lit(1)).alias("all"), F.sum(weight).alias("elements"), F.sum(odd).alias("odds"), F.sum(weight * odd).alias("odd_elements")).where("`all` > 1 and odds > 0")
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / max(1, block)), F.ceil(F.col(size) / BUNDLE)).cast("int")
    groups = groups.select("head", parts("odds", "odd_elements").alias("odd_parts"), parts("all", "elements").alias("all_parts"))
    member = stars.select("head", "doc", "n", "delta", "odd").join(groups, "head")
    spread = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = member.where("odd").select("head", spread("odd_parts").alias("i"), every("all_parts").alias("j"), F.lit(True).alias("odd"), "doc", "n", "delta")
    right = member.select("head", every("odd_parts").alias("i"), spread("all_parts").alias("j"), F.lit(False).alias("odd"), "doc", "n", "delta")
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = left.union(right).repartition(tasks, "head", "i", "j").sortWithinPartitions("head", "i", "j")
    more = cells.mapInArrow(linked(percent), "a bigint, b bigint")

    links = stars.where("not odd").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    found = components(links.union(more))
    forget(stars)
    classes = whole.select("set_id", "doc").join(found, F.col("doc") == F.col("node"), "left").select("set_id", F.coalesce("component_id", "doc").alias("class"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
