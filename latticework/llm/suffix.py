"""Repeated passages by merging Burrows-Wheeler transforms, after content-chosen anchors have dealt out the work.

A string of ``length`` bytes that occurs twice holds the same anchor in both places: of all half-length
grams in a window the one with the smallest hash (winnowing). So windows with equal text fall
under the same anchor, and only texts around an anchor that occurs more than once are looked at:

1. Each document lists its runs of consecutive windows with one anchor: position, anchor, hash of the text.
2. Runs with equal text at two places are repeated as a whole; counting them needs no text.
3. The remaining texts of an anchor are dealt into two shards. Each shard's transform comes from its own
   suffix array, and the two are merged by refining their interleaving letter by letter.
   The step at which neighbours are told apart is their common prefix, so the intervals that are
   left after ``length`` bytes are the repeated strings.

An anchor with more than GROUP different texts does not fit one task; the windows of its texts are
compared by 128-bit hashes instead, which Spark deals out like any other key.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces, texts, written

GROUP = 256
LONGEST = 4096  # windows in one run
BATCH = 60_000  # bytes merged at once: then letters fit 16 bits, whose stable sort is linear

_random = np.random.default_rng(400)
BYTE_CODES = _random.integers(0, 2**64, (2, 256), np.uint64)
BASE = _random.integers(0, 2**64, 2, np.uint64) << np.uint64(3) | np.uint64(5)
ODD = _random.integers(0, 2**64, 2, np.uint64) | np.uint64(1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` bytes, by sums over a polynomial modulo 2^64."""
    n = len(raw)
    inverse = np.uint64(pow(int(BASE[kind]), -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[kind][raw] * _powers(n, BASE[kind]), dtype=np.uint64)])
    x = (total[width:] - total[:-width]) * _powers(n - width + 1, inverse)
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def runs(raw: bytes, length: int) -> list[tuple[int, int, int, bool]]:
    """(first window, number of windows, anchor, whether it occurs twice in them) of consecutive windows that share an anchor."""
    if len(raw) < length:
        return []
    half = length // 2
    low = grams = gram_hashes(np.frombuffer(raw, np.uint8), half)
    span, done = length - half + 1, 1
    while done < span:  # the smallest of ``span`` grams, by doubling
        more = min(done, span - done)
        low = np.minimum(low[: len(low) - more], low[more:])
        done += more
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.concatenate([first, [len(low)]]))
    out = []
    for a, n, value, code in zip(first.tolist(), count.tolist(), low[first], low[first].view(np.int64).tolist(), strict=True):
        twice = np.count_nonzero(grams[a : a + n + length - half] == value) > 1
        out += [(a + k, min(LONGEST, n - k), code, twice) for k in range(0, n, LONGEST)]
    return out


def letter_bytes(length: int) -> int:
    """Bytes in one letter of the transforms: up to 8, and ``length`` is a whole number of letters."""
    return max(k for k in range(1, 9) if length % k == 0)


def suffix_order(letters: np.ndarray, step: int, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, of which each next letter is ``step`` places on, up to ``depth`` letters.

    ``letters`` has 0 at the ends of texts; those are told apart by place.
    """
    ends = np.flatnonzero(letters == 0)
    rank = letters.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    n, reach = len(rank), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step * reach)] = rank[step * reach :] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        _, rank = np.unique(key, return_inverse=True)
        reach *= 2
        if reach >= depth or int(rank.max()) == n - 1:
            return np.argsort(rank, kind="stable")


def transform(letters: np.ndarray, step: int, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The letter before each suffix in ``order``; 0 at the start of a text."""
    before = np.zeros(len(letters), letters.dtype)
    before[step:] = letters[:-step]
    before[(starts[:, None] + np.arange(step)).ravel()] = 0
    return before[order]


def merge(first: np.ndarray, second: np.ndarray, ends: tuple[int, int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave two transforms: (which of them each place takes, whether it begins an interval) after ``depth`` letters.

    Before step h the places are in the order of their first h - 1 letters. Putting each place, in that order,
    behind the letter before it gives the order by h letters; two neighbours are still in one
    interval if they were and have the same letter. The ends of texts stay in front.
    """
    side = np.concatenate([np.zeros(len(first), bool), np.ones(len(second), bool)])
    interval, mark = np.zeros(len(side), np.int32), np.ones(len(side), bool)
    front = np.repeat([False, True], ends)
    letter = np.empty(len(side), first.dtype)
    for _ in range(depth):
        letter[~side], letter[side] = first, second
        placed = np.argsort(letter, kind="stable")[len(front) :]  # as many places have no letter before them as texts end
        by_letter, by_interval = letter[placed], interval[placed]
        mark = np.ones(len(side), bool)
        np.not_equal(by_letter[1:], by_letter[:-1], out=mark[len(front) + 1 :])
        mark[len(front) + 1 :] |= by_interval[1:] != by_interval[:-1]
        side[len(front) :] = side[placed]
        side[: len(front)] = front
        interval = np.cumsum(mark, dtype=np.int32)
        if mark.all():
            break
    return side, mark


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its strings of ``length`` bytes (by start) occur more than once in ``parts``."""
    step = letter_bytes(length)
    depth = length // step
    flat = np.concatenate([np.frombuffer(p + bytes(step), np.uint8) for p in parts])
    size = np.array([len(p) + step for p in parts])
    stop = np.cumsum(size)
    code = np.zeros(len(flat), np.uint64)
    for k in range(step):
        code[: len(flat) - k] |= flat[k:].astype(np.uint64) << np.uint64(8 * (step - 1 - k))
    # of each text, the places where a whole letter begins, and then ``step`` ends, one for each chain of letters
    inside, held = np.ones(len(flat), bool), np.ones(len(flat), bool)
    inside[(stop[:, None] - 1 - np.arange(2 * step - 1)).ravel()] = False
    held[(stop[:, None] - 1 - np.arange(step - 1)).ravel()] = False
    letters = np.zeros(len(flat), np.int64)
    letters[inside] = np.unique(code[inside], return_inverse=True)[1] + 1
    letters, size = letters[held], size - (step - 1)
    stop = np.cumsum(size)
    kind = np.uint16 if letters.max(initial=0) < 1 << 16 else np.int64
    letters = letters.astype(kind)
    half = max(1, len(parts) // 2)
    cut = int(stop[half - 1]) if len(parts) > 1 else len(letters)
    orders, rows, ends = [], [], []
    for a, b in ((0, cut), (cut, len(letters))):
        mine = letters[a:b]
        begin = np.concatenate([[0], stop[(stop > a) & (stop < b)] - a]).astype(int) if b > a else np.empty(0, int)
        order = suffix_order(mine, step, depth) if b > a else np.empty(0, int)
        orders.append(order + a)
        rows.append(transform(mine, step, order, begin) if b > a else mine)
        ends.append(int((mine == 0).sum()))
    side, mark = merge(rows[0], rows[1], (ends[0], ends[1]), depth)
    place = np.empty(len(side), np.int64)
    place[~side], place[side] = orders[0], orders[1]
    alone = mark & np.concatenate([mark[1:], [True]])
    hit = np.zeros(len(letters), bool)
    hit[place[~alone]] = True
    return [hit[s - n : s - n + max(0, len(p) - length + 1)] for s, n, p in zip(stop.tolist(), size.tolist(), parts, strict=True)]


def spans(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes (from, to) that windows ``starts`` .. ``starts + counts - 1`` cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + counts - 1 + length)[order]
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]


def _marks(length: int):
    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, h, text in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = text.encode()
                for a, n, code, twice in runs(raw, length):
                    for column, x in zip(out, (doc, h, a, n, code, twice, blake2b(raw[a : a + n + length - 1], digest_size=16).digest()), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "h", "first", "n", "anchor", "twice", "same"])

    return run


def _cut(length: int):
    """Texts of the wanted runs of each document."""

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches, 128):
            out: list[list] = [[], [], [], [], [], [], [], []]
            for row in part.to_pylist():
                raw = row["text"].encode()
                for r in row["wanted"]:
                    x = (row["doc_id"], row["h"], r["first"], r["n"], r["anchor"], r["size"], r["once"], raw[r["first"] : r["first"] + r["n"] + length - 1])
                    for column, y in zip(out, x, strict=True):
                        column.append(y)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = ["doc_id", "h", "first", "n", "anchor", "size", "once", "part"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def _merged(length: int):
    """Repeated windows of the texts of whole anchors, which come one after the other."""

    def solve(held: list[dict]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for row, hit in zip(held, repeated([r["part"] for r in held], length), strict=True):
            if row["once"] and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for a, b in edge.reshape(-1, 2).tolist():
                    for column, x in zip(out, (row["doc_id"], row["h"], row["first"] + a, b - a), strict=True):
                        column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "h", "first", "n"])

    def run(batches: Iterator) -> Iterator:
        held, group, weight = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0]["anchor"] != row["anchor"]:
                    size = sum(len(r["part"]) for r in group)
                    if held and weight + size > BATCH:
                        yield solve(held)
                        held, weight = [], 0
                    held += group
                    weight += size
                    group = []
                group.append(row)
        if held or group:
            yield solve(held + group)

    return run


def _window_hashes(length: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["part"], np.uint8)
                w = [gram_hashes(raw, length, k).view(np.int64) for k in (0, 1)]
                n = len(w[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["h"]] * n, pa.int64()), pa.array(row["first"] + np.arange(n), pa.int32()), pa.array([row["once"]] * n, pa.bool_()), pa.array(w[0]), pa.array(w[1])],
                    ["doc_id", "h", "first", "once", "w1", "w2"],
                )

    return run


PLACE = "doc_id bigint, h bigint, first int, n int"


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (doc_id, h, first, n) for ``docs`` (doc_id, h, text)."""
    spark = docs.sparkSession
    marks = docs.where(F.octet_length("text") >= length).mapInArrow(_marks(length), PLACE + ", anchor bigint, twice boolean, same binary")
    marks = written(marks, "marks")
    often = marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice")).where("times > 1 or twice").select("anchor")
    shared = written(marks.join(often, "anchor"), "shared")
    forget(marks)
    by_text = shared.groupBy("anchor", "same").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"), F.min(F.struct("doc_id", "h", "first", "n")).alias("at"))
    by_text = written(by_text, "bytext")
    whole = shared.join(by_text.where("times > 1").select("anchor", "same"), ["anchor", "same"], "left_semi").select("doc_id", "h", "first", "n")

    sizes = by_text.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.max("twice").alias("any")).where("size > 1 or any").select("anchor", "size")
    wanted = by_text.join(sizes, "anchor").select("at.doc_id", "at.h", F.struct("anchor", "at.first", "at.n", "size", (F.col("times") == 1).alias("once")).alias("r"))
    wanted = wanted.groupBy("doc_id", "h").agg(F.collect_list("r").alias("wanted")).withColumnsRenamed({"doc_id": "id", "h": "g"})
    parts = docs.join(wanted, F.expr("doc_id <=> id and h = g")).select("doc_id", "h", "text", "wanted")
    parts = parts.mapInArrow(_cut(length), PLACE + ", anchor bigint, size bigint, once boolean, part binary")
    parts = written(parts.dropDuplicates(["doc_id", "h", "first", "anchor"]), "parts")
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = parts.where(F.col("size") <= GROUP).repartition(tasks, "anchor").sortWithinPartitions("anchor", "doc_id", "first")
    found = few.mapInArrow(_merged(length), PLACE)
    many = parts.where(F.col("size") > GROUP).mapInArrow(_window_hashes(length), "doc_id bigint, h bigint, first int, once boolean, w1 bigint, w2 bigint")
    twice = many.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    more = many.where("once").join(twice, ["w1", "w2"], "left_semi").select("doc_id", "h", "first", F.lit(1).alias("n"))
    return whole.union(found).union(more)


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text, as UTF-8 bytes, without the bytes that a repeated string of ``length`` bytes covers.

    Rows (doc_id, n_bytes, n_removed, n_spans, spans, kept), one per input row: ``spans`` are the maximal
    removed runs (from, to), ``kept`` the remaining bytes. A string counts as repeated where it also
    starts anywhere else, in the same text or another; strings never cross texts. Rows with equal id and text are two
    texts. A null or empty text has no bytes. ``length`` is 8 or more. Other columns are not read.
    """
    docs = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    found = repeated_windows(docs, length).groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "n")).alias("found")).withColumnsRenamed({"doc_id": "id", "h": "g"})

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches, 256):
            size, gone, kept = [], [], []
            for text, got in zip(part.column("text").to_pylist(), part.column("found"), strict=True):
                raw = text.encode()
                size.append(len(raw))
                if not got.is_valid:
                    gone.append([])
                    kept.append(raw)
                    continue
                a, b = spans(got.values.field("first").to_numpy(), got.values.field("n").to_numpy(), length)
                gone.append([{"from": int(x), "to": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array([n - len(k) for n, k in zip(size, kept, strict=True)], pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    rows = docs.join(found, F.expr("doc_id <=> id and h = g"), "left").select("doc_id", "text", "found")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<from:bigint,to:bigint>>, kept binary")
