"""Cropped and edited copies of pictures, found by local image descriptors.

Corners on the levels of a pyramid get a main direction (from the centre of mass of the patch around
them) and a code of binary brightness tests turned into that direction. Codes are cut into substrings,
each the key of a Hamming table. Pictures that share keys are candidates; two corners match when their
whole codes differ in few bits, and a pair of pictures is linked when enough of its matches agree on one
scale, turn and shift.

Each key has a head, the picture with most corners among those that hold it, and every picture is
judged against its heads. Two pictures under one head are either both linked to it, or one of them is
odd; odd ones meet all pictures of that head, block by block inside tasks. So the number of passes
over the table is fixed, and no pairs inside a group are written.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, groups_of, written

TABLES, TABLE_BITS = 4, 56
RADIUS, MARGIN = 9, 12
APART = 5  # a corner is the strongest within so many cells, so corners grow with the area and shift with the picture
LEVEL_STEP = 2.0**0.5  # factor in size from one level to the next
TURNS = 64
DIFFER = 32  # bits of a code in which two matching corners differ at most
EVIDENCE = 2  # keys that two pictures share at least
PLACE = 6  # bits below a key
BLOCK = 256  # pictures on either side of a cell
BATCH = 64  # pictures described, and pairs judged, at once
PACK = 1024  # keys in one row at most while they are shuffled
CORNER = np.dtype([("y", "<u2"), ("x", "<u2"), ("level", "u1"), ("angle", "u1"), ("code", "u1", TABLES * TABLE_BITS // 8)])

_random = np.random.default_rng(77)
TESTS = np.clip(_random.normal(0, RADIUS / 2.2, (TABLES * TABLE_BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
_turn = (np.arange(TURNS) * 2 * np.pi / TURNS)[:, None, None]
DOWN = np.rint(TESTS[..., 0] * np.cos(_turn) + TESTS[..., 1] * np.sin(_turn)).astype(np.int32)  # (turn, test, end)
ACROSS = np.rint(TESTS[..., 1] * np.cos(_turn) - TESTS[..., 0] * np.sin(_turn)).astype(np.int32)
DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])


def packed(rows: np.ndarray) -> bytes:
    """CORNER records field by field: high bytes and levels stand in runs, which files and shuffles compress."""
    high = [(rows[name] >> shift).astype(np.uint8).tobytes() for name in ("y", "x") for shift in (0, 8)]
    return b"".join([*high, *(rows[name].tobytes() for name in ("level", "angle", "code"))])


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // CORNER.itemsize
    rows, flat = np.empty(n, CORNER), np.frombuffer(data, np.uint8)
    plane = flat[: 6 * n].reshape(6, n).astype(np.uint16)
    rows["y"], rows["x"] = plane[0] | plane[1] << 8, plane[2] | plane[3] << 8
    rows["level"], rows["angle"], rows["code"] = plane[4], plane[5], flat[6 * n :].reshape(n, *CORNER["code"].shape)
    return rows


def slid(a: np.ndarray, n: int, join: np.ufunc) -> np.ndarray:
    """``join`` (add or maximum) over squares of n cells of each picture of a stack; sides shrink by n - 1."""
    for axis in (1, 2):
        cut = lambda v, at, size: v[(slice(None),) * axis + (slice(at, at + size),)]  # noqa: B023, E731
        if join is np.add:
            size = a.shape[axis] - n + 1
            a = sum(cut(a, k, size) for k in range(n))
            continue
        have = 1
        while have < n:  # runs of 2, 4, 8, ... cells
            more = min(have, n - have)
            size = a.shape[axis] - more
            a = np.maximum(cut(a, 0, size), cut(a, more, size))
            have += more
    return a


def corners(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picture, row and column of all corners of a stack, at least MARGIN from the border."""
    m, (h, w) = MARGIN, img.shape[1:]
    gy, gx = img[:, 2:, 1:-1] - img[:, :-2, 1:-1], img[:, 1:-1, 2:] - img[:, 1:-1, :-2]
    xx, yy, xy = (slid(p, 3, np.add) for p in (gx * gx, gy * gy, gx * gy))
    r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2  # cell 0 is cell 2 of the picture
    far = m - 2 - APART
    top = slid(r[:, far : h - 4 - far, far : w - 4 - far], 2 * APART + 1, np.maximum)
    c = r[:, m - 2 : h - 2 - m, m - 2 : w - 2 - m]
    z, y, x = np.nonzero((c == top) & (c > 1e-3 * np.maximum(r.max((1, 2)), 1e-9)[:, None, None]))
    return z, y + m, x + m


def shrunk(img: np.ndarray, factor: float) -> np.ndarray:
    """A stack of pictures made smaller by ``factor`` along both sides; each cell is the mean of the area it covers."""
    for axis in (1, 2):
        if factor == 2:
            size = img.shape[axis] // 2 * 2
            even, odd = ((slice(None),) * axis + (slice(k, size, 2),) for k in (0, 1))
            img = (img[even] + img[odd]) / 2
            continue
        edge = np.arange(int(img.shape[axis] / factor + 1e-9) + 1) * factor
        low = np.minimum(edge.astype(int), img.shape[axis] - 1)
        total = np.insert(np.cumsum(img, axis=axis, dtype=float), 0, 0, axis=axis)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(3)])
        at = total.take(low, axis)
        img = np.diff(at + part * (total.take(low + 1, axis) - at), axis=axis) / factor
    return img.astype(np.float32)


def describe(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Picture number and CORNER record of all corners of a stack of grey pictures.

    Level k is smaller by LEVEL_STEP ** k; levels go on until no place is far enough from the border.
    Places are those of the full picture.
    """
    full = full.astype(np.float32)
    who, found, level, above = [np.empty(0, int)], [np.empty(0, CORNER)], 0, []
    while True:
        # two levels on, sides are halved
        img = full if not level else shrunk(full, LEVEL_STEP) if level == 1 else shrunk(above[level - 2], 2)
        above.append(img)
        h, w = img.shape[1:]
        if min(h, w) < 2 * MARGIN + 3:
            return np.concatenate(who), np.concatenate(found)
        every = corners(img)
        smooth = np.zeros_like(img)
        smooth[:, 1:-1, 1:-1] = slid(img, 3, np.add)
        bright, smooth = img.ravel(), smooth.ravel()
        around, away = DISC[:, 0] * w + DISC[:, 1], DOWN * w + ACROSS
        for k in range(0, len(every[0]), 1 << 13):
            z, y, x = (v[k : k + (1 << 13)] for v in every)
            at = (z * h + y) * w + x
            patch = bright[at[:, None] + around]
            patch -= patch.mean(1, keepdims=True)
            angle = np.arctan2(patch @ DISC[:, 0].astype(np.float32), patch @ DISC[:, 1].astype(np.float32)) / (2 * np.pi)
            value = smooth[at[:, None, None] + away[np.rint(angle * TURNS).astype(int) % TURNS]]
            rows = np.empty(len(z), CORNER)
            for name, v in (("y", y), ("x", x)):
                rows[name] = np.minimum(np.rint((v + 0.5) * LEVEL_STEP**level - 0.5), 65535)
            rows["level"], rows["angle"] = level, np.rint(angle * 256).astype(int) % 256
            rows["code"] = np.packbits(value[..., 0] < value[..., 1], axis=1)
            who.append(z)
            found.append(rows)
        level += 1


def grey(width: int, height: int, channels: int, data: bytes) -> np.ndarray | None:
    """Brightness of an uncompressed picture in row order; None if the sizes do not fit."""
    if not width or not height or not channels or data is None or len(data) != width * height * channels:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3].mean(2, dtype=np.float32)


def describe_all(df: DataFrame) -> DataFrame:
    """Corners of each picture, ``packed``: (image_id, same, n_corners, corners)."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * BATCH):
                shapes: dict[tuple | None, list] = {}
                for row in batch.slice(start, 4 * BATCH).to_pylist():
                    img = grey(row["width"], row["height"], row["nChannels"], row["data"])
                    shapes.setdefault(None if img is None else img.shape, []).append((row["image_id"], row["same"], img))
                for shape, of_shape in shapes.items():
                    step = BATCH if shape is None else max(1, min(BATCH, (1 << 22) // math.prod(shape)))
                    for at in range(0, len(of_shape), step):
                        part = of_shape[at : at + step]
                        found = [np.empty(0, CORNER)] * len(part)
                        if shape is not None:
                            z, rows = describe(np.stack([s[2] for s in part]))
                            order = np.argsort(z, kind="stable")
                            found = np.split(rows[order], np.searchsorted(z[order], np.arange(1, len(part))))
                        arrays = [pa.array([s[0] for s in part], pa.int64()), pa.array([s[1] for s in part], pa.binary())]
                        arrays += [pa.array([len(f) for f in found], pa.int64()), pa.array([packed(f) for f in found], pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, ["image_id", "same", "n_corners", "corners"])

    return df.mapInArrow(run, "image_id bigint, same binary, n_corners bigint, corners binary")


def table_keys(rows: np.ndarray) -> np.ndarray:
    """Keys (corners x TABLES) of CORNER records; the number of the table stands above the bits."""
    parts = rows["code"].reshape(len(rows), TABLES, TABLE_BITS // 8).astype(np.int64)
    return parts @ (1 << 8 * np.arange(TABLE_BITS // 8, dtype=np.int64)) | np.arange(TABLES, dtype=np.int64) << TABLE_BITS


def spots(parts: int):
    """(part, n, tags, bits): the keys of each picture, once, those of a batch and a part in one row (PACK to a row).

    A spot is the key with a place by number of corners below it, the most first; its part follows from the key.
    Docs stand in ascending order, each as its distance from the one before in as few bytes as the largest distance needs;
    these and the few values of table and place are deflated, the TABLE_BITS bits of keys are random and stay as they are.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            keys = [np.unique(table_keys(unpacked(b))) for b in batch.column("corners").to_pylist()]
            if not any(map(len, keys)):
                continue
            n = np.maximum(1, batch.column("n_corners").to_numpy())
            place = 63 - np.minimum(63, 4 * np.log2(n)).astype(np.int64)
            size = [len(k) for k in keys]
            key, doc = np.concatenate(keys), np.repeat(batch.column("doc").to_numpy(), size)
            tag = (key >> TABLE_BITS << PLACE | np.repeat(place, size)).astype(np.uint8)
            part = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts
            order = np.lexsort((doc, part))
            part, doc, tag = part[order], doc[order], tag[order]
            bits = key[order].astype("<i8").view(np.uint8).reshape(-1, 8)[:, : TABLE_BITS // 8]
            edge = np.union1d(np.flatnonzero(np.diff(part)) + 1, np.arange(0, len(part), PACK)).tolist()
            out = []
            for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
                apart = np.diff(doc[a:b].astype(np.uint64))  # no sign: distances of far ids fit too
                width = np.min_scalar_type(int(apart.max())) if len(apart) else np.dtype(np.uint8)
                tags = doc[a : a + 1].tobytes() + tag[a:b].tobytes() + apart.astype(width).tobytes()
                out.append((int(part[a]), b - a, zlib.compress(tags, 1), bits[a:b].tobytes()))
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "n", "tags", "bits"])

    return run


def spread_spots(batches: Iterator) -> Iterator:
    """(spot, doc) of the rows of ``spots``, row by row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            spot, doc = [], []
            for n, tags, bits in zip(*(part.column(c).to_pylist() for c in ("n", "tags", "bits")), strict=True):
                tags = zlib.decompress(tags)
                first, tag = np.frombuffer(tags, np.uint64, 1), np.frombuffer(tags, np.uint8, n, 8).astype(np.int64)
                apart = np.frombuffer(tags, f"<u{(len(tags) - 8 - n) // (n - 1)}", offset=8 + n) if n > 1 else []
                doc.append(np.cumsum(np.concatenate([first, np.asarray(apart, np.uint64)])).view(np.int64))
                wide = np.zeros((n, 8), np.uint8)
                wide[:, : TABLE_BITS // 8] = np.frombuffer(bits, np.uint8).reshape(n, -1)
                key = wide.view("<i8")[:, 0] | tag >> PLACE << TABLE_BITS
                spot.append(key << PLACE | tag & (1 << PLACE) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(spot)), pa.array(np.concatenate(doc))], ["spot", "doc"])


def heads_of(batches: Iterator) -> Iterator:
    """(doc, head) for the rows of each key, which come one after the other with the head in front; no key is held."""
    last, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = batch.column("spot").to_numpy() >> PLACE, batch.column("doc").to_numpy()
        new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        heads = np.where(first < 0, head if head is not None else 0, doc[first])
        last, head = key[-1], heads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[~new]), pa.array(heads[~new])], ["doc", "head"])


def agrees(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether ``least`` corners on either side match and agree on scale, turn and shift.

    Bins of turn and shift overlap by half, so that a border between bins splits no consensus.
    """
    # codes as 64-bit words, the last one padded
    words = [np.pad(r["code"], ((0, 0), (0, -r["code"].shape[1] % 8))).view(np.uint64) for r in (a, b)]
    apart = sum(np.bitwise_count(words[0][:, None, k] ^ words[1][None, :, k]).astype(np.uint16) for k in range(words[0].shape[1]))
    i, j = np.nonzero(apart <= DIFFER)
    if len(i) < least:
        return False
    scale = b["level"][j].astype(int) - a["level"][i]
    turn = (b["angle"][j].astype(int) - a["angle"][i]) % 256
    half = 256 // 24 + 1
    bins = turn // half
    wraps = -(-256 // half)
    match, bins = np.tile(np.arange(len(i)), 2), np.concatenate([bins, (bins - 1) % wraps])
    # the turn of the bin, not of the match, moves the first corner: directions are coarse. Near 0 it is 0, as most edits do not turn
    near = np.minimum(turn[match], 256 - turn[match]) < half // 2 + 2
    mid = np.where(near, 0.0, (bins + 1) * half * 2 * np.pi / 256)
    size = LEVEL_STEP ** scale[match].astype(float)
    y, x = a["y"][i[match]].astype(float), a["x"][i[match]].astype(float)
    ty = np.floor((b["y"][j[match]] - size * (y * np.cos(mid) + x * np.sin(mid))) / 8).astype(np.int64)
    tx = np.floor((b["x"][j[match]] - size * (x * np.cos(mid) - y * np.sin(mid))) / 8).astype(np.int64)
    group = (scale[match] + 64) * 64 + np.where(near, 63, bins)
    shift = np.stack([ty, tx])
    for k in (0, 1):
        match, group, shift = np.tile(match, 2), np.tile(group, 2), np.tile(shift, 2)
        t = shift[k] - np.repeat([0, 1], len(match) // 2)
        _, group, n = np.unique(group * (1 << 40) + t + (1 << 39), return_inverse=True, return_counts=True)
        keep = n[group] >= least
        match, group, shift = match[keep], group[keep], shift[:, keep]
    for side in (i, j):
        if len(group):
            pairs = np.unique(np.stack([group, side[match]], 1), axis=0)[:, 0]
            keep = np.bincount(pairs, minlength=group.max() + 1)[group] >= least
            match, group = match[keep], group[keep]
    return len(group) > 0


def judged(least: int):
    """(doc, head, odd) for pairs with the corners of both, x and y."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sides = zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)
                odd = [not agrees(unpacked(x), unpacked(y), least) for x, y in sides]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("head"), pa.array(odd)], ["doc", "head", "odd"])

    return run


def linked(least: int):
    """Links among the pictures of each cell: odd ones against all of a block of their head's pictures."""

    def run(batches: Iterator) -> Iterator:
        for cell in groups_of(batches, ["head", "i", "j"]):
            odd = cell.column("odd").combine_chunks().to_numpy(zero_copy_only=False)
            doc, blobs = cell.column("doc").to_numpy(), cell.column("corners").to_pylist()
            rows = [unpacked(b) for b in blobs]
            keys = [np.unique(table_keys(r)) for r in rows]
            names, name = np.unique(doc, return_inverse=True)
            label = np.arange(len(names))
            right = np.flatnonzero(~odd)
            spot, of = np.concatenate([keys[k] for k in right] or [np.empty(0, np.int64)]), np.repeat(right, [len(keys[k]) for k in right])
            order = np.argsort(spot, kind="stable")
            spot, of = spot[order], of[order]
            for k in np.flatnonzero(odd):
                low = np.searchsorted(spot, keys[k], "left")
                n = np.searchsorted(spot, keys[k], "right") - low
                shared = np.bincount(of[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(doc))
                for other in np.flatnonzero(shared >= EVIDENCE):
                    one, two = sorted((label[name[k]], label[name[other]]))
                    if one != two and agrees(rows[k], rows[other], least):
                        label[label == two] = one
            got = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[got]), pa.array(names[label[got]])], ["a", "b"])

    return run


def copies(df: DataFrame, least: int = 5, id_col: str = "image_id") -> DataFrame:
    """Classes of pictures that are cropped or edited copies of each other.

    ``df`` has Spark's image columns (width, height, nChannels, data) beside the id. Rows
    (image_id, n_corners, component_id, kept), one per id; a null id is left out. Pictures that are
    null, empty, of wrong size or without corners link with nothing but equal ones; equal ones are put together first.
    Of rows with one id the largest by a hash of its bytes counts. Other columns are not read.

    Two pictures are candidates when they share EVIDENCE keys with each other and with a common head, and are linked when
    ``least`` corners on either side match in all but DIFFER bits and agree on scale, turn and shift. All
    corners count; they are the strongest within APART cells at levels a factor of LEVEL_STEP apart, so
    their number grows with the area of the picture, and copies find the same ones.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("image_id"), "width", "height", "nChannels", "data").where("image_id is not null")
    rows = rows.withColumn("same", F.unhex(F.substring(F.sha2(F.concat_ws("|", "width", "height", "nChannels", F.sha2("data", 256)), 256), 1, 32)))
    # pictures are read and described once, and their corners are written without a shuffle; ``row`` is fixed by the files
    described = written(describe_all(rows).withColumn("row", F.monotonically_increasing_id()), "described")
    ids = described.groupBy("image_id").agg(F.max(F.struct("same", "row", "n_corners")).alias("r"))
    ids = written(ids.select("image_id", "r.*"), "ids")
    groups = written(ids.groupBy("same").agg(F.min(F.struct("image_id", "row")).alias("r")).select("same", F.col("r.image_id").alias("doc"), "r.row"), "groups")
    # rows outdone by another of their id or equal to another picture; where they are few Spark broadcasts them by the size of their file
    spare = written(described.select("row").join(groups.select("row"), "row", "left_anti"), "spare")
    rich = described.where(F.col("n_corners") >= least).join(spare, "row", "left_anti").select(F.col("image_id").alias("doc"), "n_corners", "corners")
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rich.mapInArrow(spots(8 * tasks), "part int, n int, tags binary, bits binary").repartition(tasks, "part")
    keyed = keyed.mapInArrow(spread_spots, "spot bigint, doc bigint").sortWithinPartitions("spot", "doc")
    pairs = keyed.mapInArrow(heads_of, "doc bigint, head bigint").groupBy("doc", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= EVIDENCE).select("doc", "head")
    pairs = written(pairs, "pairs")

    wanted = written(pairs.select("doc").union(pairs.select("head")).distinct(), "wanted")
    sets = written(rich.join(wanted, "doc", "left_semi").select("doc", "corners"), "sets")
    forget(described)
    stars = pairs.join(sets.toDF("doc", "x"), "doc").join(sets.toDF("head", "y"), "head")
    stars = written(stars.mapInArrow(judged(least), "doc bigint, head bigint, odd boolean"), "stars")

    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    crowd = stars.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("odd").cast("int")).alias("odds")).where("n > 1 and odds > 0")
    crowd = crowd.select("head", parts("odds").alias("odd_parts"), parts("n").alias("all_parts"))
    member = stars.join(crowd, "head")
    spread = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = member.where("odd").select("head", spread("odd_parts").alias("i"), every("all_parts").alias("j"), F.lit(True).alias("odd"), "doc")
    right = member.select("head", every("odd_parts").alias("i"), spread("all_parts").alias("j"), F.lit(False).alias("odd"), "doc")
    cells = left.union(right).join(sets, "doc").repartition(tasks, "head", "i", "j").sortWithinPartitions("head", "i", "j")
    more = cells.mapInArrow(linked(least), "a bigint, b bigint")

    links = written(stars.where("not odd").select(F.col("doc").alias("a"), F.col("head").alias("b")).union(more), "found")
    for done in (spare, pairs, wanted, sets, stars):
        forget(done)
    classes = groups.join(components(links), F.col("doc") == F.col("node"), "left").select("same", F.coalesce("component_id", "doc").alias("component_id"))
    out = ids.join(classes, "same").select("image_id", "n_corners", "component_id")
    return out.withColumn("kept", F.col("image_id") == F.col("component_id"))
