"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window of text that shares strings with a dictionary compresses to fewer bytes with it. Each
whole text is cut into small windows at spaces, each window is compressed with both
dictionaries, and the differences of the lengths are summed up in a few figures (mean,
share of windows above each threshold) whose calibrated combination is the score.

Toxic documents are mostly ordinary text, which would crowd all else out of their dictionary. So the toxic
dictionary is trained on those runs of bytes of toxic documents whose short strings far fewer ordinary
documents hold, wherever words begin or end; passages that documents repeat count once. Both
dictionaries hold the same ordinary text besides, so only what is toxic's own differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, pieces, texts

LEVEL = 9
THRESHOLDS = (2, 3, 4, 5)
FEW = 8  # windows
GRAM, RATIO, SUPPORT = 6, 8.0, 0.03
LONG, APART = 32, 8
SLOTS = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)
CODES = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64)


def windows(raw: bytes, size: int) -> list[bytes]:
    """Consecutive windows of at most ``size`` bytes, cut before a space of their second half if there is one."""
    out, at = [], 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at + size // 2, at + size)
        cut = cut if cut > 0 else at + size
        out.append(raw[at:cut])
        at = cut
    return [*out, raw[at:]]


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """Content of a dictionary trained on ``samples``; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@lru_cache(maxsize=4)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    size: int
    coef: np.ndarray = field(default_factory=lambda: np.zeros(1 + 2 * len(THRESHOLDS)))
    bias: float = -1.0

    def figures(self, raw: bytes) -> list[float]:
        """Mean gain and shares of windows, which do not grow with the text; those of short texts are damped."""
        plain, toxic = compressor(self.ordinary).compress, compressor(self.toxic).compress
        gain = np.array([len(plain(w)) - len(toxic(w)) for w in windows(raw, self.size)], float)
        shares = [(gain >= t).sum() / (len(gain) + FEW) for t in THRESHOLDS]
        return [gain.mean(), *shares, *np.sqrt(shares)]

    def score(self, raws: list[bytes]) -> np.ndarray:
        x = np.array([self.figures(r) for r in raws]).reshape(len(raws), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef + self.bias, -30, 30)))


def hashes(raw: bytes, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes, A-Z lowered."""
    data = np.frombuffer(raw.lower(), np.uint8)
    out = np.zeros(max(0, len(data) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ CODES[data[k : k + len(out)]]) * ODD
    return out ^ (out >> np.uint64(31))


def covered(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a string of ``width`` bytes that starts at one of ``places``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, np.minimum(places + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def new_bytes(docs: list[bytes]) -> list[np.ndarray]:
    """Which bytes of each text are not in a string of LONG bytes that an earlier text or place had; one of APART strings, chosen by its hash, is looked at."""
    places, names = [], []
    for raw in docs:
        found = hashes(raw, LONG)
        places.append(np.flatnonzero(found % np.uint64(APART) == 0))
        names.append(found[places[-1]])
    flat = np.concatenate(names)
    again = np.ones(len(flat), bool)
    again[np.unique(flat, return_index=True)[1]] = False
    parts = np.split(again, np.cumsum([len(p) for p in places])[:-1])
    return [~covered(p[old], LONG, len(raw)) for raw, p, old in zip(docs, places, parts, strict=True)]


def own_strings(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of bytes of toxic texts whose strings of GRAM bytes ordinary texts do not share: at least RATIO times as large a part of toxic texts holds them.

    Passages that texts repeat count once, so that copies of one text and lines found in many do not pass for what toxic texts have in common.
    """
    counts, new = np.zeros((2, SLOTS), np.int32), new_bytes(ordinary + toxic)
    slots = lambda raw: (hashes(raw, GRAM) % np.uint64(SLOTS)).astype(np.int64)
    for k, raw in enumerate(ordinary + toxic):
        new[k] = new[k][: max(0, len(raw) - GRAM + 1)]
        counts[int(k >= len(ordinary))][np.unique(slots(raw)[new[k]])] += 1
    rate = (counts[1] / max(1, len(toxic))) / ((counts[0] + 1) / (len(ordinary) + 1))
    telling, out = (counts[1] >= max(4, SUPPORT * len(toxic))) & (rate >= RATIO), []
    for raw, now in zip(toxic, new[len(ordinary) :], strict=True):
        edge = np.flatnonzero(np.diff(covered(np.flatnonzero(telling[slots(raw)] & now), GRAM, len(raw)).astype(np.int8), prepend=0, append=0))
        out += [raw[max(0, a - 1) : b + 1].lower() for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def dictionaries(raw: list[bytes], y: np.ndarray, use: np.ndarray, size: int, room: int) -> Model:
    """The two dictionaries of the texts that ``use`` marks; the score is not set."""
    toxic, ordinary = ([raw[k] for k in np.flatnonzero((y == c) & use)] for c in (1, 0))
    own = own_strings(toxic, ordinary)
    common = trained([w for d in ordinary for w in windows(d, 4 * size)], room)
    special = trained(own, room // 4, d=6, k=32)
    return Model(common, common + special, size)


def fit(
    df: DataFrame, labels: DataFrame, use: Column, per_class: int = 4000, max_chars: int = 8000, size: int = 32, dictionary: int = 8192,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Train on a bounded sample of labelled rows.

    ``use`` is a condition on the id column of ``labels`` that names the rows to learn from. About ``per_class`` rows of each class are drawn by
    a hash of the id, and of a text over ``max_chars`` characters a piece of that length, at a place that depends on the id. Null and empty texts and
    labels that are null or neither 0 nor 1 are not learned from, and equal pieces count once. The labels are read before the texts, so that
    only drawn texts are kept. The weights of the score, and the threshold that becomes 0.5 (that of the best F1), are set on each half of the sample
    with dictionaries of the other half; the final dictionaries are of both. With one class missing, or an empty table, the score is constant: the
    share of toxic labels.
    """
    marked = labels.where(use).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    counts = dict(marked.groupBy("y").count().collect())
    n = {y: counts.get(y, 0) for y in (0, 1)}
    prior = n[1] / max(1, n[0] + n[1])
    flat = Model(b"", b"", size, bias=float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    if not n[0] or not n[1]:
        return flat
    share = F.when(F.col("y") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # the drawn labels are at most about 2 * per_class rows, so they fit any executor
    held = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id").where(F.octet_length("text") > 0)
    spare = F.greatest(F.length("text") - max_chars, F.lit(0))
    piece = F.substring("text", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), spare + 1) + 1).cast("int"), F.lit(max_chars))
    held = held.select("doc_id", piece.alias("text"), "y")
    got = held.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "text", "y")).alias("r")).select("r.*").orderBy("doc_id").collect()
    raw, y = [r.text.encode() for r in got], np.array([r.y for r in got])
    side = np.arange(len(raw)) % 2
    if min((y[side == s] == c).sum() for s in (0, 1) for c in (0, 1)) == 0:
        return flat
    halves = [dictionaries(raw, y, side == s, size, dictionary) for s in (0, 1)]
    x = np.array([halves[1 - side[k]].figures(raw[k]) for k in range(len(raw))])
    target = y.astype(float)
    weight = np.where(target == 1, n[1] / target.sum(), n[0] / (1 - target).sum())
    weight /= weight.mean()
    model = dictionaries(raw, y, side >= 0, size, dictionary)
    model.coef, model.bias = fit_logistic(x, target, weight)
    model.bias -= best_threshold(x @ model.coef + model.bias, target, weight)
    return model


def best_threshold(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """The value between two of ``z`` above which rows are called positive with the best F1."""
    order = np.argsort(-z)
    hits, called = np.cumsum((weight * target)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (called + hits[-1])))
    return float(np.clip(z[order[best : best + 2]].mean(), -30, 30))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each whole text: rows (doc_id, score, predicted), one per input row, score in 0 to 1.

    A null or empty text is one empty window; texts are read whole, very long ones one at a time. Rows with one id, a null id
    or equal texts have a row each. Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches):
            s = model.score([t.encode() for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, score double, predicted int")
