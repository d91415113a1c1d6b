"""Language identification in two steps: first the family, then the language within it.

Families are told apart by one-versus-one linear support vector machines, and so are the
languages inside each family. All machines read the same hashed byte trigrams of the whole
text, so one pass over a text scores it for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fit_logistic, pieces

# Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "uralic": ["et", "fi", "hu"],
    "semitic": ["am", "ar", "he", "mt"],
}

BITS = 13


def letters_only(raw: bytes) -> np.ndarray:
    """Bytes with A-Z lowered and every ASCII byte that is no letter turned into a space."""
    return TABLE[np.frombuffer(raw, np.uint8)]


TABLE = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def grams(raw: bytes) -> np.ndarray:
    """Hashed trigrams of a text inside one space on either side, those of spaces left out."""
    x = letters_only(b" " + raw + b" ").astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    code = code[~((x[1:-1] == 32) & ((x[:-2] == 32) | (x[2:] == 32)))]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def margin_fit(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, classes weighted alike) by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    z, y, weight = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32), y.astype(np.float32), weight.astype(np.float32)
    back = np.ascontiguousarray(z.T)
    probe = np.random.default_rng(0).standard_normal(z.shape[1]).astype(np.float32)
    for _ in range(20):
        probe = back @ (weight * (z @ probe))
        size = float(np.linalg.norm(probe)) or 1.0
        probe /= size
    rate = 1 / (2.2 * size + reg)
    w = ahead = np.zeros(z.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - np.float32(rate) * (np.float32(reg) * ahead - back @ (2 * weight * y * slack))
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Trained machines. ``weights`` has a column for each; ``family`` and ``within`` say which pair it separates."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # (family or "", first, second)
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray

    def predict(self, raws: list[bytes]) -> list[tuple[str, float]]:
        found = [grams(r) for r in raws]
        sizes = np.array([len(g) for g in found], np.int64)
        margin = np.tile(self.bias, (len(raws), 1))
        if sizes.sum():
            full = sizes > 0
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            code = np.concatenate(found)
            for k in range(len(self.pairs)):
                margin[full, k] += np.add.reduceat(self.weights[:, k][code], starts) / sizes[full]
        chance = 1 / (1 + np.exp(-np.clip(margin * self.slope, -30, 30)))
        return [self._choose(c) for c in chance]

    def _choose(self, chance: np.ndarray) -> tuple[str, float]:
        def best(group: str, names: list[str]) -> tuple[str, float]:
            votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
            for k, (g, a, b) in enumerate(self.pairs):
                if g == group:
                    for name, p in ((a, chance[k]), (b, 1 - chance[k])):
                        votes[name] += p > 0.5
                        total[name] += p
            name = max(names, key=lambda n: (votes[n], total[n], n))
            return name, total[name] / (len(names) - 1) if len(names) > 1 else 1.0

        family, p = best("", self.families)
        lang, q = best(family, self.languages[family])
        return lang, float(p * q)


def fit(df: DataFrame, per_language: int = 400, max_chars: int = 20_000, families: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", use: Column | None = None) -> Model | None:
    """Train on a bounded sample of the rows of ``df`` that satisfy ``use`` and have text and language.

    About ``per_language`` rows of each language are drawn by a hash of the id; of a text of more than ``max_chars``
    characters a piece of that length counts, from a place drawn by the hash. Trigram counts (not texts) reach the driver. None if
    no language has a usable row; one language alone is then always predicted.
    """
    home = {lang: name for name, langs in (families or FAMILIES).items() for lang in langs}
    start = 1 + F.pmod(F.xxhash64(id_col), F.greatest(F.lit(1), F.length(text_col) - max_chars + 1))
    piece = F.substring(F.col(text_col), start.cast("int"), F.lit(max_chars))
    rows = df.select(F.col(id_col).alias("doc_id"), piece.alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if use is None else use).alias("use"))
    rows = rows.where("use and text is not null and lang is not null").where(F.octet_length("text") > 0)
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator) -> Iterator:
        for part in pieces(batches):
            found = [np.unique(grams(t.encode()), return_counts=True) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array([x[0].astype(np.uint16).tobytes() for x in found], pa.binary()), pa.array([x[1].astype(np.uint32).tobytes() for x in found], pa.binary())],
                ["lang", "code", "n"],
            )

    got = drawn.select("text", "lang").mapInArrow(count, "lang string, code binary, n binary").collect()
    x, lang = np.zeros((len(got), 1 << BITS), np.float32), np.array([r.lang for r in got])
    for k, r in enumerate(got):
        n = np.frombuffer(r.n, np.uint32)
        x[k, np.frombuffer(r.code, np.uint16)] = n / max(1, n.sum())
    scale = (1 / np.sqrt((x**2).mean(0) + 1e-8)).astype(np.float32)
    x *= scale
    languages: dict[str, list[str]] = {}
    for name in sorted(counts):
        languages.setdefault(home.get(name, name), []).append(name)
    of = np.array([home.get(name, name) for name in lang])
    pairs = [("", a, b) for a, b in combinations(sorted(languages), 2)] + [(f, a, b) for f in sorted(languages) for a, b in combinations(languages[f], 2)]
    weights, bias, slope = np.zeros((1 << BITS, len(pairs)), np.float32), np.zeros(len(pairs)), np.ones(len(pairs))
    for k, (group, a, b) in enumerate(pairs):
        label = lang if group else of
        mine = (label == a) | (label == b)
        y = np.where(label[mine] == a, 1.0, -1.0)
        if len(set(y)) < 2:
            bias[k] = y[0] if len(y) else 0
            continue
        w, bias[k] = margin_fit(x[mine], y)
        coef, _ = fit_logistic((x[mine] @ w + bias[k])[:, None], (y > 0).astype(float), np.ones(len(y)), ridge=1.0)
        weights[:, k], slope[k] = w * scale, max(coef[0], 0.1)
    return Model(sorted(languages), languages, pairs, weights, bias, slope)


def identify_rows(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with the predicted language of each whole text, ``lang_pred``, and its ``score``; columns of these names are replaced.

    Every row is judged by its own text: repeated rows and null ids keep their row. ``lang_pred`` is a language of the
    training rows, or ``und`` with score 0 where the text is null, empty or has no letter, or where nothing was
    learned. Very long texts are read whole, one at a time.
    """
    rows = df.drop("lang_pred", "score")

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches):
            words = part.column(text_col).to_pylist()
            known = [model is not None and t is not None and any(map(str.isalpha, t)) for t in words]
            told = iter(model.predict([t.encode() for t, k in zip(words, known, strict=True) if k]) if any(known) else [])
            out = [next(told) if k else ("und", 0.0) for k in known]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per input row, as ``identify_rows`` gives them. Other columns are not read."""
    return identify_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model).select("doc_id", "lang_pred", "score")
