"""License scans by diagonal voting.

Every run of k words of every text is hashed and joined with the runs of the templates, a table of
some hundred rows. A match votes for a diagonal, the place in the text less the place in the
template: an unchanged copy has all its votes on one diagonal, inserted or dropped words move them to
neighbouring ones. Votes are counted for each diagonal, neighbouring diagonals are merged, and what has votes enough
is a candidate, whose words are then compared with those of the template in the text itself.

Only votes and candidates are shuffled. Texts are read twice where they stand; if the ids of texts that have
candidates are too many for Spark to broadcast, the texts are shuffled once.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, pieces, written
from .minhash import ODD, mixed

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0  # what separates words
CODES = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
END = 0  # in place of a hash: here a text ends
KEY = ["doc_id", "h"]


@dataclass(frozen=True)
class Template:
    """A wording that tells of a license. ``exact``: its words count only where all stand consecutively, once for each place.

    Otherwise ``share`` of its words must follow in order within its length and some slack, and ``needed`` words must be among those.
    """

    label: str
    text: str
    exact: bool = False
    needed: tuple[str, ...] = ()
    share: float = 0.8

    @property
    def words(self) -> list[bytes]:
        return WORD.findall(self.text.lower().encode())

    @property
    def slack(self) -> int:
        return max(2, len(self.words) // 8)


# The phrases and labels of the query's contract.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)

# Notices as the licenses themselves word them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", needed=("apache",)),
    Template("gpl-2", "GNU General Public License, version 2", needed=("gnu", "2")),
    Template("gpl-3", "GNU General Public License, version 3", needed=("gnu", "3")),
    Template("lgpl", "GNU Lesser General Public License", needed=("gnu", "lesser")),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", needed=("mozilla", "2")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", needed=("noncommercial",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", needed=("sharealike",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of BASE modulo 2^64, kept for the next call."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def word_hashes(text: bytes, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashes of the words, in parts of ``size`` bytes; a word that reaches over a border is carried on."""
    total, length = np.uint64(0), 0  # of the word that is open at the border
    for at in range(0, len(text), size):
        low = LOWER[np.frombuffer(text, np.uint8, min(size, len(text) - at), at)]
        inside = low != 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        goes_on, stays_open = length > 0 and bool(inside[0]), bool(inside[-1])
        sums = np.empty(0, np.uint64)
        if len(starts):
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            sums = np.add.reduceat(CODES[low[inside]] * powers(int(sizes.max()))[place], first)
        sizes = sizes.astype(np.uint64)
        if goes_on:
            sums[:1] = sums[:1] * np.uint64(pow(BASE, length, 1 << 64)) + total
            sizes[0] += np.uint64(length)
        elif length:
            sums, sizes = np.append(total, sums), np.append(np.uint64(length), sizes)
        total, length = (sums[-1], int(sizes[-1])) if stays_open else (np.uint64(0), 0)
        if stays_open:
            sums, sizes = sums[:-1], sizes[:-1]
        yield mixed(sums + sizes * ODD[3])
    if length:
        yield mixed(np.array([total]) + np.array([length], np.uint64) * ODD[3])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; never END."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = mixed(total * ODD[0] + words[j : n + j] * ODD[1])
    return np.where(total == END, np.uint64(1), total).view(np.int64)


def text_runs(text: bytes, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first run, hashes) of part after part, and last (number of words, END)."""
    tail, seen = np.empty(0, np.uint64), 0
    for part in word_hashes(text):
        words = np.concatenate([tail, part])
        first, seen = seen - len(tail), seen + len(part)
        found = run_hashes(words, k)
        if len(found):
            yield first, found
        tail = words[max(0, len(words) - k + 1) :]
    yield seen, np.array([END], np.int64)


def in_order(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, all rows of the table at once as bits of a number."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for x in b:
        met = open_ & places.get(x, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


def match(template: Template, window: list[bytes], exact_from: int) -> float:
    """The share of the template's words that the window holds in order; 0 if that is not enough."""
    words = template.words
    if template.exact:
        return float(window[exact_from : exact_from + len(words)] == words)
    got = in_order(words, window) / len(words)
    return got if got >= template.share and {w.encode() for w in template.needed} <= {*window} else 0.0


def templates_table(df: DataFrame, templates: Sequence[Template], k: int) -> DataFrame:
    """(run, template, place): the runs of ``k`` words of all templates, and END under template -1; broadcast if they are few."""
    rows = [(END, -1, 0)]
    for t, template in enumerate(templates):
        hashes = np.concatenate([*word_hashes(b" ".join(template.words))])
        rows += [(int(x), t, place) for place, x in enumerate(run_hashes(hashes, k))]
    found = df.sparkSession.createDataFrame(rows, "run bigint, template int, place int")
    return F.broadcast(found) if len(rows) <= 100_000 else found


def votes(docs: DataFrame, templates: Sequence[Template], k: int) -> DataFrame:
    """(doc_id, h, template, place, at): each run of a text that is one of a template, and one row with template -1 and the number of words for each text."""

    def run(batches: Iterator) -> Iterator:
        names = ["doc_id", "h", "first", "runs"]
        for part in pieces(batches, n_bytes=1 << 22):
            rows, held = [], 0
            for doc, h, text in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), part.column("text"), strict=True):
                for first, found in text_runs(text.as_buffer().to_pybytes() if text.is_valid else b"", k):
                    rows.append((doc, h, first, found))
                    held += len(found)
                    if held >= 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    runs = docs.mapInArrow(run, "doc_id bigint, h bigint, first bigint, runs array<bigint>").select(*KEY, "first", F.posexplode("runs").alias("i", "run"))
    return runs.join(templates_table(docs, templates, k), "run").select(*KEY, "template", "place", (F.col("first") + F.col("i")).alias("at"))


def candidates(found: DataFrame, templates: Sequence[Template], k: int) -> DataFrame:
    """(doc_id, h, template, start): the strongest of each group of neighbouring diagonals that has votes enough.

    Repeated rows vote alike: a diagonal has the set of the template's places, not a number of votes. A group reaches on as long as
    the next diagonal is at most the template's slack away; that of an exact template is one diagonal.
    """
    by = [*KEY, "template"]
    sizes = [len(t.words) - k + 1 for t in templates]
    const = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)
    lines = found.where("template >= 0").groupBy(*by, (F.col("at") - F.col("place")).alias("start")).agg(F.collect_set("place").alias("places"))
    order = Window.partitionBy(*by).orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(order) > const([0 if t.exact else t.slack for t in templates]), F.lit(False))
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(order))
    groups = lines.groupBy(*by, "group").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max(F.struct(F.size("places"), -F.col("start"))).alias("best"))
    least = const([n if t.exact else max(1, ceil(n / 4)) for t, n in zip(templates, sizes, strict=True)])
    return groups.where(F.col("n") >= least).select(*by, (-F.col("best.col2")).alias("start"))


def verified(docs: DataFrame, chosen: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, h, template, start, share) of the candidates whose words agree; words are counted through, only a window of them is held."""
    spans = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("template", "start")).alias("spans")).toDF("__id", "__h", "spans")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("h").eqNullSafe(F.col("__h"))
    held = docs.join(chosen.select("h").distinct(), "h", "left_semi").join(spans, same).select(*KEY, "text", "spans")
    widest = max(len(t.words) + 2 * t.slack for t in templates)

    def windows(text: bytes, wanted: list[dict]) -> Iterator[tuple[int, int, float]]:
        """Windows are taken in the order of their ends, when the word at the end has been read or no word is left."""
        reach = lambda s: (s["start"] + len(templates[s["template"]].words) + templates[s["template"]].slack, s["start"], s["template"])
        ends, last, n = deque(sorted(map(reach, wanted))), deque(maxlen=widest), 0

        def taken() -> tuple[int, int, float]:
            end, start, t = ends.popleft()
            first, held = max(0, start - templates[t].slack), [*last]
            held = held[max(0, len(held) - (n - first)) :]  # from ``first`` on; no window is wider than ``last``
            return t, start, match(templates[t], held[: end - first], start - first)

        for found in WORD.finditer(text):
            last.append(found.group())
            n += 1
            while ends and ends[0][0] == n:
                yield taken()
            if not ends:
                break
        while ends:
            yield taken()

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches, n_bytes=1 << 23):
            rows = []
            for doc, h, text, wanted in zip(*(part.column(c) for c in ("doc_id", "h", "text", "spans")), strict=True):
                data = text.as_buffer().to_pybytes().lower() if text.is_valid else b""
                rows += [(doc.as_py(), h.as_py(), *w) for w in windows(data, wanted.as_py()) if w[2]]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "template", "start", "share"])

    return held.mapInArrow(run, "doc_id bigint, h bigint, template int, start bigint, share double").distinct()


def scan(df: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): rows (doc_id, h, n_words) one for each row of ``df``, and (doc_id, h, template, label, exact, first_word, share) one for each span found.

    Words are runs of code points other than ASCII ones that are no letter or digit, A-Z lowered. h is a hash of the text; rows with
    equal id and text share their spans. A null text is empty, and a null id is an id of its own. An empty table gives two empty ones. Other
    columns are not read. Texts are read whole; a task holds one long text and parts of 1 MB of its hashes, but the candidates of one text are
    one list, so a text that holds a notice a million times has a list of a million places.
    """
    k = min(3, *(len(t.words) for t in templates))
    if not k:
        raise ValueError("a template has no words")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = written(votes(docs, templates, k), "votes")
    chosen = written(candidates(found, templates, k), "candidates")
    names = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact")) for t in templates])
    spans = verified(docs, chosen, templates).withColumn("t", F.element_at(names, F.col("template") + 1))
    spans = written(spans.select(*KEY, "template", "t.label", "t.exact", F.col("start").alias("first_word"), "share"), "spans")
    forget(chosen)
    return found.where("template = -1").select(*KEY, F.col("at").alias("n_words")), spans


def license_labels(df: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``df``; odd rows as ``scan`` says.

    Base places are those of exact templates: their number, the smallest and largest (else null), their labels. ``labels`` also has those of
    the other templates; both are distinct, sorted and joined by commas. ``score`` is the largest share of a template's words found, 0 without a label.
    """
    texts, spans = scan(df, templates, id_col, text_col)
    base = F.when(F.col("exact"), F.col("first_word"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = spans.groupBy(*KEY).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"),
    ).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("h").eqNullSafe(F.col("__h"))
    filled = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return texts.join(per, same, "left").select("doc_id", "n_words", *[F.coalesce(c, F.lit(filled[c])).alias(c) if c in filled else c for c in per.columns[2:]])
