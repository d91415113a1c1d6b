"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys (two independent 64-bit hashes) sorted by key. Documents come in batches,
the largest ids first, and the keys of each batch are anti-joined against the runs before they are added:
a key that no run has is new, and the largest id of the batch that holds it is the one that keeps its
lines; of a key that the runs have, every line of the batch has a larger holder, and only the number of its
documents is added. Each batch adds one run to level 0; when a level holds ``fanout`` runs they are merged
into one run of the next level. Whether a key is common is known after the last batch, so the lines that
have a larger holder are then looked up once among the common keys, and what is left stays.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """Array with a struct (h1, h2) for each line of ``text``; null for lines under the least length."""
    return F.transform(F.split(text, "\n", -1), lambda x: line_key(x))


def line_key(line: Column, least: int = 40) -> Column:
    key = F.translate(F.btrim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)
    return F.when(F.length(key) >= least, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


class LineRuns:
    """The levelled runs; all of them are files in the shared folder."""

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels = fanout, []

    def _rows(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """The rows of ``runs``, or of all."""
        return reduce(DataFrame.union, runs or [r for level in self.levels for r in level])

    def _merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        return self._rows(runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def anti_join(self, keys: DataFrame) -> DataFrame:
        """``keys`` with last_doc only where no run has the key. A key is new in one run only, so the join repeats no row."""
        if not self.levels:
            return keys
        old = self._rows().where("last_doc is not null").select(*KEY, F.lit(True).alias("old"))
        return keys.join(old, KEY, "left").select(*KEY, "n_docs", F.when(F.col("old").isNull(), F.col("last_doc")).alias("last_doc"))

    def add(self, occurrences: DataFrame) -> None:
        """Add the keys of one batch: rows (doc_id, h1, h2), one for each document and key. Its ids are below those of all batches before."""
        keys = occurrences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._put(written(self.anti_join(keys).sortWithinPartitions(*KEY), "run"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = written(self._merged(old).sortWithinPartitions(*KEY), "run")
            for r in old:
                forget(r)
            self._put(merged, level + 1)

    def common(self, min_docs: int) -> DataFrame:
        """Keys that at least ``min_docs`` documents hold, over all runs."""
        rows = self._rows() if sum(map(len, self.levels)) == 1 else self._merged()
        return rows.where(F.col("n_docs") >= min_docs)


def doomed(occurrences: DataFrame, common: DataFrame, hot_share: float = 1e-3) -> DataFrame:
    """Occurrences (doc_id, h1, h2) of a common key in another document than its largest.

    Keys in more than ``hot_share`` of all occurrences are at most 1 / hot_share, so they are
    broadcast; the others are joined by a shuffle in which no key is hot.
    """
    total = occurrences.count()
    bound = max(1.0, hot_share * total)
    hot, rest = common.where(F.col("n_docs") > bound), common.where(F.col("n_docs") <= bound)
    is_hot = occurrences.join(F.broadcast(hot.select(*KEY, "last_doc")), KEY, "left")
    by_hot = is_hot.where("last_doc is not null and doc_id < last_doc").select("doc_id", *KEY)
    cold = is_hot.where("last_doc is null").select("doc_id", *KEY)
    by_rest = cold.join(rest.select(*KEY, "last_doc"), KEY).where("doc_id < last_doc").select("doc_id", *KEY)
    return by_hot.union(by_rest)


def drop_common_lines(df: DataFrame, min_docs: int = 5, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with ``text_col`` rid of lines common to many documents, and n_lines, n_dropped.

    A line's key is the line without white space at its ends and with A-Z lowered. Keys of at least
    40 code points in at least ``min_docs`` documents lose all their lines but those of the
    largest id that holds them. A null or empty text is one empty line. Rows with one id count as
    one document, and rows with a null id lose nothing; ids are numbers. Columns of ``df`` keep their names and values; if
    n_lines or n_dropped exist already they are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(line_keys(text))).alias("k"))
    found = found.where("doc_id is not null and k is not null").select("doc_id", "k.h1", "k.h2").distinct()
    occurrences = written(found, "lines")
    runs = LineRuns(fanout)
    cuts = occurrences.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    ends = [None, *sorted(set(cuts or []), reverse=True), None]
    for high, low in pairwise(ends):
        at = F.lit(True) if high is None else F.col("doc_id") <= high
        runs.add(occurrences.where(at if low is None else at & (F.col("doc_id") > low)))
    gone = doomed(occurrences, runs.common(min_docs)).groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("__gone"))
    gone = gone.withColumnRenamed("doc_id", "__id")
    joined = df.join(gone, F.col(id_col) == F.col("__id"), "left")
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("__gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), line_key(x)), F.lit(False))))
    out = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("__kept", kept)
    return out.withColumn("n_dropped", F.col("n_lines") - F.size("__kept")).withColumn(text_col, F.concat_ws("\n", "__kept")).drop("__gone", "__id", "__kept")
