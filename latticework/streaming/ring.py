"""A sliding buffer of the newest frames of each key, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, keys: list[str], order: list[str], capacity: int) -> DataFrame:
    """The newest ``capacity`` rows of each key with their number ``seq`` in arrival order (from 0).

    The rank filter is pushed into the sort, so each task passes on at most ``capacity`` rows of a key.
    """
    if capacity < 1:
        raise ValueError("the capacity is 1 or more")
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    ranked = df.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= capacity)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    return ranked.join(totals, keys).withColumn("seq", F.col("__total") - F.col("__back")).drop("__back", "__total")


def stats(df: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Rows held, rows written in all, and the number of the oldest one held, for each key."""
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.least(F.lit(capacity), total).cast("long").alias("n"), total.alias("total"), F.greatest(F.lit(0), total - capacity).cast("long").alias("oldest"))


def ring(stream: DataFrame, key: str, value: str, capacity: int) -> DataFrame:
    """A stream with, for each key that got rows, its window after them: (key, n, total, oldest, window).

    The state of a key is its newest ``capacity`` values and the number written; ``value`` is a bigint column and
    rows of one trigger are taken in the order of it.
    """
    if capacity < 1:
        raise ValueError("the capacity is 1 or more")

    def push(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, total = state.get if state.exists else ([], 0)
        new = sorted(x for part in parts for x in part[value].tolist())
        held, total = [*held, *new][-capacity:], total + len(new)
        state.update((held, total))
        yield pd.DataFrame({key: [name[0]], "n": [len(held)], "total": [total], "oldest": [total - len(held)], "window": [held]})

    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n bigint, total bigint, oldest bigint, window array<bigint>"
    return stream.select(key, value).groupBy(key).applyInPandasWithState(push, schema, "held array<bigint>, total bigint", "update", "NoTimeout")
