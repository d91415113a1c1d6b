"""Open viewports as keyed state over a stream of control messages, and their latest snapshot as a table.

Every client has one state: its open viewports with their parameters. A trigger reads only the messages that are new and gives a row
for each viewport that they changed; where several messages change one, the last one wins. ``keep_latest`` folds
these rows into a snapshot of all open viewports, so neither the messages nor closed viewports pile up, and ``latest`` reads it, for
instance from the writer of ``viewport.serve``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "type string, client string, viewportId string, op string, seq bigint, params map<string,string>"
CHANGE = "client string, viewportId string, op string, params map<string,string>, version bigint, open boolean"


def parsed(messages: DataFrame, column: str = "value") -> DataFrame:
    """Control messages as columns; a missing client is the empty one. Text that is no JSON, has no type or no number, is left out."""
    rows = messages.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m")).select("m.*")
    return rows.where("type is not null and seq is not null").withColumn("client", F.coalesce("client", F.lit("")))


def applied(open_: dict, row, default_op: str) -> set:
    """Change the open viewports of a client by one message; the names of those that it changed."""
    name, given = row.viewportId, dict(row.params) if row.params is not None else None
    if row.type == "disconnect":
        gone = {*open_}
        open_.clear()
        return gone
    if not name:
        return set()
    if row.type == "createViewport":
        open_[name] = {"op": row.op or default_op, "params": given or {}}
    elif row.type == "updateViewport" and name in open_ and given is not None:
        open_[name]["params"] |= given  # a part of the parameters, merged key by key
    elif row.type == "closeViewport" and name in open_:
        del open_[name]
    else:
        return set()
    return {name}


def changes(messages: DataFrame, default_op: str = "slice") -> DataFrame:
    """A stream of (client, viewportId, op, params, version, open): one row for each viewport that a trigger's messages changed.

    createViewport opens a viewport or replaces one, updateViewport merges parameters into an open one, closeViewport closes it and
    disconnect closes all of its client; anything else changes nothing. Messages of a client are taken in the order of ``seq``; one that is not over the
    last one taken in an earlier trigger is stale and left out. ``version`` is the seq of the last message of the trigger that was taken.
    """

    def take(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ("{}", -(1 << 62))
        open_, changed = json.loads(held), set()
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for row in rows[rows["seq"] > seen].itertuples():
            changed |= applied(open_, row, default_op)
            seen = row.seq
        state.update((json.dumps(open_), int(seen)))
        if changed:
            now = [open_.get(name) for name in sorted(changed)]
            yield pd.DataFrame({
                "client": key[0], "viewportId": sorted(changed), "op": [v and v["op"] for v in now], "params": [v and v["params"] for v in now],
                "version": int(seen), "open": [v is not None for v in now],
            })

    return messages.groupBy("client").applyInPandasWithState(take, CHANGE, "viewports string, seq bigint", "update", "NoTimeout")


def snapshots(spark: SparkSession, folder: str) -> list[tuple[int, object]]:
    """(trigger, path) of the snapshots in ``folder`` that are complete, the newest last."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/trigger=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [f.getPath().getParent() for f in found or []]
    return sorted(((int(p.getName().split("=")[1]), p) for p in paths), key=lambda x: x[0])


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Open viewports (client, viewportId, op, params, version, open) of the newest snapshot, or of the newest one ``before`` a trigger."""
    paths = [p for n, p in snapshots(spark, folder) if before is None or n < before]
    return spark.read.schema(CHANGE).parquet(paths[-1].toString()) if paths else spark.createDataFrame([], CHANGE)


def keep_latest(folder: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with ``changes``: a snapshot of all open viewports per trigger, of which the last two stay.

    A trigger that is run again, as after a lost driver, reads the snapshot before it and writes its own anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch.unionByName(latest(spark, folder, number))
        now = both.groupBy("client", "viewportId").agg(F.max_by(F.struct("op", "params", "version", "open"), "version").alias("s")).select("client", "viewportId", "s.*")
        now.where("open").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/trigger={number}")
        for n, path in snapshots(spark, folder)[:-2]:
            if n < number - 1:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return each
