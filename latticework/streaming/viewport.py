"""Live viewports: control messages, newest parameters and newest frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "type string, viewportId string, seq bigint, params map<string,string>"


def parsed(messages: DataFrame, column: str = "value") -> DataFrame:
    """Control messages as columns (type, viewportId, seq, params); text that is no JSON is left out."""
    rows = messages.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m")).select("m.*")
    return rows.where("type is not null and viewportId is not null")


def active(messages: DataFrame) -> DataFrame:
    """Viewports that are open, each with its newest parameters: later updates are merged over earlier ones key by key."""
    state = messages.groupBy("viewportId").agg(
        F.max_by("type", "seq").alias("last"), F.max(F.when(F.col("type") == "createViewport", F.col("seq"))).alias("made")
    )
    open_ = state.where("last <> 'closeViewport'").select("viewportId", "made")
    kept = messages.join(open_, "viewportId").where("seq >= coalesce(made, seq)")
    entries = kept.select("viewportId", "seq", F.explode("params").alias("name", "value"))
    newest = entries.groupBy("viewportId", "name").agg(F.max_by("value", "seq").alias("value"))
    return newest.groupBy("viewportId").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("params"))


def serve(frames: DataFrame, viewports: Callable[[SparkSession], DataFrame], render: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A writer of ``frames`` (frame, seq): each trigger renders its newest frame for the open viewports; older ones are dropped."""

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("seq").alias("seq"))
        latest = batch.join(F.broadcast(newest), "seq")  # one row
        sink(render(latest, viewports(batch.sparkSession)), number)

    return frames.writeStream.foreachBatch(each)
