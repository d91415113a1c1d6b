import json

from latticework.streaming import mailbox, ring, viewport


def test_ring_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(k % 2, k) for k in range(20)]
    spark.createDataFrame(rows[:10], "cam bigint, frame bigint").coalesce(1).write.parquet(str(source), mode="append")
    stream = spark.readStream.schema("cam bigint, frame bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = ring.ring(stream, "cam", "frame", 4).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame(rows[10:], "cam bigint, frame bigint").coalesce(1).write.parquet(str(source), mode="append")
    q.processAllAvailable()
    q.stop()
    got = {r["cam"]: r for r in spark.sql("select * from held where total = 10").collect()}
    assert got[0]["window"] == [12, 14, 16, 18] and got[0]["oldest"] == 6 and got[1]["n"] == 4


def test_ring_over_a_table(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20, 30)], "k int, v int")
    assert tuple(ring.stats(df, ["k"], 4).first()) == (1, 3, 3, 0)
    df = spark.createDataFrame([(1, v) for v in range(10)], "k int, v int")
    assert sorted((r["seq"], r["v"]) for r in ring.last_n(df, ["k"], ["v"], 4).collect()) == [(6, 6), (7, 7), (8, 8), (9, 9)]


def test_viewports(spark, tmp_path):
    said = [
        {"type": "createViewport", "viewportId": "a", "seq": 1, "params": {"op": "slice", "lo": "0"}}, {"type": "updateViewport", "viewportId": "a", "seq": 2, "params": {"lo": "5"}},
        {"type": "createViewport", "viewportId": "b", "seq": 3, "params": {"op": "volume"}}, {"type": "closeViewport", "viewportId": "b", "seq": 4, "params": {}},
    ]
    messages = spark.createDataFrame([(json.dumps(m),) for m in said] + [("no json",)], "value string")
    open_ = viewport.active(viewport.parsed(messages))
    assert [(r["viewportId"], r["params"]) for r in open_.collect()] == [("a", {"op": "slice", "lo": "5"})]
    source = tmp_path / "frames"
    spark.createDataFrame([(s, s * 10) for s in range(5)], "seq bigint, frame bigint").coalesce(1).write.parquet(str(source))
    seen = []
    stream = spark.readStream.schema("seq bigint, frame bigint").parquet(str(source))
    writer = viewport.serve(stream, lambda s: open_, lambda f, v: f.crossJoin(v.select("viewportId")), lambda df, n: seen.extend(df.collect()))
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["viewportId"], r["frame"]) for r in seen] == [("a", 40)]


def said(kind, seq, name=None, client="c", op=None, **params):
    return json.dumps({"type": kind, "client": client, "viewportId": name, "seq": seq} | ({"op": op} if op else {}) | ({"params": params} if params else {}))


def test_mailboxes_go_on_from_their_checkpoint(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "open")

    def send(*messages):
        spark.createDataFrame([(m,) for m in messages], "value string").coalesce(1).write.mode("append").text(str(source))

    def run():
        stream = mailbox.parsed(spark.readStream.text(str(source)))
        q = mailbox.changes(stream).writeStream.outputMode("update").foreachBatch(mailbox.keep_latest(folder)).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return {(r["client"], r["viewportId"]): (r["op"], r["params"], r["version"]) for r in mailbox.latest(spark, folder).collect()}

    assert mailbox.latest(spark, folder).collect() == []
    send(
        said("updateViewport", 3, "a", lo="5"), said("createViewport", 1, "a", lo="0", hi="9"), "no json", said("createViewport", 2, "b", op="volume"), said("updateViewport", 4, "unknown", lo="1"),
        said("createViewport", 1, "a", "d"), said("closeViewport", 6, "never"), said("createViewport", 5, None), said("createViewport", None, "x"),
    )
    first = {("c", "a"): ("slice", {"lo": "5", "hi": "9"}, 6), ("c", "b"): ("volume", {}, 6), ("d", "a"): ("slice", {}, 1)}
    assert run() == first
    # the stream is stopped here; state and snapshot are read again
    send(said("updateViewport", 8, "a", hi="7"), said("updateViewport", 2, "a", lo="stale"), said("closeViewport", 7, "b"), said("updateViewport", 9, "b", lo="closed"))
    assert run() == {("c", "a"): ("slice", {"lo": "5", "hi": "7"}, 9), ("d", "a"): ("slice", {}, 1)}
    send(said("createViewport", 10, "b", op="slice", lo="new"), said("createViewport", 11, "a"))
    assert run()[("c", "b")] == ("slice", {"lo": "new"}, 11) and run()[("c", "a")] == ("slice", {}, 11)
    send(said("disconnect", 12), said("createViewport", 2, "z", "d"))
    assert run() == {("d", "a"): ("slice", {}, 1), ("d", "z"): ("slice", {}, 2)}
    assert len(mailbox.snapshots(spark, folder)) <= 2


def test_snapshot_of_a_trigger_run_again(spark, tmp_path):
    folder = str(tmp_path / "open")
    rows = [("c", "a", "slice", {"lo": "1"}, 3, True), ("c", "b", "slice", {}, 3, True)]
    keep = mailbox.keep_latest(folder)
    keep(spark.createDataFrame(rows, mailbox.CHANGE), 0)
    for _ in range(2):
        keep(spark.createDataFrame([("c", "a", None, None, 4, False)], mailbox.CHANGE), 1)
        assert [r["viewportId"] for r in mailbox.latest(spark, folder).collect()] == ["b"]
    frames = spark.createDataFrame([(1, 10)], "seq bigint, frame bigint")
    assert frames.crossJoin(mailbox.latest(spark, folder)).select("viewportId", "frame").collect()[0]["frame"] == 10
