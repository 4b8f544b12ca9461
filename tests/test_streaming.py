from pyspark.sql import functions as F

from siftwell.operators import trigrams
from siftwell.plans.planner import for_literal
from siftwell.sources.ignore import parse_rules
from siftwell.streaming import changes

EVENT = "path string, op string, at_ms long, file_id long, size long, mtime_ms long, content string"


def test_changes_apply_in_order_and_under_the_rules(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.txt", 5, 0, "alpha", True), (2, "b.txt", 4, 0, "beta", True)], "file_id long, path string, size long, mtime_ms long, content string, alive boolean")
    state = {"index": trigrams.build(files), "files": files.drop("content"), "batches": []}
    source = str(tmp_path / "events")
    spark.createDataFrame([("a.txt", "upsert", 1, 9, 5, 1, "wrong"), ("a.txt", "upsert", 2, 9, 5, 2, "gamma"), ("b.txt", "remove", 3, None, None, None, None), ("x.log", "upsert", 3, 8, 5, 3, "hidden")], EVENT).write.parquet(source)

    def act(batch, number):
        batch = batch.cache()
        state["index"], state["files"] = changes.apply_changes(state["index"], state["files"], batch, parse_rules("*.log"))
        state["batches"].append(batch.count())

    changes.watch(spark.readStream.schema(EVENT).parquet(source), act, str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert state["batches"] == [3]
    found = lambda w: [r.file_id for r in trigrams.candidates(state["index"], for_literal(w)).collect()]
    assert found("gamma") == [1] and found("alpha") == found("beta") == found("wrong") == found("hidden") == []
    assert {r.path: r.alive for r in state["files"].collect()} == {"a.txt": True, "b.txt": False}


def test_tool_events_are_routed(spark):
    events = spark.createDataFrame([("read", "a", 1), ("edit", "b", 2), ("shell", "c", 3), ("write", None, 4)], "tool string, path string, at_ms long")
    touched, changed = changes.route(events)
    assert sorted(r.path for r in touched.collect()) == ["a", "b"] and [r.path for r in changed.collect()] == ["b"]


def test_history_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "touches")
    rows = [("a", f"2024-01-01 00:00:{i % 60:02}") for i in range(140)] + [("b", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "path string, at string").select("path", F.col("at").cast("timestamp").alias("at")).write.parquet(source)
    stream = spark.readStream.schema("path string, at timestamp").parquet(source)
    out = changes.touch_history(stream).writeStream.outputMode("update").format("memory").queryName("touch_history").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {r.path: len(r.times) for r in spark.table("touch_history").collect()} == {"a": 128, "b": 1}
    count = changes.touches_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("touch_windows").trigger(availableNow=True).start()
    count.awaitTermination(120)
    assert {r.path: r.n for r in spark.table("touch_windows").collect()} == {"a": 140, "b": 1}
