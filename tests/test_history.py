import math

from pyspark.sql import functions as F

from siftwell.operators import frecency as h

NOW = 1_800_000_000_000
DAY = 86_400_000


def touches(spark, rows):
    return spark.createDataFrame(rows, "path string, at_ms long")


def test_decay_and_cap(spark):
    rows = [("old", NOW - 3 * DAY), ("both", NOW - 3 * DAY), ("both", NOW), ("future", NOW + 1), ("stale", NOW - 8 * DAY)] + [("much", NOW - i) for i in range(40)]
    got = {r.path: r.frecency for r in h.frecency(touches(spark, rows), NOW).collect()}
    assert got == {"old": math.floor(25 * math.exp(-0.693) + 0.5), "both": math.floor(25 * (1 + math.exp(-0.693)) + 0.5), "future": 0, "stale": 0, "much": 200}
    assert {r.path: r.frecency for r in h.frecency_undecayed(touches(spark, rows)).collect()}["both"] == 50


def test_bounds(spark):
    many = touches(spark, [("a", NOW - i) for i in range(178)] + [("stale", NOW - 40 * DAY)])
    kept = h.prune(many, NOW)
    assert (kept.count(), kept.agg(F.min("at_ms")).first()[0]) == (128, NOW - 127)
    assert h.note(many, "a", NOW + 1).where("path = 'a'").count() == 128


def test_merge_is_idempotent(spark):
    a, b = touches(spark, [("x", 1), ("x", 3), ("y", 2)]), touches(spark, [("x", 2), ("x", 3)])
    once = h.merge(a, b)
    assert sorted(map(tuple, once.collect())) == [("x", 1), ("x", 2), ("x", 3), ("y", 2)]
    assert sorted(h.merge(once, b).collect()) == sorted(once.collect())


def test_parse_drops_what_is_bad(spark):
    raw = [None, "not json", '{"a": "nope"}', '{"a": [1, "x", -5, 7], "b": "nope"}', "[1]", '{"a": []}', '{"a": [1.5e3, null, 4]}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(h.parse(F.col("raw"))).collect()]
    assert got == [{}, {}, {}, {"a": [1, 7]}, {}, {}, {"a": [1500, 4]}]
    long = "{\"a\": [" + ",".join(str(i) for i in range(1, 200)) + "]}"
    kept = spark.createDataFrame([(long,)], "raw string").select(h.parse(F.col("raw"))).first()[0]["a"]
    assert (len(kept), kept[0], kept[-1]) == (128, 72, 199)
