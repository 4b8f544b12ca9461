"""Access history: touches(path, at_ms), decayed into one number a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Decay a day (half-lives of three and ten days), retention, cap and scale.
DECAY_FAST, DECAY_SLOW = 0.231, 0.0693
DAY_MS = 86_400_000
MAX_DAYS, MAX_TOUCHES, CAP, SCALE = 7, 128, 200, 25

WIDE = "map<string, array<bigint>>"


def frecency(touches: DataFrame, now_ms: int, decay: float = DECAY_FAST) -> DataFrame:
    """path, frecency: the decayed sum over touches of the last days, scaled, rounded and capped.
    Touches in the future or too old add nothing. One aggregation with map-side partial sums."""
    age = (F.lit(now_ms) - F.col("at_ms")) / DAY_MS
    live = F.when((age >= 0) & (age <= MAX_DAYS), F.exp(-decay * age)).otherwise(0.0)
    return touches.groupBy("path").agg(F.least(F.lit(CAP), F.floor(F.sum(live) * SCALE + 0.5)).cast("int").alias("frecency"))


def frecency_undecayed(touches: DataFrame) -> DataFrame:
    """path, frecency without decay: each touch adds the scale, up to the cap."""
    return touches.groupBy("path").agg(F.least(F.lit(CAP), SCALE * F.count("*")).cast("int").alias("frecency"))


def _last(touches: DataFrame) -> DataFrame:
    """The last touches of each path; the limit is pushed below the shuffle."""
    order = Window.partitionBy("path").orderBy(F.desc("at_ms"))
    return touches.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_TOUCHES).drop("_n")


def prune(touches: DataFrame, now_ms: int) -> DataFrame:
    """Without what is too old; at most the last touches of each path stay."""
    return _last(touches.where(F.col("at_ms") >= now_ms - MAX_DAYS * DAY_MS))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two histories without repeats; at most the last touches of each path stay."""
    return _last(a.select("path", "at_ms").unionByName(b.select("path", "at_ms")).distinct())


def note(touches: DataFrame, path: str, now_ms: int) -> DataFrame:
    """Adds a touch, after dropping what is too old of that path."""
    spark = touches.sparkSession
    old = (F.col("path") == path) & (F.col("at_ms") < now_ms - MAX_DAYS * DAY_MS)
    return _last(touches.where(~old).unionByName(spark.createDataFrame([(path, now_ms)], "path string, at_ms long")))


def note_all(touches: DataFrame, new: list[tuple[str, int]]) -> DataFrame:
    """Adds a list of touches (path, at_ms) as so many calls of `note` would: one plan, however many."""
    if not new:
        return touches
    added = touches.sparkSession.createDataFrame(new, "path string, at_ms long")
    newest = F.broadcast(added.groupBy("path").agg(F.max("at_ms").alias("_newest")))
    old = touches.join(newest, "path", "left").where(F.col("_newest").isNull() | (F.col("at_ms") >= F.col("_newest") - MAX_DAYS * DAY_MS))
    return _last(old.select("path", "at_ms").unionByName(added))


def parse(raw: Column) -> Column:
    """A JSON object of path to times as map<string, array<bigint>>; what is no positive number is
    dropped, what is no object is empty. One bad element never voids the rest."""
    entries = F.from_json(raw, "map<string, string>")
    times = F.transform_values(entries, lambda k, v: F.filter(F.from_json(v, "array<string>"), lambda x: x.rlike(r"^[0-9.]+([eE][+-]?[0-9]+)?$")))
    kept = F.transform_values(times, lambda k, v: F.filter(F.transform(v, lambda x: x.try_cast("double").cast("bigint")), lambda x: x > 0))
    last = F.transform_values(kept, lambda k, v: F.when(F.size(v) > 0, F.slice(v, F.greatest(F.size(v) - MAX_TOUCHES + 1, F.lit(1)), MAX_TOUCHES)))
    return F.coalesce(F.map_filter(last, lambda k, v: v.isNotNull()), F.create_map().cast(WIDE))


def to_wide(touches: DataFrame) -> DataFrame:
    """path, times: ascending."""
    return touches.groupBy("path").agg(F.array_sort(F.collect_list("at_ms")).alias("times"))


def from_wide(rows: DataFrame, history: str = "history") -> DataFrame:
    """path, at_ms of a column of map<string, array<bigint>>."""
    return rows.select(F.explode(history).alias("path", "times")).select("path", F.explode("times").alias("at_ms"))
