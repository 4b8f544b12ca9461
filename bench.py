"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell import registry
from siftwell.operators import find, grep, maintain, trigrams
from siftwell.sources import store

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> object:
        began = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    spark.read.parquet(f"{DIR}/documents.parquet").select(F.sum(F.octet_length("text"))).collect()  # starts the JVM's readers
    files = registry.documents(spark, DIR)
    # Cold: the index is built and kept in memory for the searches below, as the reference keeps its own.
    index = trigrams.build(files, arrange=False)
    postings = index.postings.repartition(int(CPUS), "trigram").sortWithinPartitions("trigram").cache()
    indexed = index.indexed.cache()
    held = trigrams.closed(trigrams.Index(postings, indexed), files)
    held = trigrams.Index(postings, indexed, held.outside.cache())
    timed("index_build_cold", lambda: (postings.count(), indexed.count(), held.outside.count()))
    for held_or_none in (held, None):  # both searches once, untimed: warm means compiled
        grep.grep_lines(files, "Licensed under", index=held_or_none).count()
    timed("grep_narrowed_warm", lambda: grep.grep_lines(files, "Licensed under", index=held).count())
    timed("grep_unnarrowed", lambda: grep.grep_lines(files, "Licensed under").count())
    timed("grep_candidates_warm", lambda: trigrams.candidates(held, grep.plan_of("Licensed under", "literal", True)).count())
    timed("grep_regex_narrowed_warm", lambda: grep.grep_lines(files, "(MIT|Apache) License", "regex", index=held).count())
    timed("find_all_paths", lambda: find.find(files, "doc_12", registry.NOW).items.collect())
    for name in ("grep_literal", "grep_regex", "grep_fuzzy", "frecency_decayed", "history_merge", "reconcile_status", "find_frecency", "trigram_frequencies"):
        timed(name, lambda n=name: registry.QUERIES[n](spark, DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    # Beside the headline: a start from the stored index over an unchanged tree, as against building it.
    path = f"{tempfile.mkdtemp(prefix='bench-')}/index"
    store.save(held, files, path, DIR)
    timed("index_load_warm", lambda: maintain.stats(maintain.status(store.load(spark, path, DIR)[1], files)))
    shutil.rmtree(path)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
