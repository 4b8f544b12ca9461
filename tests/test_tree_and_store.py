import os

import pytest
from pyspark.sql import functions as F

from siftwell.engine import SearchEngine
from siftwell.operators import maintain, trigrams
from siftwell.sources import store
from siftwell.sources.ignore import ignored, ignored_name, parse_rules
from siftwell.sources.tree import capped, scan

TREE = {
    "src/routes/auth.ts": "export const auth = 1; // TODO", "src/auth/helpers.ts": "helper target", "docs/authentication.md": "docs", "node_modules/junk/index.js": "target", ".gitignore": "generated/\n*.log\n!keep.log\n",
    "generated/huge.ts": "target", "debug.log": "target", "keep.log": "target", "binary.dat": "tar\x00get target", "a b+c%.txt": "target odd name",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, content in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return str(root)


def matches(spark, rules, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return [r[0] for r in df.select(ignored_name(F.col("path"), parse_rules(rules))).collect()]


def test_ignore_rules(spark):
    assert parse_rules("# no\n\n  \nx\n")[0].negated is False and len(parse_rules("# no\n\nx")) == 1
    assert matches(spark, "build", ["build", "a/build", "a/build/x", "rebuild"]) == [True, True, True, False]
    assert matches(spark, "/build", ["build", "a/build"]) == [True, False]
    assert matches(spark, "logs/", ["logs/x", "a/logs/y"]) == [True, True]
    assert matches(spark, "*.log", ["a.log", "x/a.log", "a.logs"]) == [True, True, False]
    assert matches(spark, "a/*/c", ["a/b/c", "a/b/d/c"]) == [True, False]
    assert matches(spark, "a/**/c", ["a/b/d/c", "a/c"]) == [True, False]
    assert matches(spark, "*.log\n!keep.log", ["a.log", "keep.log"]) == [True, False]
    assert matches(spark, "!keep.log\n*.log", ["keep.log"]) == [True]
    assert matches(spark, "[ab", ["[ab", "a"]) == [True, False]
    below = spark.createDataFrame([("gen/keep.ts",)], "path string").select(ignored(F.col("path"), parse_rules("gen\n!keep.ts"))).first()[0]
    assert below


def test_scan(spark, tree):
    files = scan(spark, tree)
    got = {r.path: r.size for r in files.select("path", "size").collect()}
    assert set(got) == {"src/routes/auth.ts", "src/auth/helpers.ts", "docs/authentication.md", ".gitignore", "keep.log", "binary.dat", "a b+c%.txt"}
    assert got["keep.log"] == 6
    assert [r.path for r in capped(files.select("path"), 2).collect()] == sorted(got)[:2]
    assert scan(spark, tree, cap=3).count() == 3 and scan(spark, tree, max_depth=0).count() == 4


def test_store_round_trip_and_guards(spark, tree, tmp_path):
    files, path = scan(spark, tree), str(tmp_path / "cache")
    assert store.load(spark, path, tree) is None
    store.save(trigrams.build(files), files, path, tree)
    index, known = store.load(spark, path, tree)
    assert sorted(index.postings.collect()) == sorted(trigrams.build(files).postings.collect()) and known.count() == 7
    assert store.load(spark, path, "/other") is None
    (tmp_path / "cache" / "manifest.json").write_text("{broken")
    os.path.exists(tmp_path / "cache" / ".manifest.json.crc") and os.remove(tmp_path / "cache" / ".manifest.json.crc")
    assert store.load(spark, path, tree) is None


def test_cache_path():
    env = {"HOME": "/h"}
    a, b = store.cache_path("/x/proj", env, "linux"), store.cache_path("/y/proj", env, "linux")
    assert a != b and a.startswith("/h/.cache/siftwell/proj-") and a.endswith(".idx")
    assert store.cache_path("/x/proj/", env, "linux") == a
    assert store.cache_path("/x/proj", env | {"SIFTWELL_CACHE": "/c"}, "linux").startswith("/c/proj-")
    assert store.cache_path("/x/proj", env | {"SIFTWELL_CACHE": "off"}, "linux") is None
    assert "/" not in os.path.basename(store.cache_path("/x/we ird*?", env, "linux")).replace(".idx", "")


def test_engine_warm_equals_cold(spark, tree, tmp_path):
    path = str(tmp_path / "cache")
    cold = SearchEngine(spark, tree, cache=path, now=lambda: 1_800_000_000_000)
    want = [(r.path, r.line) for r in cold.grep("target").items.collect()]
    assert want == [("a b+c%.txt", 1), ("keep.log", 1), ("src/auth/helpers.ts", 1)]
    assert cold.stats() == maintain.Stats(0, 7) and cold.ready() and cold.indexed() == 7
    warm = SearchEngine(spark, tree, cache=path, now=lambda: 1_800_000_000_000)
    assert warm.stats() == maintain.Stats(7, 0)
    assert [(r.path, r.line) for r in warm.grep("target").items.collect()] == want
    assert "7 of them taken from the stored index" in warm.status()


def test_engine_takes_in_changes(spark, tree):
    now = 1_800_000_000_000
    engine = SearchEngine(spark, tree, now=lambda: now)
    os.remove(f"{tree}/keep.log")
    with open(f"{tree}/new.ts", "w") as f:
        f.write("brand new target")
    os.utime(f"{tree}/docs/authentication.md", (1, 1))
    assert engine.reconcile() == maintain.Stats(5, 2)
    assert {r.path for r in engine.grep("target").items.collect()} == {"a b+c%.txt", "new.ts", "src/auth/helpers.ts"}
    engine.forget("new.ts")
    assert {r.path for r in engine.grep("target").items.collect()} == {"a b+c%.txt", "src/auth/helpers.ts"}
    row = spark.createDataFrame([(1, "new.ts", 8, now, bytearray(b"a Target"), True)], "file_id long, path string, size long, mtime_ms long, content binary, alive boolean")
    engine.refresh(row)
    assert "new.ts" in {r.path for r in engine.grep("target").items.collect()}
    assert engine.indexed() == 7 and engine.file_count() == 7
    before = {r.path: r.score for r in engine.find("auth").items.collect()}
    engine.touch("src/routes/auth.ts")
    after = {r.path: r.score for r in engine.find("auth").items.collect()}
    assert after["src/routes/auth.ts"] == before["src/routes/auth.ts"] + 25


def test_stored_history_merges(spark, tmp_path):
    path, now = str(tmp_path / "history"), 1_800_000_000_000
    make = lambda rows: spark.createDataFrame(rows, "path string, at_ms long")
    store.save_history(make([("a", now - 1), ("", now)]), path, now)
    store.save_history(make([("a", now - 1), ("a", now), ("b", now - 9 * 86_400_000)]), path, now)
    assert sorted(map(tuple, store.load_history(spark, path).collect())) == [("a", now - 1), ("a", now)]
    assert store.history_json(store.load_history(spark, path)).first().history == f'{{"a":[{now - 1},{now}]}}'


def test_status_and_dirty(spark):
    schema = "file_id long, path string, size long, mtime_ms long, alive boolean"
    old = spark.createDataFrame([(1, "same", 1, 1, True), (2, "changed", 1, 1, True), (3, "gone", 1, 1, True), (4, "back", 1, 1, False), (5, "dead", 1, 1, False)], schema)
    new = spark.createDataFrame([(11, "same", 1, 1), (12, "changed", 2, 1), (14, "back", 1, 1), (16, "new", 1, 1)], "file_id long, path string, size long, mtime_ms long")
    diff = maintain.status(old, new)
    assert {r.path: (r.file_id, r.status) for r in diff.collect()} == {"same": (1, "same"), "changed": (2, "changed"), "gone": (3, "gone"), "back": (4, "changed"), "new": (16, "new")}
    assert maintain.stats(diff) == maintain.Stats(1, 3)
    assert maintain.dirty(diff, True) and maintain.dirty(diff.where("status = 'same'"), False) and not maintain.dirty(diff.where("status = 'same'"), True)


def test_changes_fold_into_the_tables(spark, tree, monkeypatch):
    import siftwell.engine as module

    monkeypatch.setattr(module, "FOLD_AT", 2)
    engine = SearchEngine(spark, tree, now=lambda: 1_800_000_000_000)
    written = engine._base
    engine.forget("keep.log")
    engine.forget("no such path")
    assert engine._base is written and len(engine._changed) == 1
    engine.forget("src/auth/helpers.ts")
    assert engine._base is not written and not engine._changed
    assert [r.path for r in engine.grep("target").items.collect()] == ["a b+c%.txt"] and engine.file_count() == 5
    for k in range(3):
        engine.touch("docs/authentication.md")
    assert engine.touches.count() == 3
    engine.dispose()
    assert not os.path.exists(engine._folder.removeprefix("file:"))


def test_a_search_opens_its_candidates_only(spark, tree):
    engine = SearchEngine(spark, tree)
    asked = []
    own = engine._some_files
    engine._some_files = lambda ids: asked.append(len(ids)) or own(ids)
    assert [r.path for r in engine.grep("helper tar").items.collect()] == ["src/auth/helpers.ts"] and asked == [1]
    assert [r.path for r in engine.grep("odd name").items.collect()] == ["a b+c%.txt"]
    assert [r.path for r in engine.grep("generated").items.collect()] == [".gitignore"]
    with open(f"{tree}/src/auth/helpers.ts", "w") as f:
        f.write("helper tar two\nhelper tar")
    assert engine.grep("helper tar").total == 2
    os.remove(f"{tree}/src/auth/helpers.ts")
    assert engine.grep("helper tar").total == 0


def test_searches_answer_while_the_index_is_built(spark, tree):
    import threading

    import siftwell.engine as module

    gate, real = threading.Event(), module.build
    module.build = lambda *a, **k: gate.wait(120) and real(*a, **k)
    try:
        engine = SearchEngine(spark, tree, background=True)
        assert not engine.ready() and engine.building() == 7 and "being built" in engine.status()
        assert {r.path for r in engine.grep("target").items.collect()} == {"a b+c%.txt", "keep.log", "src/auth/helpers.ts"}
        assert engine.find("helpers").items.first().path == "src/auth/helpers.ts"
        gate.set()
        assert engine.wait(120) and engine.ready() and engine.indexed() == 7
    finally:
        module.build = real
    assert engine.grep("target").total == 3


def test_a_tree_is_watched(spark, tree, tmp_path):
    import time

    from siftwell.streaming.changes import tree_events, watch_tree

    engine = SearchEngine(spark, tree)
    with open(f"{tree}/late.ts", "w") as f:
        f.write("late target")
    os.remove(f"{tree}/keep.log")
    events = {r.path: r.op for r in tree_events(engine.known, scan(spark, tree), 5).collect()}
    assert events == {"late.ts": "upsert", "keep.log": "remove"}
    query = watch_tree(engine, str(tmp_path / "watch"))
    try:
        end = time.time() + 90
        while time.time() < end and engine.file_count() != 7 or engine.grep("late target").total != 1:
            time.sleep(0.5)
    finally:
        query.stop()
    assert {r.path for r in engine.grep("target").items.collect()} == {"a b+c%.txt", "late.ts", "src/auth/helpers.ts"}


def test_many_hidden_files_come_back_whole(spark, tmp_path):
    root = tmp_path / "hidden"
    for d in range(20):
        (root / f"d{d}" / ".settings").mkdir(parents=True)
        for k in range(60):
            (root / f"d{d}" / f".f{k}").write_text(f"hidden {d} {k}")
        (root / f"d{d}" / "__init__.py").write_text("x")
        (root / f"d{d}" / ".settings" / "a#b %20.json").write_text("{}")
    got = {r.path: bytes(r.content).decode() for r in scan(spark, str(root)).select("path", "content").collect()}
    assert len(got) == 20 * 62 and got["d3/.f59"] == "hidden 3 59" and got["d0/.settings/a#b %20.json"] == "{}"


def test_versions_are_swapped_and_cleaned(spark, tree, tmp_path):
    files, path = scan(spark, tree), str(tmp_path / "cache")
    index = trigrams.build(files)
    for _ in range(4):
        store.save(index, files, path, tree)
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 2 and store.load(spark, path, tree) is not None
    assert [n for n in os.listdir(path) if n.startswith("manifest.json.")] == []
    for k in range(4):
        store.save_history(spark.createDataFrame([("a", 1_800_000_000_000 - k)], "path string, at_ms long"), str(tmp_path / "h"), 1_800_000_000_000)
    assert store.load_history(spark, str(tmp_path / "h")).count() == 4 and len([n for n in os.listdir(tmp_path / "h") if n.startswith("v-")]) == 2


def test_tree_scan_has_no_cap(spark, sf_dir, monkeypatch):
    from siftwell import registry
    from tests.compare import assert_same, expected

    monkeypatch.setattr(scan, "__defaults__", (3, *scan.__defaults__[1:]))
    assert_same(registry.QUERIES["tree_scan"](spark, sf_dir).toPandas(), expected(registry.ORACLES["tree_scan"], sf_dir))
