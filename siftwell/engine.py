"""The search engine over one tree: files, index and history in one object."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import formatting
from siftwell.functions.score import typo_budget  # noqa: F401  part of the interface
from siftwell.materialise import discard, prepare_checkpoints
from siftwell.operators import find as finding
from siftwell.operators import frecency as history
from siftwell.operators import grep as grepping
from siftwell.operators import maintain
from siftwell.operators.paging import Page
from siftwell.operators.trigrams import PUSHED_IDS, Index, build, candidates, closed, with_unindexed
from siftwell.plans.planner import literal_runs  # noqa: F401  part of the interface
from siftwell.sources import store
from siftwell.sources.tree import read_paths, scan

#: Files that may differ from the written tables, and touches that are not yet written, before they
#: are folded in; both are held as lists and small tables until then.
FOLD_AT = 4096
TOUCHES_AT = 1024
KNOWN = ["file_id", "path", "size", "mtime_ms", "alive"]
CONTENT = ["path", "size", "mtime_ms", "content"]


class SearchEngine:
    """find and grep over a tree, with access history and a stored index.

    `now` gives the time in milliseconds; pass your own to make scores repeatable. With `cache`, the
    index is read from there if it is whole, reconciled with the tree, and written if that changed
    anything. With `background`, the index is built beside the caller: until it is there, searches
    read the whole tree, with the same answers.

    The index is written tables in the shared folder and small tables of what changed since, so one
    changed file costs its own postings and not a new index; `dispose` deletes them.
    """

    name = "spark"

    def __init__(self, spark: SparkSession, root: str, cache: str | None = None, files: DataFrame | None = None, now: Callable[[], int] = lambda: int(time.time() * 1000), background: bool = False):
        self.spark, self.root, self.cache, self.now = spark, root, cache, now
        self._given = files
        self._folder = f"{prepare_checkpoints(spark)}/engine-{uuid.uuid4().hex}"
        self._touched, self._pending = spark.createDataFrame([], "path string, at_ms long"), []
        self._stats, self._failed, self._built = maintain.Stats(0, 0), None, threading.Event()
        self._lock, self._changed, self._late, self._late_index = threading.RLock(), set(), None, None
        self._content = self._read()
        if background:
            threading.Thread(target=self._start, daemon=True).start()
        else:
            self._start()
            self.wait()

    # ---- building and written tables ---------------------------------------------------------

    def _read(self) -> DataFrame:
        return self._given if self._given is not None else scan(self.spark, self.root)

    def _written(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _start(self) -> None:
        try:
            stored = store.load(self.spark, self.cache, self.root) if self.cache else None
            if stored is None:
                self._hold(build(self._content), self._content.drop("content"))
                self._stats = maintain.Stats(0, self._known.count())
                changed = True
            else:
                changed = self._take_in(*stored)
            if self.cache and changed:
                self.save()
        except Exception as e:  # told to whoever waits or asks
            self._failed = e
        finally:
            self._built.set()

    def _hold(self, index: Index, known: DataFrame) -> None:
        """Index and metadata are written down: they must not be read again from a tree that moves on."""
        with self._lock:
            self._known = self._written(known.select(*KNOWN))
            whole = Index(self._written(index.postings.repartitionByRange("trigram", "file_id").sortWithinPartitions("trigram", "file_id")), self._written(index.indexed))
            self._base = Index(whole.postings, whole.indexed, self._written(closed(whole, self._known).outside))
            self._changed, self._late, self._late_index = set(), None, None

    def _take_in(self, index: Index, known: DataFrame) -> bool:
        """Reconciles with the tree as `_content` lists it now."""
        index, known, diff = maintain.reconcile(index, known, self._content)
        diff = self._written(diff)
        self._hold(index, known)
        self._stats = maintain.stats(diff)
        return maintain.dirty(diff, stored=True)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the index is there, after at most so many seconds; a failed build raises."""
        done = self._built.wait(seconds)
        if self._failed is not None:
            raise self._failed
        return done

    def ready(self) -> bool:
        return self._built.is_set() and self._failed is None

    def building(self) -> int | None:
        """Files found so far while the index is being built, else None."""
        return None if self.ready() else self._content.count()

    # ---- what is known now -------------------------------------------------------------------

    @property
    def index(self) -> Index:
        """The written index without what changed since, and the postings of that."""
        if not self._changed:
            return self._base
        same, late = ~F.col("file_id").isin(list(self._changed)), self._late_index
        return Index(*(a.where(same).unionByName(b) for a, b in ((self._base.postings, late.postings), (self._base.indexed, late.indexed), (self._base.outside, late.outside))))

    @property
    def known(self) -> DataFrame:
        """file_id, path, size, mtime_ms, alive of every file there is or was."""
        if not hasattr(self, "_known"):  # while building
            return self._content.select(*KNOWN)
        if not self._changed:
            return self._known
        return self._known.where(~F.col("file_id").isin(list(self._changed))).unionByName(self._late.select(*KNOWN))

    @property
    def files(self) -> DataFrame:
        """Living files with their content, which each search reads anew."""
        content = self._content.select(*CONTENT)
        if hasattr(self, "_known") and self._changed:
            late = self._late.where("given")
            content = content.join(F.broadcast(late.select("path")), "path", "left_anti").unionByName(late.select(*CONTENT))
        return content.join(self.known.where("alive").select("path", "file_id", "alive"), "path")

    def _some_files(self, ids: list[int]) -> DataFrame:
        """The same for a few files, and nothing else of the tree is read."""
        rows = {r["path"]: r for r in self.known.where(F.col("alive") & F.col("file_id").isin(ids)).collect()}
        given = self._late.where("given").select("path", "content") if self._changed else self.spark.createDataFrame([], self._content.select("path", "content").schema)
        late = {r["path"] for r in given.select("path").collect()}
        old = [p for p in rows if p not in late]
        content = self._given.where(F.col("path").isin(old)).select("path", "content") if self._given is not None else read_paths(self.spark, self.root, old)
        few = self.spark.createDataFrame([tuple(r[c] for c in KNOWN) for r in rows.values()], self._known.schema)
        return content.unionByName(given).join(F.broadcast(few), "path")

    # ---- searches ----------------------------------------------------------------------------

    def find(self, query: str, limit: int = 20, cursor: str | None = None) -> Page:
        return finding.find(self.known, query, self.now(), limit, cursor, history.frecency(self.touches, self.now()))

    def grep(self, pattern: str, mode: str = "literal", ignore_case: bool = True, glob: str | None = None, limit: int = 20, cursor: str | None = None, early_stop: bool = False) -> Page:
        """A page of matches. Where the index leaves few files, only these are opened."""
        if not self.ready():
            return grepping.grep(self.files, pattern, mode, ignore_case, None, glob, limit, cursor, early_stop)
        plan = grepping.checked_plan(self.spark, pattern, mode, ignore_case)
        found = candidates(self.index, plan) if pattern else None
        if found is not None:
            ids = [r["file_id"] for r in with_unindexed(found, self.index, self.known).orderBy("file_id").limit(PUSHED_IDS + 1).collect()]
            if len(ids) <= PUSHED_IDS:
                try:
                    return grepping.grep(self._some_files(ids), pattern, mode, ignore_case, None, glob, limit, cursor)
                except AnalysisException as e:  # a file went meanwhile; the whole tree is listed anew
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
                    self._content = self._read()
        return grepping.grep(self.files, pattern, mode, ignore_case, self.index, glob, limit, cursor, early_stop)

    # ---- history -----------------------------------------------------------------------------

    @property
    def touches(self) -> DataFrame:
        """The access history: what is written and the few touches since."""
        return history.note_all(self._touched, self._pending)

    def touch(self, path: str) -> None:
        self._pending.append((path, self.now()))
        if len(self._pending) >= TOUCHES_AT:
            self._touched, self._pending = self._written(self.touches), []

    def load_history(self, path: str) -> None:
        self._touched, self._pending = store.load_history(self.spark, path), []

    def save_history(self, path: str) -> None:
        store.save_history(self.touches, path, self.now())

    # ---- changes -----------------------------------------------------------------------------

    def _note_changes(self, rows: DataFrame) -> None:
        """Takes in rows of a few files: KNOWN, content, and given (whether content is theirs)."""
        with self._lock:
            rows = self._written(rows)
            ids = {r["file_id"] for r in rows.select("file_id").collect()}
            others = lambda df: df.where(~F.col("file_id").isin(list(ids)))
            late = rows if self._late is None else self._written(others(self._late).unionByName(rows))
            new = build(rows.where("alive and given"), arrange=False)
            postings, indexed = new.postings, new.indexed
            if self._late_index is not None:
                postings, indexed = others(self._late_index.postings).unionByName(postings), others(self._late_index.indexed).unionByName(indexed)
            small = Index(self._written(postings.coalesce(1)), self._written(indexed.coalesce(1)))
            self._late, self._late_index, self._changed = late, closed(small, late), self._changed | ids
            if len(self._changed) >= FOLD_AT:
                self._fold()

    def _fold(self) -> None:
        """The changes become part of the written tables."""
        files = self.files
        self._hold(self.index, self.known)
        self._content = self._written(files.select(*self._content.columns)) if self._given is not None else self._read()

    def refresh(self, changed: DataFrame) -> None:
        """Takes whole rows (file_id, path, size, mtime_ms, content, alive) of created or changed
        files. Beyond `FOLD_AT` of them, the index is written anew."""
        self.wait()
        ids = self.known.select("path", F.col("file_id").alias("_id"))
        rows = changed.join(ids, "path", "left").withColumn("file_id", F.coalesce("_id", "file_id")).select(*KNOWN, "content")
        if len(rows.limit(FOLD_AT + 1).select("file_id").collect()) > FOLD_AT:
            index, known = maintain.refresh(self.index, self.known, rows)
            content = self._content.join(rows.select("path"), "path", "left_anti").select(*CONTENT).unionByName(rows.select(*CONTENT))
            self._hold(index, known)
            self._content = self._written(content).join(self.known.select("path", "file_id", "alive"), "path")
            return
        self._note_changes(rows.withColumn("given", F.lit(True)))

    def forget(self, path: str) -> None:
        """The path is dead; its id stays its own. An unknown path changes nothing."""
        self.wait()
        row = self.known.where(F.col("path") == path).limit(1).collect()
        if row:
            schema = self.spark.createDataFrame([], self._content.schema).select("content").schema["content"].dataType
            dead = self.spark.createDataFrame([tuple(row[0][c] for c in KNOWN)], self._known.schema).withColumn("alive", F.lit(False))
            self._note_changes(dead.select(*KNOWN, F.lit(None).cast(schema).alias("content"), F.lit(False).alias("given")))

    def reconcile(self) -> maintain.Stats:
        """Lists the tree again and takes in whatever changed; only that is read."""
        self.wait()
        with self._lock:
            self._content = self._read()
            self._take_in(self.index, self.known)
        return self._stats

    # ---- state -------------------------------------------------------------------------------

    def save(self) -> None:
        """Writes the index for the next start."""
        if not self.cache:
            raise ValueError("this engine has no cache")
        store.save(self.index, self.known_living(), self.cache, self.root)

    def known_living(self) -> DataFrame:
        """The living files' metadata, as a search and a stored index take them."""
        known = self._known if not self._changed else self.known
        return known.where("alive")

    def indexed(self) -> int:
        return self.index.size()

    def file_count(self) -> int:
        return self.known.where("alive").count()

    def stats(self) -> maintain.Stats:
        return self._stats

    def status(self) -> str:
        if not self.ready():
            return formatting.status_text(self.name, self.root, building=self.building())
        return formatting.status_text(self.name, self.root, self.indexed(), self._stats.reused, self._stats.rebuilt)

    def dispose(self) -> None:
        """Deletes the engine's tables; the stored index and history stay."""
        self._built.wait()
        discard(self.spark, self._folder)
