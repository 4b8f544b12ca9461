import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.operators import grep, trigrams
from siftwell.plans.planner import All, Need, for_literal, for_patterns, for_regex, literal_runs

# Patterns and the literal runs they are known to require.
RUNS = {
    "hello": ["hello"], "foo.*bar": ["foo", "bar"], "colou?rful": ["colo", "rful"], "a+bcde": ["bcde"], "a.b": [], "x[abcdef]y": [], "[abcdef]": [], "a{2,4}bcdef": ["bcdef"], "x{10,200}y": [],
    "a(bcdef)g": ["bcdef"], r"ab\[cdef": ["ab[cdef"], "xy[abcdef": [], "(abcd)?xyz": ["xyz"], "(abcd)*xyz": ["xyz"], "(abcd){0,2}xyz": ["xyz"], "((abc)de)?fgh": ["fgh"], "(abc)+def": ["abc", "def"],
    "(abc)def": ["abc", "def"], "(?:abcd)efg": ["abcd", "efg"], "(?:abcd)?efg": ["efg"], "(?!abcd)efg": ["efg"], "(?=abcd)efg": ["efg"], r"abc\(def": ["abc(def"],
}


@pytest.mark.parametrize("pattern", RUNS)
def test_runs(pattern):
    assert literal_runs(pattern) == RUNS[pattern]


def test_plans():
    assert for_literal("ab") == All() == for_literal("")
    assert for_literal("ABCD") == Need(frozenset({"abc", "bcd"}))
    assert for_regex("x[abcdef]y") == All()
    assert for_regex("abcd|x.y") == All()
    assert for_regex("abc|xyz") == Need(frozenset(), ((Need(frozenset({"abc"})), Need(frozenset({"xyz"}))),))
    assert for_patterns([]) == All()
    assert for_patterns([for_literal("abc"), All()]) == All()


@pytest.mark.parametrize("pattern", [r"\x41bcd", r"\u0041bcd", r"(?<n>abc)x\k<n>", "[[:alpha:]xyz]", "[]xyz]", "(?i)abc", "abc{", r"\Qabc"])
def test_what_is_not_understood_needs_nothing(pattern):
    assert for_regex(pattern) == All()


CASES = [
    ("x(foo|bar)?yyy", "xyyy"), ("(?!foo|bar)baz", "a baz here"), (r"\x41bcd", "Abcd"), (r"\u0041bcd", "Abcd"), (r"(?<n>abc)x\k<n>", "abcxabc"), ("x[abcdef]y", "xay"), ("(abcd)?xyz", "xyz"),
    ("colou?rful", "colorful"), ("straße", "STRASSE straße"), ("mask", "maſk MAſK"), ("kilo", "Kilo"), ("ist", "İst"), ("café", "CAFÉ"), ("ΟΔΟΣ", "οδος ΟΔΟΣ"), ("a{0}bcd", "bcd"), ("(ab|cd)+efg", "cdefg"),
]


def _files(spark, texts):
    rows = [(i, f"f{i}.txt", len(t.encode()), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_id long, path string, size long, content string")


@pytest.mark.parametrize("ignore_case", [True, False])
def test_narrowing_hides_nothing(spark, ignore_case):
    files = _files(spark, [t for _, t in CASES] + ["nothing of the kind", ""]).cache()
    index = trigrams.build(files)
    for pattern, _ in CASES:
        for mode in ("regex", "literal"):
            whole = grep.grep_lines(files, pattern, mode, ignore_case).collect()
            assert sorted(grep.grep_lines(files, pattern, mode, ignore_case, index).collect()) == sorted(whole), (pattern, mode)


def test_random_patterns_agree_with_no_index(spark):
    random.seed(5)
    texts = ["".join(random.choice("abcAB \né") for _ in range(random.randint(0, 60))) for _ in range(60)]
    files = _files(spark, texts).cache()
    index = trigrams.Index(trigrams.build(files).postings.cache(), trigrams.build(files).indexed.cache())
    some = 0
    for _ in range(25):
        atoms = ["".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(3)]
        pattern = "".join(random.choice([a, f"({a})?", f"[{a}]", f"({a}|{a[::-1]})", f"{a}+", "."]) for a in atoms)
        want = {(f"f{i}.txt", n + 1) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if re.search(pattern, line, re.I)}
        got = {(r.path, r.line) for r in grep.grep_lines(files, pattern, "regex", index=index).select("path", "line").collect()}
        assert {w for w in want if texts[int(w[0][1:-4])]} == got, pattern
        some += len(got)
    assert some > 50


def test_index_replaces_removes_and_reports(spark):
    files = _files(spark, ["alpha beta", "gamma", ""])
    index = trigrams.build(files)
    assert index.size() == 2 and index.has(0) and not index.has(2)
    again = trigrams.add(index, _files(spark, ["delta"]))
    assert trigrams.candidates(again, for_literal("alpha")).count() == 0
    assert [r.file_id for r in trigrams.candidates(again, for_literal("delta")).collect()] == [0]
    assert trigrams.remove(index, spark.createDataFrame([(9,), (1,)], "file_id long")).size() == 1
    assert trigrams.candidates(index, for_literal("zzz")).count() == 0
    assert trigrams.candidates(index, All()) is None
    forward = {r.file_id: r.trigrams for r in trigrams.by_file(index).collect()}
    assert forward[1] == sorted({"gam", "amm", "mma"})
    exploded = files.select("file_id", F.explode(trigrams.trigrams_of(F.col("content"))).alias("trigram")).collect()
    assert sorted((r.trigram, r.file_id) for r in exploded) == sorted((r.trigram, r.file_id) for r in index.postings.collect())
