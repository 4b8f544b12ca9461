import random

import pytest

from siftwell.functions.score import typo_budget
from siftwell.operators import grep, trigrams


def files_of(spark, rows):
    return spark.createDataFrame([(i, p, len(c) if size is None else size, c) for i, (p, c, size) in enumerate(rows)], "file_id long, path string, size long, content string")


@pytest.fixture(scope="module")
def files(spark):
    return files_of(spark, [("a.ts", "first\r\ntarget here\nthird\nTarget again\n", None), ("b.png", "target", None), ("c.dat", "tar\x00get target", None), ("d/e.txt", "const totalCount = compute(items);", None), ("big.json", "target in a large file", 3_000_000), ("huge.json", "target", 11_000_000), ("bun.lock", "pinned target", None), ("empty.txt", "", None)]).cache()


def lines(df):
    return sorted((r.path, r.line, r.start, r.stop) for r in df.collect())


def test_literal_lines_numbers_and_spans(files):
    assert lines(grep.grep_lines(files, "target")) == [("a.ts", 2, 0, 6), ("a.ts", 4, 0, 6), ("big.json", 1, 0, 6), ("bun.lock", 1, 7, 13)]
    assert lines(grep.grep_lines(files, "target", ignore_case=False)) == [("a.ts", 2, 0, 6), ("big.json", 1, 0, 6), ("bun.lock", 1, 7, 13)]
    assert lines(grep.grep_lines(files, "tar%")) == []


def test_narrowed_search_finds_unindexed_files(files):
    index = trigrams.build(files)
    assert lines(grep.grep_lines(files, "target", index=index)) == lines(grep.grep_lines(files, "target"))
    assert not index.has(4)
    assert 0 < grep.scanned(files, "target", "literal", True, index) < files.count()


def test_regex_and_errors(files):
    assert lines(grep.grep_lines(files, r"total\w+", "regex")) == [("d/e.txt", 1, 6, 16)]
    with pytest.raises(ValueError, match="Invalid regex"):
        grep.grep_lines(files, "(unclosed", "regex")
    with pytest.raises(ValueError):
        grep.grep_lines(files, "x", "glob")
    assert grep.grep_lines(files, "").count() == 0
    assert [r.line for r in grep.grep_lines(files, "^$", "regex").where("path = 'a.ts'").collect()] == [5]


def test_word_boundaries_follow_word_characters(spark):
    own = files_of(spark, [("x.txt", "ééa nation", None)])
    assert lines(grep.grep_lines(own, r"\bnation\b", "regex")) == [("x.txt", 1, 4, 10)]
    assert grep.java_pattern(r"[\b]\b", False).startswith(r"[\b](?:")


def test_fuzzy_tolerates_missing_letters(files):
    assert [r.path for r in grep.grep_lines(files, "totalcnt", "fuzzy").collect()] == ["d/e.txt"]


def test_fuzzy_against_a_plain_loop():
    def plain(line, needle, budget):
        text, reach = line.lower(), max(3 * len(needle), len(needle) + 8)
        for start in range(len(text)):
            at, missing = start, 0
            for c in needle:
                found = text.find(c, at)
                if found < 0 or found - start > reach:
                    missing += 1
                else:
                    at = found + 1
            if missing <= budget and missing < len(needle):
                return start, min(at, len(text))
        return None

    random.seed(3)
    for _ in range(300):
        texts = ["".join(random.choice("abcdé ") for _ in range(random.randint(0, 40))) for _ in range(8)]
        needle = "".join(random.choice("abcdéz") for _ in range(random.randint(1, 9)))
        want = {i: s for i, t in enumerate(texts) if (s := plain(t, needle, typo_budget(needle)))}
        assert {int(i): (int(a), int(b)) for i, a, b in zip(*grep.fuzzy_spans(texts, needle, typo_budget(needle)))} == want


def test_glob_is_a_part_of_the_path(files):
    assert {r.path for r in grep.grep_lines(files, "t", glob="*.lock").collect()} == {"bun.lock"}


def test_pages_have_no_gap_and_no_repeat(spark):
    own = files_of(spark, [(p, "needle", None) for n in range(15) for p in (f"d{n:02}/inner.txt", f"d{n:02}.txt")])
    seen, cursor, totals = [], None, set()
    while True:
        page = grep.grep(own, "needle", limit=7, cursor=cursor)
        seen += [r.path for r in page.items.collect()]
        totals.add(page.total)
        if (cursor := page.cursor) is None:
            break
    assert seen == sorted({p for n in range(15) for p in (f"d{n:02}/inner.txt", f"d{n:02}.txt")}) and totals == {30}


def test_early_stop_gives_a_lower_bound(spark):
    own = files_of(spark, [(f"f{i}.txt", "same line", None) for i in range(30)])
    page = grep.grep(own, "sme line", "fuzzy", limit=10, early_stop=True)
    assert (page.total, page.exact, page.cursor) == (11, False, "10")
    whole = grep.grep(own, "sme line", "fuzzy", limit=50, early_stop=True)
    assert (whole.total, whole.exact, whole.cursor) == (30, True, None)
    assert grep.grep(own, "same", index=trigrams.build(own), limit=10, early_stop=True).total == 30


def test_bytes_are_sniffed_and_decoded(spark):
    rows = [(0, "a.txt", 9, bytearray(b"caf\xe9 line")), (1, "b.txt", 9, bytearray(b"li\x00ne line")), (2, "c.txt", 2, bytearray(b"\x10\x02 line"))]
    own = spark.createDataFrame(rows, "file_id long, path string, size long, content binary")
    got = {r.path: r.text for r in grep.grep_lines(own, "line", index=trigrams.build(own)).collect()}
    assert got == {"a.txt": "caf� line", "c.txt": "\x10\x02 line"}
