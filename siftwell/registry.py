"""Registered queries and their DuckDB counterparts.

Each query runs an operator over whole tables; the recipes that turn the tables into files,
touches and snapshots are in `siftwell.sources.tree` and below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.formatting import files_text, remaining, shown_line
from siftwell.functions import score, text
from siftwell.materialise import prepare_checkpoints
from siftwell.operators import find, frecency, grep, maintain, trigrams
from siftwell.plans import planner
from siftwell.sources.ignore import ignored, parse_rules
from siftwell.sources import store
from siftwell.sources.tree import capped, from_documents, from_pages, scan, spread, write_tree
from siftwell.streaming.changes import route, tree_events

#: Fixed value: the clock of every query, 2024-01-31T00:00:00Z.
NOW = 1_706_659_200_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), NOW)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as touches of documents: event e touches document e modulo their number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    named = documents(spark, sf_dir).select(F.col("file_id").alias("_id"), "path")
    made = events.select((F.col("event_id") % n).alias("_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "user_id")
    return made.join(named, "_id").select("path", "at_ms", "user_id")


DOCS_SQL = f"""docs as (select doc_id as file_id, 'docs/' || lang || '/' || source || '/doc_' || doc_id || '.txt' as path, strlen(text) as size,
  {NOW} - (doc_id * 3571 % 1209600) * 1000 as mtime_ms, text as content from documents)"""
PAGES_SQL = "site as (select page_id as file_id, regexp_replace(url, '^https?://', '') as path, html as content from pages)"
TOUCHES_SQL = f"""touches as (select path, epoch_us(cast(ts as timestamp)) // 1000 as at_ms, user_id from events join docs on docs.file_id = event_id % (select count(*) from documents))"""
LINES_SQL = "lines as (select file_id, path, unnest(string_split_regex(content, '\\r?\\n')) as text, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) as line from docs)"


def _score_sql(needle: str, budget: int) -> str:
    """The fuzzy match of every line by its definition: from each start, the needle's characters in order
    within a reach, at most `budget` missing and one placed; the leftmost start that works."""
    reach = max(3 * len(needle), len(needle) + 8)
    chars = ", ".join(f"'{c}'" for c in needle)
    state = "{'at': cast(b as bigint), 'missing': 0, 'c': ''}"
    at = "instr(substr(t, s.at, b + %d + 1 - s.at), k.c)" % reach
    step = f"case when {at} > 0 then {{'at': s.at + {at}, 'missing': s.missing, 'c': ''}} else {{'at': s.at, 'missing': s.missing + 1, 'c': ''}} end"
    walk = f"list_reduce(list_prepend({state}, list_transform([{chars}], lambda x: {{'at': cast(0 as bigint), 'missing': 0, 'c': x}})), lambda s, k: {step})"
    return f"""tried as (select path, line, text, b, {walk} as s from (select *, lower(text) as t, unnest(range(1, length(text) + 1)) as b from lines)),
best as (select path, line, any_value(text) as text, min(b) as b, arg_min(s.at, b) as till from tried where s.missing <= {budget} and s.missing < {len(needle)} group by path, line)"""


def _hits_sql(condition: str, start: str, stop: str, tail: str = "") -> str:
    return f"with {DOCS_SQL}, {LINES_SQL} select path, cast(line as integer) as line, text, cast({start} as integer) as start, cast({stop} as integer) as stop from lines where {condition} {tail}"


# ---- line search ----------------------------------------------------------------------------

_TION = _hits_sql("contains(lower(text), 'tion')", "instr(lower(text), 'tion') - 1", "instr(lower(text), 'tion') + 3")


@query(_TION)
def grep_literal(spark, sf_dir):
    """All lines that hold a literal in any case."""
    return grep.grep_lines(documents(spark, sf_dir), "TION")


@query(_hits_sql("contains(text, 'The')", "instr(text, 'The') - 1", "instr(text, 'The') + 2"))
def grep_literal_cs(spark, sf_dir):
    """The same with case."""
    return grep.grep_lines(documents(spark, sf_dir), "The", ignore_case=False)


@query(_hits_sql("contains(lower(text), 'éau')", "instr(lower(text), 'éau') - 1", "instr(lower(text), 'éau') + 2"))
def grep_literal_accent(spark, sf_dir):
    """A literal beyond ASCII."""
    return grep.grep_lines(documents(spark, sf_dir), "ÉAU")


_LICENSED = _hits_sql("contains(lower(text), 'licensed under')", "instr(lower(text), 'licensed under') - 1", "instr(lower(text), 'licensed under') + 13")


@query(_LICENSED)
def grep_narrowed(spark, sf_dir):
    """A literal search narrowed by the index: the same answer as without it."""
    files = documents(spark, sf_dir)
    return grep.grep_lines(files, "Licensed under", index=trigrams.build(files, arrange=False))


@query(_LICENSED)
def grep_narrowed_rarest(spark, sf_dir):
    """The same, asking only for the rarest of the required trigrams."""
    files = documents(spark, sf_dir)
    index = trigrams.build(files, arrange=False)
    return grep.grep_lines(files, "Licensed under", index=index, rarest=trigrams.frequencies(index))


_REGEX = "(?:rel|L)[ei]+(?:as|cens)ed under (?:the|CC) [A-Z]+"


def _regex_sql(pattern: str, flags: str) -> str:
    found = f"regexp_extract(text, '{pattern}', 0, '{flags}')"
    return _hits_sql(f"regexp_matches(text, '{pattern}', '{flags}')", f"instr(text, {found}) - 1", f"instr(text, {found}) - 1 + length({found})")


@query(_regex_sql("[a-z]+tion[.,]", "i"))
def grep_regex(spark, sf_dir):
    """All lines that a regular expression matches in any case."""
    return grep.grep_lines(documents(spark, sf_dir), "[a-z]+tion[.,]", "regex")


@query(_regex_sql(_REGEX, "i"))
def grep_regex_narrowed(spark, sf_dir):
    """A regular expression with choices, narrowed by the index."""
    files = documents(spark, sf_dir)
    return grep.grep_lines(files, _REGEX, "regex", index=trigrams.build(files, arrange=False))


@query(_regex_sql("(MIT|Apache) License", "c"))
def grep_regex_cs(spark, sf_dir):
    """A case-sensitive regular expression through the folded index."""
    files = documents(spark, sf_dir)
    return grep.grep_lines(files, "(MIT|Apache) License", "regex", ignore_case=False, index=trigrams.build(files, arrange=False))


@query(f"with {DOCS_SQL}, {LINES_SQL}, {_score_sql('licenced undr', score.typo_budget('licenced undr'))} select path, cast(line as integer) as line, text, cast(b - 1 as integer) as start, cast(till - 1 as integer) as stop from best")
def grep_fuzzy(spark, sf_dir):
    """Lines that hold something like a word."""
    return grep.grep_lines(documents(spark, sf_dir), "licenced undr", "fuzzy")


@query(_hits_sql("false", "0", "0"))
def grep_empty(spark, sf_dir):
    """An empty pattern matches no line."""
    return grep.grep_lines(documents(spark, sf_dir), "")


@query(_hits_sql("contains(lower(text), 'licensed')", "instr(lower(text), 'licensed') - 1", "instr(lower(text), 'licensed') + 7").replace("line, text,", "line, left(text, 40) as text,", 1))
def grep_cut_text(spark, sf_dir):
    """Matches whose text is cut once it has matched."""
    return grep.grep_lines(documents(spark, sf_dir), "licensed", longest=40)


@query(f"""with {DOCS_SQL}, {LINES_SQL} select mode, case when mode = 'regex' then (select count(*) from lines where regexp_matches(text, '[0-9]+')) else (select count(*) from lines where contains(lower(text), 'of')) end as lines
  from (values ('regex'), ('literal')) as m(mode)""")
def grep_nothing_narrows(spark, sf_dir):
    """Searches with an index whose plans require nothing: every file is read."""
    files = documents(spark, sf_dir)
    index = trigrams.build(files, arrange=False)
    counts = [grep.grep_lines(files, pattern, mode, index=index).select(F.lit(mode).alias("mode")) for mode, pattern in (("regex", "[0-9]+"), ("literal", "of"))]
    return counts[0].unionByName(counts[1]).groupBy("mode").agg(F.count("*").alias("lines"))


@query(f"with {DOCS_SQL} select 'license' as pattern, count(*) filter (contains(lower(content), 'lic') and contains(lower(content), 'ice') and contains(lower(content), 'cen') and contains(lower(content), 'ens') and contains(lower(content), 'nse')) as scanned, count(*) as files from docs")
def grep_scanned(spark, sf_dir):
    """How many files a narrowed search verifies, and how many there are."""
    files = documents(spark, sf_dir)
    n = grep.scanned(files, "license", "literal", True, trigrams.build(files, arrange=False))
    return files.agg(F.count("*").alias("files")).select(F.lit("license").alias("pattern"), F.lit(n).cast("bigint").alias("scanned"), "files")


@query("select pattern, error from (values ('a(b', true), ('a(b)', false), ('[z', true), ('x{2,1}', true)) as p(pattern, error)")
def grep_invalid_patterns(spark, sf_dir):
    """Which patterns are refused: an error, never an empty page."""

    def refused(pattern: str) -> bool:
        try:
            grep.grep_lines(documents(spark, sf_dir), pattern, "regex")
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(p, refused(p)) for p in ("a(b", "a(b)", "[z", "x{2,1}")], "pattern string, error boolean")


@query(_hits_sql("contains(lower(text), 'tion') and contains(path, '/en/')", "instr(lower(text), 'tion') - 1", "instr(lower(text), 'tion') + 3"))
def grep_glob(spark, sf_dir):
    """A search within some paths."""
    return grep.grep_lines(documents(spark, sf_dir), "tion", glob="*/en/*")


@query(f"select path, line, text, start, stop from ({_TION}) order by path, line limit 20 offset 40")
def grep_page_3(spark, sf_dir):
    """The third page of a search."""
    return grep.grep(documents(spark, sf_dir), "tion", cursor="40").items


@query(f"with h as ({_TION}) select cast(count(*) as bigint) as total, cast(least(count(*), 60) as varchar) as cursor, true as exact from h")
def grep_total(spark, sf_dir):
    """Total, cursor and exactness of a page."""
    page = grep.grep(documents(spark, sf_dir), "tion", cursor="40")
    return spark.createDataFrame([(page.total, page.cursor, page.exact)], "total bigint, cursor string, exact boolean")


@query("select cast(21 as bigint) as total, '20' as cursor, false as exact")
def grep_early_stop(spark, sf_dir):
    """A bounded total: one hit more than the page needs."""
    page = grep.grep(documents(spark, sf_dir), "tion", early_stop=True)
    return spark.createDataFrame([(page.total, page.cursor, page.exact)], "total bigint, cursor string, exact boolean")


@query(f"""with {DOCS_SQL}, {LINES_SQL} select path || ':' || line || ': ' || case when length(t) > 200 then left(t, 200) || ' […]' else t end as shown
  from (select path, line, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from lines where contains(lower(text), 'licensed'))""")
def grep_shown(spark, sf_dir):
    """Matches as they are shown."""
    hits = grep.grep_lines(documents(spark, sf_dir), "licensed")
    return hits.select(shown_line(F.col("path"), F.col("line"), F.col("text")).alias("shown"))


@query("select conv_id, turn, cast(instr(lower(text), 'the') - 1 as integer) as start from conversations where contains(lower(text), 'the')")
def match_turns(spark, sf_dir):
    """The matcher over another relation: turns that hold a literal."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return grep.match_lines(turns, "the").select("conv_id", "turn", "start")


# ---- trigram index --------------------------------------------------------------------------

_POST = f"""{DOCS_SQL}, post as (select distinct file_id, unnest(list_transform(range(1, greatest(len(content) - 1, 1)), lambda i: substr(content, i, 3))) as trigram
  from (select file_id, lower(content) as content from docs))"""
#: Splitting into characters first keeps the SQL linear in long texts.
_CHARS = f"""{DOCS_SQL}, c as (select file_id, regexp_extract_all(lower(content), '(?s).') as c from docs),
post as (select distinct file_id, unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])) as trigram from c)"""


@query(f"with {_CHARS} select trigram, cast(count(*) as bigint) as df from post group by trigram")
def trigram_frequencies(spark, sf_dir):
    """In how many files each trigram is."""
    return trigrams.frequencies(trigrams.build(documents(spark, sf_dir), arrange=False))


@query(f"with {_CHARS} select file_id, cast(count(*) as bigint) as n, md5(string_agg(trigram, '' order by trigram)) as digest from post group by file_id")
def trigram_forward(spark, sf_dir):
    """The forward form: each file's sorted trigrams."""
    forward = trigrams.by_file(trigrams.build(documents(spark, sf_dir), arrange=False))
    return forward.select("file_id", F.size("trigrams").cast("bigint").alias("n"), F.md5(F.array_join("trigrams", "").cast("binary")).alias("digest"))


@query(f"with {_CHARS} select file_id from post where trigram in ('lic', 'ice', 'cen', 'ens', 'nse') group by file_id having count(*) = 5")
def candidates_and(spark, sf_dir):
    """Files that hold every required trigram."""
    return trigrams.candidates(trigrams.build(documents(spark, sf_dir), arrange=False), planner.for_literal("LICENSE"))


@query(f"""with {_CHARS} select file_id from (select file_id from post where trigram in ('mit', 'it ', 't l') group by file_id having count(*) = 3
  union select file_id from post where trigram in ('apa', 'pac', 'ach', 'che') group by file_id having count(*) = 4)""")
def candidates_or(spark, sf_dir):
    """Files that hold all trigrams of either choice."""
    return trigrams.candidates(trigrams.build(documents(spark, sf_dir), arrange=False), planner.for_regex("mit l|apache"))


@query(f"with {DOCS_SQL} select file_id from docs where file_id % 3 <> 0 or contains(lower(content), 'license')")
def unindexed_union_back(spark, sf_dir):
    """Candidates with the files that no index covers added back, verified for the indexed ones."""
    files = documents(spark, sf_dir)
    index = trigrams.build(files.where("file_id % 3 = 0"), arrange=False)
    found = trigrams.candidates(index, planner.for_literal("license"))
    pool = trigrams.with_unindexed(found, index, files)
    return files.join(pool, "file_id", "left_semi").where((F.col("file_id") % 3 != 0) | F.lower("content").contains("license")).select("file_id")


@query(f"with {_CHARS} select trigram, cast(count(*) as bigint) as df from post where file_id % 4 <> 1 group by trigram")
def index_remove(spark, sf_dir):
    """Postings after some files were forgotten."""
    files = documents(spark, sf_dir)
    return trigrams.frequencies(trigrams.remove(trigrams.build(files, arrange=False), files.where("file_id % 4 = 1")))


@query(f"""with {_CHARS}, z as (select file_id, unnest(list_transform(range(1, len(x) - 1), lambda i: x[i : i + 2])) as trigram from (select file_id, 'new words' as x from docs where file_id % 5 = 2))
select trigram, cast(count(*) as bigint) as df from (select file_id, trigram from post where file_id % 5 <> 2 union all select distinct file_id, trigram from z) group by trigram""")
def index_replace(spark, sf_dir):
    """Postings after some files were added again with other content: stale ones are gone."""
    files = documents(spark, sf_dir)
    changed = files.where("file_id % 5 = 2").withColumns({"content": F.lit("new words"), "size": F.lit(9).cast("long")})
    return trigrams.frequencies(trigrams.add(trigrams.build(files, arrange=False), changed))


@query(f"""with {_CHARS} select file_id from post where trigram in ('rel', 'ele', 'lea', 'eas', 'ase', 'sed') group by file_id having count(*) = 6
  union select file_id from post where trigram in ('apa', 'pac', 'ach', 'che') group by file_id having count(*) = 4""")
def candidates_of_patterns(spark, sf_dir):
    """Files that may hold any of several patterns: one plan for all, and the runs that a regular expression requires."""
    plans = [planner.for_literal("Released"), planner.for_regex("x?(?:Apache)+[0-9]*")]
    return trigrams.candidates(trigrams.build(documents(spark, sf_dir), arrange=False), planner.for_patterns(plans))


@query(f"with {DOCS_SQL} select file_id, file_id % 3 = 0 as has, (select count(*) from docs where file_id % 3 = 0) as size from docs where file_id in (3, 4, 5, 6)")
def index_has_and_size(spark, sf_dir):
    """Whether files are in an index, and how many are."""
    index = trigrams.build(documents(spark, sf_dir).where("file_id % 3 = 0"), arrange=False)
    size = index.size()
    return spark.createDataFrame([(i, index.has(i), size) for i in (3, 4, 5, 6)], "file_id bigint, has boolean, size bigint")


@query(f"with {_CHARS} select trigram, cast(count(*) as bigint) as df, (select count(*) from docs) as files from post group by trigram")
def stored_index(spark, sf_dir):
    """An index through its stored form and back, with its guards."""
    files, root = documents(spark, sf_dir), sf_dir
    path = f"{prepare_checkpoints(spark)}/stored-{uuid.uuid4().hex}"
    store.save(trigrams.build(files), files, path, root)
    index, known = store.load(spark, path, root)
    return trigrams.frequencies(index).withColumn("files", F.lit(known.count()).cast("bigint"))


# ---- path lookup ----------------------------------------------------------------------------


def _find_sql(source: str, query_text: str, extra: str = "0", columns: str = "path, score, positions, typos") -> str:
    chars = ", ".join(f"'{c}'" for c in query_text)
    budget = score.typo_budget(query_text)
    state = "{'at': cast(0 as bigint), 'typos': 0, 'pos': cast([] as bigint[])}"
    step = "case when instr(substr(lp, s.at + 1), c) > 0 then {'at': s.at + instr(substr(lp, s.at + 1), c), 'typos': s.typos, 'pos': list_append(s.pos, s.at + instr(substr(lp, s.at + 1), c))} else {'at': s.at, 'typos': s.typos + 1, 'pos': s.pos} end"
    return f"""m as (select *, regexp_extract(path, '[^/]*$') as name from (select *, list_reduce(list_prepend({state}, list_transform([{chars}], lambda c: {{'at': cast(ascii(c) as bigint), 'typos': 0, 'pos': cast([] as bigint[])}})),
  lambda s, k: {step.replace("c)", "chr(cast(k.at as integer)))")}) as s from (select *, lower(path) as lp from {source}))),
n as (select *, s.pos as pos, s.typos as typos, lower(name) as ln, regexp_replace(lower(name), '^(.+)\\.[^.]*$', '\\1') as stem from m where s.typos <= {budget} and len(s.pos) > 0),
scored as (select *, cast(case when ln = '{query_text}' then 300 when stem = '{query_text}' then 200 when starts_with(ln, '{query_text}') then 120 when contains(ln, '{query_text}') then 60 else 0 end
  + 12 * len(list_filter(range(2, len(pos) + 1), lambda i: pos[i] = pos[i - 1] + 1))
  + 18 * len(list_filter(pos, lambda p: p = 1 or substr(path, p - 1, 1) in ('/', '_', '-', '.') or (substr(path, p - 1, 1) = lower(substr(path, p - 1, 1)) and substr(path, p, 1) <> lower(substr(path, p, 1)))))
  - 2 * least(pos[1] - 1, 40) - 40 * typos - 3 * (length(path) - length(replace(path, '/', ''))) + {extra} as integer) as score, array_to_string(list_transform(pos, lambda p: p - 1), ',') as positions from n)
"""


_RECENCY = f"""case when mtime_ms is null or mtime_ms = 0 then 0 when ({NOW} - mtime_ms) / 1000.0 < 120 then 16 when ({NOW} - mtime_ms) / 1000.0 < 900 then 8 when ({NOW} - mtime_ms) / 1000.0 < 3600 then 4
  when ({NOW} - mtime_ms) / 1000.0 < 86400 then 2 when ({NOW} - mtime_ms) / 1000.0 < 604800 then 1 else 0 end"""


def _shown(scored: DataFrame) -> DataFrame:
    return scored.select("path", "score", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"with {PAGES_SQL}, {_find_sql('site', 'exmpl/frr')} select path, score, positions from scored")
def find_score(spark, sf_dir):
    """Scores and positions of a query with typos over the pages' addresses."""
    return _shown(find.score_paths(pages(spark, sf_dir), "exmpl/frr", NOW))


@query(f"with {DOCS_SQL}, {_find_sql('docs', 'doc_12', _RECENCY)} select path, score, positions from scored order by score desc, path limit 20 offset 20")
def find_page(spark, sf_dir):
    """The second page of a lookup over documents."""
    page = find.find(documents(spark, sf_dir), "doc_12", NOW, cursor="20")
    return _shown(page.items)


@query(f"with {DOCS_SQL} select path, cast({_RECENCY} as integer) as score from docs order by score desc, path limit 50")
def find_empty_query(spark, sf_dir):
    """An empty query lists what is recent."""
    return find.find(documents(spark, sf_dir), "", NOW, limit=50).items.select("path", "score")


_FRECENCY = f"""frec as (select path, cast(least(200, floor(sum(case when ({NOW} - at_ms) / 86400000.0 between 0 and 7 then exp(-0.231 * (({NOW} - at_ms) / 86400000.0)) else 0 end) * 25 + 0.5)) as integer) as frecency from touches group by path)"""


@query(f"""with {DOCS_SQL}, {TOUCHES_SQL}, {_FRECENCY}, known as (select docs.*, frecency from docs left join frec using (path)), {_find_sql('known', 'src1/doc', _RECENCY + ' + coalesce(frecency, 0)')}
select path, score, positions from scored""")
def find_frecency(spark, sf_dir):
    """A lookup in which access history counts."""
    history = frecency.frecency(touches(spark, sf_dir), NOW)
    return _shown(find.score_paths(documents(spark, sf_dir), "src1/doc", NOW, history))


@query(f"with {DOCS_SQL} select path, cast({_RECENCY} as integer) as boost from docs")
def recency_tiers(spark, sf_dir):
    """Boosts by age."""
    return documents(spark, sf_dir).select("path", score.recency_boost(F.col("mtime_ms"), NOW).cast("int").alias("boost"))


@query(f"with {DOCS_SQL} select path, cast(case file_id % 4 when 0 then 24 when 1 then 20 when 2 then 12 else 0 end as integer) as boost from docs")
def git_boost(spark, sf_dir):
    """Boosts by git status."""
    state = F.element_at(F.array(F.lit("modified"), F.lit("staged"), F.lit("untracked"), F.lit(None)), (F.col("file_id") % 4 + 1).cast("int"))
    return documents(spark, sf_dir).select("path", score.git_boost(state).cast("int").alias("boost"))


@query(f"with {DOCS_SQL} select path, cast({_RECENCY} as integer) as score, size, mtime_ms from docs order by score desc, path limit 100")
def find_tool_page(spark, sf_dir):
    """A caller's page: the query is trimmed, the limit held at 100, and hits show size and time."""
    return find.find_tool(documents(spark, sf_dir), "   ", NOW, limit=5000).items.select("path", "score", "size", "mtime_ms")


@query(f"with {DOCS_SQL}, h as (select path, cast({_RECENCY} as integer) as score from docs order by score desc, path limit 20 offset 20) select string_agg(path, chr(10) order by score desc, path) as shown, (select count(*) - 40 from docs) as remaining from h")
def find_shown(spark, sf_dir):
    """The lines of a page of files as they are shown, and what remains."""
    page = find.find(documents(spark, sf_dir), "", NOW, cursor="20")
    shown = files_text(page, "").split("\n\n")[0].split("\n", 1)[1]
    return spark.createDataFrame([(shown, remaining(page))], "shown string, remaining bigint")


# ---- access history -------------------------------------------------------------------------


@query(f"with {DOCS_SQL}, {TOUCHES_SQL}, {_FRECENCY} select path, frecency from frec")
def frecency_decayed(spark, sf_dir):
    """The decayed number of every path."""
    return frecency.frecency(touches(spark, sf_dir), NOW)


@query(f"with {DOCS_SQL}, {TOUCHES_SQL} select path, cast(least(200, 25 * count(*)) as integer) as frecency from touches group by path")
def frecency_native(spark, sf_dir):
    """The number without decay."""
    return frecency.frecency_undecayed(touches(spark, sf_dir))


@query(f"""with {DOCS_SQL}, {TOUCHES_SQL} select path, at_ms from (select path, at_ms, row_number() over (partition by path order by at_ms desc) as n from touches where at_ms >= {NOW} - 7 * 86400000) where n <= 128""")
def history_prune(spark, sf_dir):
    """History without what is too old."""
    return frecency.prune(touches(spark, sf_dir), NOW).select("path", "at_ms")


@query(f"""with {DOCS_SQL}, {TOUCHES_SQL} select path, at_ms from (select path, at_ms, row_number() over (partition by path order by at_ms desc) as n from (select distinct path, at_ms from touches)) where n <= 128""")
def history_merge(spark, sf_dir):
    """Two histories as one."""
    all_touches = touches(spark, sf_dir)
    return frecency.merge(all_touches.where("user_id % 2 = 0"), all_touches.where("user_id % 2 = 1"))


@query(f"""with {DOCS_SQL}, {TOUCHES_SQL} select path, len(t) as n, t[1] as first, t[len(t)] as last from (select path, list(at_ms order by at_ms) as t from touches group by path)""")
def history_json_round_trip(spark, sf_dir):
    """History through its JSON form and back."""
    wide = frecency.to_wide(touches(spark, sf_dir)).select(F.to_json(F.create_map("path", "times")).alias("raw"))
    back = frecency.to_wide(frecency.from_wide(wide.select(frecency.parse(F.col("raw")).alias("history"))))
    return back.select("path", F.size("times").cast("bigint").alias("n"), F.col("times")[0].alias("first"), F.element_at("times", -1).alias("last"))


@query(f"""with {DOCS_SQL}, {TOUCHES_SQL}, a as (select path, at_ms from touches union all select 'docs/new', {NOW} union all select (select min(path) from touches), {NOW}),
n as (select a.path, a.at_ms from a where not (path = (select min(path) from touches) and at_ms < {NOW} - 7 * 86400000))
select path, at_ms from (select *, row_number() over (partition by path order by at_ms desc) as n from n) where n <= 128""")
def history_noted(spark, sf_dir):
    """History after two accesses were noted, of a new path and of a known one."""
    all_touches = touches(spark, sf_dir).select("path", "at_ms")
    known = all_touches.agg(F.min("path")).first()[0]
    return frecency.note_all(frecency.note(all_touches, "docs/new", NOW), [(known, NOW)])


# ---- scan filters ---------------------------------------------------------------------------

_RULES = """
# fixed rules of the query
/docs/de
*.html
!keep.html
src1?
**/5*
"""


@query(f"""with {PAGES_SQL}, p as (select path, string_split(path, '/') as parts from site),
a as (select path, list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '/') || '/') as above from p)
select path, (case when regexp_matches(path, '(^|/).*/5[^/]*(/|$)') then true when regexp_matches(path, '(^|/)src1[^/](/|$)') then true when regexp_matches(path, '(^|/)keep\\.html(/|$)') then false
  when regexp_matches(path, '(^|/)[^/]*\\.html(/|$)') then true when regexp_matches(path, '^docs/de(/|$)') then true else false end)
  or len(list_filter(above, lambda d: regexp_matches(d, '(^|/).*/5[^/]*(/|$)') or regexp_matches(d, '(^|/)src1[^/](/|$)') or (not regexp_matches(d, '(^|/)keep\\.html(/|$)') and (regexp_matches(d, '(^|/)[^/]*\\.html(/|$)') or regexp_matches(d, '^docs/de(/|$)'))))) > 0 as ignored from a""")
def ignore_filter(spark, sf_dir):
    """Ordered ignore rules over the pages' addresses."""
    return pages(spark, sf_dir).select("path", ignored(F.col("path"), parse_rules(_RULES)).alias("ignored"))


_BINARY = ", ".join(f"'{e}'" for e in text.BINARY_EXTENSIONS)
_NAMED = """named as (select file_id, path || case file_id % 4 when 0 then '/.env' when 1 then '/A.TAR.GZ' when 2 then '/node_modules/x.js' else '' end as path from site)"""


@query(f"""with {PAGES_SQL}, {_NAMED}, x as (select path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) as ext, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') as stem from named)
select path, ext, stem, ext in ({_BINARY}) as is_binary, cast(length(path) - length(replace(path, '/', '')) as integer) as depth, contains(path, '/node_modules/') as skipped from x""")
def path_parts(spark, sf_dir):
    """Extension, stem, binary names, depth and skipped directories."""
    tail = F.when(F.col("file_id") % 4 == 0, "/.env").when(F.col("file_id") % 4 == 1, "/A.TAR.GZ").when(F.col("file_id") % 4 == 2, "/node_modules/x.js").otherwise("")
    path = F.col("path")
    named = pages(spark, sf_dir).select(F.concat("path", tail).alias("path"))
    return named.select("path", text.extension(path).alias("ext"), text.stem(path).alias("stem"), text.binary_name(path).alias("is_binary"), text.depth(path).cast("int").alias("depth"), text.in_skipped_directory(path).alias("skipped"))


@query(f"with {DOCS_SQL} select path, size > 0 and size <= 2097152 as indexable, size <= 10485760 as searchable, false as sniffed from docs")
def content_filters(spark, sf_dir):
    """Which files are indexed, searched, or binary by a look inside."""
    path, size = F.col("path"), F.col("size")
    return documents(spark, sf_dir).select("path", text.indexable(path, size).alias("indexable"), text.searchable(path, size).alias("searchable"), text.looks_binary(F.col("content")).alias("sniffed"))


# ---- maintenance ----------------------------------------------------------------------------

_OLD = f"{DOCS_SQL}, old as (select * from docs where file_id % 10 <> 0), new as (select * replace (size + case when file_id % 5 = 0 then 1 else 0 end as size) from docs where file_id % 7 <> 0)"


def _snapshots(spark, sf_dir):
    files = documents(spark, sf_dir)
    return files.where("file_id % 10 <> 0"), files.where("file_id % 7 <> 0").withColumn("size", F.col("size") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0))


@query(f"""with {_OLD} select coalesce(old.path, new.path) as path, coalesce(old.file_id, new.file_id) as file_id,
  case when new.path is null then 'gone' when old.path is null then 'new' when old.size = new.size and old.mtime_ms = new.mtime_ms then 'same' else 'changed' end as status
from old full outer join new on old.path = new.path""")
def reconcile_status(spark, sf_dir):
    """What happened to every path between two snapshots."""
    return maintain.status(*_snapshots(spark, sf_dir))


@query(f"with {_OLD} select new.path, old.path is not null as reused from new left join old on old.path = new.path and old.size = new.size and old.mtime_ms = new.mtime_ms")
def reuse_split(spark, sf_dir):
    """Which files keep their stored postings."""
    old, new = _snapshots(spark, sf_dir)
    return maintain.reuse(old, new).select("path", "reused")


@query(f"with {_CHARS} select trigram, cast(count(*) as bigint) as df from post where file_id % 7 <> 0 group by trigram")
def reconciled_postings(spark, sf_dir):
    """Postings after reconciling: as if built from the new snapshot."""
    old, new = _snapshots(spark, sf_dir)
    index, _, _ = maintain.reconcile(trigrams.build(old, arrange=False), old, new)
    return trigrams.frequencies(index)


@query(f"with {DOCS_SQL} select path, file_id % 6 <> 1 as alive from docs")
def forget_files(spark, sf_dir):
    """Files after some were forgotten: dead, but still there."""
    files = documents(spark, sf_dir)
    _, marked = maintain.forget(trigrams.build(files, arrange=False), files.drop("content"), files.where("file_id % 6 = 1"))
    return marked.select("path", "alive")


@query(f"with {DOCS_SQL} select path, size + 1 as size, md5(content || '!') as digest from docs where lang <> 'de' and doc_id % 9 <> 4".replace("from docs where", "from (select docs.*, lang, doc_id from docs join documents on doc_id = file_id) where"))
def tree_scan(spark, sf_dir):
    """A tree of files: written, listed with ignore rules, skipped and hidden directories, and read."""
    files = documents(spark, sf_dir).select("file_id", "path", F.concat("content", F.lit("!")).alias("content"))
    root = f"{prepare_checkpoints(spark)}/tree-{uuid.uuid4().hex}"
    place = F.when(F.col("file_id") % 9 == 4, F.concat(F.lit("docs/node_modules/"), F.col("file_id").cast("string"), F.lit(".txt"))).otherwise(F.col("path"))
    write_tree(files.select(place.alias("path"), "content"), root)
    return scan(spark, root, cap=None, rules=parse_rules("/docs/de")).select("path", "size", F.md5("content").alias("digest"))


@query(f"with {DOCS_SQL} select path, row_number() over (order by path) as n from docs order by path limit 7")
def tree_capped(spark, sf_dir):
    """The first files of a tree by path: the same set on every run."""
    from pyspark.sql import Window

    chosen = capped(documents(spark, sf_dir).select("path"), 7)
    return chosen.select("path", F.row_number().over(Window.orderBy("path")).cast("bigint").alias("n"))


@query(f"""with {DOCS_SQL} select path, file_id % 4 = 1 as binary_bytes, file_id % 4 = 1 as binary_text, md5(case file_id % 4 when 0 then left(content, 20) || chr(65533) || 'x' when 1 then 'a' || chr(0) || 'b' else left(content, 20) end) as digest from docs""")
def lossy_text(spark, sf_dir):
    """Bytes as text: what is no UTF-8 is replaced, and a NUL near the start marks binary content."""
    head = F.left("content", F.lit(20))
    raw = F.when(F.col("file_id") % 4 == 0, F.concat(head.cast("binary"), F.unhex(F.lit("FF")), F.lit("x").cast("binary"))).when(F.col("file_id") % 4 == 1, F.unhex(F.lit("610062"))).otherwise(head.cast("binary"))
    rows = documents(spark, sf_dir).select("path", raw.alias("raw"))
    return rows.select("path", text.bytes_look_binary(F.col("raw")).alias("binary_bytes"), text.looks_binary(text.decoded(F.col("raw"))).alias("binary_text"), F.md5(text.decoded(F.col("raw")).cast("binary")).alias("digest"))


@query(f"""with {PAGES_SQL}, p as (select file_id, path, case file_id % 5 when 0 then './' || path when 1 then '/root/tree/' || path when 2 then '/else/' || path when 3 then 'a/../' || replace(path, '/', chr(92)) else '~/tree/' || path end as given from site)
select given, case file_id % 5 when 2 then null else regexp_replace(path, '/+$', '') end as key from p""")
def index_keys(spark, sf_dir):
    """Paths as tools name them, as the index has them; null outside the tree."""
    path, n = F.col("path"), F.col("file_id") % 5
    given = F.when(n == 0, F.concat(F.lit("./"), path)).when(n == 1, F.concat(F.lit("/root/tree/"), path)).when(n == 2, F.concat(F.lit("/else/"), path)).when(n == 3, F.concat(F.lit("a/../"), F.replace(path, F.lit("/"), F.lit("\\")))).otherwise(F.concat(F.lit("~/tree/"), path))
    return pages(spark, sf_dir).select(given.alias("given")).select("given", text.index_key(F.col("given"), "/root/tree", "/root").alias("key"))


@query("""select root, '/c/siftwell/' || regexp_replace(root, '^.*/', '') || '-' || left(sha256(lower(root)), 16) || '.idx' as place from (select distinct '/data/' || lang || '/' || source as root from documents)""")
def cache_places(spark, sf_dir):
    """Where the indexes of trees are kept."""
    roots = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("/data/"), "lang", F.lit("/"), "source")).distinct().collect()]  # a row a source
    return spark.createDataFrame([(r, store.cache_path(r, {"XDG_CACHE_HOME": "/c"}, "linux")) for r in roots], "root string, place string")


@query(f"with {_OLD} select count(*) filter (old.size = new.size and old.mtime_ms = new.mtime_ms) as reused, count(*) filter (old.path is null or old.size <> new.size) as rebuilt, true as dirty, false as dirty_again from new left join old using (path)")
def reconcile_counters(spark, sf_dir):
    """How many files kept their postings, how many were read, and whether the index is worth writing."""
    old, new = _snapshots(spark, sf_dir)
    diff = maintain.status(old, new)
    counted = maintain.stats(diff)
    return spark.createDataFrame([(counted.reused, counted.rebuilt, maintain.dirty(diff, True), maintain.dirty(maintain.status(new, new), True))], "reused bigint, rebuilt bigint, dirty boolean, dirty_again boolean")


@query(f"""with {_CHARS}, z as (select file_id, unnest(list_transform(range(1, 4), lambda i: substr('fresh', i, 3))) as trigram from docs where file_id = 8)
select trigram, cast(count(*) as bigint) as df from (select file_id, trigram from post where file_id <> 8 union all select file_id, trigram from z) group by trigram""")
def refresh_one(spark, sf_dir):
    """Postings after one file changed: its old ones are gone, its id stays."""
    files = documents(spark, sf_dir)
    changed = files.where("file_id = 8").withColumns({"file_id": F.lit(-1).cast("long"), "content": F.lit("Fresh"), "size": F.lit(5).cast("long")})
    index, _ = maintain.refresh(trigrams.build(files, arrange=False), files, changed)
    return trigrams.frequencies(index)


@query(f"with {_OLD} select coalesce(old.path, new.path) as path, case when new.path is null then 'remove' else 'upsert' end as op, cast(7 as bigint) as at_ms from old full outer join new on old.path = new.path where old.path is null or new.path is null or old.size <> new.size")
def watched_events(spark, sf_dir):
    """What a watcher tells between two listings."""
    return tree_events(*_snapshots(spark, sf_dir), 7)


@query(f"with {DOCS_SQL}, e as (select path, case event_type when (select min(event_type) from events) then 'read' when (select max(event_type) from events) then 'edit' else 'shell' end as tool, event_id from events join docs on file_id = event_id % (select count(*) from documents)) select path, event_id as at_ms, tool = 'edit' as changed from e where tool <> 'shell'")
def routed_events(spark, sf_dir):
    """Tool events as touches, and those that change a file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    named = events.select((F.col("event_id") % n).alias("file_id"), F.col("event_id").alias("at_ms"), F.when(F.col("event_type") == ends["a"], "read").when(F.col("event_type") == ends["b"], "edit").otherwise("shell").alias("tool")).join(documents(spark, sf_dir).select("file_id", "path"), "file_id")
    touched, changed = route(named)
    return touched.join(changed.select("path", "at_ms", F.lit(True).alias("changed")), ["path", "at_ms"], "left").select("path", "at_ms", F.coalesce("changed", F.lit(False)).alias("changed"))
