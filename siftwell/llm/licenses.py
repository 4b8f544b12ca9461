"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance.

Terms are runs of a-z and 0-9 after A-Z became a-z.

Headers. The pieces of a text are its lines, its comment blocks (runs of lines that start with a
comment sign and hold a word, joined), and its paragraphs (joined lines between blank ones), so that a wrapped
header is one piece. A piece is compared with the statements and headers of `TEMPLATES`; terms
weigh by their document frequency over all texts, and a term no template has as one no text has.

Licence files. A text with a piece that reaches `threshold` (all licence texts have a title or
opening that does) is compared as a whole with the statements, and with the licence texts in the
folder `licence_texts`. For these, terms weigh by how many of these texts have them: a word of all
of them tells nothing, and a word of none weighs most. A text that as a whole reaches `threshold` is a
licence file: it has the licence of its best text, and licenses its directory. Any other document
has the licence of its best piece, if that reaches `threshold`; one without inherits from the
nearest ancestor directory that has a licence file.

Only texts that hold an anchor are looked into. Anchors are the heaviest terms of each statement,
so many that what is left of it has a norm below the threshold: a piece without any cannot reach
the threshold, so nothing is lost. Everything runs in DataFrame and SQL functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import LOWER, UPPER, cut, join_by_key

THRESHOLD = 0.6
#: What starts a comment line, in Java's and RE2's syntax, and two signs that mark lines meanwhile.
COMMENT = r"[ \t]*(?:#+|//+|/?\*+/?|;+|--+|%+|<!--)[ \t]*"
IN, OUT = "\x01", "\x03"

#: Licence statements, headers, and the titles and openings of licence texts, with SPDX names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Apache License"),
    ("CC0-1.0", "CC0 Universal"),
    ("GPL-3.0", "GNU General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "GNU Lesser General Public License"),
    ("MPL-2.0", "Mozilla Public License"),
]



@lru_cache(maxsize=1)
def texts() -> list[tuple[str, str]]:
    """Whole licence texts by SPDX name, in order of the name."""
    found = [p for p in resources.files("siftwell.llm").joinpath("licence_texts").iterdir() if p.name.endswith(".txt")]
    return [(p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted(found, key=lambda p: p.name)]


def _count(text: str) -> Counter:
    return Counter(re.findall(r"[a-z0-9]+", text.lower()))


@lru_cache(maxsize=1)
def _text_weights() -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Weight of each term of the licence texts, of any other term, and each text's unit vector."""
    counts = [_count(t) for _, t in texts()]
    among = Counter(t for c in counts for t in c)
    idf = {t: math.log((len(counts) + 1) / (n + 1)) for t, n in among.items()}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for c in counts]
    return idf, math.log(len(counts) + 1), [{t: n * idf[t] / norm for t, n in c.items()} for c, norm in zip(counts, norms)]


def _fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _terms(text: Column) -> Column:
    return F.filter(F.split(_fold(text), "[^a-z0-9]+"), lambda t: t != "")


def _blocks(text: Column) -> Column:
    """Lines, where consecutive comment lines are one."""
    marked = F.regexp_replace(text, f"(?md)^{COMMENT}", IN)
    marked = F.regexp_replace(marked, f"(?md)^{IN}[^a-zA-Z0-9\n]*$", "")  # without words: no part of a block
    marked = F.regexp_replace(marked, f"(?md)^([^{IN}\n][^\n]*)$", f"$1{OUT}")
    parted = F.replace(marked, F.lit(f"{OUT}\n{IN}"), F.lit(f"\n{OUT}"))
    return F.split(F.replace(parted, F.lit(f"\n{IN}"), F.lit(" ")), "\n")


def default_path() -> Column:
    """The path of a row of `documents`."""
    return F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc_"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))


def _best(columns: list[Column]) -> Column:
    """The largest cosine and minus its template's number, so that ties go to the first template."""
    return F.array_max(F.array(*[F.struct(F.round(c, 6).alias("cosine"), F.lit(-k).alias("k")) for k, c in enumerate(columns)]))


def _anchors(templates: list[Counter], idf: dict[str, float], norms: list[float], threshold: float) -> set[str]:
    anchors: set[str] = set()
    for c, norm in zip(templates, norms):
        left = norm**2
        for t in sorted(c, key=lambda t: (-c[t] * idf[t], t)):
            if math.sqrt(max(left, 0)) < threshold * norm * (1 - 1e-9):
                break
            anchors.add(t)
            left -= (c[t] * idf[t]) ** 2
    return anchors


def licenses(docs: DataFrame, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, similarity, origin (own, inherited or none), from_dir for every row.

    Every row is judged by its own text, whether its id is null or repeats. Null and empty texts
    have no licence of their own but may inherit one. A row without a path lies in the root. Ties
    go to the larger cosine, then the first template; of several licence files in a directory the
    best counts, then the name. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    templates = [_count(text) for _, text in TEMPLATES]
    vocabulary = sorted(set().union(*templates))
    slim = docs.select(F.col("doc_id"), F.coalesce(path if path is not None else default_path(), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = ["h1", "h2", "dir"]
    slim = slim.select("doc_id", "path", "text", F.xxhash64("doc_id", "path", "text").alias("h1"), F.xxhash64(F.lit(1), "doc_id", "path", "text").alias("h2"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    placed = cut(slim.select("doc_id", "path", *row))
    total = placed.count()
    held = F.array_intersect(F.split(_fold(F.col("text")), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary)))
    counts = {r["term"]: r["n"] for r in slim.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a template term
    idf = {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for c in templates]
    anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(_anchors(templates, idf, norms, threshold))) + r")(?![a-z0-9])"

    # The lines, blocks and paragraphs with an anchor leave the scan; `weights` has one row for each template term.
    text = F.col("text")
    text_idf, other, units = _text_weights()
    pieces = F.array_distinct(F.filter(F.concat(F.split(text, "\n"), _blocks(text), F.split(text, "\n[ \t\r]*\n")), lambda u: u.rlike(anchor)))
    held_anchor = slim.where(text.rlike(anchor))
    words = held_anchor.select(*row, F.posexplode(pieces).alias("at", "piece")).select(*row, "at", F.explode(_terms(F.col("piece"))).alias("term")).groupBy(*row, "at", "term").agg(F.count("*").alias("tf"))
    weights = [(t, idf.get(t), [c[t] * idf[t] / norm if t in c else 0.0 for c, norm in zip(templates, norms)], text_idf.get(t), [u.get(t, 0.0) for u in units]) for t in sorted({*vocabulary, *text_idf})]
    table = F.broadcast(spark.createDataFrame(weights, "term string, idf double, share array<double>, text_idf double, text_share array<double>"))

    def scored(words: DataFrame, keys: list[str], share: str, weight: Column, n: int) -> DataFrame:
        """The best template of each vector of words by cosine."""
        weighed = words.join(table, "term", "left").withColumn("w", F.col("tf") * weight)
        dots = [F.sum(F.coalesce(F.col("w") * F.col(share)[k], F.lit(0.0))).alias(f"s{k}") for k in range(n)]
        sums = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
        best = sums.select(*keys, _best([F.coalesce(F.try_divide(f"s{k}", "norm"), F.lit(0.0)) for k in range(n)]).alias("s"))
        return best.where(F.col("s.cosine") >= threshold)

    statement = F.coalesce("idf", F.lit(math.log(total + 1) + 1))
    piece = cut(scored(words, [*row, "at"], "share", statement, len(templates)).groupBy(*row).agg(F.max("s").alias("piece")))
    # Only texts with such a piece are compared as a whole.
    whole = held_anchor.select(*row, "text").join(piece.select(*row), row, "left_semi").select(*row, F.explode(_terms(text)).alias("term")).groupBy(*row, "term").agg(F.count("*").alias("tf"))
    whole = cut(whole)
    as_statement = scored(whole, row, "share", statement, len(templates)).select(*row, F.col("s").alias("all"))
    as_text = scored(whole, row, "text_share", F.coalesce("text_idf", F.lit(other)), len(units)).select(*row, F.col("s").alias("text"))
    best = piece.join(as_statement, row, "left").join(as_text, row, "left")
    named = lambda names, at, kind: F.struct(F.col(f"{at}.cosine").alias("similarity"), F.element_at(F.array(*map(F.lit, names)), F.lit(1) - F.col(f"{at}.k")).alias("license"), F.lit(kind).alias("file"))
    statements, names = [n for n, _ in TEMPLATES], [n for n, _ in texts()]
    is_text = F.col("text").isNotNull() & (F.col("all").isNull() | (F.col("text.cosine") >= F.col("all.cosine")))
    chosen = F.when(is_text, named(names, "text", True)).when(F.col("all").isNotNull(), named(statements, "all", True)).otherwise(named(statements, "piece", False))
    own = cut(best.select(*row, chosen.alias("c")).select(*row, "c.license", "c.similarity", "c.file"))
    licensed = own.where("file").groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("similarity")).alias("order"), "license")).alias("b")).select("from_dir", F.col("b.license").alias("dir_license"), (-F.col("b.order")).alias("dir_similarity"))

    # Directories, not documents, meet their ancestors; the nearest is the one with the longest path.
    dirs = cut(placed.groupBy("dir").agg(F.count("*").alias("n")))
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("from_dir"))
    nearest = ancestors.join(licensed, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "dir_license", "dir_similarity")).alias("b")).select("dir", "b.from_dir", "b.dir_license", "b.dir_similarity")
    by_dir = cut(dirs.join(nearest, "dir", "left"))
    repeats = placed.groupBy(*row).agg(F.count("*").alias("n"))
    by_row = cut(repeats.join(own.drop("file"), row, "left").where("n > 1 or license is not null"))
    joined = cut(join_by_key(placed, by_row, row, "n", total, "left"))
    joined = join_by_key(joined, by_dir, ["dir"], "n", total, "left")
    mine = F.col("license").isNotNull()
    return joined.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("similarity", "dir_similarity").alias("similarity"), F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("from_dir")).alias("from_dir"))


def _oracle() -> str:
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    idf, other, units = _text_weights()
    heavy = ", ".join(f"('{t}', cast({w!r} as double))" for t, w in sorted(idf.items()))
    shares = ", ".join(f"({k}, '{texts()[k][0]}', '{t}', cast({w!r} as double))" for k, u in enumerate(units) for t, w in sorted(u.items()) if w)
    return rf"""
with t as (select * from (values {values}) as t(k, name, body)),
tt as (select k, name, term, count(*) as tf from (select k, name, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) as term from t) group by all),
xi as (select * from (values {heavy}) as x(term, idf)), xs as (select * from (values {shares}) as x(k, name, term, share)),
d as (select row_number() over () as r, doc_id, 'docs/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc_' || coalesce(cast(doc_id as varchar), 'none') || '.txt' as path,
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents),
n as (select count(*) as n from d),
df as (select term, count(*) as df from (select unnest(list_distinct(regexp_extract_all(body, '[a-z0-9]+'))) as term from d) where term in (select term from tt) group by term),
idf as (select term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as idf from (select distinct term from tt) left join df using (term), n),
tn as (select k, sqrt(sum((tf * idf) * (tf * idf))) as norm from tt join idf using (term) group by k),
bl as (select r, string_split(replace(replace(regexp_replace(regexp_replace(regexp_replace(body, '(?m)^{COMMENT}', chr(1), 'g'), '(?m)^\x01[^a-zA-Z0-9\n]*$', '', 'g'), '(?m)^([^
][^
]*)$', '' || chr(3), 'g'), chr(3) || chr(10) || chr(1), chr(10) || chr(3)), chr(10) || chr(1), ' '), chr(10)) as b from d),
u as (select r, unnest(list_concat([body], list_concat(string_split(body, chr(10)), list_concat(b, string_split_regex(body, '
[ 	
]*
'))))) as piece,
  unnest(range(-1, len(list_concat(string_split(body, chr(10)), list_concat(b, string_split_regex(body, '
[ 	
]*
')))))) as place from d join bl using (r)),
w as (select r, place, term, count(*) as tf from (select r, place, unnest(regexp_extract_all(piece, '[a-z0-9]+')) as term from u) group by all),
ln as (select r, place, sqrt(sum((tf * coalesce(idf, ln(n + 1) + 1)) * (tf * coalesce(idf, ln(n + 1) + 1)))) as norm from w left join idf using (term), n group by all),
dot as (select w.r, w.place, tt.k, tt.name, sum((w.tf * idf) * (tt.tf * idf)) as dot from w join tt using (term) join idf using (term) group by all),
c as (select r, place, k, name, round(dot / tn.norm / ln.norm, 6) as cosine from dot join tn using (k) join ln using (r, place)),
m0 as (select * from c where cosine >= {THRESHOLD}),
m as (select * from m0 where r in (select r from m0 where place >= 0)),
xn as (select r, sqrt(sum((tf * coalesce(idf, {other!r})) * (tf * coalesce(idf, {other!r})))) as norm from w left join xi using (term) where place = -1 and r in (select r from m) group by r),
xd as (select w.r, xs.k, xs.name, sum((w.tf * xi.idf) * xs.share) as dot from w join xs using (term) join xi using (term) where place = -1 and r in (select r from m) group by all),
x as (select * from (select r, k, name, round(dot / norm, 6) as cosine from xd join xn using (r) where norm > 0) where cosine >= {THRESHOLD}),
own as (select r, name as license, cosine as similarity, kind > 0 as file from (select *, row_number() over (partition by r order by kind > 0 desc, cosine desc, kind desc, k) as q
  from (select r, k, name, cosine, case when place = -1 then 1 else 0 end as kind from m union all select r, k, name, cosine, 2 from x)) where q = 1),
p as (select r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') as dir from d),
lic as (select dir as from_dir, license as dir_license, similarity as dir_similarity from (select dir, license, similarity, row_number() over (partition by dir order by similarity desc, license) as q
  from p join own using (r) where file) where q = 1),
near as (select * from (select a.dir, lic.*, row_number() over (partition by a.dir order by length(from_dir) desc) as q from (select distinct dir from p) a join lic on lic.from_dir = '' or a.dir = lic.from_dir or starts_with(a.dir, lic.from_dir || '/')) where q = 1)
select p.doc_id, p.path, coalesce(own.license, near.dir_license) as license, coalesce(own.similarity, near.dir_similarity) as similarity,
  case when own.license is not null then 'own' when near.dir_license is not null then 'inherited' else 'none' end as origin,
  case when own.license is null then near.from_dir end as from_dir
from p left join own using (r) left join near using (dir)
"""


ORACLE = _oracle()
