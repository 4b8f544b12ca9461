"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns for every operator."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siftwell.llm import ann, components, decontam, hilbert, licenses, packing, pii, quality, sharding, simhash, toxicity, warc
from siftwell.llm.labelled import labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, fp long, key long, size long"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def row(i, text, **more):
    return (i, text, more.get("lang"), more.get("source"), len(text) if text else None, 1, 7, 7, 7)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [row(1, None), row(2, ""), row(3, "   \n\t"), row(4, WORDS), row(5, WORDS), row(5, WORDS), row(6, WORDS.upper() + " é"), row(None, "no id at all"), row(None, None), row(7, long), row(8, "x" * 50_000), row(9, "é😀 \x00 ok"), row(10, "idiot moron " * 4, lang="en")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, None), (9, None, None), (10, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, WORDS), (2, None), (3, "..."), (1, WORDS), (None, "one two"), (4, "never seen")], "item_id long, text string")


OPERATORS = {
    "simhash": lambda d, lab, b: simhash.near_duplicates(d),
    "packing": lambda d, lab, b: packing.pack_documents(d).where("piece = 0"),
    "pii": lambda d, lab, b: pii.find(d),
    "quality": lambda d, lab, b: quality.quality(d, lab),
    "toxicity": lambda d, lab, b: toxicity.toxicity(d, lab),
    "decontam": lambda d, lab, b: decontam.contamination(d, b),
    "licenses": lambda d, lab, b: licenses.licenses(d),
    "sharding": lambda d, lab, b: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(docs, labels, benchmark, name):
    got = OPERATORS[name](docs, labels, benchmark)
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, benchmark, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, tmp_path, labels, benchmark, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    name, run = pipeline.STAGES[stage]
    got = run(spark, own, str(tmp_path))
    assert run(spark, own.limit(0), str(tmp_path)).collect() == []
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    if stage < 4:
        assert got.columns == own.columns and got.select("_gone", "row").distinct().collect() == [(CLASHES.index("_gone"), CLASHES.index("row"))]
    if name == "near_dedup":
        assert set(ids) - {6} == {1, 4, 7, 8, 9, 10, None} and len(ids) == len(set(ids))
    if name == "decontamination":
        assert sorted(str(i) for i in ids) == sorted(["None", "None", "1", "10", "2", "3", "7", "8", "9"])


CLASHES = ["_gone", "_again", "_order", "_row", "row", "key", "fp", "h1", "h2", "n", "stays", "least", "label", "piece", "length", "_salt", "size", "score"]


def test_repeated_ids_lose_no_group(spark):
    a, b = "one two three four five six seven", "other words that stand in no other text at all"
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (7, b, 1), (7, b, 1), (None, a, 2), (None, "alone without an id", 2), (9, None, 0), (10, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    got = sorted((str(r.doc_id), r.text) for r in simhash.drop_near_copies(docs).collect())
    assert got == sorted([("3", a), ("5", b), ("None", "alone without an id"), ("9", None)], key=str)
    same = spark.createDataFrame([(7, b, 1)] * 40 + [(8, b, 1)] * 3, "doc_id long, text string, _gone int").repartition(3)
    assert [tuple(r) for r in simhash.drop_near_copies(same).collect()] == [(7, b, 1)]


def test_every_group_keeps_exactly_one_row(spark):
    random.seed(21)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 5))) for _ in range(30)]
    rows = [(random.choice([None, *range(12)]), random.choice([None, *texts]), random.randint(0, 1)) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    prints = {t: simhash.fingerprint(t) for _, t, _ in rows}
    distinct = np.array(sorted(set(prints.values())), dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= 2)
    root = {int(n): int(r) for n, r in components.forest(np.stack([distinct[i], distinct[j]], axis=1)[i != j])}
    group = lambda t: root.get(prints[t], prints[t])
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted(group(r.text) for r in kept) == sorted({group(t) for _, t, _ in rows})
    for r in kept:
        ids = [d for d, t, _ in rows if group(t) == group(r.text)]
        assert r.doc_id == min((d for d in ids if d is not None), default=None)


# ---- simhash --------------------------------------------------------------------------------


def test_links_with_hot_buckets_equal_all_pairs(spark):
    random.seed(2)
    seeds = [random.getrandbits(64) for _ in range(12)]
    prints = {0}
    for s in seeds:
        for _ in range(15):
            x = s
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    a, b = np.nonzero(near)
    want = {tuple(map(int, x)) for x in components.forest(np.stack([prints[a], prints[b]], axis=1)[a != b])}
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    for bucket in (2, 10_000):
        found = [(r.a, r.b) for r in simhash.links(df, bucket).collect()]
        pairs = np.array(found, dtype=np.int64).view(np.uint64).reshape(-1, 2)
        assert {tuple(map(int, x)) for x in components.forest(pairs)} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 200: 200, 201: 200}


# ---- packing --------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plans_hold_every_constraint(rule):
    random.seed(4)
    histogram = {random.randint(1, 300): random.randint(1, 400) for _ in range(60)}
    limits = packing.Limits(tokens=300, documents=9, attention=40_000, rule=rule) if rule == "norm" else packing.Limits(tokens=300, documents=9, attention=90_000, rule=rule)
    histogram = {k: v for k, v in histogram.items() if k * k <= limits.attention}
    of = packing.plan(histogram, limits)
    bins = {}
    for length, n in histogram.items():
        sequence, offset = packing.place(of, np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            bins.setdefault(s, []).append((o, length))
    assert len(bins) == of.sequences
    for inside in bins.values():
        inside.sort()
        assert [o for o, _ in inside] == list(np.cumsum([0, *[n for _, n in inside]])[:-1])
        assert sum(n for _, n in inside) <= 300 and len(inside) <= 9 and sum(n * n for _, n in inside) <= limits.attention
    with pytest.raises(ValueError):
        packing.plan({301: 1}, limits)


def test_token_shortcut_equals_the_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    name = packing.default_tokenizer()
    encode, slow = packing.Encoder(name, packing.ranks_of(name)), packing.Encoder(name, None)
    random.seed(9)
    odd = ["".join(random.choice(["a", "é", " ", "  ", "\n", "\t", "'s", "12", ",", "日", " ", "<|endoftext|>", "Word", "\r\n", "x'll"]) for _ in range(random.randint(0, 14))) for _ in range(800)]
    for text in odd:
        assert list(np.frombuffer(encode(text), dtype="<u4")) == model.encode(text, add_special_tokens=False).ids, repr(text)
        assert encode(text) == slow(text)


def test_ids_come_along(spark):
    df = spark.createDataFrame([(1, "hello world " * 900)], "doc_id long, text string")
    got = packing.pack_documents(df).orderBy("piece").collect()
    assert [r.length for r in got] == [len(r.ids) for r in got] and sum(r.length for r in got) == sum(len(r.ids) for r in got) and got[-1].ids[-1] == 2


# ---- personal data --------------------------------------------------------------------------


def test_base_patterns_equal_whole_text_scans():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    random.seed(1)
    for _ in range(20_000):
        text = "".join(random.choice("ab1.@@-+% _") for _ in range(random.randint(1, 24)))
        assert [m.span() for m in email.finditer(text)] == list(pii._emails(text)), text
        text = "".join(random.choice("12....a ") for _ in range(random.randint(1, 24)))
        assert [m.span() for m in ip.finditer(text)] == [m.span() for m in pii._IP.finditer(text)], text


def test_field_tags_unseen_rows_and_adds_spans():
    model = pii.train()
    right = total = 0
    for words, labels in pii.labelled_table(150, seed=77):
        got = [pii.LABELS[k] for k in model.decode(model.scores(words)[None])[0][0]]
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.97
    text = "write to john.doe [at] mail (dot) com or ring (705) 555-5569 today"
    (base, spans), (none, clean) = pii.all_spans([text, "version 2.0. of 2024-01-02 has 123456 lines, see 4.5.6 and \"a9b8c7d6e5f4a9b8c7d6e5f4a9b8c7d6\""], model)
    assert base == [] and {k for *_, k in spans} == {"email", "phone"} and none == clean == []
    assert pii.mask("a b@c.de f", [(2, 8, "email")]) == "a <EMAIL> f"


def test_long_stretches_are_decoded_whole():
    model = pii.train()
    for before in (250, 252, 253, 254, 255, 256, 300, 511):
        text = " ".join(["room 12"] * (before // 2) + ["7"] * (before % 2) + ["call (555) 123-4567 or jo [at] host [dot] com", *["room 12"] * 200])
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        path, _ = model.decode(model.scores([text[a:b] for a, b in words])[None])
        whole = {(words[t][0], pii.LABELS[k][2:]) for t, k in enumerate(path[0]) if pii.LABELS[k][0] == "B"}
        got = [(text[a:b], kind) for a, b, kind in pii.all_spans([text], model)[0][1]]
        assert got == [("(555) 123-4567", "phone"), ("jo [at] host [dot] com", "email")]
        assert {(text.index(t), kind) for t, kind in got} <= whole


def test_each_span_is_judged_by_itself():
    model = pii.train()
    words = "call (705) 555-5569 or jo [at] host [dot] com".split()
    batch = model.scores(words)[None]
    path, lead = model.decode(batch)
    allowed = lambda labels: all(b[0] != "I" or a[2:] == b[2:] for a, b in zip(["O", *labels], labels))
    worth = lambda labels: sum(batch[0, i, k] for i, k in enumerate(labels)) + sum(model.transition[a, b] for a, b in zip(labels, labels[1:]))
    assert allowed([pii.LABELS[k] for k in path[0]])
    for t, u in ((1, 3), (4, 9)):
        forced = batch.copy()
        forced[0, t:u, 1:] = -1e7
        other, _ = model.decode(forced)
        assert lead.of(0, t, u) == pytest.approx(worth(path[0]) - worth(other[0]))


def test_long_runs_stay_linear():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 100_000 + "@") == [] and pii.base_spans("1." * 100_000) != []


# ---- toxicity and quality -------------------------------------------------------------------


def test_segments_are_maximal():
    random.seed(6)
    for _ in range(300):
        scores = np.array([random.choice([-3, -2, -1, 1, 2, 4]) for _ in range(random.randint(1, 14))], dtype=float)
        want, todo = [], [(0, len(scores))]
        while todo:  # the best segment, then the same left and right of it
            a, b = todo.pop()
            best = max(((scores[i:j].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 0:
                want.append((best[0], best[2], best[3]))
                todo += [(a, best[2]), (best[3], b)]
        got = toxicity.segments(scores)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for s, *_ in want))
        assert len({(a, b) for a, b, _ in got}) == len(got) and all(got[i][1] <= got[i + 1][0] for i in range(len(got) - 1))


def test_toxic_passages_are_placed(spark):
    model = toxicity.Model({"idiot ": 5.0, "scum ": 5.0, "vequ": 5.0}, 2.0, 0.4, -4.0)
    text = "a fine day. You idiot, you scum! and then nothing more was said"
    value, found = toxicity.passages(text, model, toxicity.Scores(model.scores))
    assert value > 5 and [text[a:b] for a, b, _ in found] == ["idiot, you scum!"]
    assert toxicity.passages("vequette vequois", model, toxicity.Scores(model.scores))[0] > 0
    assert toxicity.passages(None, model, toxicity.Scores(model.scores)) == (0.0, [])
    got = toxicity.score(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model, with_passages=True).orderBy("doc_id").collect()
    assert got[0].score > 0.7 > got[1].score and len(got[0].passages) == 1


def test_models_learn_from_whole_texts(spark):
    random.seed(8)
    fill = lambda: " ".join(f"w{random.randrange(5000)}" for _ in range(4000))
    texts = {i: fill() + (" you vileword" if i % 2 else " you too") for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in texts], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, marks, "toxic").collect()
    assert min(map(len, texts.values())) > 20_000 and all(r.text == texts[r.doc_id] for r in sample) and len(sample) > 20
    assert "vileword " in toxicity.learn(docs, marks).scores
    stats = [quality.statistics(t, t.split(), Counter(t.split())) for t in (r.text for r in sample)]
    assert quality.learn(docs, marks).cuts[0].max() <= max(s[0] for s in stats) and quality.learn(docs, marks).cuts[0].min() >= min(s[0] for s in stats)


def test_machine_equals_all_pairs():
    random = np.random.default_rng(3)
    v = random.normal(size=(50, 6))
    m = quality.Machine(np.zeros((0, 7)), 0.3, random.normal(size=50), v)
    index, x = np.array([3, 9, 20, 41]), np.array([0.5, 1.0, -2.0, 0.7])
    pairs = sum(v[index[i]] @ v[index[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.raw(index, x) == pytest.approx(0.3 + m.w[index] @ x + pairs)


# ---- neighbours, curves and shards ----------------------------------------------------------


def test_hilbert_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def brute(points, k=20):
    out = {}
    for q, x in points.items():
        if q % 20 == 0:
            near = sorted(((-float(np.dot(x, y)), i) for i, y in points.items() if i != q), key=lambda t: (round(t[0], 12), t[1]))
            out[q] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("n", [5, 400])
def test_neighbours_with_copies_and_bad_rows(spark, n):
    random = np.random.default_rng(8)
    points = {i: random.normal(size=6) * random.uniform(0.2, 3) for i in range(n)}
    for i in range(0, n, 3):
        points[i] = np.ones(6)  # a third are one vector
    rows = [(i, [float(v) for v in x], 0) for i, x in points.items()]
    bad = [(100_000, None, 0), (100_020, [], 0), (100_040, [0.0] * 6, 0), (100_060, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (100_080, [float("nan")] * 6, 0), (100_100, [1.0] * 5, 0), (None, [9.0] * 6, 0)]
    df = spark.createDataFrame(rows + rows[:2] + bad, "vec_id long, embedding array<double>, query int")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, window=8).toPandas()
    want = brute(points)
    assert {q: list(part.sort_values("rank").vec_id) for q, part in got.groupby("query_id")} == want
    assert all(list(p.sort_values("rank")["rank"]) == list(range(1, len(p) + 1)) for _, p in got.groupby("query_id"))
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_repeated_rows_do_not_crowd_out_ids(spark):
    equal = [1.0, 2.0, 3.0]
    rows = [(0, equal)] * 25 + [(i, equal) for i in range(1, 30)] * 2 + [(40 + i, [0.1 * i, 0.2, -1.0]) for i in range(5)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(0, 25)).orderBy("query_id", "rank").collect()
    for q in (0, 25):
        assert [r.vec_id for r in got if r.query_id == q] == [i for i in range(30) if i != q][:20]


@pytest.mark.parametrize("parts", [2, 64])
def test_windows_alone_find_clustered_neighbours(spark, parts):
    random = np.random.default_rng(4)
    centres = random.normal(size=(40, 32)) * 3
    x = centres[np.arange(2000) % 40] + 0.05 * random.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ann.neighbours(df, F.col("vec_id") % 20 == 0, check=False, curves=4, window=96, chunk=256).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(dict(enumerate(x)))
    assert np.mean([len(set(want[q]) & set(got[got.query_id == q].vec_id)) / 20 for q in want]) >= 0.9


def test_windows_reach_over_chunks_and_partitions(spark):
    """One curve over one dimension: the window holds the nearest places, wherever chunks end."""
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1, 301)], "vec_id long, embedding array<float>")
    want = [r.vec_id for r in ann.neighbours(df, F.col("vec_id") == 40, check=False, chunk=10_000).collect()]
    assert [r.vec_id for r in ann.neighbours(df.repartition(7), F.col("vec_id") == 40, check=False, chunk=1024).collect()] == want
    assert len(ann.neighbours(df, F.col("vec_id") == 40, check=False, window=15, chunk=16).collect()) == 20


def test_other_column_names_and_flags(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], i == 3) for i in range(9)], "key long, vec array<double>, asks boolean")
    got = ann.neighbours(df, F.col("asks"), k=2, id_col="key", vec_col="vec").orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(3, 8), (3, 7)]


def test_shards_are_even_and_groups_stay_together(spark):
    random.seed(3)
    rows = [(i, "copy" * 20 if i % 3 == 0 else "t" * random.randint(0, 400), random.choice(["en", "fr", None]), f"s{i % 7}") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() < 0.1 * sizes.mean()
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))
    copies = got[got["size"] == 96]
    assert copies.groupby("shard").size().max() > 20  # a third of all rows, cut by rows
    boxes = got.groupby("shard").hilbert.agg(["min", "max"])
    assert (boxes["min"].to_numpy()[1:] >= boxes["max"].to_numpy()[:-1] - boxes["max"].max() * 0.05).all()


# ---- web archives, benchmarks and licences --------------------------------------------------


def test_records_are_linked_and_whole(spark, tmp_path):
    html = "<html lang='en'><head><title>A\n b</title></head><body><!-- no --><p>x &amp;lt; y<br>z</p><script>no()</script><a href=\"/q?a=1\">l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/b\r\nX: y", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type): r for r in warc.derivatives(warc.responses(pages)).collect()}
    assert len(got) == 6
    text, meta = got[1, "conversion"], got[1, "metadata"]
    assert text.block == "x &lt; y\nz\nl" and text.refers_to == meta.refers_to and text.concurrent_to == meta.record_id
    assert "title: A b\r\n" in meta.block and "outlink: /q?a=1\r\n" in meta.block and "languages-html: en" in meta.block
    assert text.target_uri == "http://a/bX: y" and meta.source_headers.startswith("HTTP/1.1 200") and got[2, "conversion"].content_length == 0
    warc.write_warc(warc.derivatives(warc.responses(pages)).coalesce(1), str(tmp_path / "w"))
    raw = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")).read_bytes()
    records = 0
    kept = {r.record_id: r.source_headers for r in got.values()}
    assert all(h.startswith("HTTP/1.1 200") and h.count("\r\n") == 3 for h in kept.values())
    while raw:  # a plain reader: headers, then as many bytes as they say
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        name = f"{warc.SOURCE_HEADER}: ".encode()
        source = b"".join(line.removeprefix(name) + b"\r\n" for line in head.split(b"\r\n") if line.startswith(name))
        assert source.decode() == kept[fields[b"WARC-Record-ID"].decode()]
        assert head.startswith(b"WARC/1.1") and rest[n : n + 4] == b"\r\n\r\n"
        raw, records = rest[n + 4 :], records + 1
    assert records == 6


def test_pages_of_every_kind(spark):
    schema = "page_id long, url string, html string, headers string, payload string, r string"
    rows = [(1, "http://a", "<p>x</p>" * 40_000, "h", "p", "r"), (1, "http://a", "<p>x</p>" * 40_000, "h", "p", "r"), (None, None, "<<>><p", "h", "p", "r"), (4, "", "\x00\r\n", None, None, None)]
    got = warc.derivatives(warc.responses(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6
    assert max(r.content_length for r in got if r.record_type == "conversion") == 80_000 - 1
    assert warc.derivatives(warc.responses(spark.createDataFrame([], schema))).collect() == []


def test_hits_are_mapped_to_the_original(spark):
    text = "Intro!  ONE, two;three four five six seven eight\nnine ten eleven twelve THIRTEEN... end"
    df = spark.createDataFrame([(1, text), (2, "one two"), (3, "x " * 300 + "tiny item here")], "doc_id long, text string")
    items = spark.createDataFrame([(10, WORDS), (2, "tiny, item!")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.hits(df, items, with_spans=True).collect()}
    assert [text[s.start : s.stop] for s in got[1].spans] == [text[8:-7]] and got[1]["items"] == ["10"]
    assert (got[2].n_hit, got[3].n_hit, got[3]["items"]) == (0, 2, ["2"])
    flags = {r.doc_id: (r.contaminated, r.items_sha256) for r in decontam.contamination(df, items).collect()}
    assert [flags[i][0] for i in (1, 2, 3)] == [True, False, False] and flags[1][1] == decontam.digest(["10"])


def test_automata_in_blocks_find_the_same():
    random.seed(12)
    items = [(str(i) if i % 5 else None, " ".join(random.choice("abcdef") for _ in range(20))) for i in range(12)]
    one, many = decontam.Scanner(items), decontam.Scanner(items, most=300)
    assert not one.several and many.several and len(list(decontam.item_blocks(items, most=300))) > 3
    texts = [" ".join(t for _, t in items[3:6]), None, "x " * 40 + items[7][1], ""]
    a, b = one(texts), many(texts)
    assert [h.items for h in a] == [h.items for h in b] == [{"3", "4"}, set(), {"7"}, set()]
    assert all((x.mask() == y.mask()).all() for x, y in zip(a, b)) and a[0].mask().sum() == 60


def test_large_benchmarks_keep_one_automaton_alive():
    items = [(str(i), " ".join(f"q{i}w{j}" for j in range(400))) for i in range(150)]
    held = [sum(map(len, block)) for block in decontam.item_blocks(items)]
    assert len(held) > 2 and max(held) <= decontam.AUTOMATON_BYTES
    assert decontam.Scanner(items).only is None


def test_items_without_an_id_hit_but_are_not_listed(spark):
    df = spark.createDataFrame([(1, WORDS)], "doc_id long, text string")
    got = decontam.contamination(df, spark.createDataFrame([(None, WORDS)], "item_id long, text string")).first()
    assert (got.n_hit, got.n_items, got.items_sha256, got.contaminated) == (14, 0, decontam.digest([]), True)


def test_licences_inherit_from_the_nearest_ancestor(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [(1, apache, "a/LICENSE"), (2, "code", "a/x.py"), (3, "code", "a/b/y.py"), (4, mit, "a/b/c/COPYING"), (5, "code", "a/b/c/d/z.py"), (6, "long prose of no licence " * 20 + "\n" + mit, "q/w.py"), (7, "other", "q/v.py"), (8, None, "a/n"), (9, "top", "r.py"), (None, mit, "z/one"), (None, "nothing", "z/two"), (None, "no path", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {(r.doc_id or r.path): (r.license, r.origin, r.from_dir) for r in licenses.licenses(df, F.col("path")).collect()}
    assert got == {1: ("Apache-2.0", "own", None), 2: ("Apache-2.0", "inherited", "a"), 3: ("Apache-2.0", "inherited", "a"), 4: ("MIT", "own", None), 5: ("MIT", "inherited", "a/b/c"), 6: ("MIT", "own", None), 7: (None, "none", None), 8: ("Apache-2.0", "inherited", "a"), 9: (None, "none", None), "z/one": ("MIT", "own", None), "z/two": ("MIT", "inherited", "z"), "": (None, "none", None)}


HEADER = """# Copyright 2020 Somebody Else
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os

def run():
    return os.getcwd()
"""
WRAPPED = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main(void) { return 0; }
"""


def test_whole_licence_texts_and_wrapped_headers(spark):
    whole = dict(licenses.texts())
    rows = [(f"{n}/LICENSE", t.replace("<year>", "2021").replace("<owner>", "A. Body").replace("<copyright holders>", "A. Body and others")) for n, t in whole.items()]
    rows += [(f"{n}/src/code.c", "int x = 1;") for n in whole]
    prose = "The software is provided with no claim. " + "There the work of the people and the use of a copy was, in the end, more than any person had to do. " * 80
    code = "".join(f"value{i} = compute{i}(left{i}, right{i})\n" for i in range(60))
    rows += [("py/a.py", HEADER + code), ("py/b.py", "import a"), ("c/a.c", WRAPPED + code), ("c/b.c", "int y;"), ("prose/a.txt", prose + "\nThis work is licensed under the GNU General Public License, version 3.\n"), ("prose/b.txt", prose)]
    rows += [(f"many/f{i}", f"other text {i} of many words that have nothing to do with it") for i in range(60)]
    df = spark.createDataFrame([(None, t, p, 1, 1) for p, t in rows], "doc_id long, text string, path string, h1 int, dir int")
    got = {r.path: (r.license, r.origin) for r in licenses.licenses(df, F.col("path")).collect()}
    for n in whole:
        assert got[f"{n}/LICENSE"] == (n, "own") and got[f"{n}/src/code.c"] == (n, "inherited")
    assert got["py/a.py"] == ("Apache-2.0", "own") and got["c/a.c"] == ("GPL-3.0", "own") and got["prose/a.txt"] == ("GPL-3.0", "own")
    assert got["py/b.py"] == got["c/b.c"] == got["prose/b.txt"] == got["many/f1"] == (None, "none")
