"""Every registered query of the subpackage over sf0.001, against SQL or a plain version."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__
from siftwell.llm import packing
from siftwell.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same, expected


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(rows(spark, sf_dir, name), expected(ORACLES[name], sf_dir))


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component of every id by all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2 and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_simhash(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op2_simhash").set_index("doc_id")
    prints = {i: simhash(t) for i, t in texts.items()}
    assert got.fingerprint.to_dict() == {i: f"{p:016x}" for i, p in prints.items()}
    assert got.component_id.to_dict() == groups(prints)


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    got = rows(spark, sf_dir, "op3_packing")
    seen = {}
    for r in got.itertuples():
        seen.setdefault(r.doc_id, []).append(r)
    assert set(seen) == set(texts)
    total = 0
    for doc_id, text in texts.items():
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(seen[doc_id], key=lambda r: r.piece)
        total += len(ids)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 1024 for p in pieces[1:]) and (len(ids) <= 1024) == (len(pieces) == 1)
        at = 0
        for p in pieces:
            part = ids[at : at + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
    for _, rest in got.sort_values("offset").groupby("sequence_id"):
        assert list(rest.offset) == list(np.cumsum([0, *rest.length])[:-1]) and rest.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-total // 1024) * 1.02 + 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            double = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and double % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def test_pii(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op4_pii").set_index("doc_id")
    some = 0
    for doc_id, text in texts.items():
        want, r = base(text or ""), got.loc[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(filter(None, r.spans.split(",")))
        some += len(want)
    assert some


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    got = rows(spark, sf_dir, name).merge(duckdb.sql(f"select doc_id, {label} as y from '{sf_dir}/labels.parquet'").df(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert ((held.predicted == held.y).mean()) >= least and got.score.between(0, 1).all()


def test_quality_by_all_pairs(spark, sf_dir, texts):
    """Scores of the query against the interaction of every pair of inputs, one by one."""
    from siftwell.llm import quality

    model = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = rows(spark, sf_dir, "op5_quality").set_index("doc_id")
    assert set(got.index) == set(texts)
    for doc_id, text in texts.items():
        words = (text or "").split()
        counts = Counter(words)
        share = [math.sqrt(n / len(words)) for n in counts.values()]
        scale = max(1.0, 2 * math.sqrt(sum(x * x for x in share)))
        inputs = [(zlib.crc32(w.encode()) % (1 << quality.HASH_BITS), x / scale) for w, x in zip(counts, share)]
        for i, value in enumerate(quality.statistics(text or "", words, counts)):
            inputs.append(((1 << quality.HASH_BITS) + i * quality.CELLS + sum(c <= value for c in model.cuts[i]), 0.5))
        at, x = np.array([i for i, _ in inputs]), np.array([v for _, v in inputs])
        pairs = np.triu((model.v[at] @ model.v[at].T) * np.outer(x, x), 1).sum()
        want = 1 / (1 + math.exp(-np.clip(model.w0 + (model.w[at] * x).sum() + pairs, -30, 30)))
        assert got.score[doc_id] == pytest.approx(want, abs=1e-9) and got.predicted[doc_id] == (got.score[doc_id] >= 0.5)


def best_run(scores):
    """(sum, start, end) of the run with the largest sum: by the lowest prefix sum before each end."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - lowest))
    return sums[end + 1] - lowest[end], int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1]), end + 1


def test_toxicity_by_repeated_search(spark, sf_dir, texts):
    """Scores of the query against segments found by taking the best run, then those left and right of it."""
    from siftwell.llm import toxicity

    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = rows(spark, sf_dir, "op6_toxicity").set_index("doc_id")
    assert set(got.index) == set(texts) and model.scores

    def word(w):
        return next((model.scores[n] for n in (f"{w} ", *(w[:k] for k in (6, 5, 4, 3, 2) if k <= len(w))) if n in model.scores), toxicity.DRIFT)

    some = 0
    for doc_id, text in texts.items():
        scores = np.array([max([toxicity.DRIFT, *map(word, re.findall(r"\w+", c))]) for c in (text or "").lower().split()])
        found, todo = [], [(0, len(scores))]
        while todo:
            a, b = todo.pop()
            if a < b and (best := best_run(scores[a:b]))[0] > 0:
                found.append(best[0])
                todo += [(a, a + best[1]), (a + best[2], b)]
        expected_runs = [max(model.k * len(scores), 1.0) * math.exp(-model.rate * s) for s in found]
        statistic = sum(-math.log(e) for e in expected_runs if e <= toxicity.EXPECT)
        some += statistic > 0
        want = 1 / (1 + math.exp(-(model.base + model.slope * min(statistic, 20.0))))
        assert got.score[doc_id] == pytest.approx(want, abs=1e-9) and got.predicted[doc_id] == (got.score[doc_id] >= 0.7)
    assert some


def test_sharding(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op10_sharding").set_index("doc_id")
    assert got["size"].to_dict() == {i: len((t or "").encode()) + 16 for i, t in texts.items()}
    assert got.text_crc32.to_dict() == {i: zlib.crc32((t or "").encode()) for i, t in texts.items()}
    assert set(got.law) == {"bytes"} and set(got.shard) <= set(range(40))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    whole = got["size"].sum() / 40
    assert got.groupby("shard")["size"].sum().max() <= whole + 1.02 * got["size"].max() + 0.02 * whole
    # A plain version: rows in the order of the curve, dealt by the middle of their running bytes.
    got["text"] = [texts[i] or "" for i in got.index]
    lead = got.reset_index().groupby("text").doc_id.min()
    got["lead"] = got.text.map(lead)
    group = got.groupby("text")["size"].transform("sum")
    firsts = got.reset_index().sort_values(["hilbert", "lead", "text", "doc_id"])
    at = (firsts["size"].cumsum() - firsts["size"]).set_axis(firsts.doc_id)
    first = at.groupby(got.text.reindex(at.index)).transform("min")
    small = (group <= 0.02 * got["size"].sum() / 40) & (group > got["size"])
    middle = (first + group.reindex(at.index) / 2).where(small.reindex(at.index), at + got["size"].reindex(at.index) / 2)
    plain = np.minimum(39, (middle * 40 / got["size"].sum()).astype(int))
    tied = firsts.groupby(["hilbert", "lead"]).text.transform("nunique").set_axis(firsts.doc_id) > 1
    assert (plain == got.shard.reindex(plain.index))[~tied].all() and (~tied).mean() > 0.9


def test_pipeline_against_plain_stages(spark, sf_dir, texts):
    import corpus_pipeline as pipeline
    from siftwell.llm import pii

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = rows(spark, sf_dir, "op6_toxicity").set_index("doc_id").predicted
    kept = {i: t for i, t in texts.items() if toxic[i] == 0}
    one = pipeline.drop_toxic(spark, docs, sf_dir)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(kept)
    component = groups({i: simhash(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if component[i] == i}
    two = pipeline.drop_near_copies(spark, one, sf_dir)
    assert {r.doc_id for r in two.collect()} == set(kept)
    found = rows(spark, sf_dir, "op8_decontamination").set_index("doc_id").contaminated
    kept = {i: t for i, t in kept.items() if not found[i]}
    three = pipeline.drop_contaminated(spark, two, sf_dir)
    assert {r.doc_id for r in three.collect()} == set(kept)
    four = {r.doc_id: (r.text, r.n_chars) for r in pipeline.mask_personal_data(spark, three, sf_dir).collect()}
    ids = sorted(kept)
    plain = [pii.mask(kept[i], spans) for i, (_, spans) in zip(ids, pii.all_spans([kept[i] for i in ids], pii.train()))]
    assert four == {i: (t, len(t)) for i, t in zip(ids, plain)}
    assert all(not base(t) or "+" in t for t, _ in four.values())
    last = pipeline.run(spark, sf_dir).toPandas()
    assert set(last.doc_id) == set(kept) and last.groupby("sequence_id").length.sum().max() <= 1024
