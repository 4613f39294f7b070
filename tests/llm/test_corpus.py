"""Mixing, benchmark leaks, the quality classifier and the pipeline against plain Python."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import numpy as np

import corpus_pipeline
from scaleloom.llm import benchmark_leaks, common, features, mixing, quality_classifier
from scaleloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, mix_slot string"


def simulate(blocks, weights):
    """Step by step, with an explicit clock and fractions."""
    blocks = {k: n for k, n in blocks.items() if n}
    w = {k: Fraction(weights[k]) for k in blocks}

    def when(v):
        return sum(min(n, w[k] * v) for k, n in blocks.items())

    got, out = dict.fromkeys(blocks, 0), []
    for t in range(sum(blocks.values())):
        ready = [(ceil(when((got[k] + 1) / w[k])), str(k), k) for k in blocks if got[k] < blocks[k] and floor(when(got[k] / w[k])) <= t]
        due, _, k = min(ready)
        assert due > t
        out.append(k)
        got[k] += 1
    return out


def in_order(plan):
    return [k for _, k in sorted((t, k) for k, v in plan.items() for t, _ in v)]


def test_schedule_is_that_of_the_simulation():
    rnd = random.Random(4)
    for n in (1, 2, 5, 9):
        weights = {f"s{i}": rnd.choice([1, 2, 0.5, rnd.random() + 0.01, 1 / 3]) for i in range(n)}
        blocks = {k: rnd.randrange(0, 40) for k in weights}
        plan = mixing.schedule(blocks, weights)
        assert in_order(plan) == simulate(blocks, weights)
        assert {k: len(v) for k, v in plan.items()} == {k: v for k, v in blocks.items() if v}
    assert in_order(mixing.schedule({"a": 2, "b": 3, "z": 2}, {"a": 1, "b": 1.0, "z": 0})) == ["a", "b", "a", "b", "b", "z", "z"]


def test_deviation_below_one_block_over_a_million_slots():
    """Against the very weights, sources running out on the way."""
    weights = {"big": 10_000**0.5, **{f"s{i:02}": 1000**0.5 for i in range(20)}, "rare": 0.02}
    blocks = {k: 2 if k == "rare" else 700_000 if k == "big" else 15_000 + 10 * int(k[1:]) for k in weights}
    plan = mixing.schedule(blocks, weights)
    total = sum(blocks.values())
    assert total > 1_000_000 and sorted(t for v in plan.values() for t, _ in v) == list(range(total))
    ends = sorted(n / weights[k] for k, n in blocks.items())
    at = [sum(min(n, weights[k] * v) for k, n in blocks.items()) for v in [0, *ends]]
    for k, v in plan.items():
        share = np.interp(np.arange(1, total + 1), at, [min(blocks[k], weights[k] * x) for x in [0, *ends]])
        done = np.cumsum(np.bincount([t for t, _ in v], minlength=total))
        assert np.abs(done - share).max() < 1 + 1e-6, k


def test_many_sources():
    rnd = random.Random(2)
    blocks = {i: rnd.randrange(1, 30) for i in range(10_000)}
    assert sum(map(len, mixing.schedule(blocks, {k: n**0.5 for k, n in blocks.items()}).values())) == sum(blocks.values())
    assert mixing.block_size(10**10) == 10_000 and mixing.block_size(10**6) == mixing.BLOCK


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 37)
    rows = [(i, "t", None, "abc"[i % 7 % 3] if i % 11 else None, 1, f"k{i}", "", "clash") for i in range(2000)] + [(None, None, None, "a", None, None, None, None)] * 3
    weights = {"a": 5.0, "b": 1.0, "c": 0.5, None: 2.0}
    frame = spark.createDataFrame(rows, DOCS.replace("k string", "_mix_hash string"))
    out = mixing.mix(frame, weights, block=8).collect()
    assert all(r._mix_hash == f"k{r.doc_id}" for r in out if r.doc_id is not None)
    assert len(out) == len(rows) and len({r.mix_position for r in out}) == len(rows)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.mix_slot, []).append(r.source)
    n = Counter(r[3] for r in rows)
    assert all(len(set(v)) == 1 and len(v) <= 8 for v in by_slot.values())
    assert [by_slot[t][0] for t in range(len(by_slot))] == simulate({k: -(-v // 8) for k, v in n.items()}, weights)
    ids = [r.doc_id for r in mixing.arranged(spark.createDataFrame(rows, DOCS), block=8).collect()]
    assert len(ids) == len(rows)
    places = [r.mix_position for r in mixing.arranged(spark.createDataFrame(rows, DOCS), block=8).collect()]
    assert places == sorted(places)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def best_similarity(doc, item):
    a, b = tokens(doc), tokens(item)
    k = min(5, len(b))
    if not b or len(a) < k:
        return 0
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want, best = grams(b), 0
    for s in range(max(1, len(a) - len(b) + 1)):
        got = grams(a[s : s + len(b)])
        shared = sum((got & want).values())
        best = max(best, shared / (sum(got.values()) + sum(want.values()) - shared))
    return best


def test_leaks(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, prose(rnd.randrange(15, 45)), "x") for i in range(40)] + [(90, "Zebra quark", ""), (91, None, ""), (92, "", ""), (None, prose(20), ""), (93, "go " * 30, ""), (94, items_text := prose(30), ""), (95, items_text, "")]
    bench = spark.createDataFrame(items, "item_id long, text string, n string")
    docs = [(0, None), (1, ""), (2, prose(2000)), (3, "a Zebra, quark! b"), (4, "go " * 28), (5, items[3][1].upper().replace(" ", ", ")), (6, items_text)]
    for i in range(10, 110):
        w = rnd.choice(items[:40])[1].split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if i % 3 == 0:
            w.insert(rnd.randrange(len(w)), "new")
        docs.append((i, f"{prose(rnd.randrange(50))} {' '.join(w)} {prose(rnd.randrange(50))}"))
    rows = [(i, t, "", "", 1, "", "", "") for i, t in docs]
    got = {(r.doc_id, r.item_id): r.similarity for r in benchmark_leaks.find_leaks(spark.createDataFrame(rows + rows[6:7] + [(None, items_text, "", "", 1, "", "", "")], DOCS), bench).collect()}
    want = {(d, i): s for d, t in docs for i, x, _ in items if i is not None and (s := best_similarity(t, x)) >= 0.8}
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-5 for p in want)
    half = [f"h{i}" for i in range(60)]  # the halves of an item swapped: no shingle stands where the item would begin
    one = spark.createDataFrame([(1, " ".join(half), "")], bench.schema)
    odd = [(1, f"{prose(40)} {' '.join(half[30:] + half[:30])} {prose(40)}"), (2, prose(90)), (2, " ".join(half)), (None, " ".join(half)), (3, " ".join(half[:52]))]
    odd = spark.createDataFrame([(i, t, "", "", 1, "", "", "") for i, t in odd], DOCS)
    assert sorted((r.doc_id, r.similarity) for r in benchmark_leaks.find_leaks(odd, one).collect()) == [(1, round(52 / 60, 6)), (2, 1.0), (3, round(48 / 56, 6))]
    assert sorted(r.doc_id for r in benchmark_leaks.drop_leaks(odd, one).collect()) == [2]
    for empty in ((rows, []), ([], items)):
        assert benchmark_leaks.find_leaks(spark.createDataFrame(empty[0], DOCS), spark.createDataFrame(empty[1], bench.schema)).count() == 0
    kept = {r.doc_id for r in benchmark_leaks.drop_leaks(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_classifier(spark):
    rnd = random.Random(6)
    good, bad = "the river was calm and we walked home".split(), "buy$$ cheap### pills*** now&&& win%%%".split()
    rows, labels = [], []
    for i in range(600):
        q = i % 3 != 0
        text = " ".join(rnd.choice(good if q or rnd.random() < 0.3 else bad) for _ in range(60))
        rows.append((i, text, "en", f"s{i % 5}", len(text), "", "", ""))
        if i % 2:
            labels.append((i, int(q), 0))
    rows += [(9000, None, None, None, None, None, None, None), (None, "", "", "", 0, "", "", "")]
    out = quality_classifier.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and (r.doc_id % 2 == 0 or r.held_out)]
    assert sum(r.held_out for r in held) > 50
    assert sum(r.good == (r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)
    one = quality_classifier.score(spark.createDataFrame(rows[:5], DOCS), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in one} == {1.0}
    assert quality_classifier.score(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_surest_brute_force(spark):
    rnd = np.random.default_rng(3)
    views = quality_classifier.Views(0.5)
    views.weights = [rnd.normal(size=features.DIM + 1).astype(np.float32), rnd.normal(size=quality_classifier.META + 1).astype(np.float32)]
    rows = [(i, f"text {i * i % 7} of {i}", "en", f"s{i % 4}", i * i) for i in range(90)]
    known = [{1, 2, 3}, {4, 5}]
    want = set()
    for view in (0, 1):
        of = {}
        for k, text, lang, source, n in rows:
            x = features.profile(text, keep_marks=True) if view == 0 else quality_classifier.metadata(lang, source, n)
            of.setdefault(k, float(x @ views.weights[view][:-1] + views.weights[view][-1]))
        free = [(m, k) for k, m in of.items() if k not in known[1 - view] and k < 90]
        want |= {(view, 1, k) for m, k in sorted((-m, k) for m, k in free if m > 0)[:7]} | {(view, -1, k) for m, k in sorted((m, k) for m, k in free if m < 0)[:5]}
    frame = spark.createDataFrame([(k, *r) for (k, *r) in rows[:90]], "key long, text string, lang string, source string, n_chars long").repartition(5)
    got = quality_classifier.surest(frame.unionByName(frame), views, 7, 5, known).collect()
    assert {(r.view, r.sign) for r in got} == {(r[0], r[1]) for r in want} and len(got) == len(want)
    assert len({(r.view, r.sign, r.key) for r in got} & want) >= len(want) - 4  # ties and rounding


def test_profile_in_chunks(monkeypatch):
    text = "Añ ß word " * 500
    whole = features.profile(text)
    monkeypatch.setattr(features, "_CHUNK", 64)
    assert np.abs(features.profile(text) - whole).max() < 0.02


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    leaks = {r.doc_id for r in QUERIES["op3_benchmark_leaks"](spark, d).collect()}
    before = common.written()
    out = corpus_pipeline.run(spark, d).collect()
    assert common.written() - before <= 2  # the last stage's documents and its own table
    ids = {r.doc_id for r in out}
    assert ids and not ids & leaks and len(ids) == len(out)
    assert [c for c in corpus_pipeline.run(spark, d).columns if not c.startswith("mix_")] == docs.columns
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.text) for r in out)
    assert all(r.n_chars == len(r.text) for r in out)
