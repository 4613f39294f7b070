"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from scaleloom.llm import bwt_dedup, common

DOCS = "doc_id long, text string, start string, end string, anchor string"


def brute(docs, length=100):
    """docs: {id: bytes}; per id (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), {}
    for i in sorted(docs):
        data = docs[i]
        hit = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                hit[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, h in zip(data, hit, strict=True) if not h)
        spans = sum(h and (p == 0 or not hit[p - 1]) for p, h in enumerate(hit))
        out[i] = (len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ß") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab " * 90, "é" * 160, prose(3000)]
    for _ in range(40):
        texts.append(prose(rnd.randrange(60)) + rnd.choice(shared) + prose(rnd.randrange(40)) + rnd.choice(shared)[: rnd.randrange(200)])
    for _ in range(10):
        t = list(rnd.choice(texts[8:]))
        t[rnd.randrange(len(t))] = "#"
        texts.append("".join(t))
    return [*texts, texts[10], texts[10]]


@pytest.mark.parametrize("length", [3, 10, 40])
def test_merge_gives_the_intervals(length):
    rnd = random.Random(length)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 60))).encode() for _ in range(30)]
    docs, starts = np.arange(30) * 3, np.arange(30) % 7
    seen, want = {}, set()
    for d, s, t in zip(docs, starts, strings, strict=True):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((int(d), int(s) + p))
    for v in seen.values():
        want |= {x for x in v if x != min(v)}
    for shards in (1, 2, 5):
        assert set(zip(*(x.tolist() for x in bwt_dedup.repeats(strings, docs, starts, length, shards)), strict=True)) == want


@pytest.mark.parametrize("variants", [2_000, 2, 1])
def test_deduplicate(spark, monkeypatch, variants):
    monkeypatch.setattr(bwt_dedup, "VARIANTS", variants)
    monkeypatch.setattr(bwt_dedup, "BUCKET", 50)
    monkeypatch.setattr(common, "FREQUENT", 2 if variants == 2 else 500)
    texts = corpus()
    want = brute({i: (t or "").encode() for i, t in enumerate(texts)})
    rows = [(i, t, "", "", "") for i, t in enumerate(texts)]
    got = bwt_dedup.deduplicate(spark.createDataFrame(rows + [(None, texts[10], "", "", ""), rows[9]], DOCS)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert tuple(r)[1:5] == want[r.doc_id], r.doc_id


def test_chunks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "_CHUNK", 500)
    texts = corpus(2)
    want = brute({i: (t or "").encode() for i, t in enumerate(texts)})
    got = bwt_dedup.deduplicate(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == want
    assert bwt_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_and_periods(spark):
    """A long run or a short period gives few windows, and the same result."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    texts = ["x" * n for n in (100, 101, 130, 161, 400)] + [noise(50) + "ab" * 300 + noise(70), noise(90) + "0123456" * 60, "0123456" * 40, noise(30) + noise(61) * 8, ("z" * 150 + "y") * 5]
    texts += [noise(20) + t + noise(9) for t in texts]
    want = brute({i: t.encode() for i, t in enumerate(texts)})
    got = bwt_dedup.deduplicate(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == want
    assert sum(len(a[0]) for a in bwt_dedup.anchors(b"x" * 200_000)) < 200_000 / 50
    one = bwt_dedup.deduplicate(spark.createDataFrame([(1, "x" * 200_000, "", "", "")], DOCS)).first()
    assert (one.n_removed, one.n_spans) == (199_999, 1)


def test_texts_that_share_an_id(spark):
    texts = corpus(3)
    rows = [(7, texts[10]), (7, texts[12]), (8, texts[10]), (9, texts[12]), (7, "ten bytes."), (None, texts[10])]
    got = bwt_dedup.deduplicate(spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOCS)).collect()
    least = min((hashlib.md5(t.encode()).digest(), t) for t in (texts[10], texts[12]))[1]
    want = brute({7: least.encode(), 8: texts[10].encode(), 9: texts[12].encode()})
    assert len(got) == len(rows)
    for r in got:
        whole = r.doc_id is None or r.doc_id == 7 and r.kept.decode() != least
        assert r.n_removed == 0 if whole else tuple(r)[1:5] == want[r.doc_id]
