"""Personal data, fingerprints, page text and language against plain Python."""

import hashlib
import math
import random
import re

import xxhash

from scaleloom.llm import html_extract, language_id, pii, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, fp string, host string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    rnd = random.Random(5)
    texts = [None, "", "a@b", "x@@y.com a@b.c@d.ef", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (017) 555-7713 +1 +22", "é😀 z@q.io +12345678901 ü", "@" * 999, "a." * 20_000, "7" * 5000]
    texts += ["".join(rnd.choice("ab@.-+ ()1234567890é") for _ in range(rnd.randrange(200))) for _ in range(400)]
    out = pii.digest(pii.find_pii(spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(texts)] + [(None, "q@r.st", "", "", "", "")], DOCS))).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = base_spans("q@r.st" if r.doc_id is None else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in want).encode()).hexdigest(), (r, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in BASE]
        assert {f"{k}:{s}:{e}" for s, _, k, e in want} <= set(r.spans.split(","))


def test_pii_context_and_checksums(spark):
    kinds = lambda t: [x[2] for x in pii.spans_of(t)]
    assert kinds("my IBAN is DE89 3704 0044 0532 0130 00 thanks") == ["iban"] and kinds("my IBAN is DE89 3704 0044 0532 0130 01") == []
    assert kinds("call me: (017) 555-7713") == ["local_phone"] and kinds("order (017) 555-7713") == []
    assert kinds("IBAN ES91 2100 0418 4502 0005 1332 EUR due") == kinds("IBAN ES91 2100 0418 4502 0005 1332, due") == ["iban"] and kinds("ES91 2100 0418 4502 0005 1332 9") == ["iban"] and kinds("ES91 2100 0418 4502 0005 13329") == []
    for secret in ("AKIA" + "Q7" * 8, "ghp_" + "a1" * 18, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.s5x_Zq", "-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----"):
        assert [(s, k, e) for s, _, k, e, _ in pii.spans_of(f"a {secret} b")] == [(2, "secret", 2 + len(secret))]
    assert pii.masked('token = "04dbebab91ab85687d33eeaaf9ac" x') == 'token = "<SECRET>" x' and kinds("password: hunter2!") == ["secret"] and kinds("password: please, the token: whatever key: value") == []
    score = lambda t: pii.spans_of(t)[0][4]
    assert score("visa card 4111 1111 1111 1111") > score("x 4111 1111 1111 1111") > score("order 4111 1111 1111 1111") and score("call +1 (017) 555-7713") > score("version +1 (017) 555-7713")
    for long in ("-----BEGIN PRIVATE KEY-----" * 20_000, "token=" * 50_000, "AB12 " * 50_000, "password=" + "a" * 500_000):
        pii.spans_of(long)
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("serial 123-45-6789") == []
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "en", "", "", ""), (2, None, None, None, None, None)], DOCS).selectExpr("*", "length(text) n_chars")
    assert [r.text for r in pii.mask_pii(docs).orderBy("doc_id").collect()] == ["mail <EMAIL> now", None]
    assert pii.mask_pii(docs).columns == docs.columns


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    long = [rnd.choice(words) for _ in range(400)]
    texts = [None, "", "One", "one", "ONE two", "a b c", "A B  C", "a\x0bb\x1cc", "y" * 9999]
    for _ in range(60):
        t = list(long)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(400)] = rnd.choice(words)
        texts.append(" ".join(t))
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    want = components(fps, list(fps))
    df = spark.createDataFrame([(i, t, "", "", "clash", "") for i, t in enumerate(texts)], DOCS)
    for direct in (64, 1):
        monkeypatch.setattr(simhash_dedup, "DIRECT", direct)
        got = {r.doc_id: r for r in simhash_dedup.digest(simhash_dedup.near_duplicates(df)).collect()}
        assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
        assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in simhash_dedup.keep_one(df).collect()}
    assert kept == set(want.values())
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    near = {0, (1 << 64) - 1} | {rnd.getrandbits(64) for _ in range(40)}
    for x in list(near):
        for _ in range(6):
            y = x
            for _ in range(rnd.randrange(1, 4)):
                y ^= 1 << rnd.randrange(64)
            near.add(y)
    fps = sorted(near)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and (fps[i] ^ fps[j]).bit_count() <= 2}
    df = spark.createDataFrame([(simhash_dedup._signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    for direct in (64, 0):
        monkeypatch.setattr(simhash_dedup, "DIRECT", direct)
        got = {tuple(r) for r in simhash_dedup.links(df).collect()}
        assert got | {(b, a) for a, b in got} == want


PAGE = "page_id long, url string, html string, text string, host string"


def test_html(spark):
    body = '<html><head><title>T</title></head><body><nav>menu</nav><div class="ad x">buy</div><article><h1>A &amp; B</h1><p><b>one<br>two\n  x<p>three &eacute;&#8364;</article><div id=comments><p>first!</p></div><footer>f</footer>'
    want = "A & B\n\none two x\n\nthree é€"
    assert html_extract.text_of(body) == want
    assert html_extract.text_of("<p>a<script>var x='</p>';</script>b<!-- <p>c --></p>d <i>e</i><ul><li>f<li>g</ul>") == "ab\n\nd e\n\nf\n\ng"
    assert html_extract.text_of("plain < text & more") == "plain < text & more"
    site = [(i, f"http://h.com/{i}", f"<body><div class=top>Same words here</div><div class=story><p>Story {i} differs {i * i}</p></div></body>", "", "") for i in range(8)]
    rows = [(100, "http://x.com/1", body, "", ""), (101, None, None, None, None), (102, "no", "", "", ""), (103, "http://x.com/1", body, "", "")]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(site + rows, PAGE)).collect()}
    assert out[100].text == out[103].text == want and out[100].n_chars == len(want) and out[101].text == out[102].text == ""
    assert all(out[i].text == f"Story {i} differs {i * i}" for i in range(8))
    assert html_extract.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_html_copies_do_not_erase_the_article(spark):
    story = lambda i: f"<h1>Title {i}</h1><p>Story {i} differs from the others {i * i}</p>"
    side = "<div class=box>Same words</div>"
    rows, want = [], {}
    for host, wrap in (("a", "<body><div id=page>%s<article>%s</article></div>"), ("b", "<body><div id=page>%s<div class=text>%s</div></div>")):
        for i in range(100):  # 80 copies and 20 of their own
            n = 0 if i < 80 else i
            key = len(rows)
            rows.append((key, f"http://{host}.com/{i}", wrap % (side, story(n)), "", ""))
            want[key] = f"Title {n}\n\nStory {n} differs from the others {n * n}"
    for i in range(5):
        rows.append((1000 + i, f"http://c.com/{i}", f"<body><div id=page><article>{story(3)}</article></div>", "", ""))
        want[1000 + i] = "Title 3\n\nStory 3 differs from the others 9"
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert out == want


def slow_language(model, text):
    """Family, then language: profiles by counting, votes by loops."""
    data = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", text.lower().encode())
    x = [0.0] * 4096
    for i in range(len(data) - 2):
        x[(data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761 % (1 << 32) >> 20] += 1
    total = sum(x)
    x = [math.sqrt(v / total) for v in x]

    def vote(m):
        if len(m.classes) == 1:
            return m.classes[0], 1.0
        votes, sums, least = ([f] * len(m.classes) for f in (0, 0.0, math.inf))
        for (i, j), w in zip(m.pairs, m.weights.tolist(), strict=True):
            margin = sum(a * b for a, b in zip(x, w, strict=False)) + w[-1]
            votes[i if margin > 0 else j] += 1
            for c, own in ((i, margin), (j, -margin)):
                sums[c] += own
                least[c] = min(least[c], own)
        best = max(range(len(votes)), key=lambda c: votes[c] + math.tanh(sums[c] / 100) / 4)
        return m.classes[best], 1 / (1 + math.exp(-4 * least[best]))

    family, sure = vote(model.top)
    lang, own = vote(model.within[family])
    return lang, round(sure * own, 4)


def test_language(spark):
    rnd = random.Random(1)
    vocab = {"en": "the of and thing ing that was", "de": "der die und nicht schön über", "fr": "le la et été que être", "es": "el los y que más año"}
    rows = [(i, " ".join(rnd.choice(vocab[k].split()) for _ in range(30)), k, "", "", "") for i, k in enumerate(list(vocab) * 100)]
    rows += [(9000, None, "en", "", "", ""), (9001, "123 ½ ² ① !?", "de", "", "", ""), (9002, "los años y el", None, "", "", ""), (None, "the thing", None, "", "", "")]
    out = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[9000].lang_pred == by[9001].lang_pred == "und" and by[9002].lang_pred == "es" and by[None].lang_pred == "en" and by[None].held_out is False
    held = [r for r in out if r.held_out and r.doc_id < 9000]
    assert len(held) > 50 and sum(by[r.doc_id].lang_pred == rows[r.doc_id][2] for r in held) >= 0.98 * len(held)
    kept = language_id.drop_unknown(spark.createDataFrame(rows, DOCS))
    assert kept.count() == len(rows) - 2 and kept.where("doc_id = 9002").first().lang == "es"
    none = language_id.identify(spark.createDataFrame([(1, "abc", None, "", "", "")], DOCS)).collect()
    model = language_id.train(spark.createDataFrame(rows, DOCS), ~language_id.held_out())
    for r in out[:60]:
        assert (r.lang_pred, round(r.score, 4)) == slow_language(model, rows[r.doc_id][1])
    assert none[0].lang_pred == "und" and language_id.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_language_stage_takes_the_prediction(spark):
    rnd = random.Random(8)
    vocab = {"en": "the of and thing ing that was", "de": "der die und nicht schön über", "fr": "le la et été que être", "es": "el los y que más año"}
    true = {i: k for i, k in enumerate(list(vocab) * 100)}
    wrong = {i: rnd.choice([k for k in vocab if k != true[i]]) for i in true if i % 20 == 3}
    rows = [(i, " ".join(rnd.choice(vocab[k].split()) for _ in range(30)), wrong.get(i, k), "", "", "") for i, k in true.items()]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang for r in language_id.drop_unknown(frame).collect()}
    assert got == {r.doc_id: r.lang_pred for r in language_id.identify(frame).collect()}
    assert sum(got[i] == true[i] for i in wrong) >= 0.9 * len(wrong) and sum(got[i] == k for i, k in true.items()) >= 0.99 * len(true)
    held = frame.where(language_id.held_out()).first().doc_id
    other = frame.selectExpr("doc_id", "text", f"if(doc_id = {held}, 'tlh', lang) lang", "source", "fp", "host")
    assert language_id.drop_unknown(other).where(f"doc_id = {held}").first().lang == "tlh"
    unlabelled = spark.createDataFrame([(1, "abc", None, "", "", ""), (2, "1 2", None, "", "", ""), (None, "x", None, "", "", "")], DOCS)
    assert {(r.doc_id, r.lang) for r in language_id.drop_unknown(unlabelled).collect()} == {(1, None), (None, None)}


def test_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 7)  # lists go by in blocks
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    texts = {}
    for base in range(0, 400, 20):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([12, 60, 150, 400]))]
        for i in range(base, base + (16 if base < 60 else 5)):
            copy = list(words)
            for _ in range(rnd.randrange(1 + len(words) // 50) if i > base else 0):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts[i] = " ".join(copy)
    texts |= {1000: None, 1001: "", 1002: "a b", 1003: "A  b", 1004: texts[0].upper().replace(" ", "\n"), 1005: "b a", 1006: "x " * 5000, 1007: "x " * 5001}
    rows = [(i, t, "clash", "clash", 0.5) for i, t in texts.items()]
    rows += [rows[0], (None, texts[20], "", "", 0.0), (None, "nothing like it", "", "", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string, fp string, key double")
    clash = spark.createDataFrame([(1, texts[0]), (2, texts[0]), (2, texts[40]), (3, texts[40])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == texts[0]) for r in simhash_dedup.keep_one_similar(clash).collect()) == [(1, True), (2, False)]
    assert sorted((r.doc_id, r.text == texts[0]) for r in simhash_dedup.keep_one(clash).collect()) == [(1, True), (2, False)]
    got = {(r.doc_id, r.component_id) for r in simhash_dedup.similar(frame).collect()}
    comp = {d: c for d, c in got if d is not None}
    assert {c for d, c in got if d is None} == {20, None}

    def grams(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: grams(t) for i, t in texts.items()}
    similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    reach = {i: i for i in sets}
    for _ in range(12):
        for (a, b), j in similar.items():
            if j >= 0.8:
                reach[a] = reach[b] = min(reach[a], reach[b])
    assert all(comp[a] == comp[b] for (a, b), j in similar.items() if j >= 0.85)
    assert all(reach[i] == reach[c] for i, c in comp.items())
    assert sum(comp[a] == comp[b] for (a, b), j in similar.items() if j >= 0.8) >= 0.95 * sum(j >= 0.8 for j in similar.values())
    assert simhash_dedup.similar(frame.limit(0)).count() == 0
    kept = [r.doc_id for r in simhash_dedup.keep_one_similar(frame).collect()]
    assert sorted(x for x in kept if x is not None) == sorted([0, *(i for i in texts if comp[i] == i)]) and kept.count(None) == 2


def test_similar_texts_parted_by_one_block(spark):
    """A block of words added, cut or replaced: the five-word similarity is that of any shorter shingle."""
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts, wanted = [], []
    while len(wanted) < 240:
        n, kind, j = rnd.choice([60, 100, 400]), len(wanted) % 3, rnd.uniform(0.8, 0.85)
        a = [word() for _ in range(n)]
        at = rnd.randrange(n // 2)
        new = [word() for _ in range(int((n * (1 / j - 1), 0, n * (1 - j) / (1 + j))[kind]))]
        b = a[:at] + new + a[at + int((0, n * (1 - j), n * (1 - j) / (1 + j))[kind]) :]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            wanted.append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    comp = {r.doc_id: r.component_id for r in simhash_dedup.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [comp[b] for _, b in wanted] == [a for a, _ in wanted]
