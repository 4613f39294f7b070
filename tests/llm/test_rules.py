"""Url filter and quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from scaleloom.llm import common, quality_rules, url_filter
from scaleloom.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, extra string, w string"
TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "x " * 300, "Foo bar\n\nFoo bar\nfoo bar\n \n \nFoo bar", "a\u00a0b c\x0bd\x0ce\rf",
    "#a *b $c %d &e |f <g >h", " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 70}" for i in range(100)), "é ü ß " * 40, "y" * 50_000, " ".join(f"v{i % 997}" for i in range(20_000)),
]


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    marked = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_counts(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", "x", "y") for i, t in enumerate(TEXTS)]
    out = quality_rules.apply_rules(spark.createDataFrame(rows + rows[4:6], DOCS)).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        assert tuple(r)[1:7] == counts(TEXTS[r.doc_id]), r
        assert not (r.base_failed and r.kept)


def test_quality_thresholds_follow_the_source(spark):
    clean = [(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(100)), "en", "a", "", "") for i in range(300)]
    noisy = [(1000 + i, " ".join(f"w{(i * 7 + j) % 300}##" for j in range(100)), "en", "b", "", "") for i in range(300)]
    odd = [(5000, noisy[0][1], "en", "a", "", "")]
    kept = {r.doc_id for r in quality_rules.apply_rules(spark.createDataFrame(clean + noisy + odd, DOCS)).where("kept").collect()}
    assert kept == {r[0] for r in clean + noisy}
    assert quality_rules.apply_rules(spark.createDataFrame([], DOCS)).count() == 0


def judge(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for r in rules:
        name, _, rest = r.pattern.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return host, path, best and best.pattern, best.verdict if best else None


PAGES = "page_id long, url string, html string, host string"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?q#f", "http://example.net", "http://x.net/a://b", "ftp://notnet/x", "http://example.com/de/x", "https://example.com/den", "http://q.org/fr/?a", "http://ex.org/fr", "x://Ä.net/ü/1#z", "http://a.net?b/c"]
    out = url_filter.filter_urls(spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)] * 2, PAGES)).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        host, path, rule, verdict = judge(urls[r.page_id], url_filter.RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_aliases(spark):
    link = lambda u: f'<html><link href="{u}" rel=canonical>'
    rows = [
        (1, "http://a.com/1", link("http://b.com/2"), ""), (2, "https://b.com/2#x", '<meta http-equiv="refresh" content="0; url=//evil.net/z">', ""),
        (3, "http://c.com/1", link("/9"), ""), (4, "http://c.com/9", "", ""), (5, "http://d.com/1", link("http://ok.org/fr/1"), ""), (6, "http://ok.org/fr/1", link("http://bad.net/q"), ""), (7, "http://bad.net/q", None, ""),
        (8, "http://e.com/", None, ""), (9, "http://f.com/", "", ""),
    ]
    moved = spark.createDataFrame([("http://f.com/", "http://a.com/1"), (None, "http://e.com/")], "from_url string, to_url string")
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES), redirects=moved).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block"}
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_links_are_decoded_and_resolved(spark):
    page = "http://a.com/x/y/p.html?q=1"
    hrefs = ["http://b.com/p?a=1&amp;b=2", "?page=2", "../z", "./n", "m/../k?s#f", "&#47;root&#x2F;r", "../../../up", "//C.com/d/./e/..", "/q/", "#top", " rel ", "https&#58;//d.com/&#8364;"]
    tags = ['<LINK rel="alternate canonical" href="%s"/>', "<link href='%s' rel='canonical'>", '<meta content="5; URL=%s" http-equiv=Refresh>']
    rows = [(i, page, "<html>" + tags[i % 3] % h + '<link rel=stylesheet href="/s">', "") for i, h in enumerate(hrefs)] + [(99, page, "<link rel=canonical href=/one><link rel=canonical href='/two'>", "")]
    got = {r.v for r in url_filter.page_edges(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {"b.com/p?a=1&b=2", "a.com/x/y/p.html?page=2", "a.com/x/z", "a.com/x/y/n", "a.com/x/y/k?s", "a.com/root/r", "a.com/up", "c.com/d/", "a.com/q/", "a.com/x/y/rel", "d.com/&#8364;".split("#")[0], "a.com/one", "a.com/two"}


def test_decisions_brute_force(spark):
    rnd = random.Random(6)
    hosts = ["a.com", "b.net", "example.net", "c.org", "x.example.com"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr'])}/{i}" for i in range(150)]
    links = {i: rnd.sample(range(150), rnd.choice([0, 0, 1, 2])) for i in range(150)}
    rows = [(i, u, "".join(f'<link rel="canonical" href="{urls[j]}">' for j in links[i]), "") for i, u in enumerate(urls)]
    group = list(range(150))
    for i, js in links.items():
        for j in js:
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    own = [judge(u, url_filter.RULES)[3] for u in urls]
    among = {g: {own[i] for i in range(150) if group[i] == g} for g in group}
    want = {i: own[i] or ("allow" if "allow" in among[group[i]] else "block" if "block" in among[group[i]] else "allow") for i in range(150)}
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()} == want


def slow_thresholds(values, slack, low=False):
    """Quartiles of the logarithmic sketch, one value at a time."""
    buckets = sorted(-100_000 if v <= 0 else math.ceil(round(math.log(v) / math.log(quality_rules.GAMMA), 6)) for v in values)
    at = lambda q: buckets[max(0, math.ceil(q * len(buckets) - 1e-9) - 1)]
    q1, q3 = (0.0 if b == -100_000 else quality_rules.GAMMA**b for b in (at(0.25), at(0.75)))
    reach = quality_rules.REACH * (q3 - q1) + slack
    return q1 - reach if low else q3 + reach


def test_thresholds_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_ROWS", 40)
    rnd = random.Random(9)
    docs = []
    for i in range(400):
        lang, source = rnd.choice([("en", "a"), ("en", "b"), ("de", "a"), ("fr", "q")] if i % 40 else [("xx", "q")])
        words = [f"w{rnd.randrange(60)}" + rnd.choice(["", "", "!", "#", "##$", "x" * rnd.randrange(12)]) for _ in range(rnd.randrange(50, 120))]
        words += [rnd.choice(["!" * 60, "#" * 90, "y" * 900])] * (3 if i % 23 == 5 else 0)
        docs.append((i, " ".join(words), lang, source, "", ""))
    metrics, failed = {}, {}
    for i, t, *_ in docs:
        n, chars, symbols, dup, repeats, failed[i] = counts(t)
        metrics[i] = {"symbols": symbols / chars, "dup_lines": dup / 1, "repeats": repeats / n, "bangs": t.count("!") / n, "word_length": chars / n}
    sound = [d for d in docs if not failed[d[0]]]
    want = {}
    for i, _, lang, source, *_ in docs:
        near = [d for d in sound if d[2:4] == (lang, source)]
        mid = [d for d in sound if d[2] == lang]
        of = [d[0] for d in (near if len(near) >= 40 else mid if len(mid) >= 40 else sound)]
        limit = lambda m, low=False: slow_thresholds([metrics[x][m] for x in of], quality_rules.SLACK[m], low)  # noqa: E731, B023
        want[i] = not failed[i] and all(metrics[i][m] <= limit(m) for m in quality_rules.SLACK) and metrics[i]["word_length"] >= limit("word_length", True)
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(docs, DOCS)).collect()} == want
    assert len(set(want.values())) == 2


@pytest.mark.parametrize("frequent", [500, 2])
def test_components(spark, monkeypatch, frequent):
    monkeypatch.setattr(common, "FREQUENT", frequent)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7), (None, 3)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert {got[i] for i in range(61)} == {0} and got[300] == 100 and got[1039] == 1000 and len(got) == 61 + 3 + 40


def test_components_compute_a_star_once(spark, monkeypatch):
    """No table of a round holds the lookup, which broadcasts, more than once: it has four joins, as one of its three is pushed into a union."""
    joins, write = [], common.stash

    def counted(df, name="part"):
        joins.append(len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())))
        return write(df, name)

    monkeypatch.setattr(common, "FREQUENT", 2)
    monkeypatch.setattr(common, "stash", counted)
    hubs = [(h, h + i) for h in (0, 1000) for i in range(1, 40)] + [(39, 1039)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(hubs, "u long, v long")).collect()))
    assert len(got) == 80 and set(got.values()) == {0}
    assert 1 < max(joins) <= 4, joins


def test_components_end_with_stars(spark, monkeypatch):
    """Stars take no round, and components equal those of a plain union."""
    tables, write = [], common.stash
    monkeypatch.setattr(common, "stash", lambda df, name="part": tables.append(name) or write(df, name))
    stars = [(1 + i, 10 * i) for i in range(3, 8)] + [(0, 100), (100, 0), (0, 101)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(stars, "u long, v long")).collect()))
    assert got == {n: min(e) if max(e) < 100 else 0 for e in stars for n in e} and len(tables) == 2
    assert connected_components(spark.createDataFrame([(5, 5), (None, 1)], "u long, v long")).count() == 0

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in root:
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(rows) == len(root) and dict(map(tuple, rows)) == root
