"""The style tree against a plain tree, and pages that wrap, nest or break."""

import math
import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

from scaleloom.llm import html_extract
from scaleloom.llm.html_extract import text_of

PAGE = "page_id long, url string, html string"
CONTAINERS = {"div", "nav", "ul", "footer", "aside"}


class Tree(HTMLParser):
    """(path, children, texts, tag) of the elements of well-formed markup."""

    def __init__(self, page):
        super().__init__()
        self.open, self.all = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        sign = tag + "".join({"class": ".", "id": "#"}[k] + v for k, v in attrs)
        if self.open:
            self.open[-1][1].append(sign)
        self.open.append(((*(self.open[-1][0] if self.open else ()), sign), [], [], tag))
        self.all.append(self.open[-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for e in self.open:
            e[2].append(data)


def entropy(values):
    n = Counter(values)
    m = sum(n.values())
    return 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in n.values()) / math.log(m)


def site_pages(rnd, n):
    word = lambda: rnd.choice("sun rain wind snow cloud storm hail fog".split())
    pages = []
    for i in range(n):
        story = "".join(f"<p>{i} {word()} {word()} {i * i}</p>" for _ in range(rnd.randrange(1, 5)))
        ad = f"<div class=box{i % 2}><div>{rnd.choice(['buy this', 'buy that'])}</div></div>" * rnd.randrange(3)
        pages.append(f"<html><body><div id=top><ul><li>home</li><li>news</li></ul></div>{ad}<article>{story}</article><div id=end>{word()}</div></body></html>")
    return pages


def test_style_tree_brute_force(spark):
    pages = site_pages(random.Random(3), 40)
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.x.com/{i}", p) for i, p in enumerate(pages)]
    rows += [(100, rows[0][1], rows[0][2])]  # the same main text counts once
    sites = defaultdict(list)
    for _, url, page in rows[:-1]:
        found = defaultdict(lambda: ([], []))
        for path, children, texts, tag in Tree(page).all:
            if tag in CONTAINERS:
                found[path][0].append(tuple(children))
                found[path][1].append(tuple(texts))
        for path, (look, said) in found.items():
            for site in (url[7:14], "x.com"):
                sites[site, path].append((tuple(look), tuple(said)))
    want = sorted((site, len(v), round(0.3 * entropy([x for x, _ in v]) + 0.7 * entropy([x for _, x in v]), 6)) for (site, _), v in sites.items())
    got = sorted((r.site, r.n_pages, round(r.importance, 6)) for r in html_extract.style_tree(spark.createDataFrame(rows, PAGE)).collect())
    assert got == want


def test_the_tree_alone_gives_what_names_give(spark):
    rnd = random.Random(8)
    pages, texts = [], []
    for i in range(60):
        texts.append(f"Title {i}\n\nStory {rnd.random()} of page {i}")
        title, story = texts[-1].split("\n\n")
        pages.append(f"<body><nav><ul><li>home<li>news</ul></nav><div class=ad>buy {i % 3}</div><article><h1>{title}</h1><p>{story}<div class=share>tell friends</div></article><footer>(c) h{i % 4}.x.org</footer>")
    frame = spark.createDataFrame([(i, f"http://h{i % 4}.x.org/{i}", p) for i, p in enumerate(pages)], PAGE)
    for names in (True, False):
        assert [r.text for r in html_extract.extract(frame, names).orderBy("page_id").collect()] == texts


def test_names_do_not_erase_the_article():
    story = "<article><h1>T</h1><p>one two</article>"
    for page in (f"<form id=aspnetForm>{story}</form>", f'<div class="layout no-sidebar">{story}</div>', f'<div class="has-footer menu">{story}</div>', f"<div class=widget><main>{story}</main></div>"):
        assert text_of(f"<body><nav>a menu that is longer than the story</nav>{page}<div class=sidebar>x</div><form>Send<input></form><div id=comments><article class=comment>first!</article></div>") == "T\n\none two"
    assert text_of("<div class=promo><p>" + "the text of a page without an article " * 3 + "</div><div class=promo>buy</div>") == ("the text of a page without an article " * 3).strip()
    assert text_of("<aside><article>other</article></aside><article>this</article>") == "this"


def test_long_deep_and_broken_pages():
    began = time.time()
    for page in ("<div>x" * 20_000, "<a " * 20_000, '<a "' * 20_000 + ">", "<b><div>x</div>" * 10_000, "<td><p>x" * 10_000, "<li>x" * 20_000, "<!--" * 20_000, "<script>" * 20_000):
        html_extract.Page(page).branches()
        text_of(page)
    assert time.time() - began < 60
    assert text_of("<div>x" * 20_000) == "\n\n".join("x" * 20_000)
    assert text_of("1 < 2 <3> & 4 <") == "1 < 2 <3> & 4 <"
    long = "word " * 200_000
    assert text_of(f"<article><p>{long}</article>") == long.strip()
    assert text_of(None) == text_of("") == text_of("<p></p>") == ""
