"""Main text of web pages by a site style tree.

The elements of a host's pages are merged into one tree: for each path of elements it holds how often
each sequence of children (presentation) and each content occurs. The importance of a branch is a
weighted mean of the two normalised entropies; a branch whose look and words repeat over the pages goes
from each page. All branches are in the tree, menus and adverts included. Hosts with too few pages to
tell, and snippets dealt over many hosts, are judged by the same tree merged once more over the domain.
Names (nav, footer, class="ad", ...) are a prior beside it: they remove what entropy cannot see, such as
forms, the comments of readers, or the one page of a host.

Neither takes the article: elements around an article or main, or on a page without one those that hold
most of its text, are spared. Inside it a branch goes only if one content stands on over half of the
host's pages. Pages of a host with the same main text count once, so copies do not erase each other.

Edge cases: null or empty html gives an empty text; null urls form a host of their own; broken markup
is read leniently; repeated rows each get their row; an empty table gives no rows; other columns are
ignored. Texts are neither cut nor capped; time and memory are linear in a page's length and depth.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .url_filter import host_of

#: Importance below which a branch goes, different pages on which it must stand, weight of presentation against content.
LEAST_IMPORTANCE, LEAST_PAGES, PRESENTATION = 0.5, 5, 0.3
#: Up to so many low branches of all sites are broadcast; more are joined by site.
BROADCAST_BRANCHES = 200_000
#: Tags whose quotes never close are read up to the first ">"; after so many the quotes of a page count no more.
BROKEN_QUOTES = 64

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?i)(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACE = re.compile(r"\s+")
_RAW = {k: re.compile(rf"(?i)</{k}(?=[\s/>])[^>]*>") for k in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"option", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "body", "html", "head"}
_OWN_KIND = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_KEEPS_P = (*_OWN_KIND, "table")
#: Containers, which the tree judges; headings and paragraphs go with what holds them.
_CONTAINER = frozenset("aside center details dialog dir div dl fieldset figure footer form header menu nav ol search section select table ul".split())
_FURNITURE = frozenset("head nav footer header aside button select menu dialog object applet canvas map audio video".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert".split())
_DROP_NAME = re.compile(
    r"(?i)(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu\w*|nav|navbar|navigation|breadcrumbs?|side-?bar|sidebars?|footer|header|masthead|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|toolbar|widget|pagination|pager|tags|skip)(?:$|[_-])"
)
_COMMENTS = re.compile(r"(?i)(?:^|[_-])(?:comments?|commentlist|respond|replies|disqus)(?:$|[_-])")
#: A class that says what its element is without, or beside, names no branch.
_BESIDE = re.compile(r"(?i)^(?:no|not|non|without|with|has|hide|hidden)[_-]")
_MAIN = frozenset(("article", "main"))
_P, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6
_BASE_INV = pow(_BASE, -1, _P)
#: What a name says of an element: nothing, boilerplate unless it holds the article, furniture of the page, comments of readers.
_PLAIN, _NAMED, _FIXED, _READERS = range(4)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big") % _P


@lru_cache(4096)
def _sign_hash(sign: str) -> int:
    return _hash(sign)


def _what(tag: str, attrs: str) -> tuple[int, str]:
    """What an element's names say of it, and its signature in a path."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if "=" in attrs else {}
    sign = tag + "".join(f"{c}{_SPACE.sub('.', found[k].strip())}" for k, c in (("class", "."), ("id", "#")) if k in found)
    names = [n for k in ("class", "id") for n in found.get(k, "").split() if not _BESIDE.match(n)]
    if tag in ("html", "body"):
        return _PLAIN, sign
    if any(_COMMENTS.search(n) for n in names):
        return _READERS, sign
    if tag in _MAIN:
        return _PLAIN, sign
    if tag in _FURNITURE:
        return _FIXED, sign
    if tag == "form" or found.get("role", "").lower() in _DROP_ROLE or any(_DROP_NAME.search(n) for n in names):
        return _NAMED, sign
    return _PLAIN, sign


class Page:
    """Elements of a page in order of opening (lists by element) and its blocks of text."""

    def __init__(self, html: str | None, own: str = ""):
        self.tag, self.parent, self.path, self.kind = [""], [-1], [0], [_PLAIN]
        self.look = [0]  # of the signatures of the children
        self.first, self.end = [0], [0]  # blocks of an element
        self.blocks: list[tuple[int, list[tuple[str, int]]]] = []  # element, and pieces with the element each lies in
        if html:
            self._read(html)
        for i in range(len(self.tag)):
            self.end[i] = len(self.blocks) if self.end[i] < 0 or i == 0 else self.end[i]
        self.texts = [self._text(pieces) for _, pieces in self.blocks]
        self._around()
        self.own = own

    @staticmethod
    def _text(pieces) -> str:
        return _SPACE.sub(" ", htmllib.unescape("".join(t for t, _ in pieces))).strip()

    def _read(self, page: str) -> None:
        stack, block_of, at_tag = [0], [0], {}  # open elements, those of them that are blocks; by tag the places of those in the stack
        pieces: list[tuple[str, int]] = []
        last_gt, broken = page.rfind(">"), 0

        def flush():
            if pieces:
                if any(t.strip() for t, _ in pieces):
                    self.blocks.append((block_of[-1], pieces.copy()))
                pieces.clear()

        def pop_to(i: int):
            if any(self.tag[e] in _BLOCK for e in stack[i:]):
                flush()
            while len(stack) > i:
                e = stack.pop()
                at_tag[self.tag[e]].pop()
                if e == block_of[-1]:
                    block_of.pop()
                self.end[e] = len(self.blocks)

        def innermost(tags) -> int:
            return max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=0)

        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or lt > last_gt:
                pieces.append((page[at:], stack[-1]))
                break
            if lt > at:
                pieces.append((page[at:lt], stack[-1]))
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                pieces.append((htmllib.escape(page[lt + 9 : n if end < 0 else end]), stack[-1]))
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                at = page.find(">", lt) + 1
                continue
            m = _TAG.match(page, lt) if broken < BROKEN_QUOTES else _PLAIN_TAG.match(page, lt)
            if m is None and broken < BROKEN_QUOTES and (m := _PLAIN_TAG.match(page, lt)):
                broken += 1
            if m is None:
                pieces.append(("<", stack[-1]))
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if i := innermost((tag,)):
                    pop_to(i)
                elif tag in _BLOCK:
                    flush()
                continue
            if tag in _RAW:
                end = _RAW[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                pieces.append((" ", stack[-1]))
            if tag in _BLOCK:
                flush()
            if tag in _CLOSES_P and (i := innermost(("p",))) and innermost(_KEEPS_P) < i:
                pop_to(i)
            if tag in _OWN_KIND:
                own, bound = _OWN_KIND[tag]
                while (i := innermost(own)) and i > innermost(bound):
                    pop_to(i)
            if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
                continue
            if tag == "body" and (i := innermost(("head",))):
                pop_to(i)
            kind, sign = _what(tag, m[3])
            if tag not in _BLOCK and kind == _PLAIN:
                sign = ""
            e, over = len(self.tag), stack[-1]
            self.tag.append(tag)
            self.parent.append(over)
            self.kind.append(kind)
            self.look.append(0)
            self.first.append(len(self.blocks))
            self.end.append(-1)
            if sign:
                s = _sign_hash(sign)
                self.look[over] = (self.look[over] * _BASE + s) % _P
                self.path.append((self.path[over] * _BASE_INV + s) % _P)
            else:
                self.path.append(self.path[over])
            at_tag.setdefault(tag, []).append(len(stack))
            stack.append(e)
            if tag in _BLOCK:
                block_of.append(e)
        flush()

    def _around(self) -> None:
        """Elements that hold the article (or most of the text), and those inside one."""
        n = len(self.tag)
        self.inside, barred = [False] * n, [False] * n
        self.holds = [False] * n
        mains = []
        for e in range(1, n):
            p = self.parent[e]
            barred[e] = barred[p] or self.kind[e] in (_FIXED, _READERS)
            self.inside[e] = self.inside[p]
            if self.tag[e] in _MAIN and not barred[e]:
                mains.append(e)
                self.inside[e] = True
        for e in mains:
            while e > 0 and not self.holds[e]:
                self.holds[e] = True
                e = self.parent[e]
        upto = [0]
        for t in self.texts:
            upto.append(upto[-1] + len(t))
        if not mains:
            for e in range(1, n):
                self.holds[e] = not barred[e] and 2 * (upto[self.end[e]] - upto[self.first[e]]) > upto[-1]
        #: the outermost article, or the innermost element around most of the text
        self.main = min(mains) if mains else max((e for e in range(n) if self.holds[e]), default=0)

    def branches(self) -> tuple[int, dict[int, tuple[int, int, bool]]]:
        """Hash of the main text, and by the path of each branch that is judged: its presentation, its content, whether it stands inside the article only."""
        hashes = [_hash(t.replace(self.own, "\0") if self.own else t) for t in self.texts]  # the host's own name is no content
        upto, power = [0], 1
        for h in hashes:
            upto.append((upto[-1] + h * power) % _P)
            power = power * _BASE % _P
        content = lambda e: (upto[self.end[e]] - upto[self.first[e]]) * pow(_BASE_INV, self.first[e], _P) % _P
        found: dict[int, tuple[int, int, bool]] = {}
        for e in range(1, len(self.tag)):
            if self.tag[e] in _CONTAINER and not self.holds[e] and self.end[e] > self.first[e]:
                look, said, inside = found.get(self.path[e], (0, 0, True))
                found[self.path[e]] = (look * _BASE + self.look[e] + 1) % _P, (said * _BASE + content(e) + 1) % _P, inside and self.inside[e]
        return content(self.main), found

    def text(self, low: dict[int, bool] | None = None, names: bool = True) -> str:
        """The text without the branches of ``low`` (path: whether it may go from inside an article too) and, if ``names``, those named."""
        gone = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            k = self.kind[e]
            named = k == _READERS or k in (_FIXED, _NAMED) and not self.holds[e] if names else self.tag[e] == "head"
            fixed = low.get(self.path[e]) if low and self.tag[e] in _CONTAINER and not self.holds[e] else None
            gone[e] = gone[self.parent[e]] or named or fixed is True or fixed is False and not self.inside[e]
        out = []
        for (e, pieces), text in zip(self.blocks, self.texts, strict=True):
            if gone[e]:
                continue
            if any(gone[x] for _, x in pieces):
                text = self._text([(t, x) for t, x in pieces if not gone[x]])
            if text:
                out.append(text)
        return "\n\n".join(out)


def text_of(page: str | None, low: dict[int, bool] | None = None, names: bool = True) -> str:
    return Page(page).text(low, names)


def domain_of(host):
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.[^.]*)$|^([^.]*)$", 0)


def style_tree(pages: DataFrame) -> DataFrame:
    """(site, path, n_pages, importance, common) of the branches of each host's merged tree and of each domain's.

    Importance is a weighted mean of the normalised entropies of the presentations and of the
    contents that a branch has on the site's pages; n_pages are those with different main texts;
    common is the share of the content that most of a host's pages have (null for a domain).
    """

    def emit(batches):
        for b in batches:
            rows = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                main, found = Page(page, host).branches()
                rows += [(host, path, look, said, main) for path, (look, said, _) in found.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "look", "said", "page"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(emit, "host string, path bigint, look bigint, said bigint, page bigint").distinct()
    both = seen.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("look").alias("v")), F.struct(F.lit(1).alias("side"), F.col("said").alias("v")))).alias("x"))
    by_host = stash(both.groupBy("host", "path", "x.side", "x.v").agg(F.count("*").alias("n")), "contents")
    by_domain = by_host.withColumn("site", domain_of(F.col("host"))).where("site <> host").groupBy("site", "path", "side", "v").agg(F.sum("n").alias("n"))
    counts = by_host.select(F.col("host").alias("site"), "path", "side", "v", "n", F.lit(True).alias("own")).unionByName(by_domain.withColumn("own", F.lit(False)))
    by_side = counts.groupBy("site", "path", "own", "side").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("n").alias("top"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    weight = F.when(F.col("side") == 0, PRESENTATION).otherwise(1 - PRESENTATION)
    common = F.max(F.when((F.col("side") == 1) & F.col("own"), F.col("top") / F.col("m")))
    return by_side.groupBy("site", "path", "own").agg(F.max("m").alias("n_pages"), F.sum(weight * entropy).alias("importance"), common.alias("common")).drop("own")


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html); ``names`` false leaves all but the head to the style tree."""
    low = style_tree(pages).where((F.col("n_pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    low = stash(low.groupBy("site", "path").agg(F.coalesce(F.max(F.col("common") > 0.5), F.lit(False)).alias("fixed")), "low")
    kind = pages.schema["page_id"].dataType.simpleString()
    src = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    n = low.count()
    for name, site in (("low_host", F.col("host")), ("low_domain", domain_of(F.col("host")))):
        if n:
            paths = low.groupBy("site").agg(F.collect_list(F.struct("path", "fixed")).alias(name))  # paths of a template, not of pages
            src = src.withColumn("site", site).join(F.broadcast(paths) if n <= BROADCAST_BRANCHES else paths, "site", "left").drop("site")
        else:
            src = src.withColumn(name, F.lit(None).cast("array<struct<path:bigint,fixed:boolean>>"))

    def run(batches):
        for b in batches:
            texts = []
            for page, *low in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                paths: dict[int, bool] = {}
                for x in (x for part in low for x in part or ()):
                    paths[x["path"]] = paths.get(x["path"], False) or x["fixed"]
                texts.append(text_of(page, paths, names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.select("page_id", "url", "html", "low_host", "low_domain").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
