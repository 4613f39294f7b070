"""Url rules whose block decisions reach the aliases of a page (DataFrame functions only).

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and the default
verdict; null or empty html adds no edge; repeated rows each get their row; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``pattern`` is a host with a path prefix, such as ``example.net/en/``."""

    verdict: str
    pattern: str


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query: urls that differ in scheme or fragment only are one node."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(pattern, verdict) of the longest rule that fits; of equally long ones an allow rule."""
    out = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "allow")):
        name, _, prefix = r.pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _numbers_decoded(href: Column, digits: str, head: str, value) -> Column:
    """``head`` and digits and a semicolon as the character of that number, if it is one of ASCII."""

    def one(text: Column, n: Column) -> Column:
        return F.when(value(n) < 128, F.replace(F.replace(text, F.concat(F.lit(head), n, F.lit(";")), F.char(value(n))), F.concat(F.lit(head.upper()), n, F.lit(";")), F.char(value(n)))).otherwise(text)

    return F.when(href.contains("&#"), F.aggregate(F.array_distinct(F.regexp_extract_all(href, F.lit(f"(?i){head}({digits});"), 1)), href, one)).otherwise(href)


def decoded(href: Column) -> Column:
    """Character references that a url may hold: numbers of ASCII, and the five of markup."""
    href = _numbers_decoded(href, "[0-9]{1,7}", "&#", lambda n: n.cast("int"))
    href = _numbers_decoded(href, "[0-9a-f]{1,6}", "&#x", lambda n: F.conv(n, 16, 10).cast("int"))
    for name, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        href = F.replace(href, F.lit(name), F.lit(char))
    return href


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments of an absolute path resolved."""
    parts = F.split(path, "/", -1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    done = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    done = F.when(path.rlike(r"/\.\.?$") & ~done.endswith("/"), F.concat(done, F.lit("/"))).otherwise(done)
    return F.when(path.rlike(r"/\.\.?(/|$)"), done).otherwise(path)


def resolve(href: Column, url: Column) -> Column:
    """An absolute form of ``href`` as found on the page ``url``."""
    href = F.btrim(href)
    base, here = F.concat(F.lit("x://"), host_of(url)), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    folder = F.regexp_replace(here, r"[^/]*$", "")
    path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 2)
    whole = F.when(href.startswith("//"), F.concat(F.lit("x:"), href)).otherwise(href)
    after = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    return (
        F.when(whole.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(F.lit("x://"), host_of(whole), _without_dots(path_of(whole)), after))
        .when(href.startswith("/"), F.concat(base, _without_dots(path), rest))
        .when(path == "", F.when(rest.startswith("?"), F.concat(base, here, rest)).otherwise(url))
        .otherwise(F.concat(base, _without_dots(F.concat(folder, path)), rest))
    )


_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, rf"""(?i)[\s"']{name}{_VALUE}""", i) for i in (1, 2, 3)])


def page_edges(pages: DataFrame) -> DataFrame:
    """(u, v): node of a page and nodes of its canonical links and its meta refresh targets."""
    lower = F.lower("html")
    found = pages.where("url IS NOT NULL").where(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh")))
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), 0)
    found = found.select("url", F.explode(tags).alias("tag"))
    link = F.when(_attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)\burl\s*=\s*["']?([^"']*)""", 1))
    found = found.select("url", decoded(F.coalesce(link, refresh)).alias("href")).where("btrim(href) <> ''")
    return found.select(node_of(F.col("url")).alias("u"), node_of(resolve(F.col("href"), F.col("url"))).alias("v")).where("u <> v").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    Redirects (``from_url``, ``to_url``; optional) and the canonical links and refresh targets found
    in html are edges of a graph of urls. A page without a rule of its own takes the verdict of its
    component: allow if any url of it is allowed by a rule, else block if any is blocked, else
    ``default``. ``rules`` is a short list of literals; it becomes one expression.
    """
    src = pages.select("page_id", "url", "html")
    edges = page_edges(src)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    comp = connected_components(edges)
    # a node is host, path and query, so its rule can be read off it
    as_url = F.concat(F.lit("x://"), F.col("node"))
    judged = comp.withColumn("r", rule_of(host_of(as_url), path_of(as_url), rules))
    allows, blocks = F.max(F.col("r.verdict") == "allow"), F.max(F.col("r.verdict") == "block")
    decided = judged.groupBy("component").agg(F.when(allows, "allow").when(blocks, "block").alias("alias_verdict")).where("alias_verdict IS NOT NULL")
    by_node = stash(comp.join(decided, "component").select("node", "alias_verdict"), "alias")
    url = F.col("url")
    out = src.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    out = out.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.col("alias_verdict"), F.lit(default)).alias("verdict")
    return out.join(by_node, "node", "left").select("page_id", "host", "path", F.col("r.pattern").alias("rule"), verdict)
