"""URL filters with redirect equivalence: block decisions reach every alias of a page.

Pages are judged by host and path rules.  Canonical links and refresh redirects (and any table of further redirects)
make URLs equivalent; connected components carry the decision of a ruled member to members without a rule of their
own.  An explicit allow, on the URL itself or on any alias of it, goes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import computed_once
from siftline.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (decision, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
#: A character reference goes on past its semicolon.
TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>;&]*(?:&(?:#?[a-z0-9]+;)?[^"'\s>;&]*)*)"""
NAMED = (("amp;", "&"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("apos;", "'"))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def key(url: Column) -> Column:
    """What equivalent spellings share: host, path and query, without scheme and fragment; null without a host."""
    made = F.concat(host(url), F.regexp_extract(url, PARTS, 2), F.regexp_extract(url, PARTS, 3))
    return F.when(host(url) != "", made)


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """``struct(rule, decision)`` of the longest rule that fits (allow before block at equal length), else null."""
    found = F.lit(None).cast("struct<rule: string, decision: string>")
    for decision, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):  # the last one tested wins
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(decision).alias("decision"))).otherwise(found)
    return found


def unescape(text: Column) -> Column:
    """The named references of NAMED and numeric ones, decoded once; others stay."""

    def number(part, pattern, base):
        digits = F.regexp_extract(part, pattern, 1)
        code = F.conv(digits, base, 10).cast("long")
        valid = (digits != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(made, F.regexp_replace(part, pattern, "")))

    def one(part, i):
        named = [F.when(part.startswith(n), F.concat(F.lit(c), F.substring(part, F.lit(len(n) + 1), F.length(part)))) for n, c in NAMED]
        numbers = [number(part, "^#0*([0-9]{1,7});", 10), number(part, "^#[xX]0*([0-9A-Fa-f]{1,6});", 16)]
        return F.when(i == 0, part).otherwise(F.coalesce(*named, *numbers, F.concat(F.lit("&"), part)))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def remove_dots(url: Column) -> Column:
    """An absolute URL without ``.`` and ``..`` segments in its path."""
    segments = F.split(path(url), "/")
    keep = lambda s, x: (
        F.when(x == ".", s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.lit(1), F.size(s) - 1))).otherwise(F.concat(s, F.array(x)))
    )
    kept = F.aggregate(segments, F.array().cast("array<string>"), keep)
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    cleaned = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.array_join(ended, "/"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(path(url).rlike(r"/\.\.?(/|$)"), cleaned).otherwise(url)


def absolute(base: Column, link: Column) -> Column:
    """An absolute URL for a link found on a page, with the segments of the link as they are."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path(base), link))
        .when(link.startswith("#"), F.concat(site, path(base), F.regexp_extract(base, PARTS, 3), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: keys of a page and of its canonical link or refresh target, where they differ."""
    html = F.col(html_col)
    found = F.array(
        F.when(html.rlike("(?i)canonical"), F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1)),
        F.when(html.rlike("(?i)http-equiv"), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1)),
    )
    tagged = pages.select(F.col(url_col).alias("url"), F.explode(F.filter(found, lambda x: x != "")).alias("link"))
    # each step is a column of its own; as one expression, every use of a link would repeat the steps before it
    steps = computed_once(tagged, ["url"], [unescape(F.col("link")).alias("link")])
    steps = computed_once(steps, ["url"], [absolute(F.col("url"), F.col("link")).alias("target")])
    steps = computed_once(steps, ["url"], [remove_dots(F.col("target")).alias("target")])
    return computed_once(steps, [], [key(F.col("url")).alias("a"), key(F.col("target")).alias("b")]).where("a <> b")


def judge(
    pages: DataFrame,
    rules=RULES,
    redirects: DataFrame | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``redirects(source, target)`` adds edges.

    A null URL, or one without ``://``, has an empty host and path, no rule and no aliases, and is allowed.  A null html
    has no links.  Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b")).where("a <> b"))
    roots = components(edges.select("a", "b"))
    node_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = roots.select("node", "root", rule(host(node_url), path(node_url), rules)["decision"].alias("decision"))
    blocked = ruled.groupBy("root").agg(F.bool_or(F.col("decision") == "block").alias("b"), F.bool_or(F.col("decision") == "allow").alias("a"))
    aliases = roots.join(blocked.where("b AND NOT coalesce(a, false)"), "root").select(F.col("node").alias("_key"), F.lit("block").alias("_passed"))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url"))
    marked = computed_once(named, ["page_id"], [host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), key(F.col("_url")).alias("_key")])
    judged = marked.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).join(aliases, "_key", "left")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.decision", "_passed", F.lit("allow")).alias("verdict")
    )
