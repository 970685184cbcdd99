"""URL filters with redirect equivalence, with DataFrame functions alone.

Rules name a host (and all its subdomains) and the beginning of a path; the longest rule
that fits decides. Pages without a rule take over a block from their aliases: URLs joined
by redirects and canonical links are one class (a connected component), and a class in
which a URL is blocked by a rule is blocked, except for the URLs a rule allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.components import components
from defectscope.session import written

# (verdict, host, path)
Rule = tuple[str, str, str]
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def fitting(host: Column, path: Column, rules: Sequence[Rule], of: int | None = None) -> Column:
    """The longest rule that fits, as text (host and path), or its verdict with of=0; else null.

    Of rules of one length an allowing one goes first.
    """
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == ALLOW)):
        fits = ((host == rule[1]) | F.endswith(host, F.lit(f".{rule[1]}"))) & F.startswith(path, F.lit(rule[2]))
        chosen = F.when(fits, F.lit(rule[0] if of == 0 else rule[1] + rule[2])).otherwise(chosen)
    return chosen


def alias_key(url: Column) -> Column:
    """The form under which a URL is one node: lower-case scheme and host, no fragment; null without ://."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host(url), rest))


def resolved(target: Column, base: Column) -> Column:
    """An absolute URL for a link found on the page `base`."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (F.when(target == "", F.lit(None)).when(F.contains(target, F.lit("://")), target)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(site, target))
            .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), target)))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): alias keys joined by canonical links and refreshing redirects inside the pages."""
    html, url = F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.col(url_col).cast("string")
    targets = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 0), REFRESH_URL, 1))
    # Most pages have neither tag; a plain search is cheaper than the patterns.
    may = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("http-equiv"))
    found = pages.where(may & F.contains(url, F.lit("://"))).select(url.alias("url"), F.explode(targets).alias("target"))
    return found.select(alias_key(F.col("url")).alias("a"), alias_key(resolved(F.col("target"), F.col("url"))).alias("b"))


def judge(pages: DataFrame, rules: Sequence[Rule], *, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, class_blocked) of every row of `pages`.

    `redirects` may add (from_url, to_url) pairs of a crawl's redirect log. A URL without
    :// or a null one has an empty host and path and no alias, so it is allowed unless a
    rule with an empty host fits. A rule's own verdict always stands; without one, a page is
    blocked if any URL of its class is blocked by a rule, else allowed. Ids may be null or
    repeat, other columns are ignored, and empty tables give empty results. The rules are
    few enough to be written into the plan.
    """
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(alias_key(F.col("from_url")), alias_key(F.col("to_url"))))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), alias_key(url).alias("key"))
    rows = rows.select("page_id", "host", "path", "key", fitting(F.col("host"), F.col("path"), rules).alias("rule"),
                       fitting(F.col("host"), F.col("path"), rules, 0).alias("own"))
    classes = written(components(edges, "a", "b"), "classes")
    blocked = fitting(host(F.col("node")), path(F.col("node")), rules, 0) == BLOCK
    bad = classes.groupBy("component").agg(F.max(F.coalesce(blocked, F.lit(False))).alias("class_blocked")).where("class_blocked")
    bad = classes.join(bad, "component").select(F.col("node").alias("key"), "class_blocked")
    return rows.join(bad, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("class_blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"),
        F.coalesce("class_blocked", F.lit(False)).alias("class_blocked"))


def oracle(rules: Sequence[Rule]) -> str:
    """The same verdicts for the pages in DuckDB, for tables whose pages hold no alias links."""
    best = "NULL"
    verdict = "NULL"
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == ALLOW)):
        fits = f"(host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}')"
        best = f"CASE WHEN {fits} THEN '{rule[1]}{rule[2]}' ELSE {best} END"
        verdict = f"CASE WHEN {fits} THEN '{rule[0]}' ELSE {verdict} END"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)
SELECT page_id, host, path, {best} AS rule, coalesce({verdict}, 'allow') AS verdict FROM p
"""
