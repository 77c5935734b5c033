"""Catalogs: links in pages, pools against local lists, and what a pipeline includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r'<a href="([^"]*)"[^>]*>([^<]*)'


def links(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(keep, url, name) of every link."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("name"))
    return pages.select(*keep, F.explode(both).alias("link")).select(*keep, F.col("link.url").alias("url"), F.col("link.name").alias("name"))


def first_link(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(keep, url) of each page's first link, if it has one."""
    url = F.regexp_extract(html, LINK, 1)
    return pages.where(F.col(html).rlike(LINK)).select(*keep, url.alias("url"))


def row_links(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(keep, url, name) of the links in table rows only."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return links(pages.select(*keep, F.explode(rows).alias("__row")), keep, "__row")


def crawl(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, url2, name): links of the pages that a page links to."""
    level = links(pages, [url], html) if url != "url" else links(pages.withColumnRenamed("url", "page"), ["page"], html)
    one = level.select(F.col(level.columns[0]).alias("site"), F.col("url").alias("middle"))
    two = level.select(F.col(level.columns[0]).alias("middle"), "url", "name")
    return one.join(two, "middle").select("site", "middle", "url", "name")


def crawl_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(site, n): how many rows ``crawl`` has for each page that has any.  Equal links are counted before
    links meet pages, so no pair of links becomes a row."""
    found = links(pages.select(F.col(url).alias("site"), F.col(html).alias("__html")), ["site"], "__html")
    one = found.groupBy("site", "url").agg(F.count(F.lit(1)).alias("times"))
    two = one.groupBy(F.col("site").alias("url")).agg(F.sum("times").alias("far"))
    return one.join(two, "url").groupBy("site").agg(F.sum(F.col("times") * F.col("far")).alias("n"))


def requested(found: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """What was found of what is wanted."""
    return found.join(wanted, on, "left_semi")


def link_counts(found: DataFrame, by: str, url: str = "url") -> DataFrame:
    """(by, n_links, n_urls)."""
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct(url).alias("n_urls"))


def only_local(name: Column) -> Column:
    """Whether a name is a tool's own file rather than a plugin's: hidden, a readme, a script or notes."""
    return name.startswith(".") | (name == "README") | name.endswith(".py") | name.endswith(".txt")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def closure(starts: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node): all that is reached from the starts along edges (src, dst); cycles end.

    A round joins the newest nodes only and drops those seen before; each round's nodes are
    checkpointed once, and what was seen is the union of these.  It stops when a round finds nothing
    new.
    """
    from millrace.plans.session import checkpointed

    seen = fresh = checkpointed(starts.select(F.col(starts.columns[0]).alias("node")).distinct())
    for _ in range(rounds):
        fresh = checkpointed(fresh.join(edges, fresh.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise ValueError(f"includes reach deeper than {rounds} levels")
