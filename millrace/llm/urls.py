"""URL filters: host-suffix and path-prefix expressions, matched by an equi-join on hash prefixes.

Each URL expands into (host suffix, path prefix) expressions; only path lengths that some rule
has, and suffixes of no more labels than the deepest rule's, are made.  Expressions and rules meet on the first 32 bits of the SHA-256 of the expression,
the full digest confirms the match, and of a URL's matches the longest rule wins (then block
before allow, then the rule's text).

Null URLs and those without ``://`` have an empty host and path and match no rule.  Repeated rows
give repeated results; other columns of the input are not read.  An empty rules table leaves every
URL to the default verdict, and so an empty table of pages gives an empty result.  Very long URLs
give no more expressions than the rules' depth and path lengths allow.  The rules are broadcast only if a count shows that they are few;
beyond that the join shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 200_000  #: rules, of some 100 bytes each
DEFAULT = "allow"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host_: Column, path_: Column) -> Column:
    """SHA-256 of an expression; a NUL keeps host and path apart."""
    return F.sha2(F.concat(host_, F.lit("\0"), path_), 256)


def short(digest_: Column) -> Column:
    """The first 32 bits of a digest, as a number."""
    return F.conv(F.substring(digest_, 1, 8), 16, 10).cast("long")


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests."""
    full = digest(F.col("host"), F.col("path"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of two verdicts block
    return rules.select(short(full).alias("__short"), full.alias("__full"), F.length("path").alias("__length"), F.concat("host", "path").alias("__rule"), F.col("verdict").alias("__verdict"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule and verdict of each row of pages.

    Equal (key, url) rows are judged once and given back as often as they occurred: each row counts
    itself in its first expression, so the grouping needs no row number and moves a URL once, after
    the matches of a row were folded on the map side.
    """
    table = compiled(rules)
    # path lengths: no more than the longest path has characters; labels: no rule has more
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("deepest")).first()
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    rows = rows.select("*", host(F.col("__url")).alias("__host"), path(F.col("__url")).alias("__path"))
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - facts.deepest + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in facts.lengths]).cast("array<int>"), lambda n: n <= F.length("__path"))
    first = (F.coalesce(F.col("__i"), F.lit(0)) == 0) & (F.coalesce(F.col("__j"), F.lit(0)) == 0)
    expressions = (
        rows.select("*", F.posexplode_outer(F.when(F.col("__host") != "", suffixes)).alias("__i", "__suffix"))
        .select("*", F.posexplode_outer(F.transform(fitting, lambda n: F.substr(F.col("__path"), F.lit(1), n))).alias("__j", "__prefix"))
        .withColumn("__digest", digest(F.col("__suffix"), F.col("__prefix")))
        .select("__key", "__url", "__host", "__path", first.alias("__first"), "__digest", short(F.col("__digest")).alias("__s"))
    )
    table = F.broadcast(table) if facts.n <= BROADCAST_RULES else table
    met = expressions.join(table, (F.col("__s") == F.col("__short")) & (F.col("__digest") == F.col("__full")), "left")
    best = F.max(F.when(F.col("__rule").isNotNull(), F.struct(F.length("__rule").alias("n"), F.col("__verdict").alias("verdict"), F.col("__rule").alias("rule"))))
    out = met.groupBy("__key", "__url", "__host", "__path").agg(best.alias("__best"), F.count_if("__first").alias("__times"))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select(F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
