"""Queries over the standard tables, by name, and the SQL that says the same.

Each applies one operator of this library.  Events stand for the lines of configs (one config a
user, in order of event_id; the event type is the keyword), pages for catalog pages, and the
star tables for tasks, registries and requirements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import catalog, golden, hazards, registry, requirements, scope
from millrace.plans import pipeline
from millrace.sources import files
from millrace.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FLAGSHIP = """\
# lines of each order
Prefix work
Plugin ScanTable inputfile {d}/lineitem.parquet outputfile lines
Plugin GroupCount inputfile lines outputfile sizes
"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline text, parsed, checked, composed: one DataFrame for its last output."""
    plan = pipeline.compose(spark, FLAGSHIP.format(d=sf_dir))
    return next(iter(plan.sinks().values()))


# Scalars and projections


@query(r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents")
def text_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(T.blank_if_null(F.col("text")))).cast("long").alias("n_tokens"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS v, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM (SELECT doc_id, regexp_replace(text, '\r?\n$', '') AS text FROM documents))
SELECT doc_id, count(*)::BIGINT AS n_lines FROM (SELECT doc_id, regexp_replace(v, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS v FROM l) WHERE v <> '' AND NOT starts_with(v, '#') GROUP BY doc_id""")
def comment_filter(spark, sf_dir):
    whole = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value"))
    return scope.directives(files.split_lines(whole)).groupBy(F.col("file").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 6 THEN NULL WHEN 5 THEN NULL ELSE p_size::BIGINT * CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1099511627776 END END AS bytes FROM part""")
def parse_size(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", "k", "M", "g", "T", "x", "-1G")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.size_in_bytes(F.concat(F.col("p_size").cast("string"), suffix)).alias("bytes"))


@query("""
SELECT p_partkey, p_type AS name, CASE WHEN p_partkey % 3 = 0 THEN '/' || p_brand ELSE 'in/' || p_brand END AS inputfile, 'in/out' || p_partkey AS outputfile,
  p_size * 1048576::BIGINT AS memory_hint, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::INTEGER AS gpu_hint FROM part""")
def task_hints(spark, sf_dir):
    line = F.concat(
        F.lit("Plugin "), "p_type", F.lit(" inputfile "), F.when(F.col("p_partkey") % 3 == 0, "/").otherwise(""), "p_brand", F.lit("  outputfile out"), F.col("p_partkey").cast("string"),
        F.lit(" memory="), F.col("p_size").cast("string"), F.lit("M gpu="), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("many"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", scope.task(T.tokens(line), F.lit("in/")).alias("t")).select("p_partkey", "t.*")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END::INTEGER AS workers, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 1024::BIGINT END AS memory, 0::INTEGER AS gpu, CASE WHEN p_size % 2 = 0 THEN 'continue' ELSE 'fast' END AS fail_mode FROM part""")
def block_options(spark, sf_dir):
    line = F.concat(
        F.lit("Parallel workers="), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("p_size").cast("string")), F.lit(" memory="), F.col("p_size").cast("string"),
        F.when(F.col("p_partkey") % 5 == 0, "Q").otherwise("K"), F.lit(" other=1 fail="), F.when(F.col("p_size") % 2 == 0, "continue").otherwise("slow"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", scope.block_options(T.tokens(line)).alias("o")).select("p_partkey", "o.*")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 3 = 0 THEN '/' || page_id ELSE 'pool/' || page_id END AS path FROM pages")
def resolve_path(spark, sf_dir):
    name = F.when(F.col("page_id") % 2 == 0, F.col("url")).when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", T.resolve_path(name, F.lit("pool/")).alias("path"))


@query("SELECT p_partkey, lower(regexp_replace(p_name || '_.' || p_brand, '[-_.]+', '-', 'g')) AS pkg FROM part")
def normalize_name(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.package_name(F.concat("p_name", F.lit("_."), "p_brand")).alias("pkg"))


@query("SELECT p_partkey, p_type AS name FROM part WHERE p_partkey % 2 = 0")
def plugin_names(spark, sf_dir):
    ending = F.when(F.col("p_partkey") % 2 == 0, "Plugin.so").otherwise("Helper.so")
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("plugins/"), "p_brand", F.lit("/lib"), "p_type", ending).alias("path"))
    return part.select("p_partkey", T.step_name(F.col("path")).alias("name")).where("name IS NOT NULL")


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, ': ([0-9]+)', 1), '') AS DOUBLE) IS NOT NULL AS numeric, value <> round(value, 1) AND abs(value - round(value, 1)) > 1e-8 AS differs FROM events")
def numeric_tokens(spark, sf_dir):
    token = F.regexp_extract("props", ": ([0-9]+)", 1)
    return read(spark, sf_dir, "events").select("event_id", T.is_number(token).alias("numeric"), T.differs(F.col("value").cast("string"), F.round("value", 1).cast("string")).alias("differs"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_totalprice::BIGINT ELSE (o_totalprice::BIGINT // (o_custkey % 5)) END AS share FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def default_share(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", hazards.default_share(F.floor("o_totalprice").cast("long"), (F.col("o_custkey") % 5).cast("int")).alias("share"))


@query("SELECT doc_id, split_part(coalesce(text, ''), '#', 1) AS body FROM documents")
def strip_comments(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.without_comment(T.blank_if_null(F.col("text"))).alias("body"))


# Scopes


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS current FROM events")
def prefix_scope(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return scope.carried(events, F.when(F.col("event_type") == "signup", F.col("value")), "user_id", "event_id", "current").select("event_id", "user_id", "current")


@query("""
WITH k AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'P' WHEN 'click' THEN 'K' ELSE 'X' END AS w FROM events),
s AS (SELECT *, count(CASE WHEN w = 'P' THEN 1 END) OVER o AS g, last_value(CASE WHEN w = 'P' THEN 'p' || event_id || '/' END IGNORE NULLS) OVER o AS own FROM k WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, last_value(CASE WHEN w = 'K' THEN 'k' || event_id || '/' END IGNORE NULLS) OVER i AS child, string_agg(CASE WHEN w = 'K' THEN 'k' || event_id || '/' END, '') OVER i AS nested FROM s WINDOW i AS (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, CASE WHEN g > 0 THEN own || coalesce(child, '') ELSE coalesce(nested, '') END AS prefix FROM t""")
def kitty_scope(spark, sf_dir):
    word = F.when(F.col("event_type") == "signup", "Prefix").when(F.col("event_type") == "click", "Kitty").otherwise("Plugin")
    small = F.when(F.col("event_type") == "signup", "p").otherwise("k")
    lines = read(spark, sf_dir, "events").select("event_id", "user_id", word.alias("keyword"), F.array(word, F.concat(small, F.col("event_id").cast("string"))).alias("tokens"))
    return scope.prefix_scope(lines, "user_id", "event_id").select("event_id", "user_id", "prefix")


@query("""
WITH b AS (SELECT event_id, user_id, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER o AS block, last_value(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER o AS mark FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, block::BIGINT AS block, coalesce(mark, 0) = 1 AS inside FROM b""")
def block_membership(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = F.col("event_type")
    return scope.block_membership(events, kind == "signup", kind == "purchase", "user_id", "event_id").select("event_id", "user_id", "block", "inside")


@query("""
WITH b AS (SELECT event_id, user_id, event_type, last_value(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER o AS mark FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, coalesce(lag(mark) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS was, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM b)
SELECT user_id, event_id AS line, 'Parallel blocks cannot nest' AS message FROM c WHERE event_type = 'signup' AND was = 1
UNION ALL SELECT user_id, event_id, 'EndParallel without Parallel' FROM c WHERE event_type = 'purchase' AND was = 0
UNION ALL SELECT user_id, event_id, 'Prefix is not allowed inside a Parallel block' FROM c WHERE event_type = 'error' AND was = 1
UNION ALL SELECT user_id, event_id, 'unknown word Other' FROM c WHERE event_type = 'view'
UNION ALL SELECT user_id, event_id, 'Parallel without EndParallel' FROM c WHERE k = 1 AND coalesce(mark, 0) = 1""")
def structure_errors(spark, sf_dir):
    words = {"signup": "Parallel", "purchase": "EndParallel", "error": "Prefix", "click": "Plugin", "view": "Other"}
    word = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col("event_type")]
    return scope.structure_errors(read(spark, sf_dir, "events").select("user_id", "event_id", word.alias("keyword")), "user_id", "event_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM events) WHERE r = 1")
def restart_filter(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return scope.after_restart(events, F.col("event_type") == "purchase", "user_id", "event_id")


# Registries and joins


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def registry_last_wins(spark, sf_dir):
    return registry.last_wins(read(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("event_id"))


@query("SELECT event_type, user_id, arg_min(value, event_id) AS value FROM events GROUP BY event_type, user_id")
def path_first_wins(spark, sf_dir):
    return registry.first_wins(read(spark, sf_dir, "events"), ["event_type", "user_id"], "value", F.col("event_id"))


@query("SELECT s_suppkey, s_nationkey, coalesce(n_name, 'no suitable language') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def dispatch_left_join(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return registry.dispatched(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nation, "s_nationkey", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def dependency_missing(spark, sf_dir):
    return registry.missing(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def dependency_met(spark, sf_dir):
    return registry.met(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT p_type AS name, 'so' AS extension, 'plugins/' || p_type || '/lib' || p_type || 'Plugin.so' AS path FROM part WHERE p_partkey % 2 = 0")
def plugin_discovery(spark, sf_dir):
    mark = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("lib"), "p_type", F.lit("Plugin.so"))).otherwise("__init__Plugin.py")
    return registry.plugin_files(read(spark, sf_dir, "part").select(F.concat(F.lit("plugins/"), "p_type", F.lit("/"), mark).alias("path")))


# Hazards and resources


@query("SELECT user_id, value, first, event_id AS second FROM (SELECT user_id, value, event_id, lag(event_id) OVER (PARTITION BY user_id, value ORDER BY event_id) AS first FROM events) WHERE first IS NOT NULL")
def output_collision(spark, sf_dir):
    return hazards.output_collisions(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("user_id", "value", "first", "second")


@query("""
WITH w AS (SELECT o_custkey, o_orderpriority AS path, min(o_orderkey) AS a, max(o_orderkey) AS z, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 3 GROUP BY ALL),
r AS (SELECT o_custkey, o_orderpriority AS path, o_orderkey AS reader, (o_orderkey % 7 <> 3)::INT AS own FROM orders WHERE o_orderkey % 7 < 4)
SELECT o_custkey, path, reader, CASE WHEN a <> reader THEN a ELSE z END AS writer, (n - own)::BIGINT AS n_writers FROM r JOIN w USING (o_custkey, path) WHERE n - own > 0""")
def read_after_write(spark, sf_dir):
    """Orders as tasks: some only read, some only write, some do both."""
    key = F.col("o_orderkey") % 7
    tasks = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(key < 4, F.col("o_orderpriority")).alias("inp"), F.when(key != 3, F.col("o_orderpriority")).alias("out"))
    return hazards.read_after_write(tasks, ["o_custkey"], "o_orderkey", "inp", "out")


@query("SELECT p_partkey FROM part WHERE p_size > p_partkey % 60 AND p_partkey % 60 > 0 OR p_partkey % 9 > 6")
def never_fits(spark, sf_dir):
    """Parts as tasks: their size is the memory, which some blocks have less of; GPUs are short in some."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("memory"), (F.col("p_partkey") % 9).alias("gpu"))
    return hazards.never_fits(part, {"memory": F.col("p_partkey") % 60, "gpu": F.lit(6)}).select("p_partkey")


@query("SELECT event_id, user_id, sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events")
def running_usage(spark, sf_dir):
    delta = F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(-1)
    return hazards.running_usage(read(spark, sf_dir, "events"), ["user_id"], "event_id", delta).select("event_id", "user_id", "used")


@query("SELECT user_id, max(used)::BIGINT AS peak FROM (SELECT user_id, sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM events) GROUP BY user_id")
def peak_usage(spark, sf_dir):
    return running_usage(spark, sf_dir).groupBy("user_id").agg(F.max("used").alias("peak"))


@query("SELECT l_returnflag, count(*) FILTER (l_linenumber % 3 = 0)::BIGINT AS completed, count(*) FILTER (l_linenumber % 3 <> 0)::BIGINT AS failed FROM lineitem GROUP BY l_returnflag")
def result_partition(spark, sf_dir):
    return hazards.outcomes(read(spark, sf_dir, "lineitem").withColumn("code", F.col("l_linenumber") % 3), ["l_returnflag"], "code")


@query("SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS seconds FROM events GROUP BY user_id")
def wall_time(spark, sf_dir):
    return hazards.wall_time(read(spark, sf_dir, "events"), ["user_id"], "ts", "ts").withColumn("seconds", F.round("seconds", 3))


# Sets and catalogs


def _pools(spark, sf_dir):
    lineitem, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("k")), orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))


_POOLS = "(SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) {} (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')"


@query(f"SELECT k FROM ({_POOLS.format('EXCEPT')})")
def pool_minus_local(spark, sf_dir):
    return catalog.difference(*_pools(spark, sf_dir))


@query("SELECT k FROM ((SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') EXCEPT (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 40))")
def local_minus_pool(spark, sf_dir):
    return catalog.difference(*reversed(_pools(spark, sf_dir)))


@query(f"SELECT k FROM ({_POOLS.format('INTERSECT')})")
def pool_and_local(spark, sf_dir):
    return catalog.common(*_pools(spark, sf_dir))


@query(f"SELECT k FROM ({_POOLS.format('UNION')})")
def pool_union(spark, sf_dir):
    return catalog.either(*_pools(spark, sf_dir))


_LINK = r"""<a href="([^"]*)"[^>]*>([^<]*)"""


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS url, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS name FROM pages")
def html_links(spark, sf_dir):
    return catalog.links(read(spark, sf_dir, "pages"), ["page_id"])


@query(f"SELECT page_id, regexp_extract(html, '{_LINK}', 1) AS url FROM pages WHERE regexp_matches(html, '{_LINK}')")
def html_first_link(spark, sf_dir):
    return catalog.first_link(read(spark, sf_dir, "pages"), ["page_id"])


@query(f"SELECT site, count(*)::BIGINT AS n_links, count(DISTINCT url)::BIGINT AS n_urls FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS site, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS url FROM pages) GROUP BY site")
def site_link_counts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), "html")
    return catalog.link_counts(catalog.links(pages, ["site"]), "site")


@query(f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS url FROM pages),
w AS (SELECT DISTINCT regexp_extract(html, '{_LINK}', 1) AS url FROM pages WHERE regexp_matches(html, '{_LINK}') AND page_id % 5 = 0)
SELECT page_id, count(*)::BIGINT AS n FROM l WHERE url IN (SELECT url FROM w) GROUP BY page_id""")
def requested_links(spark, sf_dir):
    """Links that are asked for: the first ones of some pages."""
    pages = read(spark, sf_dir, "pages")
    wanted = catalog.first_link(pages.where("page_id % 5 = 0"), ["page_id"]).select("url")
    return catalog.requested(catalog.links(pages, ["page_id"]), wanted, "url").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH p AS (SELECT regexp_extract(html, '{_LINK}', 1) AS site, page_id, html FROM pages),
l AS (SELECT page_id, site, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS url FROM p),
o AS (SELECT site, count(*) AS n FROM p GROUP BY site), k AS (SELECT site, url, count(*) AS n FROM l GROUP BY site, url),
t AS (SELECT site AS middle, sum(n) AS n FROM k GROUP BY site)
SELECT k.site, sum(k.n * t.n)::BIGINT AS n FROM k JOIN t ON k.url = t.middle GROUP BY k.site""")
def crawl(spark, sf_dir):
    """Pages named by their first link, so that links meet pages: how many links two steps lead to."""
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("html", catalog.LINK, 1).alias("url"), "html")
    return catalog.crawl_counts(pages)


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_partkey % 6 IN (0, 1, 2, 3))")
def local_exclusion(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = F.element_at(F.array(F.concat(F.lit("."), "p_name"), F.lit("README"), F.concat("p_name", F.lit(".py")), F.concat("p_name", F.lit(".txt")), "p_name", F.concat(F.lit("x"), "p_name")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.where(~catalog.only_local(names))


@query("""
WITH RECURSIVE n AS (SELECT max(c_custkey) + 1 AS n FROM customer),
e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey) % n AS dst FROM orders, n),
r AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r""")
def include_closure(spark, sf_dir):
    """All orders are edges, to targets spread over all customers; one segment's customers are the starts."""
    customer = read(spark, sf_dir, "customer")
    n = customer.agg(F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).first()[0]
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n).alias("dst"))
    return catalog.closure(customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"), edges.distinct())


# Requirements


def _specs(spark, sf_dir):
    """Parts as requirements: the name is the package, the size the version; some are release candidates,
    some have extras or a marker, some lines are unreadable."""
    return requirements.specifiers(requirements.parsed(_requirements(spark, sf_dir), "p_brand"), "p_brand")


def _requirements(spark, sf_dir):
    key = F.col("p_partkey")
    op = F.element_at(F.array(*[F.lit(o) for o in ("==", ">=", "<=", ">", "<")]), (key % 5 + 1).cast("int"))
    version = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.when(key % 4 == 0, "rc1").otherwise(""))
    extras, marker = F.when(key % 3 == 0, "[x,y] ").otherwise(" "), F.when(key % 2 == 0, '; python_version < "3.8"').otherwise("")
    broken = F.when(key % 13 == 0, " ==").otherwise("")
    return read(spark, sf_dir, "part").select("p_brand", key.alias("pos"), F.concat(F.regexp_replace("p_name", " ", "_"), extras, op, version, broken, marker, F.lit(" # note")).alias("value"))


_SPECS = """
s AS (SELECT p_brand, p_partkey AS pos, replace(p_name, ' ', '_') AS name, lower(replace(p_name, ' ', '-')) AS pkg, (['==', '>=', '<=', '>', '<'])[p_partkey % 5 + 1] AS op,
  2 * p_size - (p_partkey % 4 = 0)::INT AS k, '1.' || p_size || CASE WHEN p_partkey % 4 = 0 THEN 'rc1' ELSE '' END AS version FROM part WHERE p_partkey % 13 <> 0)"""


@query(f"WITH {_SPECS} SELECT p_brand, pos, name, pkg, op, version FROM s")
def requirement_specs(spark, sf_dir):
    return _specs(spark, sf_dir)


@query("""
SELECT p_brand, p_partkey AS pos, 'skipping unreadable requirement ' || chr(39) || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '[x,y] ' ELSE ' ' END || (['==', '>=', '<=', '>', '<'])[p_partkey % 5 + 1] || '1.' || p_size
  || CASE WHEN p_partkey % 4 = 0 THEN 'rc1' ELSE '' END || ' ==' || CASE WHEN p_partkey % 2 = 0 THEN '; python_version < "3.8"' ELSE '' END || chr(39) AS message
FROM part WHERE p_partkey % 13 = 0""")
def requirement_warnings(spark, sf_dir):
    return requirements.warnings(_requirements(spark, sf_dir), "p_brand")


@query(f"WITH {_SPECS} SELECT pkg, array_to_string(list_sort(list_distinct(list(version))), ',') AS versions FROM s WHERE op = '==' GROUP BY pkg HAVING count(DISTINCT version) > 1")
def pinned_conflicts(spark, sf_dir):
    return requirements.pinned_conflicts(_specs(spark, sf_dir)).withColumn("versions", F.array_join("versions", ","))


@query(f"WITH {_SPECS}, m AS (SELECT pkg, max(k) FILTER (op IN ('>=', '>', '==')) AS lo, min(k) FILTER (op IN ('<=', '<')) AS hi, arg_max(version, k) FILTER (op IN ('>=', '>', '==')) AS lower, arg_min(version, k) FILTER (op IN ('<=', '<')) AS upper FROM s GROUP BY pkg) SELECT pkg, lower, upper FROM m WHERE lo > hi")
def bounds_unsat(spark, sf_dir):
    return requirements.unsatisfiable(_specs(spark, sf_dir))


@query(f"WITH {_SPECS} SELECT pkg, arg_min(name, pos) || array_to_string(list_sort(list_distinct(list(op || version))), ',') AS line FROM s GROUP BY pkg")
def merge_specs(spark, sf_dir):
    return requirements.merged(_specs(spark, sf_dir))


@query("SELECT user_id, event_type AS key, arg_max(value::VARCHAR, event_id) AS value FROM events GROUP BY user_id, event_type")
def params_last_wins(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    rows = events.select("user_id", F.col("event_id").alias("pos"), F.concat("event_type", F.lit("\t "), F.col("value").cast("string")).alias("value"))
    return files.parameters(rows, "user_id")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) // 2)) AS i FROM d)
SELECT doc_id, i::BIGINT AS pair, w[2 * i + 1] AS key, w[2 * i + 2] AS value FROM p""")
def token_pairs(spark, sf_dir):
    """All tokens of all texts, as a stream of key and value."""
    return files.token_pairs(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")), "doc_id")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) // 2)) AS i FROM d)
SELECT doc_id, w[2 * i + 1] AS key, arg_max(w[2 * i + 2], i) AS value FROM p GROUP BY doc_id, key""")
def token_parameters(spark, sf_dir):
    """All tokens of all texts, as a stream of key and value; the last value of a key counts."""
    whole = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    return files.token_parameters(whole, "doc_id")


# Comparison


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem),
a AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN 'x' ELSE l_returnflag END AS l_returnflag FROM l),
b AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_partkey % 15 = 0 THEN 'x' ELSE l_returnflag END AS l_returnflag FROM l)
SELECT *, 'got' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def golden_diff(spark, sf_dir):
    """Both sides hold every line; some have another flag."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    got, expected = (lines.withColumn("l_returnflag", F.when(F.col("l_partkey") % k == 0, "x").otherwise(F.col("l_returnflag"))) for k in (10, 15))
    return golden.difference(got, expected)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
d AS (SELECT o_custkey, n, o_totalprice AS got, o_totalprice + CASE WHEN o_orderkey % 4 = 0 THEN 0.5 WHEN o_orderkey % 4 = 1 THEN 1e-10 ELSE 0 END AS expected FROM o)
SELECT o_custkey, n::BIGINT AS n, 1::BIGINT AS field FROM d WHERE abs(got - expected) > 1e-8""")
def golden_tolerance(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    shift = F.when(F.col("o_orderkey") % 4 == 0, 0.5).when(F.col("o_orderkey") % 4 == 1, 1e-10).otherwise(0.0)
    got = orders.select("o_custkey", F.array(key, F.col("o_totalprice").cast("string")).alias("fields"))
    expected = orders.select("o_custkey", F.array(key, (F.col("o_totalprice") + shift).cast("string")).alias("fields"))
    out = golden.field_differences(got, expected, "o_custkey", "fields")
    return out.select("o_custkey", F.col("n").cast("long").alias("n"), F.col("field").cast("long").alias("field"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'OFF' WHEN o_custkey % 5 = 0 THEN 'INCOMPAT' END AS status FROM orders")
def skip_lists(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    skips = customer.where("o_custkey % 3 = 0").select("o_custkey", F.lit("OFF").alias("status"), F.lit("slow").alias("reason")).unionByName(customer.where("o_custkey % 5 = 0").select("o_custkey", F.lit("INCOMPAT").alias("status"), F.lit("old").alias("reason")))
    return golden.skipped(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), skips, "o_custkey").select("o_orderkey", "status")


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'WARN' WHEN o_orderkey % 9 = 0 THEN 'INCOMPAT' WHEN o_custkey % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    yes = F.lit(True)
    status = golden.status(yes, F.col("o_orderstatus") != "P", yes, F.col("o_orderkey") % 9 == 0, yes, F.col("o_custkey") % 4 != 0)
    return golden.counts(read(spark, sf_dir, "orders").select(status.alias("status")))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type IN ('click', 'error')) = 0 THEN 0.0 ELSE count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('click', 'error'))::DOUBLE * 100 END::DOUBLE AS pass_rate FROM events GROUP BY user_id")
def pass_rate(spark, sf_dir):
    return golden.pass_rate(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "click", F.col("event_type") == "error")


# Files and small functions


@query("SELECT user_id, event_type AS key, arg_max(value::VARCHAR, event_id) AS value, count(*) > 1 AS duplicate FROM events GROUP BY user_id, event_type")
def table_parameters(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.concat("event_type", F.lit("  "), F.col("value").cast("string"), F.lit(" more")).alias("value"))
    return files.table_parameters(rows, "user_id")


@query(r"""
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS v FROM d)
SELECT doc_id, pos::BIGINT AS pos, regexp_replace(v, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS value FROM e""")
def sequence(spark, sf_dir):
    whole = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("value"))
    return files.sequence(files.split_lines(whole)).withColumnRenamed("file", "doc_id")


@query("SELECT 'plugins/X' || p_partkey AS folder, 'X' || p_partkey AS name, p_partkey % 2 = 1 AS built FROM part WHERE p_partkey % 3 <> 0")
def built_crates(spark, sf_dir):
    name = F.concat(F.lit("X"), F.col("p_partkey").cast("string"))
    here = F.concat(F.lit("plugins/"), name, F.lit("/"))
    key = F.col("p_partkey")
    made = F.array_compact(F.array(F.when(key % 3 != 0, F.concat(here, F.lit("Cargo.toml"))), F.when(key % 2 == 1, F.concat(here, F.lit("lib"), name, F.lit("Plugin.so")))))
    return registry.built_crates(read(spark, sf_dir, "part").select(F.explode(made).alias("path")))


@query("SELECT 'out/' || o_orderkey || '.expected' AS expected, CASE WHEN o_custkey % 3 = 0 THEN 'out/' || o_orderkey END AS produced FROM orders")
def paired_files(spark, sf_dir):
    name = F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"))
    paths = F.array_compact(F.array(F.concat(name, F.lit(".expected")), F.when(F.col("o_custkey") % 3 == 0, name)))
    return golden.paired(read(spark, sf_dir, "orders").select(F.explode(paths).alias("path")))


@query("SELECT o_custkey, count(*) FILTER (o_orderkey % 20 = 0) = 0 AS equal FROM orders GROUP BY o_custkey")
def equal_files(spark, sf_dir):
    """Customers' orders as files; a twentieth of the lines differ."""
    got = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("string").alias("value"))
    expected = got.withColumn("value", F.when(F.col("pos") % 20 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    return golden.equal_files(got, expected, "o_custkey")


@query("SELECT p_partkey, p_brand || '/' || p_type AS below, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END::INTEGER AS code, rpad(p_type, 50, ' ') AS padded FROM part")
def small_functions(spark, sf_dir):
    """Names below a folder, exit codes, and padded names."""
    code = T.exit_code(F.col("p_size") % 2 == 0, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", T.below(F.col("p_brand"), F.col("p_type")).alias("below"), code.alias("code"), T.pad(F.col("p_type")).alias("padded"))


@query("SELECT p_partkey, rank() OVER (ORDER BY a, b, ph, po, dv)::BIGINT AS place FROM (SELECT p_partkey, p_size AS a, p_partkey % 3 AS b, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 3 END AS ph, CASE p_partkey % 5 WHEN 3 THEN 2 ELSE -1 END AS po, CASE p_partkey % 5 WHEN 2 THEN 1 ELSE 9 END AS dv FROM part)")
def version_order(spark, sf_dir):
    """Parts as versions (alphas, candidates, development, post and final releases), and their places."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("a0", ".rc0", ".dev1", ".post2", ".0")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    part = read(spark, sf_dir, "part").select("p_partkey", T.version_key(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string"), suffix)).alias("key"))
    sizes = part.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1  # a row for each version
    return part.join(sizes.withColumn("place", before), "key").select("p_partkey", "place")


# Extension


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    out = windows.counts(read(spark, sf_dir, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
