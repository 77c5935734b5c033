"""One query for each operator of this package, over the standard tables, and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import contamination, langid, lattice, licenses, minhash, mixing, quality, secrets, substrings, urls

#: The public vocabulary that op7 reads; another machine names its own.
VOCABULARY = os.environ.get("MILLRACE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")

#: Fixed values: (label, phrase).
LICENSE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Fixed values: (host, path, verdict).
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of a column as text, modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), base=LICENSE_PHRASES).drop("spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.where(remainder("doc_id", 4) != 2))
    out = langid.identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lattice.score(documents, remainder("doc_id", 10) != 0, VOCABULARY)
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_decontamination,
        op3_license_scan,
        op4_secret_scan,
        op5_language_id,
        op6_source_mix,
        op7_lm_score,
        op8_near_duplicates,
        op9_quality_rules,
        op10_url_filter,
    )
}

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for line in quality.STOP_WORDS for w in line.split()}))
_RULES = " AND ".join([f"{r.measure} >= {r.low!r}::DOUBLE" for r in quality.RULES if r.low is not None] + [f"{r.measure} <= {r.high!r}::DOUBLE" for r in quality.RULES if r.high is not None])

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c0 AS (SELECT doc_id, h, unnest(range(0, length(h) // 2, 256)) AS b FROM d),
c1 AS (SELECT doc_id, b, substr(h, 2 * b + 1, 710) AS part FROM c0),
i AS (SELECT doc_id, b, part, unnest(range(0, greatest(0, length(part) // 2 - 99))) AS o FROM c1),
w AS (SELECT doc_id, b + o AS s, md5(substr(part, 2 * o + 1, 200)) AS k FROM i),
f AS (SELECT k, min((doc_id, s)) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.s FROM w JOIN f USING (k) WHERE (w.doc_id, w.s) <> f.first),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM r),
c AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM g),
p AS (SELECT doc_id, n, min(s) AS a, max(s) + 100 AS b FROM c GROUP BY doc_id, n),
q AS (SELECT doc_id, n, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM p),
k AS (SELECT q.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY n) AS head, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
e AS (SELECT rid, i, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS win
      FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, win FROM e WHERE win IS NOT NULL GROUP BY rid, win HAVING count(*) > 1),
spots AS (SELECT e.rid, e.i, lead(e.i) OVER (PARTITION BY e.rid ORDER BY e.i) AS nxt FROM e JOIN twice USING (rid, win)),
reps AS (SELECT rid, sum(CASE WHEN nxt IS NULL THEN 8 ELSE least(8, nxt - i) END) AS n FROM spots GROUP BY rid),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
      FROM w LEFT JOIN reps USING (rid)),
r AS (SELECT *, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_length, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
        n_stop_words / greatest(n_words, 1)::DOUBLE AS stop_ratio, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept FROM r
""",
    "op10_url_filter": r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT row_number() OVER () AS rid, page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
}
