"""Quality rules: one threshold table, compiled into one projection of built-in functions.

A rule is a row ``Rule(name, measure, low, high)``: a document passes if the measure lies within
the bounds.  ``measures`` gives the columns, ``verdict`` compiles the table into one boolean
column; the plan is a scan and projections, without exchange, join or user function.

Null texts count as empty: no words, all counts 0, ``base_failed`` true, ``kept`` false.  Rows are
judged one by one, so repeated rows give repeated results and other columns pass through; columns
of the input that bear a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with was as by at be this are from or",
    "der die das und ist von zu den mit für im ein eine nicht auf des dem sich auch als",
    "le la les de des et un une est que dans pour qui sur pas par avec du en au",
    "el los las y es una por con para su del al lo como se no",
)

#: The threshold table.  Ratios are kept loose: a rule should catch junk, not plain prose.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_ratio", high=0.30),
    Rule("word_length", "mean_word_length", low=2.0, high=16.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
    Rule("stop_words", "stop_ratio", low=0.01),
)


def _within(rule: Rule) -> Column:
    value = F.col(rule.measure)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= F.lit(rule.low))
    if rule.high is not None:
        ok = ok & (value <= F.lit(rule.high))
    return ok


def verdict(rules: Sequence[Rule]) -> Column:
    """All rules of the table as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        out = out & _within(rule)
    return out


def measures(df: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The input with the measures that rules refer to, in one chain of projections."""
    stops = sorted({w for line in stop_words for w in line.split()})
    out = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("__words", F.array_remove(F.split("__text", BLANK), ""))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_lines", F.size("__lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    # n_repeat_words: windows are hashed; only where two hashes are equal they are sorted by (hash,
    # place), and each window equal to a neighbour covers the words up to the next such one, 8 at most.
    eight = "xxhash64(" + ", ".join(f"__hash[i + {k}]" for k in range(WINDOW)) + ")"
    out = out.withColumn("__windows", F.expr(f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(0, CAST(n_words AS INT) - {WINDOW}), i -> {eight}) ELSE array() END"))
    out = out.withColumn("__twice", F.expr("CASE WHEN size(__windows) > size(array_distinct(__windows)) THEN sort_array(transform(__windows, (h, i) -> struct(h AS h, i AS i))) END"))
    out = out.withColumn("__spots", F.expr("sort_array(transform(filter(__twice, (w, k) -> w.h <=> get(__twice, k - 1).h OR w.h <=> get(__twice, k + 1).h), w -> w.i))"))
    out = out.withColumn("n_repeat_words", F.expr(f"CAST(coalesce(aggregate(__spots, struct(-{WINDOW} AS last, 0 AS n), (a, i) -> struct(i AS last, a.n + least({WINDOW}, i - a.last) AS n), a -> a.n), 0) AS LONG)"))
    out = out.withColumn("n_stop_words", F.size(F.filter("__words", lambda w: F.lower(w).isin(stops))).cast("long"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumn("repeat_ratio", F.col("n_repeat_words") / words)
    out = out.withColumn("mean_word_length", F.col("word_chars") / words)
    out = out.withColumn("symbol_ratio", F.col("n_symbols") / words)
    out = out.withColumn("stop_ratio", F.col("n_stop_words") / words)
    out = out.withColumn("dup_line_ratio", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
    return out


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The input with all measures, ``base_failed`` and ``kept``."""
    out = measures(df, text, stop_words)
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in df.columns])
