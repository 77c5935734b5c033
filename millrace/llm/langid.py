"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of labelled texts' letters in Spark; the log-probability matrix
(``BUCKETS`` x languages, a fixed bound) is broadcast, and batches are scored in numpy: each n-gram
gathers its row of the matrix, and rows are summed by document.

Labelled rows may be bounded: ``sample_per_language`` rows of each language or about that, those of
lowest hash (default ``SAMPLE_PER_LANGUAGE``; None: all of them).  Every document is scored whole.

Null texts and texts without a letter give ``und`` with score 0; so does every text if nothing
labelled could be learned from (also from an empty table).  Ties go to the label that sorts first.
Repeated rows repeat, other columns pass through, and an empty table gives an empty result.  A very
long text is cut into pieces of ``PIECE`` characters, all of which count.  More than
``MAX_LANGUAGES`` labels, which bound the broadcast table, are an error: none is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.core import U64, mix, text_buffers

BITS = 15
BUCKETS = 1 << BITS
SAMPLE_PER_LANGUAGE = 5_000
MAX_LANGUAGES = 1_000
SMOOTHING = 0.5
PIECE = 1 << 17  #: characters that one numpy pass looks at
UNKNOWN = "und"
BETWEEN = re.compile(r"[\x00-\x60\x7B-\x7F]+")  #: runs of ASCII characters that are no small letters become one blank
#: Evidence counts by this power: neighbouring n-grams overlap, so naive Bayes is too sure of itself.
TEMPER = 0.1


def pieces(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """(row, text in lower case, its words a blank apart) runs of about the given size; long texts are cut with 2 characters of overlap."""
    rows, parts, total = [], [], 0
    for i, text in enumerate(texts):
        text = BETWEEN.sub(" ", (text or "").lower())
        for at in range(0, max(1, len(text)), size):
            part = text[max(0, at - 2) : at + size]
            rows.append(i)
            parts.append((part, at > 0))
            total += len(part)
            if total >= size:
                yield rows, parts
                rows, parts, total = [], [], 0
    if rows:
        yield rows, parts


def grams(parts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that end at each character, and which part that is.

    Texts get a blank on either side; in a part that continues a text, n-grams that end in the
    two repeated characters are left out.
    """
    joined = "".join(("" if more else "  ") + p + " " for p, more in parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    lengths = np.fromiter(((3 - 2 * more) + len(p) for p, more in parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    keep = np.ones(len(codes), bool)
    for start in (ends - lengths):
        keep[start : start + 2] = False
    at = np.flatnonzero(keep)
    shift = U64(64 - BITS)
    with np.errstate(over="ignore"):
        one = codes[at] * U64(0x9E3779B97F4A7C15)
        two = (one ^ (codes[at - 1] + U64(7)) * U64(0xC2B2AE3D27D4EB4F)) * U64(0x165667B19E3779F9)
        three = (two ^ (codes[at - 2] + U64(11)) * U64(0x27D4EB2F165667C5)) * U64(0x85EBCA77C2B2AE63)
    found = np.stack([mix(x) >> shift for x in (one, two, three)], 1).astype(np.int32)
    return found, np.searchsorted(ends, at, side="right")


def count_batches(labels: list[str]):
    index = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), BUCKETS), np.int64)
        for batch in batches:
            langs = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for low, high, texts in text_buffers(batch.column(0), 4 * PIECE):
                for rows, parts in pieces([x.decode("utf-8", "surrogatepass") for x in texts]):
                    found, part = grams(parts)
                    which = langs[low:high][np.array(rows)][part]
                    ok = which >= 0
                    flat = (which[ok, None] * BUCKETS + found[ok]).ravel()
                    total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


def log_table(counts: np.ndarray) -> np.ndarray:
    """BUCKETS x languages log-probabilities from languages x BUCKETS counts."""
    smooth = counts + SMOOTHING
    return (np.log(smooth) - np.log(smooth.sum(1, keepdims=True))).T.astype(np.float32)


def predict(texts: list[str | None], known: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The label and its (tempered) posterior probability for each text."""
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not known:
        return labels, scores
    sums = np.zeros((len(texts), len(known)))
    for rows, parts in pieces(texts):
        found, part = grams(parts)
        each = table[found[:, 0]] + table[found[:, 1]] + table[found[:, 2]]
        cuts = np.searchsorted(part, np.arange(len(parts)))
        filled = np.flatnonzero(np.diff(np.append(cuts, len(part))))
        np.add.at(sums, np.array(rows)[filled], np.add.reduceat(each, cuts[filled], axis=0, dtype=np.float64))
    best = sums.argmax(1)
    odds = np.exp((sums - sums.max(1, keepdims=True)) * TEMPER)
    sure = odds[np.arange(len(best)), best] / odds.sum(1)
    for i, text in enumerate(texts):
        if text is not None and any(map(str.isalpha, text)):
            labels[i], scores[i] = known[best[i]], min(1.0, float(sure[i]))
    return labels, scores


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_per_language: int | None = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Learns from rows whose label is not null: the labels, and the matrix of log-probabilities."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    spark = labelled.sparkSession
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels: the table of log-probabilities would not be small")
    labels = sorted(sizes)
    if not labels:
        return [], np.zeros((BUCKETS, 0), np.float32)
    if sample_per_language:
        # Hashes spread evenly: the threshold for each language keeps about the sample's size.
        share = spark.createDataFrame([(k, min(1.0, sample_per_language / n)) for k, n in sizes.items()], "lang string, share double")
        low = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        rows = rows.join(F.broadcast(share), "lang").where(low).select("text", "lang")
    counted = rows.mapInArrow(count_batches(labels), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(labels), BUCKETS))
    for batch in counted.toArrow().to_batches():  # languages x BUCKETS numbers at most
        counts[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    return labels, log_table(counts)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input's columns with the predicted label and its score (columns of those names are replaced)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.drop(label, score)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_buffers(batch.column(at), 4 * PIECE):
                labels, scores = predict([x.decode("utf-8", "surrogatepass") for x in texts], *shared.value)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, label, score])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))
