"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before it kept, and its decisions take effect.  All but the last return the columns of documents;
columns beyond those of ``documents``, whatever their names, pass through.

Null, empty and wordless texts have no language, so the first stage rejects them.  Every row is a
document of its own also where doc_id is null or repeats: rows of equal or nearly equal texts are
near duplicates whatever their ids, and one of them stays; different texts under one id all stay.
A document that holds a benchmark item goes, also if its doc_id is null.  Very long texts are
worked on whole.  Empty ``documents`` give an empty result with the columns of the last stage, an
empty ``benchmark`` drops nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import contamination, langid, minhash, mixing, secrets
from millrace.llm.core import free_name, remove, shared_folder

SURE = 0.3  #: least posterior probability of a document's language; very short texts come near it


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; the model learns from the labelled ones."""
    model = langid.train(docs)
    label, score = free_name("lang_pred", docs), free_name("score", docs)
    known = langid.identify(docs, model, label=label, score=score).where((F.col(label) != langid.UNKNOWN) & (F.col(score) >= SURE))
    return known.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that of the least doc_id."""
    return minhash.deduplicate(docs).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.decontaminate(docs, items).select(docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text, and every document stays."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of their copies."""
    return mixing.mixture(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_redaction", secret_redaction),
    ("mix", mix),
]

#: SQL cannot say classifiers, signatures and dependent rounding; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again.

    A stage's result is removed when the next one is written; the last one stays for its readers."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
