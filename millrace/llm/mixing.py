"""Mixing sources to target weights by pivotal dependent rounding.

*Targets.*  Sources, in order of code points (null last), weigh 5, 2, 1 and so on in turn and share
``SHARE`` of all words.  A source's target stops at ``CAP`` times its size, and the excess is
shared out again by weight until none is above: the water level is found by sorting sources by
cap over weight.

*Copies.*  A source's documents all have the copy number target / size.  Its whole part is fixed;
the fractions are rounded dependently: an open document is paired with one of like size, or with all
smaller open ones of its chunk together, and words move at random from one side to the other (copies weighted by size,
expectations kept) until one side is whole.  The words of a source are thus preserved up to the last
open document, a small one.  A source's documents are
dealt into chunks by a hash of their id, text and number among equal rows, as many as its documents need; a chunk leaves at most one
open document, and these are combined in a reduction tree of ``FAN`` chunks a node.  No source,
however large, meets in one task, and the order of rows and the number of partitions do not
matter: reruns agree.

Null texts have size 0 and are never taken; a null source is a source.  Every row is a document of
its own, with its own decision, also where ids are null or repeat; equal rows are numbered, so
none of these meet in one chunk.  An empty table gives an empty result.  A very long text is a large
document like others.  Columns that ``mixture`` does not need pass through, whatever their names,
but a column ``copies`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.core import INK, Tables, free_name, materialize, text_buffers

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
CHUNK = 1024  #: documents in a chunk, about
FAN = 64
SEED = 20_261
EDGE = 1e-9
ALIKE = 4  #: of two alike documents one is at most so many times as large


def size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ...) to (..., size): its words."""
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        for low, high, texts in text_buffers(batch.column(0)):
            raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
            ink = INK[raw]
            begins = ink.copy()
            begins[1:] &= ~ink[:-1]
            ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, high - low))
            sizes[low:high] = np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes)], [*batch.schema.names[1:], "size"])


def running(df: DataFrame, order: list, sums: dict[str, Column], tables: Tables) -> DataFrame:
    """The rows with sums over all rows before each in the order; sorted by ranges, summed within each
    and over ranges, so no task sees all rows."""
    rows = tables.write(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    ranges = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])  # a row for each range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()]).join(F.broadcast(ranges), "_part")
    return rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", "_at", *[f"_{n}" for n in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, documents, rank, target) from rows (source, size); there may be many sources."""
    tables = Tables(sizes.sparkSession)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by = running(by, [F.asc_nulls_last("source")], {"before": F.lit(1)}, tables).withColumn("rank", F.col("before") + 1).drop("before")
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", cap * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    all_ = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    by = running(by, ["level", "rank"], {"capped": F.col("cap"), "heavy": F.col("weight")}, tables)
    by = by.withColumn("water", (share * float(all_[0]) - F.col("capped")) / (float(all_[1]) - F.col("heavy"))).withColumn("full", F.col("water") >= F.col("level"))
    by = tables.write(by)
    level = by.agg(F.max(F.when(~F.col("full"), F.col("water")))).first()[0]
    tables.keep(by)
    return by.select("source", "source_size", "documents", "rank", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.lit(level if level is not None else 0.0)).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator, last: bool = False) -> tuple[np.ndarray, int]:
    """Rounds fractional copies in turn: (0 or 1 for each, the one still open or -1).

    The largest open document is paired with the next one if that is about as large (``ALIKE``), else
    with all smaller open ones together: words move from one side to the other until a document is
    whole; which way, with the probability that keeps every document's expectation.  Large documents
    thus settle among themselves, the last of them with the many small ones, and what stays open at
    the end is small where there are any small ones to take its words.
    """
    order = np.argsort(-size, kind="stable")
    value, s = part.astype(np.float64)[order], size.astype(np.float64)[order]
    draws = rng.random(2 * len(value) + 1)  # each move makes one of them whole
    snap = lambda v: np.where(v <= EDGE, 0.0, np.where(v >= 1 - EDGE, 1.0, v))
    value, open_ = snap(value), -1
    draw = iter(draws)
    while True:
        waiting = np.flatnonzero((value > 0) & (value < 1))
        if len(waiting) < 2:
            open_ = int(waiting[0]) if len(waiting) else -1
            break
        j, at = waiting[0], waiting[1:]
        if s[at[0]] * ALIKE >= s[j]:
            at = at[:1]
        rest, words = value[at], s[at]
        share = np.minimum(rest, 1 - rest) * words
        share /= share.sum()
        room = words / share  # how far words may move until the first of them is whole
        give = min(value[j] * s[j], float(((1 - rest) * room).min()))
        take = min((1 - value[j]) * s[j], float((rest * room).min()))
        moved = give if next(draw) * (give + take) < take else -take
        value[j] -= moved / s[j]
        value[at] += moved * share / words
        value = snap(value)
    if last and open_ >= 0:
        value[open_] = float(draws[-1] < value[open_])
        open_ = -1
    out = np.empty(len(value))
    out[order] = value
    return out, int(order[open_]) if open_ >= 0 else -1


def generator(*numbers: int) -> np.random.Generator:
    return np.random.default_rng([SEED, *(int(n) & 0xFFFFFFFFFFFFFFFF for n in numbers)])


def round_chunk(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's documents of one chunk, large ones first: small ones fill them up, and the one that
    stays open at the end is mostly small, so the source comes near its target."""
    frame = frame.sort_values(["size", "order", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    value, open_ = pivot(frame["size"].to_numpy(), frame["part"].to_numpy(), generator(0, frame["rank"].iloc[0], frame["chunk"].iloc[0]))
    frame["open"] = np.arange(len(frame)) == open_
    frame["part"] = value
    return frame


def round_node(level: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "chunk"], ascending=[False, True], kind="stable").reset_index(drop=True)
        value, open_ = pivot(frame["size"].to_numpy(), frame["part"].to_numpy(), generator(level, frame["rank"].iloc[0], frame["chunk"].iloc[0]), last)
        frame["open"] = np.arange(len(frame)) == open_
        frame["part"] = value
        return frame

    return run


def decided(rows: DataFrame, kind: str) -> DataFrame:
    """row, id, size, source_size, target and copies from (text, id, source, row, rest).

    ``row`` is any number of its own for each row.  It only tells apart rows of one id, source and
    text, and of those only the ones that are equal in ``rest`` too, the hash of what else they hold.
    """
    rows = rows.select("text", "id", "source", "row", "rest", F.xxhash64("text", F.lit(SEED)).alias("digest"))
    sizes = materialize(rows.mapInArrow(size_batches, f"id {kind}, source string, row long, rest long, digest long, size long"))
    aims = targets(sizes)
    chunks = max(1, -(-(aims.agg(F.max("documents")).first()[0] or 1) // CHUNK))  # of the largest source
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    number = F.row_number().over(Window.partitionBy("id", "source", "digest").orderBy("rest", "row"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit(SEED), "digest", number)
    met = sizes.withColumn("order", order).alias("s").join(aims.alias("t"), same).select("row", "order", "size", "source_size", "target", F.col("rank").cast("long").alias("rank"), F.ceil(F.col("documents") / CHUNK).alias("chunks"))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CAP))).otherwise(0.0)
    met = met.withColumn("whole", F.floor(share)).withColumn("part", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0))
    met = met.withColumn("chunk", F.pmod("order", "chunks"))
    schema = "row long, size long, source_size long, target double, rank long, whole long, part double, order long, chunk long"
    first = materialize(met.select("row", "size", "source_size", "target", "rank", "whole", "part", "order", "chunk").groupBy("rank", "chunk").applyInPandas(round_chunk, schema + ", open boolean"))
    waiting = first.where("open").select("rank", "chunk", "size", "part", "open")
    settled = None
    level, width = 1, chunks
    while True:  # as many rounds as the tree has levels: log(chunks) to the base FAN
        width = -(-width // FAN)
        last = width <= 1
        node = F.expr(f"chunk div {FAN**level}")
        step = materialize(waiting.groupBy("rank", node).applyInPandas(round_node(level, last), "rank long, chunk long, size long, part double, open boolean"))
        done = step.where("NOT open").select("rank", "chunk", F.col("part").alias("rounded"))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        waiting, level = step.where("open"), level + 1
    ends = first.where("NOT open").withColumn("rounded", F.col("part"))
    opened = first.where("open").join(settled, ["rank", "chunk"])
    out = ends.unionByName(opened)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("rounded").cast("long")).otherwise(0)
    out = out.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))
    return sizes.select("row", "id").join(out, "row")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target and taken (words, repeats counted) of each row of df."""
    rows = df.select(F.col(text).alias("text"), F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("rest"))
    out = decided(rows, df.schema[key].dataType.simpleString())
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df with ``copies``: how often the mix takes each (rows with 0 are left out).

    The rows are numbered and written once, and each gets its own copies back by its number.
    """
    df = df.drop("copies")
    own = free_name("row_number", df)
    numbered = materialize(df.withColumn(own, F.monotonically_increasing_id()))
    rest = [c for c in df.columns if c not in (key, text, source)]
    rows = numbered.select(F.col(text).alias("text"), F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(own).alias("row"), F.xxhash64(F.lit(SEED), *rest).alias("rest"))
    plan = decided(rows, df.schema[key].dataType.simpleString()).where("copies > 0").select(F.col("row").alias(own), "copies")
    return numbered.join(plan, own).select(*df.columns, "copies")
