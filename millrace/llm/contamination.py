"""Benchmark decontamination by greedy string tiling.

Texts and items share tokens where ``SEED``-word hashes are equal; a Spark join of the texts'
seeds with the items' distinct seeds gives, for each (document, item), the places in the text that
the item has as well.  Tiling then marks, again and again, the longest match whose words are
unmarked on both sides: a running Karp-Rabin hash over the seeds of both sides finds the greatest
length at which they still share a window (by bisection, as a longer match holds shorter ones), and
the seeds confirm it.  No pair of places is ever listed, so texts and items full of one repeated word
cost no more than others.  Tiles may stand in any order and anywhere, so an item is caught if its
passages were moved about.  A document is contaminated by an item if tiles cover at least
``COVERAGE`` of the item's words.

Benchmarks of up to ``BROADCAST_SEEDS`` seeds are broadcast, and texts send only seeds that some
item has; larger ones are joined by a shuffle on the seed.  A seed that many texts share adds one
row a text and place, never a pair of texts.  Seeds meet on 128 bits: two independent hashes of
their words.

Words are those of the text in lower case, without punctuation.  Null, empty and wordless texts and
items match nothing; an item of fewer than ``SEED`` words is matched as a whole, by one seed of its
own length.  Documents and items are told apart by key and text: a key may be null or repeat, equal
rows count once, different texts under one key are judged apart and give a row each.  Very long
texts are hashed whole; a group holds the matches of one text and item.  Empty tables match nothing.
Other columns are not read and may have any names; if both keys have one name, the item's column
is called ``item_`` and that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.core import BUFFER, U64, WORD, Roller, free_name, text_buffers, word_grams, word_hashes, words_of
from millrace.llm.minhash import raw_digest

SEED = 5
COVERAGE = 0.5
BROADCAST_SEEDS = 1_000_000


def seed_batches(sizes: list[int], wanted: np.ndarray | None):
    """(id, mark, text) to (id, mark, place, size, hash, check) of all seeds of the given lengths that are wanted (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = None
        if wanted is not None:
            maybe = np.zeros(1 << 22, bool)
            maybe[(wanted >> U64(42)).astype(np.int64)] = True
        for batch in batches:
            for low, _, texts in text_buffers(batch.column(2), 4 * BUFFER, lower=True):
                hashes, doc, index, start, end = words_of(texts, WORD)
                raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                for size in sizes:
                    grams, ok = word_grams(hashes, doc, size)
                    at = np.flatnonzero(ok if maybe is None else ok & maybe[(grams >> U64(42)).view(np.int64)])
                    if wanted is not None:
                        near = np.searchsorted(wanted, grams[at])
                        near[near == len(wanted)] = 0
                        at = at[wanted[near] == grams[at]] if len(wanted) else at[:0]
                    if not len(at):
                        continue
                    used, which = np.unique(at[:, None] + np.arange(size), return_inverse=True)
                    other = word_hashes(raw, start[used], end[used], salt=1)[which.reshape(len(at), size)]
                    check, _ = word_grams(other.ravel(), np.zeros(other.size, np.int64), size)
                    rows = pa.array(doc[at] + low)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(index[at].astype(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(grams[at].view(np.int64)), pa.array(check[::size].view(np.int64))],
                        ["id", "mark", "place", "size", "hash", "check"],
                    )

    return run


def room(alive: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """From each seed on, how many alive ones follow each other."""
    stop = np.flatnonzero(~alive | ~np.append(follows, False))  # a seed that is dead or has no next one
    last = stop[np.searchsorted(stop, np.arange(len(alive)))]
    return np.where(alive, last - np.arange(len(alive)) + alive[last], 0)


def tile(places: np.ndarray, seeds: np.ndarray, item: np.ndarray, size: int, roller: Roller) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, words), longest first, then those of least places.

    ``seeds`` stand at ``places`` (rising) of the text, ``item`` has its own seeds in order.  A seed
    stays in play while all its words are unmarked.
    """
    if not len(seeds) or not len(item):
        return []
    follows = places[1:] == places[:-1] + 1, np.ones(max(0, len(item) - 1), bool)
    alive = np.isin(seeds, item), np.isin(item, seeds)
    sums = [roller.sums(x.view(U64)) for x in (seeds, item)]
    tiles: list[tuple[int, int, int]] = []
    top = min(len(seeds), len(item))

    def windows(length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at = [np.flatnonzero(r >= length) for r in rooms]
        return at, [roller.spans(s, a, a + length) for s, a in zip(sums, at, strict=True)]

    def shared(length: int) -> bool:
        _, (t, i) = windows(length)
        return bool(len(t) and len(i) and np.isin(i, t).any())

    while True:
        rooms = [room(a, f) for a, f in zip(alive, follows, strict=True)]
        top = min(top, *(int(r.max(initial=0)) for r in rooms))
        if top < 1 or not shared(1):
            return tiles
        low = 1  # bisection for the greatest length that both still share
        if shared(top):
            low = top
        while low < top:
            middle = (low + top + 1) // 2
            if shared(middle):
                low = middle
            else:
                top = middle - 1
        at, (t, i) = windows(low)
        first = int(np.flatnonzero(np.isin(t, i))[0])
        a, b = int(at[0][first]), int(at[1][np.flatnonzero(i == t[first])[0]])
        if not np.array_equal(seeds[a : a + low], item[b : b + low]):
            raise ValueError("two different stretches of seeds have one hash")
        words = low + size - 1
        tiles.append((int(places[a]), b, words))
        alive[0][(places > places[a] - size) & (places < places[a] + words)] = False
        alive[1][max(0, b - size + 1) : b + words] = False


def tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., matches, seeds, size, n_item_words, least) to (..., n_tiles, n_covered, n_item_words); pairs
    whose shared seeds reach fewer words of the item than ``least`` have no tiles."""
    roller = Roller()
    for batch in batches:
        matches, own = batch.column(4), batch.column(5)
        place, hashes = (matches.flatten().field(i).to_numpy() for i in (0, 1))
        items = own.flatten().to_numpy()
        cuts, item_cuts = (np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy()))) for x in (matches, own))
        sizes, words, least = (batch.column(i).to_numpy() for i in (6, 7, 8))
        covered, count = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for i in range(len(batch)):
            p, s = place[cuts[i] : cuts[i + 1]], hashes[cuts[i] : cuts[i + 1]]
            item = items[item_cuts[i] : item_cuts[i + 1]]
            touched = np.zeros(int(words[i]) + 1, np.int64)
            hit = np.flatnonzero(np.isin(item, s))
            np.add.at(touched, hit, 1)
            np.add.at(touched, hit + sizes[i], -1)
            if (np.cumsum(touched) > 0).sum() < least[i]:
                continue
            order = np.argsort(p, kind="stable")
            tiles = tile(p[order], s[order], item, int(sizes[i]), roller)
            covered[i], count[i] = sum(n for _, _, n in tiles), len(tiles)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(count), pa.array(covered), batch.column(7)], ["id", "mark", "item_id", "item_mark", "n_tiles", "n_covered", "n_item_words"])


def length_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) to (id, mark, number of words)."""
    for batch in batches:
        for low, high, texts in text_buffers(batch.column(2), 4 * BUFFER, lower=True):
            _, doc, _, _, _ = words_of(texts, WORD)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(np.bincount(doc, minlength=high - low).astype(np.int64))], ["id", "mark", "words"])


def pairs(df: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, coverage: float) -> DataFrame:
    """id, mark (digest of the text), item_id, n_tiles, n_covered, n_item_words and coverage at or above the threshold."""
    kinds = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows, own = (d.select(F.col(k).alias("id"), raw_digest(F.col(t)).alias("mark"), F.col(t).alias("text")).where("text IS NOT NULL") for d, k, t in ((df, key, text), (items, item_key, item_text)))
    schema = "id {}, mark binary, place long, size int, hash long, check long"
    name = [F.col("id").alias("item_id"), F.col("mark").alias("item_mark")]
    lengths = own.mapInArrow(length_batches, f"id {kinds[1]}, mark binary, words long").groupBy(*name).agg(F.max("words").alias("n_item_words")).where("n_item_words > 0")
    seeds = own.mapInArrow(seed_batches(list(range(1, SEED + 1)), None), schema.format(kinds[1])).distinct().select(*name, F.col("place").alias("at"), "size", "hash", "check")
    # the usual seeds, and for a short item the one that is all of it
    alike = lambda a, b: a.item_id.eqNullSafe(b.item_id) & (a.item_mark == b.item_mark)
    seeds = seeds.join(lengths, alike(seeds, lengths)).where(F.col("size") == F.least(F.lit(SEED), F.col("n_item_words"))).select(seeds.item_id, seeds.item_mark, "at", "size", "hash", "check", "n_item_words")
    few = seeds.select("hash", "size").limit(BROADCAST_SEEDS + 1).toArrow()
    small = few.num_rows <= BROADCAST_SEEDS
    whole = seeds.groupBy("item_id", "item_mark", "size", "n_item_words").agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("seeds")).withColumn("seeds", F.col("seeds.hash"))
    single = seeds.select("item_id", "item_mark", "size", "hash", "check").distinct()
    if small:
        wanted = np.unique(few.column("hash").to_numpy().view(U64))
        sizes = sorted(set(few.column("size").to_pylist()))
        whole, single = F.broadcast(whole), F.broadcast(single)
    else:
        wanted, sizes = None, sorted(r[0] for r in seeds.select("size").distinct().collect())
    met = rows.mapInArrow(seed_batches(sizes, wanted), schema.format(kinds[0])).join(single, ["hash", "size", "check"])
    met = met.groupBy("id", "mark", "item_id", "item_mark").agg(F.collect_set(F.struct("place", "hash")).alias("matches"))
    found = met.join(whole, alike(met, whole)).select("id", "mark", met.item_id, met.item_mark, "matches", "seeds", "size", "n_item_words", (coverage * F.col("n_item_words")).alias("least"))
    tiled = found.mapInArrow(tile_batches, f"id {kinds[0]}, mark binary, item_id {kinds[1]}, item_mark binary, n_tiles long, n_covered long, n_item_words long")
    return tiled.withColumn("coverage", F.col("n_covered") / F.col("n_item_words")).where(F.col("coverage") >= coverage)


def contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_item_words, n_tiles, n_covered and coverage of each pair at or above the threshold."""
    out = pairs(df, items, key, text, item_key, item_text, coverage)
    return out.select(F.col("id").alias(key), F.col("item_id").alias(item_key if item_key != key else f"item_{item_key}"), "n_item_words", "n_tiles", "n_covered", "coverage")


def decontaminate(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df whose text no item contaminates."""
    own, mark = free_name("row_id", df), free_name("row_digest", df)
    away = pairs(df, items, key, text, item_key, item_text, coverage).select(F.col("id").alias(own), F.col("mark").alias(mark)).distinct()
    return df.join(away, df[key].eqNullSafe(away[own]) & (raw_digest(df[text]) == away[mark]), "left_anti")
