"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The pieces and their scores come from an existing tokenizer's vocabulary (never trained here).
The scores are merge ranks; taken as Zipf ranks they give each piece a prior probability.  One
expectation step over the training texts' words reweighs the pieces: every segmentation of every
word counts by its probability under the prior.  A text's probability is the product over its
words (each begins with a blank) of the sum over the word's segmentations, found by a forward
recursion in log space over the lattice of pieces, times the probability of the end.  Every byte
is a piece, so any text has a probability.

Work is done once for each distinct word: word counts are gathered from all texts (local counts
first, then a grouping by word), the lattice runs over the distinct words, and texts look their
words up.  Frequent words (``FREQUENT`` of them at most, a fixed bound) are broadcast; the rest
meet the texts in a join on the word's hash.

The base score is a smoothed unigram model of whole words.  Texts are in lower case (A-Z), words
are runs without blanks, and an end follows each text.  Null and empty texts have the end only.
Rows are told apart by key and text; equal rows are scored once and given back as often.
Words are told apart by 64-bit hashes.  A very long text or word is scored whole.  Other columns are
not read.  An empty table gives an empty result; with nothing to learn from, every word is unseen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.core import BUFFER, INK, LOWER, U64, Roller, materialize, mix, text_buffers, text_marks, words_of

FREQUENT = 1 << 17
LONG = 40  #: longer words, in bytes, take the plain recursion
GROUP = 1 << 16  #: words that one pass of the lattice takes
END = -1  #: hash of the end
ZIPF = 10.0
PRIOR = 1_000.0  #: pieces' worth of counts that the prior has


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a blank begins a word) and prior log-probabilities; the last is the end's.

    Every single byte is a piece, and pieces with a blank inside are left out: no word has them.
    """
    import sentencepiece

    if not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary at {path!r}: name a SentencePiece model that the driver can read")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-4 for b in range(256)}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            piece, w = bytes([int(model.id_to_piece(i)[3:-1], 16)]), 1e-4
        else:
            piece, w = model.id_to_piece(i).replace("▁", " ").encode(), 1.0 / (ZIPF + max(0.0, -model.get_score(i)))
        if piece and b" " not in piece[1:]:
            weight[piece] = weight.get(piece, 0.0) + w
    pieces = sorted(weight)
    p = np.array([*(weight[x] for x in pieces), 1.0 / ZIPF])
    return pieces, np.log(p / p.sum())


class Lattice:
    """Forward and backward recursions over many words at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.logp = logp
        self.roller = Roller(256)
        self.sizes = sorted({len(p) for p in pieces})
        hashes = np.zeros(len(pieces), U64)
        for size in self.sizes:
            of = [i for i, p in enumerate(pieces) if len(p) == size]
            text = np.frombuffer(b"".join(pieces[i] for i in of), np.uint8).reshape(-1, size)
            hashes[of] = self.codes(self.sums(text), 0, size)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.maybe = np.zeros(1 << 19, bool)
        self.maybe[(hashes >> U64(45)).astype(np.int64)] = True

    def sums(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros((text.shape[1] + 1, text.shape[0]), U64)
        np.cumsum((self.roller.table[text] * self.roller.up[: text.shape[1]]).T, axis=0, out=out[1:])
        return out

    def codes(self, sums: np.ndarray, low: int, high: int) -> np.ndarray:
        x = (sums[high] - sums[low]) * self.roller.down[low]
        return (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)

    def edges(self, sums: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose bytes [low, high) are a piece, and which."""
        code = self.codes(sums, low, high)
        rows = np.flatnonzero(self.maybe[(code >> U64(45)).view(np.int64)])
        at = np.searchsorted(self.hashes, code[rows])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == code[rows]
        return rows[hit], self.numbers[at[hit]]

    def run(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each word (without its leading blank); with counts, also the pieces'
        expected numbers."""
        out = np.full(len(words), self.logp[-1])
        expected = None if counts is None else np.zeros(len(self.logp))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if expected is not None:
            expected[-1] = counts[lengths == 0].sum()
        for size in np.unique(lengths[(lengths > 0) & (lengths <= LONG)]):
            rows = np.flatnonzero(lengths == size)
            n = int(size) + 1
            text = np.frombuffer(b"".join(b" " + words[i] for i in rows), np.uint8).reshape(-1, n)
            sums = self.sums(text)
            alpha = np.full((n + 1, len(rows)), -np.inf)
            alpha[0] = 0.0
            kept = []
            for high in range(1, n + 1):
                for length in self.sizes:
                    if length > high:
                        break
                    hit, number = self.edges(sums, high - length, high)
                    if len(hit):
                        alpha[high, hit] = np.logaddexp(alpha[high, hit], alpha[high - length, hit] + self.logp[number])
                        if expected is not None:
                            kept.append((high - length, high, hit, number))
            out[rows] = alpha[n]
            if expected is not None:
                beta = np.full((n + 1, len(rows)), -np.inf)
                beta[n] = 0.0
                weight = counts[rows]
                for low, high, hit, number in sorted(kept, key=lambda k: -k[1]):
                    through = self.logp[number] + beta[high, hit]
                    expected += np.bincount(number, weight[hit] * np.exp(alpha[low, hit] + through - alpha[n, hit]), len(expected))
                    beta[low, hit] = np.logaddexp(beta[low, hit], through)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self.plain(b" " + words[i], None if counts is None else float(counts[i]), expected)
        return out, expected

    def plain(self, text: bytes, count: float | None, expected: np.ndarray | None) -> float:
        """The same recursions for one long word; pieces are looked up again on the way back, so two
        numbers a byte are held, however long it is."""

        def ending(high: int) -> list[tuple[int, int]]:
            """(beginning, piece) of the pieces that end there."""
            return [(high - s, self.index[text[high - s : high]]) for s in self.sizes if s <= high and text[high - s : high] in self.index]

        alpha = np.full(len(text) + 1, -np.inf)
        alpha[0] = 0.0
        for high in range(1, len(text) + 1):
            terms = [alpha[low] + self.logp[number] for low, number in ending(high)]
            top = max(terms)
            alpha[high] = top + math.log(sum(math.exp(t - top) for t in terms))
        if expected is not None:
            beta = np.full(len(text) + 1, -np.inf)
            beta[-1] = 0.0
            for high in range(len(text), 0, -1):  # all that begins there has been added
                for low, number in ending(high):
                    through = self.logp[number] + beta[high]
                    expected[number] += count * math.exp(alpha[low] + through - alpha[-1])
                    beta[low] = np.logaddexp(beta[low], through)
        return float(alpha[-1])


def grouped(batches: Iterator[pa.RecordBatch], rows: int = GROUP) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, training?) to (hash, word, count in training texts), summed over some MB of text."""
    for batch in batches:
        learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for low, high, part in text_buffers(batch.column(0), 24 * BUFFER):
            hashes, doc, _, start, end = words_of(part, INK, lower=True)
            raw = LOWER[np.frombuffer(b"\n".join(part) + b"\n", np.uint8)].tobytes()
            own, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            n = np.bincount(which, learn[low:high][doc], len(own)).astype(np.int64)
            words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(own.view(np.int64), END)), pa.array([*words, b""], pa.binary()), pa.array(np.append(n, learn[low:high].sum()).astype(np.int64))], ["hash", "word", "n"]
            )


def learn(df: DataFrame, training: Column, path: str, text: str = "text"):
    """(words: hash, word, n; pieces; log-probabilities; training tokens; distinct training tokens)."""
    spark = df.sparkSession
    pairs = df.select(F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("learn")).mapInArrow(word_batches, "hash long, word binary, n long")
    words = materialize(pairs.groupBy("hash").agg(F.first("word").alias("word"), F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pieces, prior = vocabulary(path)
    shared = spark.sparkContext.broadcast((pieces, prior))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = None, 0.0
        for group in grouped(batches):
            lattice = lattice or Lattice(*shared.value)
            sums = sums + lattice.run(group.column("word").to_pylist(), group.column("n").to_numpy())[1]
        if lattice is not None:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["piece", "n"])

    counted = words.where("n > 0").select("word", "n").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    weight = PRIOR * np.exp(prior)
    for batch in counted.toArrow().to_batches():  # as many rows as the vocabulary has pieces, at most
        weight[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
    return words, pieces, np.log(weight / weight.sum()), int(total[0]), int(total[1])


def frequent_limit(words: DataFrame, most: int = FREQUENT) -> int:
    """The least count that at most so many words reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in words.where("n > 0").groupBy(step).count().collect()), reverse=True)
    have, limit = 0, None
    for s, n in sizes:
        have += n
        if have > most:
            break
        limit = s
    return 1 << 62 if limit is None else math.ceil(2 ** (limit / 8) - 1e-9)


def score(df: DataFrame, training: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: key, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    words, pieces, logp, n, v = learn(df, training, path, text)
    model = spark.sparkContext.broadcast((pieces, logp))
    down = math.log10(n + 0.1 * (v + 1))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for group in grouped(batches):
            lattice = lattice or Lattice(*model.value)
            found, _ = lattice.run(group.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([group.column("hash").combine_chunks(), group.column("n").combine_chunks(), pa.array(found / math.log(10))], ["hash", "n", "logz"])

    limit = frequent_limit(words)
    table = words.where(F.col("n") >= limit).mapInArrow(forward, "hash long, n long, logz double").toArrow()
    hashes = table.column("hash").to_numpy()
    order = np.argsort(hashes)
    top = spark.sparkContext.broadcast((hashes[order], np.log10(table.column("n").to_numpy()[order] + 0.1) - down, table.column("logz").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what frequent words say, and one for each other word of it."""
        known, base, logz = top.value
        for batch in batches:
            for low, high, part in text_buffers(batch.column(1), 8 * BUFFER):
                hashed, doc, _, _, _ = words_of(part, INK, lower=True)
                size = len(part)
                own = np.concatenate([hashed.view(np.int64), np.full(size, END)])
                doc = np.concatenate([doc, np.arange(size)])
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                sums = [np.bincount(doc[hit], x, size) for x in (base[at[hit]], logz[at[hit]])]
                tokens, seen = np.bincount(doc, minlength=size), np.bincount(doc[hit], minlength=size)
                with np.errstate(over="ignore"):
                    pair = np.stack([doc[~hit], own[~hit]], 1)
                    order = np.argsort(mix(pair[:, 1].view(U64) + pair[:, 0].astype(U64) * U64(0x9E3779B97F4A7C15)), kind="stable")
                pair = pair[order]
                fresh = np.ones(len(pair), bool)
                fresh[1:] = (pair[1:] != pair[:-1]).any(1)
                times = np.diff(np.append(np.flatnonzero(fresh), len(pair)))
                pair = pair[fresh]
                marks = text_marks(part)
                rows = np.concatenate([np.arange(size), pair[:, 0]])
                none = np.zeros(len(pair))
                ids = batch.column(0).take(pa.array(rows + low))
                names = np.array([zlib.crc32(str(x).encode()) for x in batch.column(0).slice(low, size).to_pylist()], np.int64)
                spread = mix((marks ^ (names << 20)).view(U64)).view(np.int64)  # text rows meet no word: spread, copies too
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(marks[rows]),
                        pa.array(np.concatenate([spread, pair[:, 1]])),
                        pa.array(np.concatenate([np.zeros(size, np.int64), times])),
                        pa.array(np.concatenate([tokens, none.astype(np.int64)])),
                        pa.array(np.concatenate([seen, none.astype(np.int64)])),
                        pa.array(np.concatenate([sums[0], none])),
                        pa.array(np.concatenate([sums[1], none])),
                    ],
                    ["key", "mark", "hash", "times", "tokens", "known", "base", "logz"],
                )

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    left = texts.mapInArrow(look_up, f"key {kind}, mark long, hash long, times long, tokens long, known long, base double, logz double")
    rest = words.where((F.col("n") < limit)).mapInArrow(forward, "hash long, n long, logz double").select("hash", F.col("n").alias("c"), F.col("logz").alias("z"))
    met = left.join(rest, "hash", "left")
    word = F.col("times") > 0
    out = met.groupBy("key", "mark").agg(
        F.count_if(~word).alias("copies"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(word, F.when(F.col("c") > 0, F.col("times")).otherwise(0)).otherwise(F.col("known"))).alias("known"),
        F.sum(F.when(word, F.col("times") * (F.log10(F.col("c") + 0.1) - down)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(word, F.col("times") * F.col("z")).otherwise(F.col("logz"))).alias("score"),
    )
    each = lambda c: (F.col(c) / F.col("copies")).cast("long")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("key").alias(key), each("tokens").alias("n_tokens"), each("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
