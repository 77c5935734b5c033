"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier is removed.  Strings
are judged on the input: copies may overlap, and what is removed from one text does not change
the judgement of another.

*Dealing suffixes to buckets.*  Suffixes need comparing only up to ``LENGTH`` bytes.  A suffix goes
to the bucket of its prefix's anchor: the ``GRAM``-byte gram of least hash in the prefix.  Equal
prefixes have equal anchors, and neighbouring suffixes mostly share one, so they travel together
as a piece of text (``LENGTH`` to ``LENGTH + WINDOW - 1`` bytes) instead of one by one; before
that, only the anchor's and the piece's hashes travel.  A piece that occurs more than once is
settled there and then: all but its first occurrence repeat.  Buckets with one distinct piece
hold nothing else to compare.  Only pieces of the remaining buckets are fetched and sorted.
A bucket of over ``HOT`` distinct pieces (a frequent line in many contexts) is split: its suffixes
are dealt again, ``SPLIT`` groups a piece, by the bytes that all suffixes of a group share.  Equal
groups are repeats of the first one, byte for byte: a task settles those it makes itself before they
travel, and the rest settle as they arrive in order, so a passage in any number of texts is held once.
A group bucket that still has more than ``FULL`` bytes of different pieces is dealt a last time, each
suffix alone by a 128-bit digest of its ``LENGTH`` bytes, and settled by that.

*Sorting a bucket.*  A task takes one block of buckets at a time (``BLOCK`` bytes, or one bucket of
at most ``FULL``).  In the block's text, suffixes at positions whose residue modulo ``PERIOD`` lies in a difference
cover are ranked first, by prefix doubling.  The block's suffixes are sorted by their first
``PERIOD`` bytes; ties are resolved without looking at more text, by the ranks of the two cover
positions at the same distance from both, in a three-way partition of all tied stretches at once.
Neighbours in the suffix array with ``LENGTH`` common bytes form a class, and all but the class's
first place (doc_id, then start) are repeats.

Memory in a task is bounded by ``FULL``; a repeated piece costs one row a batch and occurrence
list, never a pair.  Pieces that are settled before they travel are told apart by two 64-bit hashes.

Null and empty texts, and texts shorter than ``LENGTH`` bytes, lose nothing.  Rows with one doc_id
and equal texts are one document, given back as often as they occur; different texts under one
doc_id share the spans found under it.  Rows with a null doc_id are judged as one document
number too, that of a null, which counts as the last.  Very long texts are cut into parts that
overlap.  Other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.core import BUFFER, U64, Roller, digest, mix, text_bytes, text_buffers

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
PERIOD = 32
HOT = 256
SPLIT = 8
BLOCK = 1 << 19
FULL = 1 << 21  #: bytes of different pieces that one bucket may have to be sorted
PLACE_BITS = 18  #: BUFFER is 2**18
LAST = np.iinfo(np.int64).max  #: number of a null doc_id
PACK = 512  #: start * PACK + length; a piece is shorter than that


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of the given width."""
    n = len(values) - width + 1
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def anchored(raw: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, roller: Roller):
    """Pieces of a buffer of parts: (start, end, anchor's hash, piece's hash, anchor's place)."""
    sums = roller.sums(raw)
    grams = roller.grams(sums, GRAM)
    low_bits = U64((1 << PLACE_BITS) - 1)
    order = (grams & ~low_bits) | np.arange(len(grams), dtype=U64)
    place = (sliding_min(order, WINDOW) & low_bits).astype(np.int64)
    valid = np.zeros(len(place), bool)
    for o, n in zip(offsets, lengths, strict=True):
        valid[o : o + n - LENGTH + 1] = True
    at = np.flatnonzero(valid)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(fresh)
    start = at[begin]
    end = at[np.append(begin[1:], len(at)) - 1] + LENGTH
    return start, end, grams[place[start]], roller.spans(sums, start, end), place[start]


def parts(texts: list[bytes], size: int = BUFFER) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(document, offset in it, bytes) parts that fill a buffer; parts of a long text overlap by LENGTH - 1 bytes."""
    docs, at, out, total = [], [], [], 0
    for i, text in enumerate(texts):
        for low in range(0, max(0, len(text) - LENGTH + 1), size - LENGTH + 1):
            part = text[low : low + size] if len(text) > size else text
            if total + len(part) > size and out:
                yield docs, at, out
                docs, at, out, total = [], [], [], 0
            docs.append(i)
            at.append(low)
            out.append(part)
            total += len(part)
    if out:
        yield docs, at, out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, sorted, with overlapping and touching ones merged."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.zeros(len(doc), np.int64)
    group[1:] = np.cumsum(doc[1:] != doc[:-1])
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(reach, at)


def numbers(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, content, doc, at) of pieces; those that an earlier one of the batch equals are repeats
    already: (a spread number, length, doc, start * PACK)."""
    roller = Roller()
    for batch in batches:
        ids = numbers(batch.column(0))
        order = np.argsort(ids, kind="stable")
        texts = text_bytes(batch.column(1))
        texts = [texts[i] for i in order]
        ids = ids[order]
        found = []
        for docs, at, bodies in parts(texts):
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
            offsets = np.cumsum(lengths) - lengths
            start, end, anchor, content, _ = anchored(raw, offsets, lengths, roller)
            part = np.searchsorted(offsets, start, side="right") - 1
            found.append((anchor, content, ids[np.array(docs)][part], np.array(at)[part] + start - offsets[part], end - start))
        if not found:
            continue
        anchor, content, doc, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(mix(anchor) ^ content, kind="stable")
        same = np.zeros(len(by), bool)
        same[1:] = (anchor[by[1:]] == anchor[by[:-1]]) & (content[by[1:]] == content[by[:-1]])
        head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
        own = (doc[by] == doc[head]) & (start[by] == start[head])
        again = np.sort(by[same & ~own])
        first = np.sort(by[~same])
        d, s, e = merged(doc[again], start[again], start[again] + length[again])
        yield batch_of(
            bucket=np.concatenate([anchor[first].view(np.int64), mix(d.view(U64) ^ s.view(U64)).view(np.int64)]),
            content=np.concatenate([content[first].view(np.int64), e - s]),
            doc=np.concatenate([doc[first], d]),
            at=np.concatenate([start[first] * PACK + length[first], s * PACK]),
        )


def settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (bucket, content, doc, at) to (doc, start, length, kind, bucket).

    kind 1: a repeat; 2: a piece to compare in its bucket; 3: the same, of a hot bucket.  What is
    kept between batches: the last run's first place, and up to HOT pieces of the last bucket.
    """
    last = None  # bucket, content, doc and at of the first row of the last run
    held = [np.zeros(0, np.int64)] * 4
    hot = None

    def rows(doc, at, kind, bucket):
        return batch_of(doc=doc, start=at // PACK, length=at % PACK, kind=np.full(len(doc), kind, np.int32), bucket=bucket)

    def closed(group):
        bucket, _, doc, at = group
        many = np.zeros(len(bucket), bool)
        many[1:] = bucket[1:] == bucket[:-1]
        many[:-1] |= many[1:]
        return rows(doc[many], at[many], 2, bucket[many])

    for batch in batches:
        bucket, content, doc, at = (batch.column(i).to_numpy() for i in range(4))
        done = at % PACK == 0
        if done.any():
            yield batch_of(doc=doc[done], start=at[done] // PACK, length=content[done], kind=np.full(int(done.sum()), 1, np.int32), bucket=bucket[done])
            bucket, content, doc, at = bucket[~done], content[~done], doc[~done], at[~done]
        if not len(bucket):
            continue
        if last is not None:
            bucket, content, doc, at = (np.concatenate(([x], y)) for x, y in zip(last, (bucket, content, doc, at), strict=True))
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (content[1:] != content[:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(bucket)), 0))
        again = ~fresh & ((doc != doc[head]) | (at != at[head]))
        if again.any():
            yield rows(doc[again], at[again], 1, bucket[again])
        new = fresh.copy()
        new[0] = last is None
        last = tuple(x[head[-1]] for x in (bucket, content, doc, at))
        group = [np.concatenate((x, y[new])) for x, y in zip(held, (bucket, content, doc, at), strict=True)]
        if hot is not None and len(group[0]):
            still = group[0] == hot
            if still.any():
                yield rows(group[2][still], group[3][still], 3, group[0][still])
                group = [x[~still] for x in group]
        if not len(group[0]):
            held = group
            continue
        cut = int(np.searchsorted(group[0], group[0][-1]))
        if cut:
            yield closed([x[:cut] for x in group])
        held = [x[cut:] for x in group]
        if len(held[0]) > HOT:
            hot = held[0][0]
            yield rows(held[2], held[3], 3, held[0])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield closed(held)


def fetch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, list of settled rows) to (bucket, doc, start, length, bytes); bytes are null for repeats."""
    roller = Roller()
    names = ["bucket", "doc", "start", "length", "bytes"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.binary())], names)

    for batch in batches:
        rows = []
        ids = numbers(batch.column(0))
        for low, high, texts in text_buffers(batch.column(1), 16 * BUFFER):
            for doc, text, spans in zip(ids[low:high].tolist(), texts, batch.column(2).slice(low, high - low).to_pylist(), strict=True):
                for span in spans or ():
                    start, length, kind, bucket = span["start"], span["length"], span["kind"], span["bucket"]
                    if kind == 1:
                        rows.append((bucket, doc, start, length, None))
                    elif kind == 2:
                        rows.append((bucket, doc, start, length, text[start : start + length]))
                    else:
                        rows += [(b, doc, start + lo, n, text[start + lo : start + lo + n]) for b, lo, n in split_piece(text[start : start + length], roller)]
                if len(rows) > 50_000:
                    yield out(settled_here(rows))
                    rows = []
        if rows:
            yield out(settled_here(rows))


def settled_here(rows: list[tuple]) -> list[tuple]:
    """The same rows; of equal pieces all but the first lose their bytes, as they repeat it.  Of rows
    that are one piece of one document, one stays."""
    first: dict[tuple[int, bytes], tuple[int, int]] = {}
    for bucket, doc, start, _, body in rows:
        if body is not None:
            first[bucket, body] = min(first.get((bucket, body), (doc, start)), (doc, start))
    out, seen = [], set()
    for row in rows:
        bucket, doc, start, length, body = row
        if body is None or first[bucket, body] == (doc, start):
            if body is None or (bucket, doc, start, length) not in seen:
                out.append(row)
            seen.add((bucket, doc, start, length))
        else:
            out.append((int(mix(np.array([doc * PACK + start], np.int64).view(U64)).view(np.int64)[0]), doc, start, length, None))
    return out


def split_piece(piece: bytes, roller: Roller) -> list[tuple[int, int, int]]:
    """(bucket, offset, length) of groups of the piece's suffixes.

    A suffix is placed by how far into it the anchor lies, which is the same for equal suffixes;
    a group takes neighbouring distances, and its bucket is the hash of the bytes that all
    distances of the group have around the anchor.
    """
    raw = np.frombuffer(piece, np.uint8)
    if len(raw) < LENGTH:
        return []
    _, _, _, _, places = anchored(raw, np.array([0]), np.array([len(raw)]), roller)
    place = int(places[0])
    step = -(-WINDOW // SPLIT)
    sums = roller.sums(raw)
    out = []
    for lo in range(0, WINDOW, step):
        hi = min(WINDOW, lo + step) - 1  # the anchor stands lo to hi bytes into the suffix
        first, last = max(0, place - hi), min(len(raw) - LENGTH, place - lo)
        if first <= last:
            a, b = np.array([place - lo]), np.array([place - hi + LENGTH])
            key = roller.spans(sums, a, b) ^ mix(np.array([lo + 1], U64))
            out.append((int(key.view(np.int64)[0]), first, last - first + LENGTH))
    return out


def difference_cover(period: int) -> list[int]:
    """Residues whose differences take every value modulo period, found greedily."""
    cover, seen = [0], {0}
    while len(seen) < period:
        best = max(range(period), key=lambda x: len({(x - c) % period for c in cover} | {(c - x) % period for c in cover} | seen))
        seen |= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


def shifts(period: int, cover: list[int]) -> np.ndarray:
    """shift[i, j]: a distance below period that takes residues i and j both into the cover."""
    pair = {(b - a) % period: a for a in cover for b in cover}
    return np.array([[(pair[(j - i) % period] - i) % period for j in range(period)] for i in range(period)])


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows of keys, equal rows equal."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for k in keys:
        sorted_ = k[order]
        fresh[1:] |= sorted_[1:] != sorted_[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def eights(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers that sort like the bytes."""
    window = np.lib.stride_tricks.sliding_window_view(text, 8)[at]
    return np.ascontiguousarray(window).view(">u8").ravel().astype(U64)


class Block:
    """The suffix array of a block of text, for suffixes at the given positions, up to LENGTH bytes."""

    cover = difference_cover(PERIOD)
    shift = shifts(PERIOD, cover)

    def __init__(self, text: np.ndarray):
        self.text = np.concatenate([text, np.zeros(LENGTH + 8 * PERIOD, np.uint8)])
        inside = np.zeros(PERIOD, bool)
        inside[self.cover] = True
        n = len(text) + PERIOD
        sample = np.flatnonzero(np.resize(inside, n))
        self.rank = np.full(n + 4 * PERIOD, -1, np.int64)
        self.rank[sample] = dense([eights(self.text, sample + i) for i in range(0, PERIOD, 8)])
        depth = PERIOD
        while depth < LENGTH:  # residues repeat, so a sampled suffix's continuation is sampled too
            self.rank[sample] = dense([self.rank[sample], self.rank[sample + depth]])
            depth *= 2

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in suffix order, and for each whether it shares LENGTH bytes with the one before."""
        start = [eights(self.text, at + i) for i in range(0, PERIOD, 8)]
        first = dense(start)
        order = np.argsort(first, kind="stable")
        at, segment = at[order], first[order]
        settled = np.zeros(len(at), bool)
        while True:
            size = np.bincount(segment)
            begin = np.cumsum(size) - size
            rows = np.flatnonzero(((size > 1) & ~settled[: len(size)])[segment])
            if not len(rows):
                break
            seg = segment[rows]
            pivot = at[begin[seg] + size[seg] // 2]
            own = at[rows]
            by = self.shift[own % PERIOD, pivot % PERIOD]
            sign = np.sign(self.rank[own + by] - self.rank[pivot + by]) + 1
            key = np.full(len(at), 1, np.int64)
            key[rows] = sign
            key += 3 * segment
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            fresh = np.zeros(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            number = np.cumsum(fresh)
            settled = np.zeros(number[-1] + 1, bool)
            settled[number] = key % 3 == 1  # equal to a pivot, or finished before
            segment = number
        same = np.zeros(len(at), bool)
        view = np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)
        tied = np.flatnonzero(segment[1:] == segment[:-1]) + 1
        same[tied] = True  # equal in rank: LENGTH bytes and more
        first = first[np.argsort(first, kind="stable")]
        near = np.flatnonzero((segment[1:] != segment[:-1]) & (first[1:] == first[:-1])) + 1
        for low in range(0, len(near), 1 << 15):
            i = near[low : low + (1 << 15)]
            same[i] = (view[at[i]] == view[at[i - 1]]).all(1)
        return at, same


def repeats(pieces: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged intervals (doc, start, end) of the pieces' suffixes that also start earlier."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    offset = np.cumsum(lengths) - lengths
    count = np.maximum(0, lengths - LENGTH + 1)
    at = np.repeat(offset - np.cumsum(count) + count, count) + np.arange(count.sum())
    if not len(at):
        return doc[:0], start[:0], start[:0]
    at, same = Block(text).sort(at)
    part = np.searchsorted(offset, at, side="right") - 1
    d, s = doc[part], start[part] + at - offset[part]
    group = np.cumsum(~same)
    order = np.lexsort((s, d, group))
    d, s, group = d[order], s[order], group[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(group)), 0))
    again = (d != d[head]) | (s != s[head])
    return merged(d[again], s[again], s[again] + LENGTH)


def alone(pieces: list[bytes], doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """(doc, start, 0, k1, k2): each suffix of the pieces with a digest of its LENGTH bytes."""
    found = [(d, s + i, *np.frombuffer(digest(p[i : i + LENGTH], 16), np.int64).tolist()) for p, d, s in zip(pieces, doc.tolist(), start.tolist(), strict=True) for i in range(len(p) - LENGTH + 1)]
    d, s, k1, k2 = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ([],) * 4))
    return batch_of(doc=d, start=s, end=np.zeros(len(d), np.int64), k1=k1, k2=k2)


def done(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Intervals that are settled; their keys only spread them."""
    k1 = mix(doc.astype(np.int64).view(U64) ^ mix(start.astype(np.int64).view(U64))).view(np.int64)
    return batch_of(doc=doc, start=start, end=end, k1=k1, k2=np.zeros(len(doc), np.int64))


def sort_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket, bytes, doc and start to (doc, start, end, k1, k2): repeats, a block of
    whole buckets at a time, and suffixes of overfull buckets (end 0) to settle by their digest."""
    held: pa.Table | None = None
    last = None  # bucket, bytes, doc and start of the first of the latest equal pieces
    over = None  # the overfull bucket

    def sorted_(table: pa.Table) -> pa.RecordBatch:
        return done(*repeats(table.column("bytes").to_pylist(), table.column("doc").to_numpy(), table.column("start").to_numpy()))

    for batch in batches:
        null = batch.column(4).is_null()
        known = batch.filter(null)
        if known.num_rows:
            s = known.column(2).to_numpy()
            yield done(known.column(1).to_numpy(), s, s + known.column(3).to_numpy())
        batch = batch.filter(pc.invert(null))
        if not batch.num_rows:
            continue
        bucket, doc, start, length = (batch.column(i).to_numpy() for i in range(4))
        body = batch.column(4)
        same = np.zeros(len(bucket), bool)
        same[1:] = (bucket[1:] == bucket[:-1]) & pc.equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
        same[0] = last is not None and last[0] == bucket[0] and last[1] == body[0].as_py()
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(bucket))))
        first_doc, first_start = (np.where(head < 0, last[i] if last else 0, x[head]) for i, x in ((2, doc), (3, start)))
        again = same & ((doc != first_doc) | (start != first_start))
        if again.any():
            yield done(doc[again], start[again], start[again] + length[again])
        if head[-1] >= 0:
            i = int(head[-1])
            last = (bucket[i], body[i].as_py(), doc[i], start[i])
        table = pa.Table.from_batches([batch.filter(pa.array(~same))])
        if over is not None:
            still = table.column("bucket").to_numpy() == over
            if still.any():
                part = table.filter(pa.array(still))
                yield alone(part.column("bytes").to_pylist(), part.column("doc").to_numpy(), part.column("start").to_numpy())
                table = table.filter(pa.array(~still))
        held = table if held is None else pa.concat_tables([held, table])
        size = int(pc.sum(pc.binary_length(held.column("bytes"))).as_py() or 0)
        if size < BLOCK:
            continue
        key = held.column("bucket").to_numpy()
        total = np.cumsum(pc.binary_length(held.column("bytes")).to_numpy())
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1  # where another bucket begins
        low = 0
        while len(edges) and edges[-1] > low:
            want = total[low - 1] + BLOCK if low else BLOCK
            high = int(edges[min(int(np.searchsorted(total[edges - 1], want)), len(edges) - 1)])
            if high <= low:
                high = int(edges[np.searchsorted(edges, low, side="right")])
            yield sorted_(held.slice(low, high - low))
            low = high
        held = held.slice(low).combine_chunks()
        if int(pc.sum(pc.binary_length(held.column("bytes"))).as_py() or 0) > FULL:
            over = held.column("bucket")[0].as_py()
            yield alone(held.column("bytes").to_pylist(), held.column("doc").to_numpy(), held.column("start").to_numpy())
            held = None
    if held is not None and len(held):
        yield sorted_(held)


def last_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of k1, k2, doc and start to (doc, start, end): of suffixes with one digest all but the first repeat."""
    last = None
    for batch in batches:
        doc, start, end, k1, k2 = (batch.column(i).to_numpy() for i in range(5))
        open_ = np.flatnonzero(end == 0)
        out = [(doc[end > 0], start[end > 0], end[end > 0])]
        if len(open_):
            d, s, a, b = doc[open_], start[open_], k1[open_], k2[open_]
            if last is not None:
                d, s, a, b = (np.concatenate(([x], y)) for x, y in zip(last, (d, s, a, b), strict=True))
            fresh = np.ones(len(d), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
            again = (d != d[head]) | (s != s[head])
            last = tuple(x[head[-1]] for x in (d, s, a, b))
            out.append((d[again], s[again], s[again] + LENGTH))
        d, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
        yield batch_of(doc=d, start=s, end=e)


def result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, list of intervals) to the result's columns."""
    for batch in batches:
        out = []
        for text, spans in ((x, y) for low, high, texts in text_buffers(batch.column(1), 16 * BUFFER) for x, y in zip(texts, batch.column(2).slice(low, high - low).to_pylist(), strict=True)):
            low, kept, removed, count = 0, hashlib.sha256(), 0, 0
            end = None
            for s, e in sorted((x["start"], min(x["end"], len(text))) for x in spans or () if x["start"] < len(text)):
                if end is None or s > end:
                    kept.update(text[low:s])
                    count += 1
                    removed += e - s
                    low = end = e
                elif e > end:
                    removed += e - end
                    low = end = e
            kept.update(text[low:])
            out.append((len(text), removed, count, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents by number, repeats): the second has (doc, start, end) intervals that cover, without
    being merged, every byte to remove."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    by_doc = rows.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), "doc_id", "text").repartition("doc")
    pieces = rows.mapInArrow(piece_batches, "bucket long, content long, doc long, at long")
    settled = pieces.repartition("bucket").sortWithinPartitions("bucket", "content", "doc", "at").mapInArrow(settle_batches, "doc long, start long, length long, kind int, bucket long")
    lists = settled.groupBy("doc").agg(F.collect_list(F.struct("start", "length", "kind", "bucket")).alias("spans"))
    # all columns, as the last join reads them too: then Spark moves the texts only once
    fetched = by_doc.join(lists, "doc").select("doc", "text", "spans", "doc_id").mapInArrow(fetch_batches, "bucket long, doc long, start long, length long, bytes binary")
    found = fetched.repartition("bucket").sortWithinPartitions("bucket", "bytes", "doc", "start").mapInArrow(sort_batches, "doc long, start long, end long, k1 long, k2 long")
    return by_doc, found.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc", "start").mapInArrow(last_batches, "doc long, start long, end long")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of df."""
    by_doc, found = spans(df, key, text)
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return by_doc.join(lists, "doc", "left").select("doc_id", "text", "spans").mapInArrow(result_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
