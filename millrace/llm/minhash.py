"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

*Signatures.*  An element (hashed five-word shingle) of weight w owns the region [0, w) x [0, inf)
of a plane (weight x rank).  Darts are thrown into it by hashing: the weight axis is cut into
units, the rank axis into doubling strips, a strip into cells of area 1/2 at most, and each unit
and cell holds a Poisson number of darts given by its hash.  A dart has a place in its unit (of an
element's last unit only those within the weight count), a coordinate and a rank; a signature keeps
the earliest dart for each coordinate.  A document reads strips only until it has about k ln k + 2k
darts, so long documents look at a few low strips and the cost is linear in their elements.  Two
documents agree on a coordinate with the probability of their weighted Jaccard similarity.  Weights
are 1 (the default: the plain similarity of shingle sets), or any function of how often a shingle
occurs in the text, such as ``repeated``.

*Classes.*  Texts of equal words (a 128-bit cryptographic digest) are one node.  Signatures of nodes
are cut into bands; nodes that share a band meet in a bucket.  A bucket never lists its pairs as
rows.  Each node is first verified against one hub: of its buckets' pivots, the one that meets most
others over all bands.  Then only buckets that hold several labels matter: what lies outside a
bucket's main label is compared with all of the bucket.  That is done in blocks of at most about
``CHUNK`` such nodes and ``CHUNK`` members, so a hot bucket is spread over many tasks, and on
sizes, what both share with their hub, and bitmaps of the shingles: these rule out pairs that
cannot reach the similarity, exactly, and only what is left becomes pairs and fetches texts.  Where
more than ``AT_ONCE`` nodes lie outside, rounds take a hashed part of them first (``HEADS``, then
``GROWTH`` times as many, and so on), so that most have merged before the last round takes all that
are left.  No two nodes of a bucket stay unlinked unless they were verified or ruled out.  Verified
links are merged into components at the end (and between rounds).

Verification is exact: the Jaccard similarity of the shingle sets, ``SIMILARITY`` or more.  A text
of fewer than five words has one shingle, all its words.  Words are those of the text in lower
case, without punctuation.  By the bands, a pair of similarity 0.8 is found with probability 0.9998,
one of 0.9 with 1 - 1e-7; pairs below 0.8 are no near duplicates.

Null, empty and wordless texts are nobody's duplicate: each such row is a class of its own.  Each row
is a document, told apart by doc_id and text: different texts under one doc_id may be in different
classes, rows with a null doc_id are in classes like others, and repeated rows come back as often.
A class is named by its least doc_id (null if it has none).  A very long text is hashed whole, alone
in its buffer.  Other columns are not read by ``classes`` and may have any names.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.core import BASE, BUFFER, U64, WORD, Tables, digest, free_name, mix, text_buffers, word_grams, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
CELL = 0.5
FIRST = 2.0**-6  #: end of the lowest strip of ranks
PAIRS = 1 << 17  #: units and cells, or nodes and members, that one numpy pass looks at
CHUNK = 1024  #: nodes of one side of a block
BLOCK = 1 << 18  #: bytes of texts that one group compares with a hub
AT_ONCE = 1024  #: nodes outside a bucket's main label that one round takes
HEADS, GROWTH = 16, 64  #: nodes that the first round takes where there are more, and how many times more each further one
BITS = 32  #: 64-bit words of the bitmap of a text's shingles

Weights = Callable[[np.ndarray], np.ndarray]


def repeated(times: np.ndarray) -> np.ndarray:
    """Weight of a shingle that occurs so often: 1, and more slowly more."""
    return 1.0 + np.log(times)


def cell(strip: int, part: int) -> tuple[float, float]:
    """Lower end and height of a cell of the rank axis."""
    low = 0.0 if strip == 0 else FIRST * 2.0 ** (strip - 1)
    height = FIRST if strip == 0 else low
    n = cells(strip)
    return low + height / n * part, height / n


def cells(strip: int) -> int:
    height = FIRST if strip == 0 else FIRST * 2.0 ** (strip - 1)
    return max(1, int(np.ceil(height / CELL)))


def poisson_cuts(mean: float) -> np.ndarray:
    """Where a uniform number passes from one Poisson number to the next."""
    term, steps = np.exp(-mean), []
    for i in range(1, 24):
        steps.append(term)
        term *= mean / i
    return np.cumsum(steps)


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def signatures(units: np.ndarray, doc: np.ndarray, n_docs: int, k: int = COORDINATES, room: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart's hash for each document and coordinate (documents without units: 0).

    units: 64-bit ids of units of weight (distinct within a document), doc: their documents, room:
    how much of each unit the element's weight fills (None: all of it).
    """
    room = np.ones(len(units)) if room is None else room
    size = np.bincount(doc, room, minlength=n_docs)
    best = np.full(n_docs * k, np.inf)
    kept = np.zeros(n_docs * k, U64)
    want = (k * np.log(k) + 2 * k) / np.maximum(size, 1e-9)
    last = np.maximum(0, np.ceil(np.log2(want / FIRST))).astype(int)
    last[size == 0] = -1
    strip = 0
    while len(units):
        parts, count = cells(strip), len(units)
        low, height = cell(strip, 0)
        cuts = poisson_cuts(height)
        salts = mix(np.arange(1, parts + 1, dtype=U64) + U64(strip * 1_000_003))
        step = max(1, PAIRS // count)
        for begin in range(0, parts, step):  # some cells at once, for all units that still read
            salt = salts[begin : begin + step]
            u = uniform(mix((units ^ salt[:, None]).ravel()))
            hit = np.flatnonzero(u > cuts[0])
            number = np.searchsorted(cuts, u[hit])
            thrown = 0
            while len(hit):
                part, at = np.divmod(hit, count)
                with np.errstate(over="ignore"):
                    dart = mix(units[at] * U64(BASE) ^ mix(salt + U64(thrown))[part])
                slot = doc[at] * k + (dart % U64(k)).astype(np.int64)
                rank = low + height * (begin + part + uniform(mix(dart)))
                better = (rank < best[slot]) & (uniform(mix(dart ^ U64(BASE))) < room[at])
                slot, rank, dart = slot[better], rank[better], dart[better]
                np.minimum.at(best, slot, rank)
                first = best[slot] == rank
                kept[slot[first]] = dart[first]
                thrown += 1
                more = number > thrown
                hit, number = hit[more], number[more]
        strip += 1
        reading = ~(np.isfinite(best.reshape(n_docs, k)).all(1) & (last < strip))[doc]
        units, doc, room = units[reading], doc[reading], room[reading]
    return kept.reshape(n_docs, k)


def counted(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (gram, document) and how often each occurs."""
    with np.errstate(over="ignore"):
        own = mix(grams) ^ (doc.astype(U64) + U64(1)) * U64(BASE)
    order = np.argsort(own, kind="stable")
    own = own[order]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else order
    return grams[order[begin]], doc[order[begin]], np.diff(np.append(begin, len(own)))


def weight_units(grams: np.ndarray, doc: np.ndarray, times: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, documents, room) of distinct grams: each gram has as many units as its weight, rounded up."""
    weight = weights(times)
    n = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(grams)), n)
    i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return grams[at] ^ mix(i.astype(U64)) * (i > 0), doc[at], np.minimum(1.0, weight[at] - i)


def shingles(texts: list[bytes], k: int = SHINGLE):
    """(grams, their documents, words of each text, digest of each text's words)."""
    hashes, doc, _, start, end = words_of(texts, WORD, lower=True)
    n_words = np.bincount(doc, minlength=len(texts))
    grams, ok = word_grams(hashes, doc, k)
    grams, of = grams[ok], doc[: len(ok)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if not len(short):
        return grams, of, n_words
    first = np.searchsorted(doc, short)
    whole = np.array([np.bitwise_xor.reduce(mix(hashes[i : i + n] ^ mix(np.arange(n, dtype=U64)))) for i, n in zip(first, n_words[short], strict=True)], U64)
    return np.concatenate([grams, mix(whole)]), np.concatenate([of, short]), n_words


def identities(texts: list[bytes]) -> np.ndarray:
    """A 128-bit digest of each text's words, as two numbers."""
    out = np.zeros((len(texts), 2), np.int64)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        word = WORD[raw]
        kept = word.copy()
        kept[1:] |= word[:-1]  # each word, and one byte behind it
        body = np.where(word, raw, 0x20)[kept].astype(np.uint8).tobytes().rstrip(b" ")
        out[i] = np.frombuffer(digest(body, 16), np.int64)
    return out


def bitmaps(grams: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """``BITS`` 64-bit words a document; each shingle sets one bit."""
    out = np.zeros((n_docs, BITS), U64)
    bit = mix(grams ^ U64(BASE)) % U64(64 * BITS)
    np.bitwise_or.at(out, (doc, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return out


def lists(wide: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1]), pa.array(wide.view(np.int64).ravel()))


def signature_batches(weights: Weights | None, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = 0
        for batch in batches:
            for low, high, texts in text_buffers(batch.column(2), 4 * BUFFER, lower=True):
                n = high - low
                grams, of, n_words = shingles(texts)
                grams, of, times = counted(grams, of)
                units, doc, room = weight_units(grams, of, times, weights) if weights else (grams, of, None)
                found = signatures(units, doc, n, bands * rows, room)
                keys = np.zeros((n, bands), U64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = mix(keys * U64(BASE) + found[:, r::rows])
                own = identities(texts)
                for i in np.flatnonzero(n_words == 0):  # wordless texts meet no other: any number of their own
                    apart += 1
                    own[i] = np.frombuffer(digest(b"\xff%d" % apart, 16), np.int64)
                columns = [pa.array(n_words.astype(np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.bincount(of, minlength=n)), pa.array(np.fromiter(map(len, texts), np.int64, n)), lists(keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), batch.column(1).slice(low, n), *columns], ["doc_id", "raw", "n_words", "d1", "d2", "size", "n_bytes", "bands"])

    return run


def raw_digest(text: Column) -> Column:
    """What tells texts apart, byte for byte: SHA-256, null for null."""
    return F.unhex(F.sha2(text, 256))


def signed(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Weights | None = None, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, raw (digest of the text), n_words, d1, d2 (digest of its words), size (shingles), n_bytes
    and bands of each row."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc_id"), raw_digest(F.col(text)).alias("raw"), F.col(text).alias("text")).mapInArrow(
        signature_batches(weights, bands, rows), f"doc_id {kind}, raw binary, n_words long, d1 long, d2 long, size long, n_bytes long, bands array<long>"
    )


def compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, block, head, node, text) in order of a, block and head (first) to (a, b, similarity,
    common, bits): each text against that of its hub.  Only the hub's shingles are kept."""
    group, hub = None, np.zeros(0, U64)
    for batch in batches:
        a, block, head, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for low, high, texts in text_buffers(batch.column(4), 4 * BUFFER, lower=True):
            grams, of, _ = shingles(texts)
            grams, of, _ = counted(grams, of)
            order = np.lexsort((grams, of))
            grams, of = grams[order], of[order]
            cuts = np.searchsorted(of, np.arange(high - low + 1))
            bits = bitmaps(grams, of, high - low)
            out = []
            for i in range(high - low):
                own, at = grams[cuts[i] : cuts[i + 1]], low + i
                if head[at]:
                    group, hub = (a[at], block[at]), own
                    continue
                if group != (a[at], block[at]):
                    raise ValueError("a text came before that of its hub")
                near = np.searchsorted(hub, own)
                near[near == len(hub)] = 0
                both = int((hub[near] == own).sum()) if len(hub) else 0
                out.append((i, both / max(1, len(hub) + len(own) - both), both))
            rows = np.array([x[0] for x in out], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[low + rows]), pa.array(node[low + rows]), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int64()), lists(bits[rows])], ["a", "b", "similarity", "common", "bits"]
            )


def verify(pairs: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, similarity, common shingles, bitmap of b) of pairs (a, b, n_bytes of b), exactly.

    The texts of b travel to a's in blocks of about ``BLOCK`` bytes, so an a with many partners is
    spread over many groups, and its own text is sent once for each block.
    """
    sizes = tables.write(pairs.groupBy("a").agg(F.ceil(F.sum("n_bytes") / BLOCK).alias("blocks")))
    wide = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), "blocks")).alias("block"), F.lit(False).alias("head"), F.col("b").alias("node"))
    heads = wide.select("a", "block", F.lit(True).alias("head"), F.col("a").alias("node")).distinct()
    moved = wide.unionByName(heads).join(texts, "node").select("a", "block", "head", "node", "text")
    dealt = moved.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("head"))
    return dealt.mapInArrow(compare_batches, "a long, b long, similarity double, common long, bits array<long>")


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, class): the least node of each connected component of edges (a, b).

    Alternating large-star and small-star passes until only stars are left (no node has two links
    down, or one down and one up); each is a grouping by node, and the number of passes grows with
    the logarithm of a component's size.  A pass writes its
    links, so it is never run twice, and those of the pass before are removed.
    """
    tables = tables or Tables(edges.sparkSession)
    links, old = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), None
    while True:
        # large star: neighbours above a node go to the least of its neighbours and itself
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = tables.write(small)
        if old is not None:
            tables.drop(old)
        old = links
        ends = links.select(F.col("u").alias("k"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("k"), F.lit(0).alias("up")))
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 OR up = 1 AND n > 1").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("class"))


def lacks(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that row i of a has and row j of b has not."""
    out = np.zeros(len(i), np.int64)
    for w in range(BITS):
        out += np.bitwise_count(a[i, w] & ~b[j, w])
    return out


def may_link(o: dict[str, np.ndarray], m: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of o, rows of m) of different labels that sizes, a common hub and bitmaps leave possible.

    Two sets share at most the lesser part of a hub that either has, and the lesser rest.  Each bit
    that only one of two bitmaps has set stands for a shingle, at least, that the other lacks.
    """
    found = []
    share = similarity / (1 + similarity)
    step = max(1, PAIRS // max(1, len(m["node"])))
    for low in range(0, len(o["node"]), step):
        s = {k: v[low : low + step, None] for k, v in o.items() if k != "bits"}
        need = share * (s["size"] + m["size"]) - 1e-6  # shared shingles
        ok = (s["label"] != m["label"]) & (np.minimum(s["size"], m["size"]) >= need)
        ok &= (s["hub"] != m["node"]) & (m["hub"] != s["node"])  # verified before
        ok &= ~m["out"] | (s["node"] < m["node"])  # pairs of two outer nodes come up from either side
        by_hub = np.minimum(s["common"], m["common"]) + np.minimum(s["size"] - s["common"], m["size"] - m["common"])
        ok &= (s["hub"] != m["hub"]) | (by_hub >= need)
        i, j = np.nonzero(ok)
        need = need[i, j]
        i += low
        fits = o["size"][i] - lacks(o["bits"], m["bits"], i, j) >= need
        i, j, need = i[fits], j[fits], need[fits]
        fits = m["size"][j] - lacks(m["bits"], o["bits"], j, i) >= need
        i, j = i[fits], j[fits]
        found.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def block_batches(similarity: float):
    """Rows in order of block (a bucket's number, i, j) to pairs of nodes to verify."""
    names = ["node", "label", "size", "hub", "common", "n_bytes", "out", "head"]

    def pairs_of(rows: pa.Table) -> pa.RecordBatch | None:
        side = {c: rows.column(c).to_numpy() for c in names}
        side["bits"] = np.array(rows.column("bits").combine_chunks().flatten().to_numpy(), np.int64).view(U64).reshape(-1, BITS)
        o, m = ({k: v[side["head"] == own] for k, v in side.items()} for own in (True, False))
        i, j = may_link(o, m, similarity)
        x, y, n = o["node"][i], m["node"][j], m["n_bytes"][j]
        n = np.where(x < y, n, o["n_bytes"][i])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n)], ["a", "b", "n_bytes"]) if len(x) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = [rows.column(c).to_numpy() for c in ("band", "key", "i", "j")]
            edge = np.zeros(max(0, len(rows) - 1), bool)
            for k in key:
                edge |= k[1:] != k[:-1]
            cuts = np.concatenate(([0], np.flatnonzero(edge) + 1))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                out = pairs_of(rows.slice(low, high - low))
                if out is not None:
                    yield out
            held = rows.slice(cuts[-1])
        if held is not None and len(held):
            out = pairs_of(held)
            if out is not None:
                yield out

    return run


def open_pairs(member: DataFrame, label: DataFrame, facts: DataFrame, similarity: float, heads: int, tables: Tables) -> tuple[DataFrame, int]:
    """Pairs (a, b, n_bytes) of nodes of different labels that a bucket leaves to verify, and how many
    nodes outside the main label the largest bucket has that this round did not take whole."""
    now = member.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = now.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("band", "key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("parts"))
    main = tables.write(sizes.where("parts > 1").select("band", "key", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.m")).alias("left")))
    large = main.agg(F.max(F.when(F.col("left") > AT_ONCE, F.col("left")))).first()[0] or 0
    takes = F.when(F.col("left") <= AT_ONCE, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(float(heads)) / F.col("left")))
    rows = now.join(main, ["band", "key"]).join(facts, "node")
    rows = rows.withColumn("out", F.col("label") != F.col("main"))
    rows = rows.withColumn("takes", takes).withColumn("taken", F.col("out") & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.col("takes") * (1 << 30)))
    # blocks: the taken nodes in n_i chunks, all members in n_j
    n_i = F.greatest(F.lit(1), F.ceil(F.col("left") * F.col("takes") / CHUNK)).cast("int")
    n_j = F.ceil(F.col("all") / CHUNK).cast("int")
    own = F.xxhash64("node", F.lit(1))
    as_member = F.transform(F.sequence(F.lit(0), n_i - 1), lambda i: F.struct(i.alias("i"), F.pmod(own, n_j).cast("int").alias("j"), F.lit(False).alias("head")))
    as_head = F.transform(F.sequence(F.lit(0), n_j - 1), lambda j: F.struct(F.pmod(own, n_i).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("head")))
    places = F.when(F.col("taken"), F.concat(as_member, as_head)).otherwise(as_member)
    # with one round to come for every pair of outer nodes, one side suffices; else the other may not be taken
    both = F.col("out") & (F.col("takes") >= 1)
    blocks = rows.select("band", "key", "node", "label", "size", "hub", "common", "n_bytes", both.alias("out"), "bits", F.explode(places).alias("p")).select("band", "key", "p.i", "p.j", "p.head", "node", "label", "size", "hub", "common", "n_bytes", "out", "bits")
    dealt = blocks.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    found = dealt.mapInArrow(block_batches(similarity), "a long, b long, n_bytes long").groupBy("a", "b").agg(F.first("n_bytes").alias("n_bytes"))
    out = tables.write(found)
    tables.drop(main)
    return out, (0 if large <= heads else large)


def placed(df: DataFrame, key: str, text: str, similarity: float, weights: Weights | None) -> tuple[DataFrame, DataFrame]:
    """(rows, leads): the signed rows of df, and for each digest of words the leading row of its class
    (``lead``: nameless, doc_id, raw)."""
    tables = Tables(df.sparkSession)
    rows = tables.write(signed(df, key, text, weights))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "raw")).alias("lead")
    nodes = rows.where("n_words > 0").groupBy("d1", "d2").agg(lead, F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("n_bytes").alias("n_bytes"))
    nodes = tables.write(nodes.withColumn("node", F.monotonically_increasing_id()))
    each = nodes.select("node", "size", "n_bytes", F.posexplode("bands").alias("band", "key"))
    crowd = tables.write(each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    member = tables.write(each.join(crowd, ["band", "key"]))

    # texts of those nodes only that meet others; of equal rows one
    central = tables.write(member.groupBy("node").agg(F.sum("n").alias("met"), F.first("size").alias("size"), F.first("n_bytes").alias("n_bytes")))
    own = nodes.join(central.select("node"), "node").select("node", F.col("lead.doc_id").alias("own_id"), F.col("lead.raw").alias("own_raw"))
    bodies = df.select(F.col(key).alias("doc_id"), raw_digest(F.col(text)).alias("raw"), F.col(text).alias("text")).where("text IS NOT NULL")
    texts = tables.write(bodies.join(own, F.col("raw").eqNullSafe(F.col("own_raw")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).groupBy("node").agg(F.first("text").alias("text")))

    # each node and its hub, the most central of its buckets' pivots; who is the pivot of all its buckets is its own
    rank = F.struct("met", F.negative("node").alias("low"))
    pivot = tables.write(member.join(central.select("node", "met"), "node").groupBy("band", "key").agg(F.max(rank).alias("p")))
    hubs = member.join(pivot, ["band", "key"]).groupBy("node", "n_bytes").agg(F.max(F.when(F.negative("p.low") != F.col("node"), F.col("p"))).alias("p"))
    hubs = tables.write(hubs.select(F.coalesce(F.negative("p.low"), F.col("node")).alias("a"), F.col("node").alias("b"), "n_bytes"))
    checked = tables.write(verify(hubs, texts, tables))
    link = F.col("similarity") >= similarity
    edges = checked.where(link & (F.col("a") != F.col("b"))).select("a", "b")
    facts = checked.select(F.col("b").alias("node"), F.col("a").alias("hub"), "common", "bits")

    # labels for a start: the hub, or the hub's own one
    label = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    above = label.select(F.col("node").alias("label"), F.col("label").alias("above"))
    label = label.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    heads, tested = HEADS, None
    while True:
        pairs, left = open_pairs(member, label, facts, similarity, heads, tables)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        found = tables.write(verify(pairs, texts, tables).where(link).select("a", "b"))
        edges = edges.unionByName(found)
        merged = components(edges, tables)
        if not left:
            break
        label, heads = merged.withColumnRenamed("class", "label"), heads * GROWTH
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
    merged = merged.unionByName(merged.select(F.col("class").alias("node"), "class").distinct())
    leads = tables.write(nodes.select("node", "lead").join(merged, "node").groupBy("class").agg(F.min("lead").alias("first")))
    leads = merged.join(leads, "class").select("node", "first")
    leads = tables.write(nodes.join(leads, "node", "left").select("d1", "d2", F.coalesce("first", "lead").alias("lead")))
    tables.keep(rows, leads)
    return rows, leads


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weights: Weights | None = None) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of each row of df."""
    rows, leads = placed(df, key, text, similarity, weights)
    out = rows.select("doc_id", "d1", "d2").join(leads, ["d1", "d2"], "left")
    return out.select(F.col("doc_id").alias(key), F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weights: Weights | None = None) -> DataFrame:
    """The rows of df with one row of each class: that of the least doc_id (null last), then of the
    least digest of the text.  Of rows equal in both, one stays; which, if other columns differ, is
    decided by their hash.  Null, empty and wordless texts stay."""
    rows, leads = placed(df, key, text, similarity, weights)
    out = rows.where("n_words > 0").select("doc_id", "raw", "d1", "d2").join(leads, ["d1", "d2"])
    leads_it = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("raw") == F.col("lead.raw"))
    tables = Tables(df.sparkSession)
    judged = out.groupBy("doc_id", "raw").agg(F.max(leads_it).alias("leads"), F.count(F.lit(1)).alias("n"))
    marks = tables.write(judged.where("NOT leads OR n > 1"))
    own, raw = free_name("row_id", df), free_name("row_digest", df)
    marks = marks.select(F.col("doc_id").alias(own), F.col("raw").alias(raw), "leads")
    same = lambda m: df[key].eqNullSafe(m[own]) & (raw_digest(df[text]) == m[raw])
    kept = df.join(marks, same(marks), "left_anti")
    again = marks.where("leads").drop("leads")
    if again.isEmpty():
        return kept
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias(own), raw_digest(F.col(text)).alias(raw))
    whole = whole.join(again.select(F.col(own).alias("_id"), F.col(raw).alias("_raw")), F.col(own).eqNullSafe(F.col("_id")) & (F.col(raw) == F.col("_raw")))
    one = whole.groupBy(own, raw).agg(F.min_by("row", F.xxhash64(*[f"row.`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()])).alias("row"))
    return kept.unionByName(one.select("row.*"))
