"""Vectorised byte and word helpers that the task-side code of several operators shares.

Everything here works on one bounded buffer at a time (see ``buffers``), so a task's memory
does not depend on the length of a document or the number of documents it reads.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BUFFER = 1 << 18  #: bytes that one numpy pass looks at
GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + GOLD
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
        return x ^ (x >> U64(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo 2**64, and their inverses."""
    up = np.full(n, base, U64)
    down = np.full(n, pow(base, -1, 1 << 64), U64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Roller:
    """Hashes of any spans of a buffer of bytes or of 64-bit symbols, in a few numpy passes.

    The hash of a span is the sum of its symbols times rising powers of an odd base, scaled back
    to the span's start: equal spans have equal hashes wherever they stand.
    """

    def __init__(self, size: int = BUFFER + 4096):
        self.up, self.down = powers(size)
        self.table = mix(np.arange(256, dtype=U64) * U64(0x632BE59BD9B4E019))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        if len(symbols) >= len(self.up):
            self.up, self.down = powers(2 * len(symbols))
        out = np.zeros(len(symbols) + 1, U64)
        values = self.table[symbols] if symbols.dtype == np.uint8 else symbols
        np.cumsum(values * self.up[: len(symbols)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k-symbol windows (not mixed across documents: the caller masks those)."""
        n = len(sums) - 1 - k + 1
        return mix((sums[k:] - sums[: len(sums) - k]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def byte_class(spec: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


#: bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text in lower case
WORD = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: bytes of the words [^\x20\x09-\x0D]+
INK = ~byte_class(bytes([0x20, *range(0x09, 0x0E)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def buffers(texts: list[bytes], size: int = BUFFER) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fill a buffer of about the given size; a longer text stands alone."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > size:
            yield begin, i
            begin, total = i, 0
        total += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


#: keeps the first 0 to 8 bytes of a little-endian number
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=object).astype(U64)
EIGHTS = 64  #: longer words, in bytes, are hashed one by one


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of spans of a buffer: eight bytes at a time are mixed in, so no two words of one
    length and up to eight bytes share a hash; long words go through a cryptographic hash.  Hashes of
    different salts are independent."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    out = mix(length.astype(U64) ^ U64(BASE) ^ mix(np.array([salt], U64)))
    for j in range(0, EIGHTS, 8):
        at = np.flatnonzero(length > j)
        if not len(at):
            break
        out[at] = mix(out[at] ^ (view[start[at] + j] & FIRST_BYTES[np.minimum(8, length[at] - j)]))
    for i in np.flatnonzero(length > EIGHTS):
        out[i] ^= U64(digest(b"%d " % salt + raw[start[i] : end[i]].tobytes()))
    return out


def digest(text: bytes, size: int = 8) -> int | bytes:
    """A cryptographic hash of the text: a number for 8 bytes, else the bytes."""
    found = hashlib.blake2b(text, digest_size=size).digest()
    return int.from_bytes(found, "little") if size == 8 else found


def text_marks(texts: list[bytes]) -> np.ndarray:
    """Such a number for each text, as a long."""
    return np.array([digest(t) for t in texts], U64).view(np.int64)


def words_of(texts: list[bytes], kind: np.ndarray, lower: bool = False):
    """Words of several texts at once.

    Returns (hash, doc, index in the document, byte start, byte end) arrays over all words; byte
    offsets count from the joined buffer's start, where a newline ends each text.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        raw = LOWER[raw]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    start, end = runs(kind[raw])
    hashes = word_hashes(raw, start, end)
    doc = np.searchsorted(np.cumsum(lengths), start, side="right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    return hashes, doc, np.arange(len(doc)) - first[doc], start, end


def word_grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one document."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * U64(BASE) + hashes[j : j + n]
    return mix(out), doc[:n] == doc[k - 1 : k - 1 + n]


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_buffers(column, size: int = BUFFER, lower: bool = False) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, their texts as bytes, null as empty) of a text column.

    A buffer of about ``size`` bytes at a time, or one longer text, becomes Python objects.
    """
    lengths = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths + 1)
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        part = column.slice(low, high - low)
        yield low, high, [x.lower().encode("utf-8", "surrogatepass") if x else b"" for x in part.to_pylist()] if lower else text_bytes(part)
        low = high


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs: the session's ``spark.checkpoint.dir``.  Only a session on
    one machine may do without, and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


class Tables:
    """Tables written once to the shared folder: later reads survive lost executors, read only the
    columns they need, and know the table's size."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            remove(self.spark, self.paths.pop(id(table))[1])

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all others."""
        self.drop(*(t for t, _ in list(self.paths.values()) if not any(t is k for k in tables)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    return Tables(df.sparkSession).write(df)


def free_name(name: str, df: DataFrame) -> str:
    """The name, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tasks(df: DataFrame) -> int:
    """Partitions for an explicit exchange: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
