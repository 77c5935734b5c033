"""Secret scans: known patterns, and sliding-window entropy over candidate strings.

Base kinds are patterns (``assign``, ``access``, ``hex``), leftmost and non-overlapping for each
kind.  The method adds kind ``entropy``: candidate strings are runs of token characters; a window
of ``WINDOW`` characters slides over each, its Shannon entropy kept up to date by incremental
counts, and stretches of windows above their character class's threshold become a span, unless
the allow list suppresses it or a base span already holds it.

Offsets are code points, ends exclusive.  Null texts count as empty: no spans.  Rows are scanned
one by one, so repeated rows repeat; other columns pass through, and columns of the input that
bear a result's name are replaced.  A very long text takes time in proportion to its length, also
if it is full of secrets.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
#: The base kinds' patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits a character in a window, by character class of the candidate.
THRESHOLD = {"hex": 3.0, "lower": 3.5, "upper": 3.5, "mixed": 3.6, "token": 3.7}
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("lower", re.compile(r"[a-z0-9]+")), ("upper", re.compile(r"[A-Z0-9]+")), ("mixed", re.compile(r"[A-Za-z0-9]+")))
#: The allow list, for parts between / and = of a candidate: numbers, identifiers, placeholders and
#: samples from manuals; and words, also run together, with up to four digits behind each.
ALLOW = re.compile(r"[0-9+_-]*|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
SAMPLE = re.compile(r"[Ee]xample|EXAMPLE|placeholder|changeme|your[_-]")
WORD = re.compile(r"([A-Za-z]*)[0-9]{0,4}")
HUMP = re.compile(r"[a-z][A-Z]")
LETTERS = 6  #: words run together change to a capital once in so many letters at most; random letters do in four
PART = re.compile(r"[^/=]+")
#: A hexadecimal digest that the text announces as such is public.
ANNOUNCED = re.compile(r"\b(?:sha[0-9]*|md5|commit|checksum|integrity)\b[-:= ]*$", re.IGNORECASE)
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def character_class(candidate: str) -> str:
    return next((name for name, kind in CLASSES if kind.fullmatch(candidate)), "token")


def allowed(part: str) -> bool:
    if ALLOW.fullmatch(part) or SAMPLE.search(part):
        return True
    words = [WORD.fullmatch(x) for x in re.split("[+_-]+", part)]
    return all(w and len(HUMP.findall(w.group(1))) <= max(1, len(w.group(1)) // LETTERS) for w in words)


def suspect(candidate: str) -> tuple[int, int]:
    """The stretch from the first to the last part that the allow list does not know."""
    parts = [m.span() for m in PART.finditer(candidate) if not allowed(m.group())]
    return (parts[0][0], parts[-1][1]) if parts else (0, 0)


def hot_stretches(candidate: str, threshold: float) -> list[tuple[int, int]]:
    """Merged stretches of windows whose entropy reaches the threshold."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= WINDOW:
            old = candidate[i - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if i >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= threshold:
            low = i - WINDOW + 1
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((low, i + 1))
    return out


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all secrets, in that order."""
    text = text or ""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(out)
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        low_, high = suspect(m.group())
        word = m.group()[low_:high]
        if len(word) < WINDOW:
            continue
        kind, at = character_class(word), m.start() + low_
        if kind == "hex" and ANNOUNCED.search(text[max(0, at - 24) : at]):
            continue
        for a, b in hot_stretches(word, THRESHOLD[kind]):
            a, b = a + at, b + at
            before = bisect.bisect_right(starts, a)
            if not before or reach[before - 1] < b:  # no base span holds it
                out.append((a, 3, b))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
RESULT = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with counts of each kind, the digest of the base spans, and all spans."""
    kept = df.drop(*[f.name for f in RESULT])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(x) for x in batch.column(at).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in spans) for spans in found], pa.int64()) for i in range(len(KINDS))]
            digests = [hashlib.sha256(shown([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(digests, pa.string()), pa.array([shown(x) for x in found], pa.string())], [*batch.schema.names, *(f.name for f in RESULT)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *RESULT]))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input with secrets in the text replaced; rows and columns stay as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if not x or not (spans := find(x)) else redacted(x, spans, mark) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)
