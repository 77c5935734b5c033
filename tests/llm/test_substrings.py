import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from millrace.llm import substrings
from millrace.llm.substrings import LENGTH, Block


def brute(docs):
    """doc_id -> (n_bytes, n_removed, n_spans, digest), by a set of all strings seen so far."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            part = raw[i : i + LENGTH]
            if part in seen:
                mark[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(part)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[doc] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "érable", "and", "stone", "x", "über", "running", "1234"]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(k))
    line, passage = prose(8)[:60], prose(60)
    docs = []
    for i in range(n):
        kind = rng.randrange(8)
        text = prose(rng.randrange(0, 150))
        if kind == 1 and docs:
            text = docs[rng.randrange(len(docs))][1]
        elif kind == 2 and docs:
            old = (docs[rng.randrange(len(docs))][1] or "").split(" ")
            old[len(old) // 2] = "changed"
            text = " ".join(old)
        elif kind == 3:
            text = prose(10) + passage + prose(10)
        elif kind == 4:
            text = (line + " ") * 6
        elif kind == 5:
            text = "ab" * rng.randrange(0, 200)
        elif kind == 6:
            text = prose(5) + " " + line + " " + prose(20)
        docs.append((i * 37 % 8191 + 1000, text))
    docs += [(100, None), (101, ""), (102, "short"), (103, "z" * 100), (104, "z" * 99), (105, "z" * 700)]
    return docs


def test_block_order_matches_plain_sort():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:1400] = text[2000:2400]
    text[3000:3300] = 97
    at = np.arange(len(text) - LENGTH)
    order, same = Block(text).sort(at)
    raw = text.tobytes()
    parts = [raw[i : i + LENGTH] for i in order]
    assert parts == sorted(parts)
    assert same.tolist() == [False] + [a == b for a, b in zip(parts, parts[1:])]


def test_matches_brute_force(spark):
    docs = texts(1)
    df = spark.createDataFrame([Row(doc_id=d, text=t, bucket="clash") for d, t in docs]).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(df).collect()}
    assert got == brute(docs)


def locally(docs, rows=40):
    """The tasks' functions one after another in this process, where constants can be changed."""

    def run(f, table, *order):
        table = table.sort_by([(c, "ascending") for c in order]) if order else table
        return pa.Table.from_batches(list(f(iter(table.combine_chunks().to_batches(max_chunksize=rows)))))

    table = pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    settled = run(substrings.settle_batches, run(substrings.piece_batches, table), "bucket", "content", "doc", "at").to_pylist()
    spans = {}
    for r in settled:
        spans.setdefault(r.pop("doc"), []).append(r)
    fetched = run(substrings.fetch_batches, table.append_column("spans", pa.array([spans.get(d, []) for d, _ in docs])))
    found = run(substrings.last_batches, run(substrings.sort_batches, fetched, "bucket", "bytes", "doc", "start"), "k1", "k2", "doc", "start").to_pylist()
    spans = {}
    for r in found:
        spans.setdefault(r.pop("doc"), []).append(r)
    out = run(substrings.result_batches, table.append_column("spans", pa.array([spans.get(d, []) for d, _ in docs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.to_pylist()}


def test_hot_and_overfull_buckets_match_brute_force(monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 2)
    for full in (1 << 21, 400):
        monkeypatch.setattr(substrings, "BLOCK", 300)
        monkeypatch.setattr(substrings, "FULL", full)
        for seed in (3, 4, 5):
            docs = texts(seed, 80)
            assert locally(docs) == brute(docs)


def test_a_passage_in_many_texts_fills_no_bucket(monkeypatch):
    rng = random.Random(1)
    prose = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    for size in (170, 104):  # whole groups are equal, or each group has bytes of its own
        passage = prose(size)
        docs = [(i, prose(60) + passage + prose(60)) for i in range(3000)]
        most = []
        whole = substrings.repeats
        monkeypatch.setattr(substrings, "FULL", 20_000)
        monkeypatch.setattr(substrings, "BLOCK", 20_000)
        monkeypatch.setattr(substrings, "repeats", lambda p, d, s: most.append(sum(map(len, p))) or whole(p, d, s))
        assert locally(docs, 500) == brute(docs)
        assert max(most, default=0) < 200_000
        monkeypatch.setattr(substrings, "repeats", whole)


def test_text_longer_than_a_buffer(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, base), (2, base[1000:290_000]), (3, "q" + base)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.deduplicate(df).collect()}
    assert got == {1: (300_000, 0, 0), 2: (289_000, 289_000, 1), 3: (300_001, 300_000, 1)}


def test_empty_table_repeated_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicate(empty).collect() == []
    same = "abc" * 100
    df = spark.createDataFrame([(1, same), (1, same), (None, same), (2, same)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in substrings.deduplicate(df).collect())
    inner = 300 - 3  # the first document repeats itself from its fourth byte on
    assert got == [(1, inner), (1, inner), (2, 300), (99, 300)]
