import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lattice, queries
from millrace.llm.lattice import Lattice

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def small():
    pieces = sorted({*(bytes([b]) for b in range(256)), b" a", b"ab", b" ab", b"bc", b"abc", b"cab"})
    p = np.random.default_rng(1).random(len(pieces) + 1)
    return pieces, np.log(p / p.sum())


def every(text, index, logp):
    """Probability and expected pieces, by listing all segmentations."""
    total, expected = 0.0, Counter()

    def go(at, p, used):
        nonlocal total
        if at == len(text):
            total += p
            for u in used:
                expected[u] += p
        for end in range(at + 1, len(text) + 1):
            i = index.get(text[at:end])
            if i is not None:
                go(end, p * math.exp(logp[i]), [*used, i])

    go(0, 1.0, [])
    return total, {i: x / total for i, x in expected.items()}


def test_forward_and_backward_against_all_segmentations(monkeypatch):
    pieces, logp = small()
    words = [b"abc", b"cabcab", b"x", b"", b"bcabca", b"\xc3\xa9ab"]
    counts = np.array([2, 1, 5, 3, 1, 4])
    for long in (lattice.LONG, 0):
        monkeypatch.setattr(lattice, "LONG", long)
        model = Lattice(pieces, logp)
        found, expected = model.run(words, counts)
        want = np.zeros(len(logp))
        for w, c, z in zip(words, counts, found):
            if not w:
                assert math.isclose(z, logp[-1])
                want[-1] += c
                continue
            p, e = every(b" " + w, model.index, logp)
            assert math.isclose(math.exp(z), p, rel_tol=1e-9)
            for i, x in e.items():
                want[i] += c * x
        assert np.allclose(expected, want)
        assert np.allclose(model.run(words)[0], found)


def test_base_scores_match_brute_force(spark, monkeypatch):
    docs = [(i, " ".join(["The", "cat", f"w{i % 7}", "sAt", "é" * (i % 3 + 1), f"only{i}"] * (i % 4))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 500), (7, docs[7][1])]
    train = Counter(t for d, x in docs for t in tokens(x) if zlib.crc32(str(d).encode()) % 10)
    n, v = sum(train.values()), len(train)
    df = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, hash int").repartition(3)
    for frequent in (lattice.FREQUENT, 3):
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        monkeypatch.setattr(lattice.frequent_limit, "__defaults__", (frequent,))
        got = lattice.score(df, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, queries.VOCABULARY).collect()
        assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
        text = dict(docs)
        for r in got:
            t = tokens(text[r.doc_id])
            base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in train for x in t), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score(df, F.lit(True), queries.VOCABULARY).collect() == []


def test_scores_sum_all_segmentations_and_words_a_polynomial_hash_confuses(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, "the cat sat"), (2, "The hat"), (3, ""), (4, word), (5, other + " cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.score(df, F.col("doc_id") != 5, queries.VOCABULARY).collect()}
    assert (got[5].n_tokens, got[5].n_known) == (3, 2)
    _, pieces, logp, _, _ = lattice.learn(df, F.col("doc_id") != 5, queries.VOCABULARY)
    index = {p: i for i, p in enumerate(pieces)}
    for d, text in docs[:3]:
        want = logp[-1] + sum(math.log(every(b" " + w.encode(), index, logp)[0]) for w in text.lower().split())
        assert math.isclose(got[d].score, want / math.log(10), rel_tol=1e-9)
    with __import__("pytest").raises(FileNotFoundError):
        lattice.vocabulary("/nowhere.model")
