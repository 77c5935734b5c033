import random
import re

import numpy as np

from millrace.llm import minhash
from millrace.llm.core import mix


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, limit=0.8):
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= limit:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    prose = lambda k: " ".join("".join(rng.choice("aeinrstöß") for _ in range(rng.randrange(2, 8))) for _ in range(k))
    docs = []
    for i in range(n):
        text = prose(rng.randrange(1, 200))
        if docs and rng.random() < 0.5:
            old = words(rng.choice(docs)[1])
            for _ in range(rng.randrange(0, 4)):
                if old:
                    old[rng.randrange(len(old))] = "new"
            text = " ".join(old) + "."
        docs.append((i, text))
    return docs + [(1000, None), (1001, ""), (1002, "..."), (1003, "one two"), (1004, "One, two!")]


def test_classes_match_brute_force(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, class int").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == brute(docs)


def variants(seed, n, size, most):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    docs = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(1, most)):
            text[rng.randrange(size)] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(text)))
    return docs


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Blocks of few nodes, and rounds, as in large buckets: many variants of one text, some of them far apart."""
    monkeypatch.setattr(minhash, "CHUNK", 7)
    for at_once in (1000, 2):
        monkeypatch.setattr(minhash, "AT_ONCE", at_once)
        monkeypatch.setattr(minhash, "HEADS", 1)
        monkeypatch.setattr(minhash, "GROWTH", 5)
        docs = variants(9, 60, 60, 4)
        got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        want = brute(docs)
        assert len(set(want.values())) > 3
        assert got == want


def side(texts, labels, hub):
    grams, of, _ = minhash.shingles([t.encode() for t in texts])
    grams, of, _ = minhash.counted(grams, of)
    sets = [set(grams[of == i].tolist()) for i in range(len(texts))]
    return {
        "node": np.arange(len(texts)), "label": np.array(labels), "size": np.array([len(x) for x in sets]), "hub": np.full(len(texts), hub),
        "common": np.array([len(x & sets[hub]) for x in sets]), "out": np.ones(len(texts), bool), "bits": minhash.bitmaps(grams, of, len(texts)),
    }, sets


def test_bounds_never_rule_out_a_link():
    for size, most in ((40, 4), (400, 30)):
        texts = [t for _, t in variants(3, 80, size, most)]
        m, sets = side(texts, range(80), 0)
        got = set(zip(*(x.tolist() for x in minhash.may_link(m, m, 0.8)), strict=True))
        links = {(i, j) for i in range(1, 80) for j in range(i + 1, 80) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert links and links <= got and len(got) < 80 * 79 / 2


def test_one_document_of_each_group_stays(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in minhash.deduplicate(df).collect()}
    assert kept == set(brute(docs).values())


def test_empty_nulls_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(empty).collect() == [] and minhash.deduplicate(empty).collect() == []
    text = "a b c d e f g"
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in minhash.classes(df).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 5)]
    assert sorted((r.doc_id or 0, r.text) for r in minhash.deduplicate(df).collect()) == [(0, None), (5, text)]


def test_no_text_is_lost_and_one_row_of_each_class_stays(spark):
    a, b, t = "one two three four five six", "quite another text of some more words", "t u v w x y z"
    rows = [(1, a, 1, {"k": 1}), (5, a, 2, None), (5, b, 3, None), (9, t, 4, None), (9, t, 5, None), (None, "n n n n n m", 6, None), (None, "N n n n n m.", 7, None), (None, "", 8, None), (None, "", 8, None), (3, "...", 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long, raw map<string,int>").repartition(3)
    kept = sorted((r.doc_id or 0, r.text) for r in minhash.deduplicate(df).collect())
    lead = min(("n n n n n m", "N n n n n m."), key=lambda x: __import__("hashlib").sha256(x.encode()).digest())
    assert kept == sorted([(1, a), (5, b), (9, t), (0, lead), (0, ""), (0, ""), (3, "...")])
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in minhash.classes(df).collect())
    assert got == sorted([(1, 1), (5, 1), (5, 5), (9, 9), (9, 9), (0, 0), (0, 0), (0, 0), (0, 0), (3, 3)])


def test_words_that_a_polynomial_hash_confuses_are_told_apart(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " some further words stand here"
    df = spark.createDataFrame([(1, word + rest), (2, other + rest), (3, word), (4, other)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"v{rng.randrange(10**6)}" for _ in range(200_000)]
    near = [w if i % 100 else "new" for i, w in enumerate(long)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, "x"), (3, " ".join(near)), (4, "y" * 2_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def weighted(weights, trials=80, k=64):
    rng = np.random.default_rng(3)
    share, exact = [], 0.0
    for _ in range(trials):
        ids = mix(rng.integers(0, 1 << 60, 300).astype(np.uint64))
        a, b = np.repeat(ids[:200], 1 + np.arange(200) % 3), np.repeat(ids[50:250], 1 + (np.arange(200) // 7) % 4)
        grams, doc, times = minhash.counted(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]))
        units, of, room = minhash.weight_units(grams, doc, times, weights)
        found = minhash.signatures(units, of, 2, k, room)
        share.append((found[0] == found[1]).mean())
        wa, wb = ({g: w for g, w, d in zip(grams.tolist(), weights(times), doc, strict=True) if d == side} for side in (0, 1))
        keys = set(wa) | set(wb)
        exact = sum(min(wa.get(x, 0), wb.get(x, 0)) for x in keys) / sum(max(wa.get(x, 0), wb.get(x, 0)) for x in keys)
    return np.mean(share), exact, 4 * (exact * (1 - exact) / (trials * k)) ** 0.5 + 0.005


def test_signatures_estimate_weighted_similarity():
    seen = set()
    for weights in (lambda n: n.astype(float), minhash.repeated, lambda n: 0.3 * n, lambda n: np.ones(len(n))):
        got, exact, off = weighted(weights)
        assert abs(got - exact) < off
        seen.add(round(exact, 3))
    assert len(seen) == 3  # a common factor changes nothing


def test_weights_choose_candidates_only(spark):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(df, weights=minhash.repeated).collect()}
    assert got == brute(docs)


def test_signature_does_not_depend_on_the_batch():
    ids = mix(np.arange(500, dtype=np.uint64))
    alone = minhash.signatures(ids[:7], np.zeros(7, np.int64), 1)
    both = minhash.signatures(np.concatenate([ids[:7], ids]), np.repeat([1, 2], [7, 500]), 4)
    assert (both[1] == alone[0]).all() and (both[0] == 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 3)]
    got = {r.node: r["class"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 105: 100, 103: 100}
