import random
import re

import numpy as np

from millrace.llm import contamination
from millrace.llm.core import Roller


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def greedy(a, b, least):
    """Greedy string tiling as it is told: the longest common unmarked run, again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        i, j, n = best
        out.append(best)
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_tiles_match_plain_greedy_tiling():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        b = [rng.choice("abc") for _ in range(rng.randrange(0, 20))]
        for k in (2, 3):
            number = lambda w: int("".join(w).replace("a", "1").replace("b", "2").replace("c", "3"))
            item = [number(b[j : j + k]) for j in range(len(b) - k + 1)]
            seeds = [(i, number(a[i : i + k])) for i in range(len(a) - k + 1) if number(a[i : i + k]) in item]
            p, h = (np.array([s[i] for s in seeds], np.int64) for i in range(2))
            assert contamination.tile(p, h, np.array(item, np.int64), k, Roller()) == greedy(a, b, k)


def test_texts_of_one_repeated_word_take_no_pairs_of_places():
    import time

    for period in (1, 2, 7):
        h = np.arange(20_000) % period
        began = time.monotonic()
        tiles = contamination.tile(np.arange(20_000), h, h[:396].copy(), 5, Roller())
        assert tiles == [(0, 0, 400)] and time.monotonic() - began < 2


def corpus():
    rng = random.Random(7)
    prose = lambda k: " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 7))) for _ in range(k))
    items = [(i, prose(rng.randrange(12, 40))) for i in range(8)] + [(50, "Only three words"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        text, kind = prose(rng.randrange(0, 60)), i % 5
        item = items[i % 8][1].split()
        if kind == 1:
            text += ". " + " ".join(item).upper() + "! " + prose(4)
        elif kind == 2:  # reordered halves
            h = len(item) // 2
            text = " ".join(item[h:]) + " " + text + " " + " ".join(item[:h])
        elif kind == 3:  # too little of it
            text += " " + " ".join(item[:5])
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, "so only, THREE words here")], items


def expected(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            a, b = words(t), words(x)
            if b:
                tiles = greedy(a, b, min(5, len(b)))
                covered = sum(n for _, _, n in tiles)
                if covered >= 0.5 * len(b):
                    out[d, i] = (len(b), len(tiles), covered)
    return out


def test_pairs_match_brute_force_with_and_without_broadcast(spark, monkeypatch):
    docs, items = corpus()
    want = expected(docs, items)
    assert len(want) > 15
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (contamination.BROADCAST_SEEDS, 10):
        monkeypatch.setattr(contamination, "BROADCAST_SEEDS", most)
        got = {(r.doc_id, r.item_id): (r.n_item_words, r.n_tiles, r.n_covered) for r in contamination.contaminated(df, bench).collect()}
        assert got == want
    kept = {r.doc_id for r in contamination.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (None, "a b c d e f"), (2, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contaminated(docs, none, key="item_id").collect() == []
    items = spark.createDataFrame([(9, "A b c d e f."), (9, "A b c d e f."), (9, "x y z x y z"), (None, "g h i j k l")], "item_id long, text string")
    got = contamination.contaminated(docs, items, key="item_id").collect()  # both keys have one name
    assert sorted(((r.item_id or 0, r.item_item_id or 0, r.n_tiles, r.coverage) for r in got)) == [(0, 9, 1, 1.0), (1, 0, 1, 1.0), (1, 9, 1, 1.0)]
    assert contamination.contaminated(docs.limit(0), items, key="item_id").collect() == []
    assert [(r.item_id, r.text) for r in contamination.decontaminate(docs, items, key="item_id").collect()] == [(2, None)]


def test_long_texts_of_one_word_and_words_a_polynomial_hash_confuses(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " some further words"
    docs = spark.createDataFrame([(1, "echo " * 20_000), (2, other + rest)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "echo " * 400), (8, word + rest), (9, other + rest)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contamination.contaminated(docs, items).collect()) == [(1, 7), (2, 9)]
