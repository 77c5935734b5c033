import random
import re
from collections import defaultdict

import numpy as np

from millrace.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, share=1.5, cap=2.0):
    """Targets by rounds of sharing what is left among sources below their cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "é", "Z", None, "b", "b", "b"]), " ".join(["w"] * rng.randrange(0, 40)) + rng.choice(["", "\n", " \x0b"])) for i in range(n)] + [(999, "a", None), (998, "only empty", "")]


def check(got, data):
    total = defaultdict(int)
    for _, s, t in data:
        total[s] += size(t)
    want = filled(total)
    source, text = {i: s for i, s, _ in data}, {i: t for i, _, t in data}
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in data)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size(text[r.doc_id]) and r.source_size == total[s]
        assert abs(r.target - want[s]) < 1e-6
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 40, (s, taken[s], want[s])


def test_targets_bounds_and_reruns(spark, monkeypatch):
    data = rows(1)
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    first = mixing.mixed(df).collect()
    check(first, data)
    monkeypatch.setattr(mixing, "CHUNK", 5)
    monkeypatch.setattr(mixing, "FAN", 3)
    small = mixing.mixed(df).collect()
    check(small, data)
    again = mixing.mixed(df.repartition(7, "text")).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, again))


def test_expectations_are_kept():
    size_, part = np.array([3, 10, 1, 7]), np.array([0.3, 0.6, 0.5, 0.25])
    sums = np.zeros(4)
    for i in range(20_000):
        value, open_ = mixing.pivot(size_, part, mixing.generator(9, i), last=True)
        assert open_ == -1 and set(value) <= {0.0, 1.0}
        sums += value
    assert np.allclose(sums / 20_000, part, atol=0.015)


def test_empty_repeated_and_wordless_rows(spark):
    kind = "doc_id long, source string, text string"
    assert mixing.mixed(spark.createDataFrame([], kind)).collect() == []
    got = mixing.mixed(spark.createDataFrame([(1, "s", "a b"), (1, "s", "a b"), (None, None, None)], kind)).collect()
    assert sorted((r.doc_id or 0, r.size, r.source_size) for r in got) == [(0, 0, 0), (1, 2, 4), (1, 2, 4)]
    assert sum(r.taken for r in got) == 6


def test_null_and_repeated_ids_keep_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    texts = ["w " * (1 + i % 9) + f"t{i}" for i in range(90)] + ["same text"] * 60
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, "s", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n long")
    got = mixing.mixture(df).collect()
    assert sorted(r.n for r in got) == list(range(150)) and {r.copies for r in got} == {1, 2}
    assert {r.n: r.doc_id for r in got} == {r[3]: r[0] for r in data}
    total = sum(size(t) for t in texts)
    assert abs(sum(size(r.text) * r.copies for r in got) - 1.5 * total) <= 10
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted((r.n, r.copies) for r in got) == sorted((r.n, r.copies) for r in again)


def test_equal_and_null_ids_do_not_meet_in_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    whole = mixing.round_chunk

    def counted(frame):
        assert len(frame) < 40, "one chunk holds rows that should be dealt"
        return whole(frame)

    monkeypatch.setattr(mixing, "round_chunk", counted)
    data = [(None if i % 2 else 7, "s", "same text") for i in range(200)]
    assert mixing.mixed(spark.createDataFrame(data, "doc_id long, source string, text string")).count() == 200


def test_sources_of_few_large_and_many_small_documents_come_near_their_targets(spark):
    rng = random.Random(5)
    data = []
    for i in range(2400):
        n = rng.randrange(200, 400) if rng.random() < 0.1 else rng.randrange(1, 60)
        data.append((i, f"s{i % 20:02}", "w " * n))
    got = mixing.mixed(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()
    source, taken, target = {i: s for i, s, _ in data}, defaultdict(int), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert max(abs(taken[s] - target[s]) / target[s] for s in taken) < 0.03
