import random
import re

import corpus_pipeline
from millrace.llm import queries
from tests.llm.test_contamination import expected
from tests.llm.test_minhash import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "der", "ß", "ei"]}


def documents(seed=11):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(PARTS["en"]) + rng.choice(PARTS["en"]) for _ in range(20))) for i in range(4)]
    rows = []
    for i in range(200):
        lang = rng.choice(list(PARTS))
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 80)))
        kind = i % 8
        if kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 2:
            text += " " + rng.choice(items)[1] + "."
        elif kind == 3:
            text += ' token = "24be64439e3e49cf46b2d7c9"'
        elif kind == 4 and i % 3 == 0:
            text = "123 456 !!"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    return [*rows, (500, None, None, None, None), (501, "", "en", "s1", 0)], items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = documents()
    folder = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "secret_redaction", "mix"]
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), {r[0]: r for r in rows}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{number}")
        docs = spark.read.parquet(f"{folder}/out{number}")
        after = {r.doc_id: tuple(r) for r in docs.collect()}
        texts = [(d, r[1]) for d, r in before.items()]
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert set(after) == {d for d, t in texts if t and re.search("[a-zß]", t)}
        elif name == "near_duplicates":
            assert set(after) == set(brute(texts).values()) < set(before)
        elif name == "benchmark_leaks":
            assert set(after) == set(before) - {d for d, _ in expected(texts, items)} < set(before)
        elif name == "secret_redaction":
            assert set(after) == set(before)
            for d, r in after.items():
                clean = before[d][1].replace('token = "24be64439e3e49cf46b2d7c9', "[SECRET]")
                assert r == (d, clean, *before[d][2:4], len(clean))
        else:
            assert set(after) <= set(before) and {r[-1] for r in after.values()} <= {1, 2}
            taken = sum(len(r[1].split()) * r[-1] for r in after.values())
            total = sum(len(t.split()) for _, t in texts)
            assert abs(taken - 1.5 * total) < 300
        before = {d: r[:5] for d, r in after.items()}
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in docs.collect())


def test_null_and_repeated_ids_through_all_stages(spark, tmp_path):
    rows, items = documents()
    folder = str(tmp_path)
    plain = [r for r in rows[:200] if r[0] % 8 in (0, 5, 6, 7)]
    rows = [((None, 7, r[0] + 1000)[i % 3], r[1], r[2], "s", r[4]) for i, r in enumerate(plain)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.text for r in got) == sorted(r[1] for r in rows)
    assert {r.text: r.doc_id for r in got} == {r[1]: r[0] for r in rows}
    words = [len(r[1].split()) for r in rows]
    assert abs(sum(len(r.text.split()) * r.copies for r in got) - 1.5 * sum(words)) <= max(words)


def test_extra_columns_and_empty_tables(spark, tmp_path):
    rows, items = documents(3)
    folder = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kind = KIND + ", score double, lang_pred string, node long, item_id long"
    docs = spark.createDataFrame([(*r, 7.5, "x", 1, 2) for r in rows[:40] if r[1]], kind)
    for _, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        assert {(r.score, r.lang_pred, r.node, r.item_id) for r in kept.collect()} == {(7.5, "x", 1, 2)}
    empty = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == [], name
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.benchmark_leaks(spark, docs, f"{folder}/none").count() == docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
