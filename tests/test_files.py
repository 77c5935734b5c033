import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.sources import files, sinks


def test_lines_parameters_and_sequences(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a\t1\nno tab\nb\t 2 \na\t3\t4\n")
    rows = files.lines(spark, str(tmp_path / "p.txt"))
    assert [(r.pos, r.value) for r in rows.orderBy("pos").collect()][1] == (2, "no tab")
    assert {r.key: r.value for r in files.parameters(rows).collect()} == {"a": "3", "b": "2"}
    assert files.as_map(files.parameters(rows)).first().params == {"a": "3", "b": "2"}
    got = {r.key: (r.value, r.duplicate) for r in files.table_parameters(rows).collect()}
    assert got == {"a": ("3", True), "b": ("2", False), "no": ("tab", False)}
    whole = spark.createDataFrame([("f", "k1 v1\nk2\tv2 k1 v3 odd")], "file string, value string")
    assert {r.key: r.value for r in files.token_parameters(whole).collect()} == {"k1": "v3", "k2": "v2"}
    assert [r.value for r in files.sequence(rows).orderBy("pos").collect()] == ["a\t1", "no tab", "b\t 2", "a\t3\t4"]


def test_token_parameters_query_reads_every_token(spark, tmp_path):
    texts = [(1, "a 1 b 2 c 3 d 4 a 5 odd"), (2, "one"), (3, None), (4, " x y\n"), (5, "k v"), (5, "k2 v2 k3 v3")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["token_parameters"](spark, str(tmp_path)).collect())
    assert got == [(1, "a", "5"), (1, "b", "2"), (1, "c", "3"), (1, "d", "4"), (4, "x", "y"), (5, "k", "v"), (5, "k2", "v2"), (5, "k3", "v3")]


def test_token_parameters_sorts_no_pairs_of_files_of_their_own(spark, tmp_path):
    def brute(texts):
        best = {}
        for doc, text in texts:
            words = (text or "").split()
            for i in range(len(words) // 2):
                key = doc, words[2 * i]
                best[key] = max(best.get(key, (-1, "")), (i, words[2 * i + 1]))
        return sorted(((str(d), k, v) for (d, k), (_, v) in best.items()))

    own = [(i, " ".join(f"k{(i + j * j) % 7} v{j}" for j in range(i))) for i in range(60)] + [(100, "ä 1 a 2 ä 3"), (101, None), (None, "n 1 n 2")]
    several = own + [(7, "k1 z k2"), (7, None), (8, "x y"), (None, "n 3"), (None, "n 1 n 1")]
    for name, texts in (("own", own), ("several", several)):
        spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        out = queries.QUERIES["token_parameters"](spark, str(tmp_path / name))
        assert sorted((str(r.doc_id), r.key, r.value) for r in out.collect()) == brute(texts)
        if name == "own":
            final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "Final Plan" in final and "Sort" not in final


def test_formats(spark, tmp_path):
    for kind in ("parquet", "json", "orc"):
        spark.range(3).write.format(kind).save(str(tmp_path / kind))
        assert files.table(spark, str(tmp_path / kind), kind).count() == 3
    with pytest.raises(ValueError):
        files.table(spark, "x", "unknown")


def test_write_whole_replaces_or_leaves(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_whole(spark.range(2), path)
    sinks.write_whole(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        sinks.write_whole(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_reports(spark, tmp_path):
    path = str(tmp_path / "diff")
    assert sinks.write_difference(spark.range(1), path)
    assert not sinks.write_difference(spark.range(0), path)
    assert not (tmp_path / "diff").exists()
    sinks.write_lines(spark.createDataFrame([("b", 2), ("a", 1)], "value string, n int"), str(tmp_path / "l"), "n")
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    log = sinks.run_log(str(tmp_path / "logs"))
    log.info("step done")
    assert "[millrace] step done" in next((tmp_path / "logs").iterdir()).read_text()


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "APlugin.py").write_text("x")
    (tmp_path / "b.txt").write_text("yy")
    assert [r.length for r in files.listing(spark, str(tmp_path), "*.py").collect()] == [1]
