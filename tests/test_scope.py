import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import scope
from millrace.plans import pipeline
from millrace.sources import files

GOOD = """\
# comment
Prefix data
Plugin A inputfile a.csv outputfile out/a

Parallel workers=4 memory=32G fail=continue junk
  Plugin B inputfile b outputfile /abs/b memory=2G gpu=1
  # inside
  Plugin C inputfile c outputfile c2 memory=bad
EndParallel
Plugin D inputfile d outputfile d2
Kitty k
Plugin E inputfile e outputfile e2
"""


def configs(spark, **texts):
    return files.split_lines(spark.createDataFrame(list(texts.items()), "file string, value string"))


def test_parse(spark):
    rows = {r.task.name: r for r in scope.parsed(configs(spark, good=GOOD)).where("keyword = 'Plugin'").collect()}
    assert [n for n, r in sorted(rows.items()) if r.inside] == ["B", "C"]
    assert rows["A"].task.inputfile == "data/a.csv" and rows["A"].prefix == "data/"
    b, c = rows["B"].task, rows["C"].task
    assert (b.outputfile, b.memory_hint, b.gpu_hint) == ("/abs/b", 2 * 1024**3, 1)
    assert (c.memory_hint, c.gpu_hint) == (0, 0)
    assert rows["E"].task.inputfile == "data/k/e"
    options = scope.parsed(configs(spark, good=GOOD)).where("options IS NOT NULL").first().options
    assert (options.workers, options.memory, options.gpu, options.fail_mode) == (4, 32 * 1024**3, 0, "continue")


@pytest.mark.parametrize(
    ("line", "options"),
    [
        ("Parallel", (0, 0, 0, "fast")),
        ("Parallel gpu=2 workers=3", (3, 0, 2, "fast")),
        ("Parallel workers=x memory=1K", (0, 1024, 0, "fast")),
        ("Parallel fail=fast other=1", (0, 0, 0, "fast")),
    ],
)
def test_options(spark, line, options):
    row = scope.parsed(configs(spark, f=line + "\nEndParallel")).where("options IS NOT NULL").first().options
    assert tuple(row) == options


def test_structure_errors(spark):
    texts = {
        "nested": "Parallel\nParallel\nEndParallel",
        "end": "EndParallel",
        "open": "Plugin A inputfile a outputfile b\nParallel",
        "inside": "Parallel\nPrefix x\nKitty y\nPipeline z\nEndParallel",
        "word": "Nonsense",
        "good": GOOD,
        "empty": "Parallel\nEndParallel",
    }
    found = {}
    for r in scope.structure_errors(scope.directives(configs(spark, **texts))).orderBy("file", "line").collect():
        found.setdefault(r.file, []).append((r.line, r.message))
    assert set(found) == {"nested", "end", "open", "inside", "word"}
    assert found["nested"] == [(2, "Parallel blocks cannot nest")]
    assert found["open"] == [(2, "Parallel without EndParallel")]
    assert [m.split()[0] for _, m in found["inside"]] == ["Prefix", "Kitty", "Pipeline"]


def test_kitties_nest_without_prefix(spark):
    text = "Kitty a\nKitty b\nPlugin X inputfile i outputfile o\nPrefix p\nKitty c\nKitty d\nPlugin Y inputfile i outputfile o"
    rows = {r.task.name: r.prefix for r in scope.parsed(configs(spark, f=text)).where("task IS NOT NULL").collect()}
    assert rows == {"X": "a/b/", "Y": "p/d/"}


def test_restart(spark):
    rows = spark.createDataFrame([("f", 1, "A"), ("f", 2, "R"), ("f", 3, "B"), ("g", 1, "R")], "file string, pos int, name string")
    got = scope.after_restart(rows, F.col("name") == "R", "file", "pos").collect()
    assert sorted((r.file, r.pos) for r in got) == [("f", 2), ("f", 3), ("g", 1)]


def test_hazards_of_many_configs(spark):
    bad = "Parallel\nPlugin A inputfile a outputfile x\nPlugin B inputfile x outputfile y\nPlugin C inputfile c outputfile x\nEndParallel"
    fine = "Plugin A inputfile a outputfile x\nPlugin B inputfile x outputfile y"
    collisions, hazards = pipeline.checks(configs(spark, bad=bad, fine=fine))
    assert [(r.file, r.first, r.second, r.outputfile) for r in collisions.collect()] == [("bad", 2, 4, "x")]
    assert [(r.file, r.writer, r.n_writers, r.reader, r.path) for r in hazards.collect()] == [("bad", 2, 2, 3, "x")]


def test_whole_queries_leave_no_row_out(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(4, 1, "signup"), (5, 1, "click"), (8, 2, "signup"), (9, 2, "view")], "event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    got = {r.event_id: r.prefix for r in queries.QUERIES["kitty_scope"](spark, folder).collect()}
    assert got == {4: "p4/", 5: "p4/k5/", 8: "p8/", 9: "p8/"}
    spark.createDataFrame([(i, "BUILDING" if i == 50 else "OTHER") for i in range(2000)], "c_custkey long, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(50, 1550), (1900, 1)], "o_custkey long, o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    # 50 * 7 + 1550 = 1900, and 1900 * 7 + 1 = 13301, which is 1301 modulo 2000
    assert sorted(r.node for r in queries.QUERIES["include_closure"](spark, folder).collect()) == [50, 1301, 1900]
    spark.createDataFrame([(1, 30, 1, "A"), (1, 10, 2, "A"), (1, 15, 3, "A"), (1, 7, 4, "A")], "l_orderkey long, l_partkey long, l_linenumber long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    got = sorted((r.l_partkey, r.l_returnflag, r.side) for r in queries.QUERIES["golden_diff"](spark, folder).collect())
    assert got == [(10, "A", "expected"), (10, "x", "got"), (15, "A", "got"), (15, "x", "expected")]
