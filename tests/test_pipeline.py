import time

import pytest

from millrace.plans import pipeline, scaffold
from millrace.plans.steps import STEPS, command_line, step


@pytest.fixture
def base(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, k int").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "count.params").write_text("input\tt2\nby\tk\n")
    return str(tmp_path)


def test_steps_compose_lazily_and_write(spark, base):
    text = f"Prefix {base}\nPlugin ScanTable inputfile t.parquet outputfile t2\nPlugin GroupCount inputfile count.params outputfile out\n"
    plan = pipeline.compose(spark, text)
    assert set(plan.sinks()) == {f"{base}/out"}
    results = pipeline.write_all(spark, plan.sinks())
    assert [r.status for r in results] == ["completed"]
    assert sorted(map(tuple, spark.read.parquet(f"{base}/out").collect())) == [(0, 3), (1, 3), (2, 3)]


def test_includes_restart_and_errors(spark, base):
    parts = {"sub": f"Plugin GroupCount inputfile {base}/t.parquet outputfile {base}/n", "loop": "Pipeline loop"}
    text = f"Plugin ScanTable inputfile {base}/t.parquet outputfile {base}/m\nPipeline sub"
    assert set(pipeline.compose(spark, text, include=parts.__getitem__).sinks()) == {f"{base}/m", f"{base}/n"}
    assert set(pipeline.compose(spark, text, include=parts.__getitem__, restart="GroupCount").sinks()) == {f"{base}/n"}
    for bad, said in (("Pipeline loop", "includes itself"), ("Plugin None inputfile a outputfile b", "no step"), ("Plugin X", "outputfile"), ("Oops", "line 1: unknown word")):
        with pytest.raises(pipeline.PipelineError, match=said):
            pipeline.compose(spark, bad, include=parts.__getitem__)
    with pytest.raises(pipeline.PipelineError, match="restart"):
        pipeline.compose(spark, text, include=parts.__getitem__, restart="Nowhere")


def test_failures_fast_and_continue(spark):
    def write(df, path):
        if path == "bad":
            raise ValueError("no")
        time.sleep(0.3)

    results = dict.fromkeys(["bad", "a", "b", "c"], spark.range(1))
    fast = {r.name: r.status for r in pipeline.write_all(spark, results, 1, "fast", write)}
    assert fast["bad"] == "failed" and fast["c"] == "skipped"
    every = {r.name: r.status for r in pipeline.write_all(spark, results, 2, "continue", write)}
    assert every == {"bad": "failed", "a": "completed", "b": "completed", "c": "completed"}


def test_results_are_written_side_by_side(spark):
    began = time.monotonic()
    pipeline.write_all(spark, {str(i): spark.range(1) for i in range(4)}, 4, write=lambda df, path: time.sleep(0.5))
    assert time.monotonic() - began < 1.5


def test_command_step_and_scaffold(spark):
    lines = spark.createDataFrame([("b",), ("a",)], "value string").coalesce(1)
    from millrace.plans.steps import Context

    out = STEPS["Command"](Context(spark, params={"command": "sort"}), lines)
    assert [r.value for r in out.collect()] == ["a", "b"]
    assert command_line({"command": "x y", "-n": "3", "-v": "", "other": "1"}) == ["x", "y", "-n", "3", "-v"]
    code = scaffold.source("Mine", "tool inputfile -k size [ -v ] extra")
    exec(code, {})  # the source is valid and registers its step
    assert "Mine" in STEPS and "ctx.params['size']" in code

    @step("Mine")
    def again(ctx, df):
        return df

    assert STEPS.pop("Mine") is again


def test_steps_are_loaded_from_a_search_path(tmp_path):
    for root in ("one", "two", "three"):
        (tmp_path / root / "p").mkdir(parents=True)
        (tmp_path / root / "p" / f"X{root}Plugin.py").write_text(f"from millrace.plans.steps import step\n\n\n@step('X{root}')\ndef f(ctx, df):\n    return df\n")
    from millrace.plans.steps import load

    assert load(f"{tmp_path}/one:{tmp_path}/two::{tmp_path}/three") == ["Xone", "Xtwo"]
    assert load("") == []
    del STEPS["Xone"], STEPS["Xtwo"]


def test_stream_counts_equal_table_counts(spark, tmp_path):
    from millrace.streaming import windows

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT) * 7) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type FROM range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windows.counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, windows.counts(rows).collect()))


def test_command_runs_once_a_partition(spark):
    from millrace.plans.steps import Context

    lines = spark.range(35).selectExpr("cast(id AS string) AS value").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        for command, want in (("wc -l", ["35"]), ("sort -rn", [str(i) for i in range(34, -1, -1)]), ("head -n 1", ["0"])):
            assert [r.value.strip() for r in STEPS["Command"](Context(spark, params={"command": command}), lines).collect()] == want
    finally:
        spark.conf.set(name, before)


def test_command_keeps_lines_whole(spark):
    from millrace.plans.steps import pipe

    lines = spark.createDataFrame([("a\rb ",), (None,), ("é\x85c",)], "value string").coalesce(1)
    assert [r.value for r in pipe(lines, ["cat"]).collect()] == ["a\rb ", "", "é\x85c"]
    assert [r.value for r in pipe(lines.limit(1), ["printf", r"\377x\n"]).collect()] == ["\ufffdx"]


def config(tmp_path, text):
    (tmp_path / "config.txt").write_text(text)
    return str(tmp_path / "config.txt")


def test_block_options_act(spark, base, tmp_path, monkeypatch):
    seen = []
    whole = pipeline.write_all
    monkeypatch.setattr(pipeline, "write_all", lambda s, r, workers, mode: seen.append((sorted(r), workers, mode)) or whole(s, r, workers, mode))
    text = f"""Prefix {base}
Parallel workers=3 memory=4G gpu=2 fail=continue
Plugin ScanTable inputfile t.parquet outputfile a memory=2G
Plugin Filter inputfile bad.params outputfile b
Plugin ScanTable inputfile t.parquet outputfile c gpu=1
EndParallel
Plugin ScanTable inputfile t.parquet outputfile d
"""
    (tmp_path / "bad.params").write_text("input\tt.parquet\nwhere\tid / 0 > 1 AND raise_error('no') IS NULL\n")
    got = {r.name.removeprefix(f"{base}/"): r.status for r in pipeline.run(spark, config(tmp_path, text))}
    assert got["a"] == got["c"] == "completed" and got["b"] == "failed"
    assert [(len(r), w, m) for r, w, m in seen][0] == (3, 2, "continue")
    with pytest.raises(pipeline.PipelineError, match="never run ScanTable"):
        pipeline.compose(spark, f"Parallel memory=1G\nPlugin ScanTable inputfile {base}/t.parquet outputfile x memory=2G\nEndParallel")


def test_litter_runs_includes_side_by_side(spark, base):
    parts = {n: f"Plugin ScanTable inputfile {base}/t.parquet outputfile out{n}" for n in "xyz"}
    text = f"Prefix {base}\nLitterLaunch\nKitty a\nPipeline x\nKitty b\nPipeline y\nLitterGather\nPipeline z"
    plan = pipeline.compose(spark, text, include=parts.__getitem__)
    groups = [(g.name, g.at_once(), sorted(p.removeprefix(base) for p in r)) for g, r in plan.written()]
    assert groups == [("litter", 2, ["/a/outx", "/b/outy"]), ("steps", 4, ["/b/outz"])]


def test_hazards_are_reported_and_logged(spark, base, tmp_path):
    text = f"""Prefix {base}
Parallel workers=2
Plugin ScanTable inputfile t.parquet outputfile m
Plugin ScanTable inputfile t.parquet outputfile m
Plugin GroupCount inputfile m outputfile n
EndParallel
"""
    assert [r.status for r in pipeline.run(spark, config(tmp_path, text), log_folder=str(tmp_path / "logs"))] == ["completed"]
    (log,) = (tmp_path / "logs").iterdir()
    said = log.read_text()
    for words in ("lines 3 and 4 both write", "line 5 reads", "replaced", "GroupCount reads", "completed in"):
        assert words in said


def test_restart_behind_an_output_that_was_never_stored(spark, base, tmp_path):
    text = f"Prefix {base}\nPlugin ScanTable inputfile t.parquet outputfile m\nPlugin GroupCount inputfile m outputfile n\n"
    path = config(tmp_path, text)
    assert [r.status for r in pipeline.run(spark, path)] == ["completed"]
    assert not (tmp_path / "m").exists()
    assert [(r.name, r.status) for r in pipeline.run(spark, path, "GroupCount")] == [(f"{base}/n", "completed")]
    spark.range(2).write.parquet(f"{base}/m")  # a stored one is read
    pipeline.run(spark, path, "GroupCount")
    assert sorted(r.id for r in spark.read.parquet(f"{base}/n").collect()) == [0, 1]


def test_cases_in_folders(spark, tmp_path):
    from millrace.plans import cases
    from millrace.sources import sinks

    @step("Sorted")
    def sorted_lines(ctx, df):
        return df.select("value").orderBy("value").coalesce(1)

    folder = tmp_path / "case"
    assert cases.run_case(spark, str(folder)) == "WARN"
    folder.mkdir()
    (folder / "config.txt").write_text("Plugin Sorted inputfile in.txt outputfile out\n")
    (folder / "pretest.txt").write_text(f"cp {folder}/raw.txt {folder}/in.txt\n")
    (folder / "raw.txt").write_text("b\na\n")
    assert cases.pretest(spark, str(folder)) == 1 and (folder / "in.txt").exists()
    assert cases.run_case(spark, str(folder)) == "WARN"
    (folder / "interactive").touch()
    assert cases.run_case(spark, str(folder)) == "INCOMPAT"
    (folder / "interactive").unlink()
    (folder / "gone.expected").write_text("a\n")
    assert cases.run_case(spark, str(folder)) == "FAIL"
    assert sinks.exists(spark, f"{folder}/out")
    del STEPS["Sorted"]


def test_scaffold_writes_where_the_search_path_looks(tmp_path):
    from millrace.plans.steps import load

    assert scaffold.write("Fresh", "tool inputfile", str(tmp_path)).exists()
    assert load(str(tmp_path)) == ["Fresh"]
    with pytest.raises(FileExistsError):
        scaffold.write("Fresh", "tool inputfile", str(tmp_path))
    del STEPS["Fresh"]
