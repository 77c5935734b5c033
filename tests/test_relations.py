import pytest

from millrace.operators import catalog, golden, hazards, registry, requirements
from millrace.sources import files


def test_registry(spark):
    rows = spark.createDataFrame([("a", "C", 1), ("a", "Python", 2), ("b", "R", 1)], "name string, language string, ord int")
    from pyspark.sql import functions as F

    assert {r.name: r.language for r in registry.last_wins(rows, ["name"], "language", F.col("ord")).collect()} == {"a": "Python", "b": "R"}
    assert {r.name: r.language for r in registry.first_wins(rows, ["name"], "language", F.col("ord")).collect()} == {"a": "C", "b": "R"}
    tree = [("p/Foo/libFooPlugin.so",), ("p/Foo/Cargo.toml",), ("p/Bar/Cargo.toml",), ("p/__init__Plugin.py",), ("p/Baz/BazPlugin.R",)]
    paths = spark.createDataFrame(tree, "path string")
    assert sorted((r.name, r.extension) for r in registry.plugin_files(paths).collect()) == [("Baz", "R"), ("Foo", "so")]
    assert sorted((r.name, r.built) for r in registry.built_crates(paths).collect()) == [("Bar", False), ("Foo", True)]


def test_closure_ends_on_cycles_and_reports_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "n int")
    assert sorted(r.node for r in catalog.closure(start, edges).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        catalog.closure(start, edges, rounds=1)


def test_catalog(spark):
    html = '<table><tr><td><a href="u1">A</a> <a href="u2">B</a></td></tr></table><a href="u3">C</a>'
    pages = spark.createDataFrame([("u0", html), ("u1", '<tr><a href="u9">Z</a></tr>')], "url string, html string")
    named = pages.withColumnRenamed("url", "site")
    assert sorted((r.url, r.name) for r in catalog.links(named, ["site"]).collect()) == [("u1", "A"), ("u2", "B"), ("u3", "C"), ("u9", "Z")]
    assert sorted(r.url for r in catalog.row_links(named, ["site"]).collect()) == ["u1", "u2", "u9"]
    assert sorted(r.url for r in catalog.first_link(named, ["site"]).collect()) == ["u1", "u9"]
    assert [tuple(r) for r in catalog.crawl(pages).collect()] == [("u0", "u1", "u9", "Z")]


def test_crawl_query_counts_links_without_pairing_them(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from millrace import queries

    names = ["a", "b", "c", ""]
    pages = [(i, "".join(f'<a href="{names[(i + i // 7 * j) % 4]}">{j}</a>' for j in range(i % 5))) for i in range(40)] + [(40, None), (41, "no link")]
    small = spark.createDataFrame(pages, "page_id long, html string")
    named = small.select(F.regexp_extract("html", catalog.LINK, 1).alias("url"), "html")
    want = {r.site: r["count"] for r in catalog.crawl(named).groupBy("site").count().collect()}
    assert {r.site: r.n for r in catalog.crawl_counts(named).collect()} == want and len(want) > 1
    hub = spark.range(10).select("id", F.repeat(F.lit('<a href="u">x</a>'), 20_000).alias("html"))
    small.unionByName(hub.withColumnRenamed("id", "page_id")).write.parquet(str(tmp_path / "pages.parquet"))
    began = time.monotonic()
    assert {r.site: r.n for r in queries.QUERIES["crawl"](spark, str(tmp_path)).collect()} == {**want, "u": 200_000**2}
    assert time.monotonic() - began < 30


def test_requirements(spark):
    text = [("p", 1, "Foo_Bar==1.2 # pin"), ("p", 2, "-r other"), ("p", 3, ""), ("q", 4, "foo-bar == 1.3"), ("q", 5, "num>=1.10, <2"), ("r", 6, "num<=1.9"), ("r", 7, "any")]
    rows = spark.createDataFrame(text, "plugin string, pos int, value string")
    specs = requirements.specifiers(requirements.parsed(rows)).cache()
    assert [(r.pkg, r.versions) for r in requirements.pinned_conflicts(specs).collect()] == [("foo-bar", ["1.2", "1.3"])]
    assert [tuple(r) for r in requirements.unsatisfiable(specs).collect()] == [("num", "1.10", "1.9")]
    assert sorted(r.line for r in requirements.merged(specs).collect()) == ["Foo_Bar==1.2,==1.3", "any", "num<2,<=1.9,>=1.10"]


def test_markers_extras_suffixes_and_unreadable_lines(spark, tmp_path):
    trees = {"p": 'foo[x, y]>=1; python_version < "3.8"\nbar>=2.0rc1\nuse @ http://h/x.zip\n==3 # no name\n', "q": "bar<1.0\nfoo (<3)\n-r more\nb d==1\n"}
    for plugin, text in trees.items():
        (tmp_path / "tree" / plugin).mkdir(parents=True)
        (tmp_path / "tree" / plugin / "requirements.txt").write_text(text)
    found, pins, bounds = requirements.resolve(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert sorted((r.plugin, r.pos) for r in found.collect()) == [("p", 4), ("q", 4)]
    assert pins.isEmpty() and [tuple(r) for r in bounds.collect()] == [("bar", "2.0rc1", "1.0")]
    assert not (tmp_path / "out").exists()
    (tmp_path / "tree" / "q" / "requirements.txt").write_text("bar<3.0\nfoo (<3)\n")
    requirements.resolve(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["bar<3.0,>=2.0rc1", "foo<3,>=1", "use"]


def test_golden(spark):
    def file(text):
        return files.split_lines(spark.createDataFrame([("f", text)], "file string, value string")).select("pos", "value")

    a = file("x,1.0\ny,2.0")
    assert golden.verdict(a, file("x,1.0\ny,2.0")) == "PASS"
    assert golden.verdict(a, file("y,2.0\nx,1.0")) == "PASS"
    assert golden.verdict(a, file("x,1.0\ny,2.000000001"), "csv") == "PASS"
    assert golden.verdict(a, file("x,1.0\ny,2.1"), "csv") == "FAIL"
    assert golden.verdict(a, file("x,1.0"), "csv") == "FAIL"
    assert golden.verdict(a, file("z"), "txt", custom=lambda g, e: True) == "PASS"
    with pytest.raises(ValueError):
        golden.fields_of("txt")
    paths = spark.createDataFrame([("a.csv.expected",), ("a.csv",), ("b.expected",)], "path string")
    assert sorted((r.expected, r.produced) for r in golden.paired(paths).collect()) == [("a.csv.expected", "a.csv"), ("b.expected", None)]
