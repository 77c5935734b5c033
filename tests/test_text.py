from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_sizes(spark):
    values = ["1G", "32G", "512M", "1M", "1T", "4096", "0", "2g", "4m", "1t", "3K", "", "abc", "G", "-1G", "1GB", "9999999999G", "99999999999999999999", None]
    g = 1024**3
    assert one(spark, values, T.size_in_bytes) == [g, 32 * g, g // 2, 1024**2, 1024 * g, 4096, 0, 2 * g, 4 * 1024**2, 1024 * g, 3072, *[None] * 8]


def test_trim_tokens_and_comments(spark):
    assert one(spark, [" \ta b\r\n", None], T.trim_blanks) == ["a b", None]
    assert one(spark, ["  a\tb  c\n", "", None], T.tokens) == [["a", "b", "c"], [], None]
    assert one(spark, ["a # b # c", "# x", "plain"], T.without_comment) == ["a ", "", "plain"]


def test_paths_and_names(spark):
    assert one(spark, ["x", "/x", "\\x", "s3://b/x", ""], lambda c: T.resolve_path(c, F.lit("p/"))) == ["p/x", "/x", "\\x", "s3://b/x", "p/"]
    assert one(spark, ["a/libFooPlugin.so", "b/BarPlugin.py", "c/Baz.py"], T.step_name) == ["Foo", "Bar", None]
    assert one(spark, ["A_b", "x-._y", "Z"], T.package_name) == ["a-b", "x-y", "z"]


def test_numbers_versions_and_differences(spark):
    assert one(spark, ["1", "-2.5e3", ".5", "1_0", "1d", "nan", "", None], T.is_number) == [True, True, True, False, False, False, False, False]
    keys = one(spark, ["1.10", "1.9", "1.0.0", "2", "x", "1.*", None], T.version_key)
    assert [k and k.release for k in keys] == [[1, 10], [1, 9], [1], [2], None, None, None]
    rising = ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1.dev3", "1.0.post1", "1.0-2", "1.0.1", "1.1", "1!0.1"]
    keys = one(spark, rising, T.version_key)
    assert keys == sorted(keys) and len(set(map(str, keys))) == len(rising)
    assert one(spark, ["1.0", "1.000000001", "1.1", "a"], lambda c: T.differs(c, F.lit("1"))) == [False, False, True, True]
    assert one(spark, ["4abc", "x", "7"], lambda c: T.leading_int(c, F.lit(0))) == [4, 0, 7]
