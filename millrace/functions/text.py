"""Column functions on strings, sizes, names and paths.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of sizes, each a power of 1024.
SIZE_SUFFIXES = "KMGT"
TOLERANCE = 1e-8


def trim_blanks(c: Column) -> Column:
    """Without blanks, tabs and line ends on either side."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def tokens(c: Column) -> Column:
    """Runs of characters without white space; null for null."""
    return F.array_remove(F.split(c, r"[ \t\n\x0B\f\r]+"), "")


def size_in_bytes(c: Column) -> Column:
    """Digits and an optional K, M, G or T; null if malformed or beyond 63 bits."""
    ok = c.rlike(r"^[0-9]+[KMGTkmgt]?$")
    number = F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("long")
    suffix = F.upper(F.regexp_extract(c, r"([A-Za-z]?)$", 1))
    scale = F.lit(1).cast("long")
    for power, letter in enumerate(SIZE_SUFFIXES, 1):
        scale = F.when(suffix == letter, F.lit(1024**power).cast("long")).otherwise(scale)
    return F.when(ok, F.try_multiply(number, scale))


def leading_int(c: Column, default: Column) -> Column:
    """The number that a string begins with, else the default."""
    return F.coalesce(F.regexp_extract(c, r"^[ \t]*([+-]?[0-9]+)", 1).try_cast("int"), default)


def resolve_path(c: Column, prefix: Column) -> Column:
    """An absolute path (leading slash or backslash, or a scheme) as it is, another below the prefix."""
    return F.when(c.rlike(r"^[/\\]|^[A-Za-z][A-Za-z0-9+.-]*://"), c).otherwise(F.concat(prefix, c))


def below(prefix: Column, name: Column) -> Column:
    return F.concat_ws("/", prefix, name)


def package_name(c: Column) -> Column:
    """Runs of dashes, underscores and dots as one dash, in lower case."""
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))


def without_comment(c: Column) -> Column:
    return F.split_part(c, F.lit("#"), F.lit(1))


def is_number(c: Column) -> Column:
    """Whether the string is a decimal number (no type suffixes, infinities or separators)."""
    return F.coalesce(c.rlike(r"^[ ]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ ]*$"), F.lit(False))


def differs(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two tokens differ: numbers by more than the tolerance, others at all."""
    both = is_number(a) & is_number(b)
    return F.when(both, F.abs(a.try_cast("double") - b.try_cast("double")) > tolerance).otherwise(~a.eqNullSafe(b))


def step_name(path: Column, suffix: str = "Plugin") -> Column:
    """The name in a file such as dir/libNamePlugin.so; null for other files."""
    name = F.regexp_extract(path, rf"([^/\\]+){suffix}\.[^.]+$", 1)
    return F.when(name != "", F.regexp_replace(name, "^lib", ""))


#: Words for pre-releases, in order of their phase.
PRE_RELEASES = ("a|alpha", "b|beta", "c|rc|pre|preview")
VERSION = (
    r"(?i)^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*))?"
    r"((?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?[0-9]*)?)((?:[-_.]?dev[-_.]?[0-9]*)?)(?:\+[a-z0-9._-]+)?$"
)


def version_key(c: Column) -> Column:
    """A struct that sorts as versions do: epoch, release numbers without trailing zeros, pre-release,
    post-release and development number; null if the string is no version."""

    def part(i: int) -> Column:
        return F.regexp_extract(c, VERSION, i)

    def number(x: Column) -> Column:
        return F.coalesce(F.regexp_extract(x, r"([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))

    none, most = F.lit(-1).cast("long"), F.lit((1 << 63) - 1).cast("long")
    phase = F.lit(None).cast("int")
    for i, words in enumerate(PRE_RELEASES):
        phase = F.when(F.lower(part(3)).isin(*words.split("|")), i).otherwise(phase)
    only_dev = (part(5) == "") & (part(6) != "")
    return F.when(
        c.rlike(VERSION),
        F.struct(
            number(part(1)).alias("epoch"),
            F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda x: x.cast("long")).alias("release"),
            F.coalesce(phase, F.when(only_dev, -1).otherwise(len(PRE_RELEASES))).alias("phase"),
            number(part(4)).alias("pre"),
            F.when(part(5) == "", none).otherwise(number(part(5))).alias("post"),
            F.when(part(6) == "", most).otherwise(number(part(6))).alias("dev"),
        ),
    )


def exit_code(normal: Column, code: Column) -> Column:
    return F.when(normal, code).otherwise(F.lit(-1))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def pad(c: Column, width: int = 50) -> Column:
    return F.rpad(c, width, " ")
