"""Column expressions against plain Python, on random texts."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from corpusloom.functions import text as T

ALPHABET = [" ", "\t", "\n", "\r", "\r\n", "a", "B", "é", " ", "\x85", " ", ".", "---"]


def texts(n=400, seed=5):
    rng = random.Random(seed)
    return ["", "\n", "\n\n\n", " \t", "a\n\n\n\n\nb\n"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def blank(line):
    return set(line) <= {" ", "\t"}


def allowed(x, most):
    """Which lines may stay: those that aren't the last of ``most + 1`` blank ones in a row."""
    lines = x.split("\n")
    return [line for i, line in enumerate(lines) if i < most or not all(map(blank, lines[i - most : i + 1]))]


def interior_and_leading(x):
    """The characters of a text, each with whether only blanks stand before it on its line."""
    return [(c, blank(x[x.rfind("\n", 0, i) + 1 : i])) for i, c in enumerate(x)]


def applied(spark, make, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", make(F.col("x"))).orderBy("i").collect()]


def test_newlines(spark):
    assert applied(spark, T.normalize_newlines, texts()) == [x.replace("\r\n", "\n").replace("\r", "\n") for x in texts()]


def test_trim(spark):
    assert applied(spark, T.trim_trailing, texts()) == ["\n".join(line.rstrip(" \t") for line in x.split("\n")) for x in texts()]


def test_final_newline(spark):
    assert applied(spark, T.ensure_final_newline, texts()) == [x.rstrip("\n") + "\n" for x in texts()]


def test_collapse(spark):
    for most in (0, 1, 3):
        for x, got in zip(texts(), applied(spark, lambda x, m=most: T.collapse_blank_lines(x, m), texts()), strict=True):
            body, end = (x[:-1], "\n") if x.endswith("\n") else (x, "")
            stay = allowed(body, most)
            assert got == ("\n".join(stay) + end if x and stay else "")
            assert [y for y in got.split("\n") if not blank(y)] == [y for y in x.split("\n") if not blank(y)]


def test_collapsing_twice_is_collapsing_once(spark):
    once = applied(spark, lambda x: T.collapse_blank_lines(x, 2), texts())
    assert applied(spark, lambda x: T.collapse_blank_lines(x, 2), once) == once


def test_tabs(spark):
    for x, got in zip(texts(), applied(spark, lambda x: T.normalize_tabs(x, 4), texts()), strict=True):
        assert got == "".join(" " * 4 if c == "\t" and leading else c for c, leading in interior_and_leading(x))


def test_non_whitespace(spark):
    assert applied(spark, T.non_whitespace_count, texts()) == [sum(map(len, x.split())) for x in texts()]


def test_nulls_stay_null(spark):
    for make in (T.normalize_newlines, T.trim_trailing, T.ensure_final_newline, lambda x: T.normalize_tabs(x, 4)):
        assert applied(spark, make, [None]) == [None]


def test_transform_names_only_what_changed(spark):
    df = spark.createDataFrame([("a \r\nb", "text"), ("a \r\nb", "markup"), ("a\n", "text"), ("", "text")], "x string, kind string")
    rows = [tuple(r) for r in T.transformed(df, "x", "kind").select("new_text", F.array_join("text_ops", ",")).collect()]
    assert rows == [
        ("a\nb\n", "normalize_newlines,trim_trailing_whitespace,ensure_final_newline"),
        ("a \nb", "normalize_newlines"),
        ("a\n", ""),
        ("\n", "ensure_final_newline"),
    ]


def test_suffix(spark):
    assert applied(spark, T.suffix, ["a/b.txt", "a/.txt", "a.b/c", "x.tar.gz", "A.TXT", "a/b."]) == [".txt", "", "", ".gz", ".TXT", ""]


def test_ratio_rounds_up(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (0, 7)], "a long, b long")
    assert [r[0] for r in df.select(T.ratio_up("a", "b")).collect()] == [Decimal("0.333333333334"), Decimal(2), Decimal(0)]


def test_front_block(spark):
    assert applied(spark, T.front_block, ["---\na: 1\n---\nx", " --- \na\n...\n", "---\nopen", "x\n---\n---", "---\n---\n"]) == ["a: 1", "a", None, None, ""]
