"""Text normalisation as column expressions: newlines, blanks, tabs, final newline, and what changed."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it (fixed value).
PYTHON_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_newlines(x: Column) -> Column:
    """CRLF and CR become LF; other line separators stay."""
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trim_trailing(x: Column) -> Column:
    """Spaces and tabs before each LF and at the end go."""
    return F.regexp_replace(x, r"[ \t]+(?=\n|\z)", "")


def ensure_final_newline(x: Column) -> Column:
    """Exactly one LF at the end; the empty text becomes one LF."""
    return F.concat(F.regexp_replace(x, r"\n+\z", ""), F.lit("\n"))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t")) == ""


def collapse_blank_lines(x: Column, most: int) -> Column:
    """Of a run of blank lines the first ``most`` stay, as they are."""
    ended = F.endswith(x, F.lit("\n"))
    body = F.when(ended, F.left(x, F.length(x) - 1)).otherwise(x)

    def keep(lines: Column) -> Column:
        return F.filter(lines, lambda _, i: ~((i >= most) & F.forall(F.slice(lines, i - most + 1, F.lit(most + 1)), _blank)))

    def join(kept: Column) -> Column:
        return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.array_join(kept, "\n"), F.when(ended, F.lit("\n")).otherwise(F.lit(""))))

    return F.when(x == "", x).otherwise(let(let(F.split(body, "\n", -1), keep), join))


def normalize_tabs(x: Column, width: int) -> Column:
    """Each tab of a line's leading white space becomes ``width`` spaces."""
    lead = lambda line: F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit(" " * width))
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.concat(lead(line), F.regexp_replace(line, r"\A[ \t]+", ""))), "\n")


def suffix(path: Column) -> Column:
    """The last extension of a path's name; a leading dot alone starts none."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"(?s)^.+?(\.[^.]+)$", 1)


def suffix_class(path: Column) -> Column:
    return F.when(F.lower(suffix(path)).isin(".txt", ".md"), F.lit("text")).otherwise(F.lit("markup"))


def non_whitespace_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, PYTHON_SPACE, "")).cast("long")


def rename_target(path: Column) -> Column:
    """The .md path that a .txt path, in any case, is renamed to; null for others."""
    return F.when(F.lower(suffix(path)) == ".txt", F.concat(F.left(path, F.length(path) - 4), F.lit(".md")))


def operation_kind(operations: Column) -> Column:
    """rename, rewrite or both."""
    rename = F.array_contains(operations, "rename")
    return F.when(rename & (F.size(operations) > 1), F.lit("rename_and_rewrite")).when(rename, F.lit("rename")).otherwise(F.lit("rewrite"))


def front_block(x: Column) -> Column:
    """The lines between a leading ``---`` line and the next ``---`` or ``...`` line; null if there is none."""
    stripped = lambda line: F.regexp_replace(line, rf"\A{PYTHON_SPACE}+|{PYTHON_SPACE}+\z", "")

    def block(lines: Column) -> Column:
        marks = F.transform(lines, lambda y, i: F.when((i > 0) & stripped(y).isin("---", "..."), i + 1))
        end = F.array_min(F.filter(marks, lambda m: m.isNotNull()))
        return F.when((stripped(F.element_at(lines, 1)) == "---") & end.isNotNull(), F.array_join(F.slice(lines, F.lit(2), end - 2), "\n"))

    return let(F.split(x, "\n", -1), block)


def allocated_bytes(size: Column, fragment: int) -> Column:
    """Bytes of whole fragments."""
    return F.expr("NULL") if fragment <= 0 else (F.floor((size + F.lit(fragment - 1)) / F.lit(fragment)) * fragment).cast("long")


def ratio_up(numerator: str, denominator: str) -> Column:
    """The quotient of two whole columns or expressions, rounded up at twelve decimals."""
    d = f"CAST({denominator} AS DECIMAL(20,0))"
    units = F.expr(f"(CAST({numerator} AS DECIMAL(20,0)) * 1000000000000 + {d} - 1) DIV {d}")
    return (units.cast("decimal(20,0)") * F.lit(Decimal("0.000000000001"))).cast("decimal(32,12)")


def run_id(at: Column, seed: Column) -> Column:
    """run_<UTC time>_<six hex digits>, the digits from seed."""
    return F.concat(F.lit("run_"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.left(F.sha2(seed.cast("string"), 256), F.lit(6)))


@dataclass(frozen=True)
class Rules:
    """Switches of the normalisation."""

    newlines: bool = True
    trim: bool = True
    tabs: bool = False
    tab_width: int = 4
    blank_lines: int | None = 3
    final_newline: bool = True


#: A step's name, its switch and its expression, in order; markup takes the first alone.
def _steps(rules: Rules) -> list[tuple[str, bool, object]]:
    return [
        ("normalize_newlines", rules.newlines, normalize_newlines),
        ("trim_trailing_whitespace", rules.trim, trim_trailing),
        ("normalize_tabs", rules.tabs, lambda x: normalize_tabs(x, rules.tab_width)),
        ("collapse_blank_lines", rules.blank_lines is not None, lambda x: collapse_blank_lines(x, rules.blank_lines)),
        ("ensure_final_newline", rules.final_newline, ensure_final_newline),
    ]


def transformed(df: DataFrame, text: str, kind: str, rules: Rules = Rules(), out: str = "new_text", ops: str = "text_ops") -> DataFrame:
    """Adds the normalised text and the names of the steps that changed it."""
    columns, before, flags = df.columns, text, []
    for i, (name, on, step) in enumerate(_steps(rules)):
        if not on:
            continue
        now = f"__step{i}"
        applies = F.lit(True) if name == "normalize_newlines" else F.col(kind) == "text"
        df = df.withColumn(now, F.when(applies, step(F.col(before))).otherwise(F.col(before)))
        flags.append(F.when(F.col(now) != F.col(before), F.lit(name)))
        before = now
    named = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return df.select(*columns, F.col(before).alias(out), named.alias(ops))
