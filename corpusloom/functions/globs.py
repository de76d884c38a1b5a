"""Gitignore patterns as anchored regular expressions; the last one that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(text: str) -> str:
    """One path segment with ``*``, ``?`` and ``[...]``, as a regular expression."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            while text[i + 1 : i + 2] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            inside = text[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def compiled(pattern: str) -> tuple[str, bool] | None:
    """A regular expression over whole relative paths, and whether the pattern takes back; None for no pattern.

    A pattern without a slash, but at its end, matches at any depth; a directory's pattern takes what is below.
    """
    text = pattern.rstrip("\n")
    if re.search(r"(?<!\\) +$", text):
        text = text.rstrip(" ")
    if not text or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text[1:] if back else text
    only_below = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    segments = text.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += _segment(segment) + ("" if last else "/")
    if only_below:
        out += "/.*"
    elif segments[-1] != "**":
        out += "(?:/.*)?"
    return f"^{out}$", back


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path includes it."""
    out = F.lit(False)
    for found in map(compiled, patterns):
        if found:
            out = F.when(path.rlike("(?s)" + found[0]), F.lit(not found[1])).otherwise(out)
    return out


def pruned(directory: Column, patterns: list[str]) -> Column:
    """Whether a directory is left out with all below it, whatever is taken back there."""
    return matches(F.concat(directory, F.lit("/_")), patterns)
