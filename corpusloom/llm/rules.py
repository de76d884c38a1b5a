"""Quality rules: statistics in DataFrame expressions, and a decision list learned from labels.

The list is learned by sequential covering on the driver, in plain Python, from the statistics of a bounded
sample of labelled rows (``sample`` rows, those of the smallest identifier hashes outside the held-out fold):
a rule grows one threshold at a time by information gain on two thirds of the sample, is pruned on the other
third, and the rows that it covers are set aside; rules go on while they reject more than they wrongly reject.
The result is an ordered Spark conditional expression, and everything about documents stays one.

Null texts have no words; repeated rows and identifiers give repeated results; rows of a null label teach
nothing; of rows that repeat a labelled identifier the smallest text is learned from, with the mean of its labels;
without labels the list is empty and keeps all that the base rules keep; other columns are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

SPACE = r"[\x20\x09-\x0D]+"
#: Statistics that rules may test, as ratios of the counted columns.
RATIOS = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Sorting windows by their 64-bit hash, then by their words, brings equal ones together; only rows whose hashes
    aren't all different, as they are where no window repeats, are sorted.
    """
    n = lambda w: F.size(w)

    def covered(w: Column, hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))

        def again(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

            twice = F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
            step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["total"] + p + 3 - F.greatest(p, acc["end"])).alias("total"))
            return F.aggregate(places, start, step, lambda acc: acc["total"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, again))

    hashes = lambda w: F.transform(F.sequence(F.lit(0), n(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return _let(words, lambda w: F.when(n(w) < 4, F.lit(0)).otherwise(_let(hashes(w), lambda h: covered(w, h))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counted statistics of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    t = F.col("t")
    words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each array is bound once and gives all that is counted of it.
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    counted = rows.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).alias("n_marks"),
    )
    return counted.select(
        "doc_id",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        F.col("l.again").cast("long").alias("n_dup_lines"),
        F.col("w.again").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        F.col("n_upper").cast("long"),
        F.col("n_marks").cast("long"),
    )


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value >= bound, else value < bound
    bound: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.name] >= self.bound) == self.above

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value >= F.lit(self.bound) if self.above else value < F.lit(self.bound)


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _best(rows: list[tuple[dict[str, float], bool]]) -> tuple[float, Condition | None]:
    """The threshold of most information gain for the rows that are to be rejected."""
    p, n = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
    if not p or not n:
        return 0.0, None
    before, best, found = math.log2(p / (p + n)), 0.0, None
    for name in RATIOS:
        ordered = sorted((row[name], bad) for row, bad in rows)
        under_p = under_n = 0
        for i, (value, bad) in enumerate(ordered[:-1]):
            under_p, under_n = under_p + bad, under_n + (not bad)
            upper = ordered[i + 1][0]
            if value == upper:
                continue
            for above, a, b in ((False, under_p, under_n), (True, p - under_p, n - under_n)):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > best + 1e-9:
                    best, found = gain, Condition(name, above, (value + upper) / 2)
    return best, found


def _worth(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> float:
    hit = [bad for row, bad in rows if covers(rule, row)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def learn(rows: list[tuple[dict[str, float], bool]], most_rules: int = 12, most_terms: int = 4) -> list[Rule]:
    """Sequential covering of the rows marked True."""
    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules and any(bad for _, bad in left):
        grow, prune = [x for i, x in enumerate(left) if i % 3], left[::3]
        rule: Rule = ()
        inside = grow
        while len(rule) < most_terms:
            gain, more = _best(inside)
            if more is None or gain <= 0:
                break
            rule, inside = (*rule, more), [x for x in inside if more.holds(x[0])]
        if not rule:
            break
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: _worth(r, prune))
        caught = [bad for row, bad in left if covers(rule, row)]
        if _worth(rule, prune) <= 0.5 or 2 * sum(caught) <= len(caught):
            break
        rules.append(rule)
        left = [x for x in left if not covers(rule, x[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Kept or not, as an ordered conditional expression over the statistics."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from at most ``sample`` labelled rows; their statistics alone come to the driver."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark")).dropna().where(crc_mod("doc_id", 4) != 2)
    # Rows that repeat an identifier are one: their mean label, and the first of their texts.
    picked = marked.groupBy("doc_id").agg(F.avg("mark").alias("mark")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "mark").agg(F.min("text").alias("text"))
    stats = statistics(texts.select(F.struct("doc_id", "mark").alias("key"), "text"), "key", "text")
    rows = stats.select("doc_id.*", *[F.expr(v).alias(k) for k, v in RATIOS.items()]).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").collect()
    return learn([({k: float(r[k]) for k in RATIOS}, r["mark"] < 0.5) for r in rows])


def judge(docs: DataFrame, labels: DataFrame, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The statistics of every document, the base rules and the verdict."""
    rules = fit(docs, labels, sample, id_col, text_col, label_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = statistics(docs, id_col, text_col)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
