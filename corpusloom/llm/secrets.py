"""Secret scans with multipart credential linking, in DataFrame expressions alone.

Strong kinds stand on their own: ``assign`` (a credential word given a value of 6 or more characters),
``access`` (an access key identifier) and ``hex`` (24 or more hexadecimal digits).  Weak kinds mean little
alone: ``ident`` (a user or client identifier given a value), ``key40`` (a bare 40-character secret) and
``endpoint`` (a service address).  A weak span is reported only if, within the same scope, spans of its
complementary parts occur:

* ``ident`` and ``endpoint`` need a secret part (``assign``, ``hex`` or ``key40``); an ``endpoint`` that has
  one needs an identifier (``ident`` or ``access``) too;
* ``key40`` needs an identifier part.

The linking is an interval join inside the row, by one sweep: parts, widened by ``scope`` code points, are sorted
by where they begin and weak spans by where they end, and a weak span is linked if of the complementary parts that
began by then one reaches as far as the weak span's start.

Places are code points.  Null and empty texts have no spans; rows are scanned on their own, so repeated rows
and identifiers give repeated results; other columns are dropped unless ``carry``.  A text of any number of
matches takes time in proportion to them, but for the sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Fixed patterns of the strong kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Patterns of the weak kinds; a key40 is looked for among whole runs of its characters.
IDENT = r"""(?:(?i:user_?name|user_?id|client_?id|account_?id|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
KEY40 = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|redis|mongodb|amqp)://[A-Za-z0-9._:@%-]+"
ORDER = ("assign", "access", "hex", "ident", "key40", "endpoint")

SPAN = "struct<start:bigint,`end`:bigint,kind:string>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def preceding(items: Column, start: Column, merge, block: int = 64) -> Column:
    """For each item what ``merge``, an associative function, makes of ``start`` and the items before it.

    A fold that gathers an array copies it at every step, so nothing is gathered: blocks are folded, then the
    blocks before each block, then the items before each item of its block.
    """

    def of(held: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / block).cast("int"))
        folded = F.transform(blocks, lambda j: F.aggregate(F.slice(held, j * block + 1, F.lit(block)), start, merge))
        earlier = _let(folded, lambda f: F.transform(f, lambda x, j: F.aggregate(F.slice(f, F.lit(1), j), start, merge)))
        each = _let(earlier, lambda e: F.transform(held, lambda x, i: F.aggregate(F.slice(held, i - F.pmod(i, F.lit(block)) + 1, F.pmod(i, F.lit(block))), F.get(e, F.floor(i / block).cast("int")), merge)))
        return F.when(F.size(held) > 0, each).otherwise(F.transform(held, lambda x: start))

    return _let(items, of)


def _runs(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as spans, with the matched string.

    ``split`` gives what lies between the matches that ``regexp_extract_all`` lists, so running lengths give
    their places.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.arrays_zip(between.alias("gap"), matches.alias("hit")), lambda x: x["hit"].isNotNull())

    def placed(held: Column) -> Column:
        lengths = F.transform(held, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long"))

        def spans(at: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(x["gap"])
                return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))

            return F.transform(held, span)

        return _let(preceding(lengths, F.lit(0).cast("long"), lambda a, b: a + b), spans)

    return _let(pieces, placed)


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,`end`:bigint,kind:string,hit:string>>")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def found(text: Column, kind: str) -> Column:
    """The spans of one kind; a pattern runs only on texts that a cheap test lets through."""
    if kind == "assign":
        test = F.lower(text).rlike("password|passwd|secret|token|api_?key") & text.rlike(ASSIGN)
        value = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6
        return _plain(F.filter(F.when(test, _runs(text, ASSIGN, kind)).otherwise(_none()), value))
    pattern = {"access": ACCESS, "hex": HEX, "ident": IDENT, "key40": KEY40, "endpoint": ENDPOINT}[kind]
    cheap = {"access": F.contains(text, F.lit("AKIA")), "endpoint": F.contains(text, F.lit("://"))}.get(kind, F.lit(True))
    spans = F.when(cheap & text.rlike(pattern), _runs(text, pattern, kind)).otherwise(_none())
    if kind == "key40":  # whole runs of 40, with a digit and both cases
        spans = F.filter(spans, lambda x: (F.length(x["hit"]) == 40) & x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Z]") & x["hit"].rlike("[a-z]"))
    return _plain(spans)


def link(parts: Column, scope: int) -> Column:
    """The weak spans of parts that are linked to their complementary parts."""
    far = F.lit(-1).cast("long")
    # Each part begins ``scope`` before its start; a weak one also asks, at its end, how far those begun reach.
    reach = lambda x, kinds: F.when(x["kind"].isin(*kinds), x["end"] + scope).otherwise(far)
    begins = F.transform(parts, lambda x: F.struct((x["start"] - scope).alias("at"), F.lit(0).alias("rank"), reach(x, ("assign", "hex", "key40")).alias("secret"), reach(x, ("ident", "access")).alias("name"), x.alias("span")))
    weak = F.filter(parts, lambda x: x["kind"].isin("ident", "key40", "endpoint"))
    asks = F.transform(weak, lambda x: F.struct(x["end"].alias("at"), F.lit(1).alias("rank"), far.alias("secret"), far.alias("name"), x.alias("span")))

    def met(events: Column) -> Column:
        ends = F.transform(events, lambda x: F.struct(x["secret"].alias("secret"), x["name"].alias("name")))
        farthest = preceding(ends, F.struct(far.alias("secret"), far.alias("name")), lambda a, b: F.struct(F.greatest(a["secret"], b["secret"]).alias("secret"), F.greatest(a["name"], b["name"]).alias("name")))

        def linked(x: Column, i: Column, f: Column) -> Column:
            kind, start = x["span"]["kind"], x["span"]["start"]
            secret, name = F.get(f, i)["secret"] >= start, F.get(f, i)["name"] >= start
            return (x["rank"] == 1) & F.when(kind == "ident", secret).when(kind == "key40", name).otherwise(secret & name)

        return _let(farthest, lambda f: F.transform(F.filter(events, lambda x, i: linked(x, i, f)), lambda x: x["span"]))

    return F.sort_array(_let(F.sort_array(F.concat(begins, asks)), met))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then by kind in the listed order."""
    rank = lambda k: F.coalesce(*[F.when(k == n, F.lit(i)) for i, n in enumerate(ORDER)])
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row per document: ``base`` and ``linked`` spans as arrays, and their digests."""
    row = [F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    strong = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"), *row)
    for kind in ORDER[:3]:
        strong = strong.withColumn(f"s_{kind}", found(F.col("text"), kind))
    base = F.concat(*[F.col(f"s_{k}") for k in ORDER[:3]])
    weak = strong.withColumn("base", base)
    # Every weak kind needs a complementary part; an ident or endpoint needs a secret, so only a key40 can bring one.
    for kind in ("ident", "key40", "endpoint"):
        possible = F.lower(F.col("text")).rlike("user_?name|user_?id|client_?id|account_?id|login") if kind == "ident" else F.lit(True)
        weak = weak.withColumn(f"w_{kind}", F.when(possible, found(F.col("text"), kind)).otherwise(F.array().cast(f"array<{SPAN}>")))
    parts = F.concat("base", "w_ident", "w_key40", "w_endpoint")
    any_weak = F.size("w_ident") + F.size("w_key40") + F.size("w_endpoint") > 0
    linked = weak.withColumn("linked", F.when(any_weak, link(parts, scope)).otherwise(F.array().cast(f"array<{SPAN}>")))
    return linked.select(
        "doc_id",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in ORDER[:3]],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
        "base",
        "linked",
        *(["row"] if carry else []),
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]", block: int = 128) -> Column:
    """text with every span replaced by the mask; of overlapping spans the first one's mask stands for all.

    What stays is listed first, as stretches between masks.  A place in a text is found by counting from its
    start, so stretches are cut out of blocks of the text, and blocks out of the text.
    """
    def stretches(held: Column) -> Column:
        """What lies before each span that starts where earlier ones have ended."""
        ends = preceding(F.transform(held, lambda x: x["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        return _let(ends, lambda at: F.filter(F.transform(held, lambda x, i: F.struct(F.get(at, i).alias("start"), x["start"].alias("end"))), lambda g: g["start"] <= g["end"]))

    def cut(of: Column, start: Column, end: Column) -> Column:
        return F.substring(of, start.cast("int") + 1, (end - start).cast("int"))

    def joined(gaps: Column, last: Column) -> Column:
        every = F.concat(gaps, F.array(F.struct(last.alias("start"), F.length(text).cast("long").alias("end"))))

        def whole(held: Column) -> Column:
            def one(i: Column) -> Column:
                own = F.slice(held, i * block + 1, F.lit(block))
                return _let(F.struct(own.alias("own"), F.element_at(own, 1)["start"].alias("start"), F.element_at(own, -1)["end"].alias("end")), lambda o: _let(cut(text, o["start"], o["end"]), lambda t: F.array_join(F.transform(o["own"], lambda g: cut(t, g["start"] - o["start"], g["end"] - o["start"])), mask)))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / block).cast("int")), one), mask)

        return _let(every, whole)

    masked = _let(F.sort_array(spans), lambda s: joined(stretches(s), F.array_max(F.transform(s, lambda x: x["end"]))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
