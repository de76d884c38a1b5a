"""Planning: every file ends as exactly one of action, explained skip or no-op."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.facts import utf16_suspect
from ..functions.globs import matches
from ..operators.tables import kept


@dataclass(frozen=True)
class Config:
    """Parameters of a plan."""

    include: tuple[str, ...] = ("*.txt", "*.md", "*.html", "*.htm")
    exclude: tuple[str, ...] = (".git/", ".corpusloom/", "node_modules/")
    detect: bool = True
    scan_detect: bool | None = True
    least_confidence: float = 0.80
    non_ascii_floor: int = 20
    max_bytes: int = 100 << 20
    on_collision: str = "skip"
    rename: bool = True
    rules: T.Rules = field(default_factory=T.Rules)


def gate(config: Config) -> Column:
    """The first reason that facts alone give against a file; null if none does.

    Over columns path, nlink, size_bytes, nul_bytes, bom, utf8_valid, confidence and non_ascii_bytes.
    """
    path = F.col("path")
    open_ = ~F.col("nul_bytes") & F.col("bom").isNull() & ~F.col("utf8_valid")
    unknown = F.lit("binary-suspect" if config.scan_detect is True else "low-confidence-encoding")
    return (
        F.when(~matches(path, list(config.include)), F.lit("excluded"))
        .when(matches(path, list(config.exclude)), F.lit("excluded"))
        .when(F.col("nlink") > 1, F.lit("hard-link-alias"))
        .when(F.col("size_bytes") > config.max_bytes, F.lit("oversize"))
        .when(open_ & F.lit(not config.detect), F.lit("low-confidence-encoding"))
        .when(open_ & F.col("confidence").isNull(), unknown)
        .when(open_ & (F.col("confidence") < config.least_confidence), F.lit("low-confidence-encoding"))
        .when(open_ & (F.col("non_ascii_bytes") < config.non_ascii_floor), F.lit("below-non-ascii-floor"))
    )


def nul_reason(content: Column, nul: Column, bom: Column) -> Column:
    """NULs without a mark: text in UTF-16, or just NULs."""
    return F.when(nul & bom.isNull(), F.when(utf16_suspect(content), F.lit("utf16-suspect")).otherwise(F.lit("nul-bytes")))


def changed_reason(size: Column, sha: Column, now_size: Column, now_sha: Column) -> Column:
    """What a file that isn't as it was scanned is skipped for."""
    return F.when(now_size.isNull(), F.lit("unreadable")).when(~size.eqNullSafe(now_size) | ~sha.eqNullSafe(now_sha), F.lit("changed-since-scan"))


def operations(texts: DataFrame, rules: T.Rules = T.Rules(), rename: bool = True) -> DataFrame:
    """Adds ``new_text`` and ``ops`` to rows of path, kind, decoded text x and ``marked`` (to be re-encoded)."""
    out = T.transformed(texts, "x", "kind", rules)
    first = F.array_compact(F.array(F.when(F.col("marked"), F.lit("reencode"))))
    last = F.array_compact(F.array(F.when((F.col("kind") == "text") & T.rename_target(F.col("path")).isNotNull(), F.lit("rename")))) if rename else F.array().cast("array<string>")
    return out.withColumn("ops", F.concat(first, F.col("text_ops"), last)).drop("text_ops")


def ledger(pending: DataFrame, files: DataFrame, on_collision: str = "skip") -> DataFrame:
    """Gives each output to its first claimant in path order.

    ``pending`` has path and ops; a renaming row competes for its target, others for their own path.  Adds
    ``target``, ``reason`` (collision) and ``winner``, the path that a losing row lost to.  A target that any
    file has blocks a rename, unless collisions overwrite; such rows claim nothing, nor do rows without ops.
    """
    target = F.when(F.array_contains("ops", "rename"), T.rename_target(F.col("path")))
    rows = pending.withColumn("target", target).withColumn("key", F.coalesce(target, F.col("path")))
    taken = files.select(F.col("path").alias("taken"))
    rows = rows.join(taken, F.col("target") == F.col("taken"), "left")
    blocked = F.col("taken").isNotNull() & F.lit(on_collision != "overwrite")
    rows = rows.withColumn("claims", (F.size("ops") > 0) & ~blocked)
    by_key = Window.partitionBy("key", "claims").orderBy("path")
    rows = rows.withColumn("place", F.when(F.col("claims"), F.row_number().over(by_key)))
    first = rows.where("place = 1").select(F.col("key").alias("won"), F.col("path").alias("winner_path"))
    rows = rows.join(first, F.col("key") == F.col("won"), "left")
    lost = (F.size("ops") > 0) & (~F.col("claims") | (F.col("place") > 1))
    winner = F.when(lost & (F.col("winner_path") < F.col("path")), F.col("winner_path"))
    return rows.withColumn("reason", F.when(lost, F.lit("collision"))).withColumn("winner", winner).drop("key", "taken", "claims", "place", "won", "winner_path")


def numbered(rows: DataFrame, *order: str | Column, name: str = "seq") -> DataFrame:
    """Adds dense numbers 1..n in order of columns, whatever these hold.

    Rows are ranged and sorted, and written with their range and place; the counts of the ranges, as many as there
    are partitions, give the offsets.  So no window holds more than those counts.
    """
    place = F.monotonically_increasing_id()
    ranged = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place), "numbered")
    part = F.shiftright("__place", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    found = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    return found.withColumn(name, (F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).select(*rows.columns, name)


def from_bytes(files: DataFrame, config: Config = Config()) -> DataFrame:
    """What a plan needs to know of files ``path``, ``content`` and, where it is given, ``nlink``.

    Adds the facts of the bytes, the charset and its confidence, ``kind``, the decoded text ``x``, ``marked`` (to be
    re-encoded) and ``decode_error``, the offset of what can't be decoded (-1: the codec is unknown).  Only bytes that
    are neither marked, nor UTF-8, nor hold NULs go to the charset detection, and only those and marked ones that
    aren't UTF-8 to decoding outside the JVM.  Null content is an unreadable file, whose facts are null.
    """
    from ..functions import detect
    from ..functions.facts import BOM_LENGTH, with_facts

    files = files if "nlink" in files.columns else files.withColumn("nlink", F.lit(1))
    seen = with_facts(files).withColumn("kind", T.suffix_class(F.col("path")))
    known = F.col("bom").isNotNull() | F.col("utf8_valid") | F.col("nul_bytes")
    sure = seen.where(F.coalesce(known, F.lit(True))).withColumns({"charset": F.coalesce("bom", F.lit("utf-8")), "confidence": F.lit(1.0)})
    unsure = seen.where(~known).withColumn("__found", detect.legacy_charset("content"))
    unsure = unsure.withColumns({"charset": F.col("__found.name"), "confidence": F.col("__found.confidence")}).drop("__found")
    plain = F.coalesce(F.col("bom"), F.lit("utf-8")) == "utf-8"
    skip = F.when(F.col("bom") == "utf-8", BOM_LENGTH["utf-8"]).otherwise(0)
    bare = F.expr("substring(content, 1 + __skip)")
    easy = sure.where(plain).withColumn("__skip", skip).withColumn("x", F.when(F.coalesce("utf8_valid", F.lit(False)), bare.cast("string"))).drop("__skip")
    easy = easy.withColumn("decode_error", F.lit(None).cast("long"))
    # A mark that lies, and every other codec, are decoded strictly by Python.
    hard = sure.where(~plain).unionByName(unsure)
    lying = easy.where((F.col("bom") == "utf-8") & ~F.col("utf8_valid")).drop("x", "decode_error")
    easy = easy.where(F.coalesce(~((F.col("bom") == "utf-8") & ~F.col("utf8_valid")), F.lit(True)))
    hard = hard.unionByName(lying).withColumn("__d", detect.decoded("content", "bom", F.coalesce("charset", F.lit("utf-8"))))
    hard = hard.withColumns({"x": F.col("__d.text"), "decode_error": F.col("__d.error_at")}).drop("__d")
    return easy.unionByName(hard).withColumn("marked", F.col("bom").isNotNull() | (F.col("charset") != "utf-8"))


def build_plan(files: DataFrame, config: Config = Config()) -> DataFrame:
    """A row per file: disposition (action, skip or noop), reason, operations, target, and the actions' numbers.

    ``files`` has path, kind, x, marked and the columns of :func:`gate`; with the bytes in ``content`` NULs are told
    from UTF-16, with ``decode_error`` undecodable texts are skipped, and a null ``content`` is unreadable.
    """
    early = [gate(config)]
    if "content" in files.columns:
        early = [F.when(F.col("content").isNull(), F.lit("unreadable")), *early, nul_reason(F.col("content"), F.col("nul_bytes"), F.col("bom"))]
    early.append(F.when(F.col("nul_bytes") & F.col("bom").isNull(), F.lit("nul-bytes")))
    if "decode_error" in files.columns:
        early.append(F.when(F.col("decode_error").isNotNull(), F.lit("decode-replacement")))
    gated = files.withColumn("early", F.coalesce(*early))
    planned = operations(gated.where("early IS NULL"), config.rules, config.rename)
    shrunk = T.non_whitespace_count(F.col("new_text")) < T.non_whitespace_count(F.col("x"))
    none = F.array().cast("array<string>")
    skipped = gated.where("early IS NOT NULL").select("path", "early", none.alias("ops"))
    # Texts are read once, for this; all that follows is about paths.
    facts = kept(planned.select("path", F.when(shrunk, F.lit("shrink-invariant")).alias("early"), "ops").unionByName(skipped), "facts")
    fine = ledger(facts.where("early IS NULL").select("path", "ops"), facts, config.on_collision)
    disposition = F.when(F.col("reason").isNotNull(), F.lit("skip")).when(F.size("ops") > 0, F.lit("action")).otherwise(F.lit("noop"))
    named = fine.select("path", disposition.alias("disposition"), "reason", F.array_join("ops", ",").alias("ops"), "target")
    skips = facts.where("early IS NOT NULL").select("path", F.lit("skip").alias("disposition"), F.col("early").alias("reason"), F.lit("").alias("ops"), F.lit(None).cast("string").alias("target"))
    actions = numbered(named.where("disposition = 'action'"), "path")
    rest = named.where("disposition <> 'action'").unionByName(skips).withColumn("seq", F.lit(None).cast("long"))
    return actions.unionByName(rest)


def verdict(reasons: DataFrame, fail_collisions: bool = False, fail_low_confidence: bool = False) -> DataFrame:
    """One row: how many skips are findings, and the exit code that follows."""
    counted = ["unreadable", "changed-since-scan", "timeout"] + ["collision"] * fail_collisions + ["low-confidence-encoding", "below-non-ascii-floor"] * fail_low_confidence
    return reasons.agg(F.count_if(F.col("reason").isin(*counted)).alias("findings")).withColumn("exit_code", (F.col("findings") > 0).cast("long"))
