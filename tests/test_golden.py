"""Odd documents as bytes, and what a plan makes of each by the default configuration."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import detect
from corpusloom.plans import apply as A
from corpusloom.plans import planner as P

LEGACY = "Größe und Übermaß: die schöne Straße führt über Brücken, Flüsse und Hügel. Äpfel, Öl, Käse. "
#: name: bytes, disposition, reason, operations, target.
GOLDEN = {
    "below-floor.txt": (("plain words only, " * 20 + "café, naïve\n").encode("cp1252"), "skip", "below-non-ascii-floor", "", None),
    "clean-noop.md": (b"clean\n", "noop", None, "", None),
    "collision-src.md": (b"taken\n", "noop", None, "", None),
    "collision-src.txt": (b"moves\n", "skip", "collision", "normal", None),
    "decode-replacement.txt": (b"\xef\xbb\xbfbroken \xff here\n", "skip", "decode-replacement", "", None),
    "legacy-cp1252.txt": ((LEGACY * 8 + " \r\nzweite Zeile\r\n").encode("cp1252"), "action", None, "reencode,normalize_newlines,trim_trailing_whitespace,rename", "legacy-cp1252.md"),
    "markup-crlf.html": (b"<p>a\r\n\r\n\r\n\r\n\r\n\r\nb\r\n", "action", None, "normalize_newlines", None),
    "mixed-endings.txt": (b"a\r\nb\rc\n", "action", None, "normalize_newlines,rename", "mixed-endings.md"),
    "padded-legacy.txt": (b"a\n" + b"\n" * 200 + b"b\n", "action", None, "collapse_blank_lines,rename", "padded-legacy.md"),
    "scattered-nuls.txt": (b"some\x00 words with\x00 NULs\n" * 4, "skip", "nul-bytes", "", None),
    "tabs-leading.md": (b"\tlead\tinside\n", "noop", None, "", None),
    "utf16-bomless.txt": ("interleaved text\n".encode("utf-16-le"), "skip", "utf16-suspect", "", None),
    "utf16-le-bom.txt": (b"\xff\xfe" + "line\r\nmore\r\n".encode("utf-16-le"), "action", None, "reencode,normalize_newlines,rename", "utf16-le-bom.md"),
    "utf8-bom.txt": (b"\xef\xbb\xbfmarked\n", "action", None, "reencode,rename", "utf8-bom.md"),
    "zero-byte.txt": (b"", "action", None, "ensure_final_newline,rename", "zero-byte.md"),
    "gone.md": (None, "skip", "unreadable", "", None),
}


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(k, None if v[0] is None else bytearray(v[0])) for k, v in GOLDEN.items()]
    return P.from_bytes(spark.createDataFrame(rows, "path string, content binary").repartition(3))


def test_golden_documents(seen):
    got = {r["path"]: (r["disposition"], r["reason"], r["target"]) for r in P.build_plan(seen).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[1:3] for k, v in GOLDEN.items()}
    assert all(got[k][2] == v[4] for k, v in GOLDEN.items() if v[1] == "action")
    ops = {r["path"]: r["ops"] for r in P.build_plan(seen).where("disposition = 'action'").collect()}
    assert ops == {k: v[3] for k, v in GOLDEN.items() if v[1] == "action"}


def test_nothing_fits(spark, monkeypatch):
    """Bytes that no charset is found for are suspect; the worker's detector is told by the confidence alone."""
    rows = spark.createDataFrame([("x.txt", bytearray(b"\x81\x8d\x8f\x90\x9d" * 9))], "path string, content binary")
    found = P.from_bytes(rows).withColumn("confidence", F.lit(None).cast("double"))
    assert P.build_plan(found).first()["reason"] == "binary-suspect"
    assert detect.best_charset(b"") is None or detect.best_charset(b"")[1] <= 1


def test_where_decoding_fails(seen):
    assert seen.where("path = 'decode-replacement.txt'").first()["decode_error"] == 7
    assert seen.where("path = 'legacy-cp1252.txt'").first()["x"].startswith("Größe")


def test_a_run_and_its_undoing(spark, seen, tmp_path):
    """What is applied can be undone to the byte, and each step leaves its records."""
    files = spark.createDataFrame([(k, bytearray(v[0])) for k, v in GOLDEN.items() if v[0] is not None], "path string, content binary")
    plan = P.build_plan(seen).where("disposition = 'action'").join(seen.select("path", F.col("sha256").alias("source_sha")), "path")
    done = A.execute(files, plan.select("seq", "path", "target", "ops", "source_sha"), "run", f"file://{tmp_path}/one")
    assert {r["outcome"] for r in done.outcomes.collect()} == {"applied"}
    after = {r["path"]: bytes(r["content"]) for r in done.corpus.collect()}
    assert after["utf16-le-bom.md"] == b"line\nmore\n" and after["utf8-bom.md"] == b"marked\n" and after["zero-byte.md"] == b"\n" and "zero-byte.txt" not in after
    assert after["legacy-cp1252.md"].decode().startswith("Größe") and len(after) == len(GOLDEN) - 1
    records = done.journal.orderBy("record_seq").collect()
    assert [r["record_seq"] for r in records] == list(range(1, len(records) + 1)) and [r["result"] for r in records[:4]] == ["intent", "applied"] * 2
    back = A.restore(done.corpus, done.journal, done.backups, "undo", f"file://{tmp_path}/two")
    assert {r["path"]: bytes(r["content"]) for r in back.corpus.collect()} == {k: v[0] for k, v in GOLDEN.items() if v[0] is not None}
    assert {r["result"] for r in back.journal.collect()} == {"intent", "applied"} and back.journal.where("undoes_action_id IS NULL").isEmpty()


def test_overwritten_targets_come_back(spark, tmp_path):
    config = P.Config(on_collision="overwrite")
    files = spark.createDataFrame([("a.txt", bytearray(b"new \n")), ("a.md", bytearray(b"old\n"))], "path string, content binary")
    seen = P.from_bytes(files, config)
    plan = P.build_plan(seen, config).where("path = 'a.txt'").join(seen.select("path", F.col("sha256").alias("source_sha")), "path")
    assert A.execute(files, plan, "r0", f"file://{tmp_path}/none", config, preserved=False).outcomes.first()["outcome"] == "skipped:collision-unpreserved"
    done = A.execute(files, plan, "r1", f"file://{tmp_path}/one", config)
    assert [(r["path"], bytes(r["content"])) for r in done.corpus.collect()] == [("a.md", b"new\n")]
    back = A.restore(done.corpus, done.journal, done.backups, "r2", f"file://{tmp_path}/two")
    assert {r["path"]: bytes(r["content"]) for r in back.corpus.collect()} == {"a.txt": b"new \n", "a.md": b"old\n"}
    with pytest.raises(ValueError):  # backups are written once
        A.execute(files, plan, "r1", f"file://{tmp_path}/one", config)


def test_restoring_refuses_what_changed(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.md", bytearray(b"x \n")) for i in range(3)], "path string, content binary")
    seen = P.from_bytes(files)
    plan = P.build_plan(seen).join(seen.select("path", F.col("sha256").alias("source_sha")), "path")
    done = A.execute(files, plan, "r1", f"file://{tmp_path}/one")
    now = done.corpus.select("path", F.when(F.col("path") == "1.md", F.encode(F.lit("mine"), "UTF-8")).otherwise(F.col("content")).alias("content"))
    backups = done.backups.where("key NOT LIKE '%/2.md'")
    back = A.restore(now, done.journal, backups, "r2", f"file://{tmp_path}/two")
    assert {r["path"]: r["outcome"] for r in back.outcomes.collect()} == {"0.md": "restored", "1.md": "modified-since-apply", "2.md": "backup-missing"}
    assert {r["path"]: bytes(r["content"]) for r in back.corpus.collect()} == {"0.md": b"x \n", "1.md": b"mine", "2.md": b"x\n"}


GATE = "plan string, operation string, overwrites boolean, backup_dir boolean, preserved boolean, opt_in boolean, outside boolean, backup_inside boolean, backup_writable boolean, journal_writable boolean, bytes_needed long, bytes_free long"


def test_the_gate(spark):
    fine = {"operation": "rewrite", "overwrites": False, "backup_dir": True, "preserved": False, "opt_in": False, "outside": False, "backup_inside": False, "backup_writable": True, "journal_writable": True, "bytes_needed": 5, "bytes_free": 9}
    cases = {
        "fine": ([{}], ""),
        "bare": ([{"backup_dir": False}], "rewrites-unpreserved"),
        "declared": ([{"backup_dir": False, "preserved": True}], ""),
        "one opted": ([{"backup_dir": False, "opt_in": True}], ""),
        "two opted": ([{"backup_dir": False, "opt_in": True}] * 2, "opt-in-of-many,rewrites-unpreserved"),
        "renames": ([{"backup_dir": False, "operation": "rename"}], ""),
        "clobbers": ([{"backup_dir": False, "operation": "rename", "overwrites": True}], "overwrites-without-backup"),
        "inside": ([{"backup_inside": True, "backup_writable": False}], "backup-inside-corpus"),
        "locked": ([{"backup_writable": False}], "backup-unwritable"),
        "no journal": ([{"journal_writable": False}], "journal-unwritable"),
        "escapes": ([{}, {"outside": True}], "outside-root"),
        "full": ([{}, {}], "no-space"),
    }
    rows = [(name, *(fine | own).values()) for name, (actions, _) in cases.items() for own in actions]
    got = {r["plan"]: r["refusals"] for r in A.preservation(spark.createDataFrame(rows, GATE)).collect()}
    assert got == {name: refusals if len(actions) == 1 or name == "full" else ",".join(filter(None, [refusals, "no-space"])) for name, (actions, refusals) in cases.items()}
