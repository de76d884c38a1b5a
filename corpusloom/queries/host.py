"""What touches files and the driver alone: trees, artifacts, configuration, guards and progress.

Trees are small fixtures below the shared folder.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import scratch
from ..plans import apply as A
from ..session import ship
from ..sources import artifacts, sinks
from ..sources.tree import TreeSource
from .base import query, table


def _folder(spark) -> str:
    path = scratch(spark).removeprefix("file://")
    os.makedirs(path)
    return path


def _tree(spark) -> str:
    root = _folder(spark)
    os.makedirs(f"{root}/sub")
    os.makedirs(f"{root}/out")
    for name, data in {"a.txt": b"a\r\n", ".dot.txt": b"", "sub/_b.md": b"b\n", "out/c.txt": b"c", "d.bak": b"d"}.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    os.symlink("a.txt", f"{root}/to-file")
    os.symlink("sub", f"{root}/to-directory")
    os.symlink("gone", f"{root}/to-nothing")
    os.link(f"{root}/a.txt", f"{root}/twin.txt")
    return root


def _scan(spark, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("corpus_tree").option("exclude", "out/,*.bak").load(path)


@query("src01_tree_scan", "SELECT * FROM (VALUES ('.dot.txt', 'file', CAST(0 AS BIGINT), CAST(1 AS BIGINT)), ('a.txt', 'file', 3, 2), ('d.bak', 'excluded', 1, 1), ('sub/_b.md', 'file', 2, 1), ('twin.txt', 'file', 3, 2)) v(path, kind, size_bytes, nlink)")
def src01(spark, sf_dir):
    return _scan(spark, _tree(spark)).where("kind IN ('file', 'excluded')").select("path", "kind", "size_bytes", "nlink")


@query("src02_single_file", "SELECT 'a.txt' AS path, sha256(E'a\\r\\n') AS digest")
def src02(spark, sf_dir):
    return _scan(spark, f"{_tree(spark)}/a.txt").select("path", F.sha2("content", 256).alias("digest"))


@query("src04_symlinks", "SELECT * FROM (VALUES ('to-directory', 'link-directory', 'sub'), ('to-file', 'link-file', 'a.txt'), ('to-nothing', 'link-broken', 'gone')) v(path, kind, target)")
def src04(spark, sf_dir):
    return _scan(spark, _tree(spark)).where("kind LIKE 'link%'").select("path", "kind", "target")


@query("src06_unreadable", "SELECT * FROM (VALUES ('a.txt', 'unreadable', true), ('gone', 'unreadable', true), ('sub/_b.md', 'file', false)) v(path, kind, explained)")
def src06(spark, sf_dir):
    """A file that goes between listing and reading, and a directory that goes before it is listed, are rows with their errors."""
    from ..sources.tree import Chunk, TreeReader, listing

    root = _tree(spark)
    reader = TreeReader({"path": root})
    seen = [row for row in listing(root, ["a.txt", "*.md"], []) if row[1] == "file"]
    os.unlink(f"{root}/a.txt")
    rows = [reader.loaded(root, row) for row in seen] + list(reader.read(Chunk(root, [("gone", True)])))
    return spark.createDataFrame([(r[0], r[1], r[9] is not None) for r in rows], "path string, kind string, explained boolean")


ARTIFACTS = ['{"run_id": "r1", "totals": {"files": 2}}', '{"run_id": "r2", "totals": {"files": 5}}']


@query("src07_json_artifacts", f"SELECT 'r1' AS run_id, CAST(2 AS BIGINT) AS files, 'sha256:' || sha256('{ARTIFACTS[0]}') AS sha256 UNION ALL SELECT 'r2', 5, 'sha256:' || sha256('{ARTIFACTS[1]}')")
def src07(spark, sf_dir):
    root = _folder(spark)
    for i, text in enumerate(ARTIFACTS):
        with open(f"{root}/{i}.json", "w") as f:
            f.write(text)
    rows = artifacts.read_json(spark, f"file://{root}", "run_id string, totals struct<files:long>")
    return rows.select("artifact.run_id", "artifact.totals.files", "sha256")


@dataclass(frozen=True)
class Encoding:
    floor: int = 20
    detect: bool = True


@dataclass(frozen=True)
class Settings:
    include: tuple = ("*.txt",)
    encoding: Encoding = field(default_factory=Encoding)


@query("src09_config", "SELECT CAST(5 AS BIGINT) AS floor, true AS detect, '*.md,*.rst' AS include")
def src09(spark, sf_dir):
    path = f"{_folder(spark)}/c.toml"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("include = ['*.md', '*.rst']\n[encoding]\nfloor = 5\n")
    found = artifacts.load_config(path, Settings)
    return spark.createDataFrame([(found.encoding.floor, found.encoding.detect, ",".join(found.include))], "floor long, detect boolean, include string")


@query("src10_sidecars", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), '/c/.corpusloom/corpusloom-r1-manifest.jsonl'), (1, '/c/.corpusloom/corpusloom-r1-report.json'), (2, '/c/.corpusloom/corpusloom-r2-manifest.jsonl'), (3, '/c/.corpusloom/corpusloom-r2-report.json')) v(place, path)")
def src10(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(artifacts.sidecars(["r1", "r2", "r1"], "/c"))), "place long, path string")


@query("snk01_atomic_artifact", "SELECT '{\"a\": 1}' AS text, true AS refused")
def snk01(spark, sf_dir):
    path = f"{_folder(spark)}/x.json"
    sinks.write_artifact(path, {"a": 1})
    try:
        sinks.write_artifact(path, {"a": 2}, clobber=False)
        refused = False
    except FileExistsError:
        refused = True
    with open(path) as f:
        return spark.createDataFrame([(json.dumps(json.load(f)), refused)], "text string, refused boolean")


@query("snk03_guard", "SELECT * FROM (VALUES ('inside', true), ('own folder', false), ('outside', false), ('an input', true), ('a directory', true)) v(place, refused)")
def snk03(spark, sf_dir):
    top = _folder(spark)
    os.makedirs(f"{top}/corpus")
    with open(f"{top}/in.json", "w") as f:
        f.write("{}")
    places = {"inside": f"{top}/corpus/x.json", "own folder": f"{top}/corpus/.corpusloom/x.json", "outside": f"{top}/x.json", "an input": f"{top}/in.json", "a directory": top}
    rows = []
    for name, path in places.items():
        try:
            sinks.guard(path, f"{top}/corpus", [f"{top}/in.json"])
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "place string, refused boolean")


@query("snk07_heartbeat", "SELECT * FROM (VALUES (CAST(30 AS BIGINT), CAST(3 AS BIGINT)), (60, 3), (90, 3), (100, 3)) v(processed, total_skipped)")
def snk07(spark, sf_dir):
    """A report each 30 ticks of an injected clock, and one at the end."""
    said, now = [], [0]
    beat = sinks.Heartbeat(said.append, 100, every=30, clock=lambda: now[0])
    for i in range(1, 101):
        now[0] = i
        beat.advance(i, min(i, 3), 0)
    return spark.createDataFrame([(x["processed"], x["skipped"]) for x in said], "processed long, total_skipped long")


@query("txt15_validate", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'no block' ELSE 'invalid' END AS verdict FROM documents")
def txt15(spark, sf_dir):
    from ..functions.detect import front_problem
    from ..functions.text import front_block

    i = F.col("doc_id") % 4
    text = F.when(i == 0, F.lit("---\ntitle: t\nnormalizer: {}\nsource: {}\noutput: {}\n---\nx")).when(i == 1, F.lit("x")).when(i == 2, F.lit("---\ntitle: [\n---\n")).otherwise(F.lit("---\ntitle: 1\n---\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", front_block(text).alias("block")).withColumn("problem", front_problem("block"))
    return rows.select("doc_id", F.when(F.col("block").isNull(), F.lit("no block")).when(F.col("problem").isNull(), F.lit("valid")).otherwise(F.lit("invalid")).alias("verdict"))


@query("ver01_content_checks", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'newlines' ELSE 'encoding' END AS check_name, count(*) AS n FROM documents GROUP BY 1")
def ver01(spark, sf_dir):
    from ..functions.facts import with_facts
    from ..plans.verify import content_findings

    i = F.col("doc_id")
    content = F.when(i % 2 == 0, F.concat(F.encode(F.regexp_replace("text", r"[\r\n]", " "), "UTF-8"), F.unhex(F.lit("0D0A")))).otherwise(F.unhex(F.lit("61FF")))
    files = with_facts(table(spark, sf_dir, "documents").select(i.cast("string").alias("path"), content.alias("content")))
    return content_findings(files).groupBy(F.col("check").alias("check_name")).agg(F.count("*").alias("n"))


@query("chn10_backup_objects", "SELECT * FROM (VALUES ('b/file', 'regular'), ('b/link', 'symlink'), ('b/missing', 'missing'), ('b/folder', 'not-regular'), ('to/file', 'symlink')) v(backup, verdict)")
def chn10(spark, sf_dir):
    """Each component of a backup's path must be a real directory, and its end a regular file."""
    top = _folder(spark)
    os.makedirs(f"{top}/b/folder")
    with open(f"{top}/b/file", "w") as f:
        f.write("x")
    os.symlink("file", f"{top}/b/link")
    os.symlink("b", f"{top}/to")

    def verdict(rel: str) -> str:
        parts = rel.split("/")
        if any(os.path.islink(os.path.join(top, *parts[: i + 1])) for i in range(len(parts))):
            return "symlink"
        full = os.path.join(top, rel)
        return "missing" if not os.path.exists(full) else "regular" if os.path.isfile(full) else "not-regular"

    return spark.createDataFrame([(x, verdict(x)) for x in ("b/file", "b/link", "b/missing", "b/folder", "to/file")], "backup string, verdict string")


@query("apl08_finish_remaining", "SELECT path FROM (SELECT 's' || doc_id AS path, doc_id FROM documents UNION ALL SELECT 't' || doc_id, doc_id FROM documents WHERE doc_id % 5 <> 0) WHERE NOT (path LIKE 's%' AND doc_id % 3 = 0 AND doc_id % 5 <> 0)")
def apl08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    s, t = (F.concat(F.lit(x), F.col("i").cast("string")) for x in "st")
    names = docs.select(s.alias("path")).unionByName(docs.where("i % 5 <> 0").select(t.alias("path")))
    verdicts = docs.select(F.when(F.col("i") % 3 == 0, F.lit("finish-remaining")).otherwise(F.lit("completed")).alias("verdict"), s.alias("source"), t.alias("target"))
    return A.finished(names, verdicts)
