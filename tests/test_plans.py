"""Globs, ledger, chains, coverage, thresholds, sources and sinks."""

import os
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.globs import compiled, matches
from corpusloom.functions.paths import contained
from corpusloom.plans import chain, planner, qualify, verify
from corpusloom.sources import artifacts, sinks
from corpusloom.sources.tree import TreeSource

GLOBS = [
    ("*.txt", ["a.txt", "x/a.txt", "a.txt/b"], ["a.md", "atxt"]),
    ("/a", ["a", "a/b"], ["x/a"]),
    ("a/", ["a/b", "x/a/b"], ["a"]),
    ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
    ("**/b", ["b", "x/b", "x/y/b"], ["bb"]),
    ("a/**", ["a/b", "a/b/c"], ["a"]),
    ("a/**/c", ["a/c", "a/b/c", "a/x/y/c"], ["ac"]),
    ("d[0-2].?", ["d1.x"], ["d3.x", "d1.xy"]),
    ("d[!0-2]", ["d9"], ["d1"]),
    ("\\#a", ["#a"], ["a"]),
]


@pytest.mark.parametrize("pattern,yes,no", GLOBS)
def test_globs(pattern, yes, no):
    rx, back = compiled(pattern)
    assert not back and all(re.match(rx, p) for p in yes) and not any(re.match(rx, p) for p in no)


def test_last_glob_decides(spark):
    df = spark.createDataFrame([("a.txt",), ("keep.txt",), ("b.md",)], "p string")
    assert [r[0] for r in df.select(matches(F.col("p"), ["# no", "", "*.txt", "!keep.txt"])).collect()] == [True, False, False]


def test_containment(spark):
    df = spark.createDataFrame([("a/b",), ("../a",), ("a/../../b/c",), ("/a",), ("a/..",), ("./a//b",)], "p string")
    assert [r[0] for r in df.select(contained(F.col("p"))).collect()] == [True, False, False, False, True, True]


def greedy(rows, policy):
    """The ledger as a loop in path order."""
    paths, claimed, out = {p for p, _ in rows}, {}, {}
    for path, ops in sorted(rows):
        target = path[:-4] + ".md" if "rename" in ops else None
        if not ops:
            out[path] = None
            continue
        key = target or path
        if key in claimed or (target in paths and policy != "overwrite"):
            out[path] = "collision"
            continue
        claimed[key] = path
        out[path] = None
    return out


@pytest.mark.parametrize("policy", ["skip", "overwrite"])
def test_ledger_is_greedy(spark, policy):
    import random

    rng = random.Random(3)
    rows = {}
    for _ in range(300):
        path = f"{rng.randint(0, 99)}{rng.choice(['.txt', '.TXT', '.md'])}"
        rows[path] = [x for x in (["normalize_newlines"] if rng.random() < 0.4 else []) + (["rename"] if path.lower().endswith(".txt") else [])]
    df = spark.createDataFrame(list(rows.items()), "path string, ops array<string>")
    found = {r["path"]: r["reason"] for r in planner.ledger(df, df, policy).collect()}
    assert found == greedy(list(rows.items()), policy)


def test_dense_numbers(spark):
    df = spark.createDataFrame([(p,) for p in ["b/2", "a/1", "a/10", "c", "a/2"]], "p string")
    assert [(r["p"], r["seq"]) for r in planner.numbered(df, "p").orderBy("seq").collect()] == [("a/1", 1), ("a/10", 2), ("a/2", 3), ("b/2", 4), ("c", 5)]


def test_chain_order():
    heads = [{"run_id": i, "sha": f"s{i}", "prior_sha": f"s{i - 1}" if i else None} for i in (2, 0, 1)]
    assert [h["run_id"] for h in chain.ordered_sets(heads)] == [0, 1, 2]
    for bad in (heads + [{"run_id": 9, "sha": "s9", "prior_sha": "s0"}], heads[:2], heads + [{"run_id": 9, "sha": "s9", "prior_sha": "none"}]):
        with pytest.raises(ValueError):
            chain.ordered_sets(bad)


def test_lifecycle_states(spark):
    schema = "set_index int, seq long, kind string, action_id string, undoes_action_id string, operation string, original_path string, target_path string, before_sha string, after_sha string, result string"
    row = lambda s, q, kind, action, undoes, result: (s, q, kind, action, undoes, "rename", "p", "t", "b", "c", result)
    data = [
        row(1, 1, "apply", "a1", None, "intent"),
        row(1, 2, "apply", "a1", None, "applied"),
        row(1, 3, "apply", "a2", None, "intent"),
        row(2, 1, "apply", "a2", None, "applied"),
        row(2, 2, "apply", "a3", None, "intent"),
        row(3, 1, "restore", "r1", "a1", "intent"),
        row(3, 2, "restore", "r1", "a1", "applied"),
        row(3, 3, "restore", "r2", "a2", "intent"),
    ]
    records = spark.createDataFrame(data, schema)
    assert {r["action"]: r["state"] for r in chain.lifecycle(records).collect()} == {"a1": "restored", "a2": "pending-restore", "a3": "pending-intent"}
    assert [tuple(r) for r in chain.standalone_terminals(records).collect()] == [(2, "a2", True)]
    assert chain.sequence_gaps(records).isEmpty() and chain.unknown_undoes(records).isEmpty() and chain.kind_lineage(records).isEmpty()


def test_report_fold(spark):
    data = [("a", 1, "not-attempted"), ("a", 2, "applied"), ("a", 3, "already-applied"), ("b", 1, "applied"), ("b", 2, "failed"), ("c", 1, "already-applied"), ("d", 1, None)]
    df = spark.createDataFrame(data, "action_id string, attempt int, observation string")
    assert {r["action_id"]: (r["state"], r["illegal"]) for r in verify.report_states(df).collect()} == {"a": ("applied", ""), "b": ("applied", "applied>failed"), "c": ("applied", "")}


def test_published_thresholds(spark):
    from corpusloom.queries.scale import points

    assert qualify.thresholds(points(spark), 10000, 100000, 1000000).first()[0] == 25_902_581_760
    assert qualify.slope(points(spark)).select(F.ceil("slope").cast("long")).first()[0] == 20_752


def test_recipes(spark):
    rows = {r["recipe_class"]: r["n"] for r in qualify.corpus(spark, 80).groupBy("recipe_class").agg(F.count("*").alias("n")).collect()}
    assert rows == {"rename-only": 48, "rewrite-and-rename": 16, "clean-markdown": 8, "rewrite-markdown": 4, "legacy-conversion": 2, "below-floor-skip": 2}


def test_tree_source(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "skip").mkdir()
    (root / "a.txt").write_bytes(b"a\r\n")
    (root / ".hidden.txt").write_bytes(b"h")
    (root / "sub/_b.md").write_bytes(b"b")
    (root / "skip/c.txt").write_bytes(b"c")
    (root / "x.bak").write_bytes(b"x")
    (root / "link").symlink_to("a.txt")
    (root / "broken").symlink_to("nowhere")
    os.link(root / "a.txt", root / "twin.txt")
    spark.dataSource.register(TreeSource)
    df = spark.read.format("corpus_tree").option("exclude", "skip/,*.bak").load(str(root))
    rows = {r["path"]: r for r in df.collect()}
    assert {k: r["kind"] for k, r in rows.items()} == {"a.txt": "file", ".hidden.txt": "file", "sub/_b.md": "file", "x.bak": "excluded", "link": "link-file", "broken": "link-broken", "twin.txt": "file"}
    assert bytes(rows["a.txt"]["content"]) == b"a\r\n" and rows["a.txt"]["nlink"] == 2 and rows["link"]["target"] == "a.txt"
    assert rows["a.txt"]["ino"] == rows["twin.txt"]["ino"]
    one = spark.read.format("corpus_tree").load(str(root / "a.txt")).collect()
    assert [r["path"] for r in one] == ["a.txt"] and bytes(one[0]["content"]) == b"a\r\n"


def test_manifest_torn_tail(spark):
    body = '{"h": 1}\n{"seq": 1}\n{"seq": 2}\n'
    df = spark.createDataFrame([("m", body), ("torn", body + '{"se'), ("only", '{"h": 1}\n')], "path string, value string")
    rows = artifacts.manifest_records(df, "seq long").select("path", "r.seq").orderBy("path", "seq").collect()
    assert [tuple(r) for r in rows] == [("m", 1), ("m", 2), ("torn", 1), ("torn", 2)]


def test_log_problems(spark):
    good = '{"ts":"t","level":"info","run_id":"r","command":"scan","event":"e","n":1}'
    lines = [good, good.replace('"r"', '"q"'), good.replace('"n":1', '"n":1,"n":2'), "nonsense", good.replace('"n":1', '"n":NaN')]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").orderBy("i").coalesce(1)
    assert [r["problem"] for r in artifacts.log_lines(df, "r", "scan", "n long").collect()] == [None, "another run", "repeated key", "not a log object", "not a number"]


def test_config(tmp_path):
    from dataclasses import dataclass, field

    @dataclass(frozen=True)
    class Inner:
        floor: int = 20

    @dataclass(frozen=True)
    class Outer:
        encoding: Inner = field(default_factory=Inner)
        include: tuple = ("a",)

    path = tmp_path / "c.toml"
    path.write_bytes("﻿include = ['b']\n[encoding]\nfloor = 3\n".encode())
    assert artifacts.load_config(str(path), Outer) == Outer(Inner(3), ("b",))
    for bad in ("x = 1", "[encoding]\nfloor = 'a'", "[parallel]\nn = 1"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            artifacts.load_config(str(path), Outer)


def test_sinks(spark, tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    with pytest.raises(ValueError):
        sinks.guard(str(root / "x.json"), str(root), [])
    sinks.guard(str(root / ".corpusloom/x.json"), str(root), [])
    sinks.write_artifact(str(tmp_path / "a/x.json"), {"a": 1})
    assert (tmp_path / "a/x.json").read_text() == '{"a": 1}'
    with pytest.raises(FileExistsError):
        sinks.write_artifact(str(tmp_path / "a/x.json"), {"a": 2}, clobber=False)
    copies = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, content string")
    sinks.append_backups(copies, f"file://{tmp_path}/backups")
    with pytest.raises(ValueError):
        sinks.append_backups(copies, f"file://{tmp_path}/backups")
    with pytest.raises(ValueError):
        sinks.append_backups(copies.unionByName(copies), f"file://{tmp_path}/others")


def test_heartbeat():
    said, now = [], [0.0]
    beat = sinks.Heartbeat(said.append, 3, every=10, clock=lambda: now[0])
    beat.advance(1, 0, 0)
    now[0] = 11
    beat.advance(2, 1, 0)
    beat.advance(3, 1, 0)
    assert [x["processed"] for x in said] == [2, 3]
    with pytest.raises(ValueError):
        beat.advance(2, 1, 0)


def test_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import start

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "path string, text string"
    spark.createDataFrame([("a.txt", "x \r\n"), ("b.md", "x\n")], schema).coalesce(1).write.parquet(source)
    start(spark.readStream.schema(schema).parquet(source), out, f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([("c.md", "x\n"), ("d.md", "new\n")], schema).coalesce(1).write.mode("append").parquet(source)
    start(spark.readStream.schema(schema).parquet(source), out, f"{tmp_path}/check").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{out}/texts").collect()) == ["new\n", "x\n"]
    paths = {r["path"]: r["sha"] for r in spark.read.parquet(f"{out}/paths").collect()}
    assert sorted(paths) == ["a.txt", "b.md", "c.md", "d.md"] and paths["a.txt"] == paths["b.md"] == paths["c.md"] != paths["d.md"]
    assert spark.read.parquet(f"{out}/claims").count() == 2


def test_trees_are_listed_by_tasks(spark, tmp_path):
    from corpusloom.session import ship
    from corpusloom.sources.tree import TreeReader, TreeSource

    names = [f"{a}/{b}/f{c}.txt" for a in "xyz" for b in "pq" for c in range(3)] + ["top.txt", "x/beside.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "x" / "long.txt").write_bytes(b"y" * 100)
    ship(spark)
    spark.dataSource.register(TreeSource)
    for parts in (1, 2, 4, 9, 64):
        assert len(TreeReader({"path": str(tmp_path), "parts": str(parts)}).partitions()) <= parts
        rows = spark.read.format("corpus_tree").option("parts", parts).option("maxFileBytes", 50).load(str(tmp_path)).collect()
        assert {r["path"]: bytes(r["content"]) for r in rows if r["kind"] == "file"} == {n: n.encode() for n in names}
        assert [(r["path"], r["kind"], r["content"]) for r in rows if r["kind"] != "file"] == [("x/long.txt", "oversize", None)]
        assert all((r["error"] is None) == (r["kind"] == "file") for r in rows)
