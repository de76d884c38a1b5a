"""Artifacts: JSON documents, manifests of JSON lines, logs and configuration."""

from __future__ import annotations

import tomllib
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One artifact per file, strict: what doesn't fit the schema fails; also the digest of the very bytes."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = raw.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.col("content").cast("string").alias("value"))
    return text.select("path", "sha256", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("artifact"))


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return manifest_records(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), schema)


def manifest_records(texts: DataFrame, schema: str) -> DataFrame:
    """Records of manifests given as whole texts: the first line is the header, a torn last line is dropped.

    Only a last line without its line end may be torn; a malformed line elsewhere fails.
    """
    lines = F.split("value", "\n", -1)
    whole = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))  # the last piece is empty, or torn
    rows = texts.select("path", F.posexplode(whole).alias("line", "text"))
    parsed = rows.select("path", (F.col("line") + 1).alias("line"), F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed


def manifest_headers(texts: DataFrame, schema: str) -> DataFrame:
    """The first line of each manifest, and the digest of its closed bytes."""
    return texts.select("path", F.sha2("value", 256).alias("sha"), F.from_json(F.substring_index("value", "\n", 1), schema, {"mode": "FAILFAST"}).alias("header"))


def log_lines(lines: DataFrame, run_id: str, command: str, extra: str) -> DataFrame:
    """Structured log lines with what is wrong with each: no object, repeated keys, another run or command.

    Keys are listed by pattern at the first level of objects without nesting, which is what log lines are.
    """
    schema = f"ts string, level string, run_id string, command string, event string, {extra}"
    keys = F.regexp_extract_all("value", F.lit(r'[{,]\s*"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("l"), keys.alias("k"))
    problem = (
        F.when(F.col("l").isNull() | F.col("l.event").isNull(), F.lit("not a log object"))
        .when(F.size("k") != F.size(F.array_distinct("k")), F.lit("repeated key"))
        .when(F.col("value").rlike(r"(?i)\b(nan|-?infinity)\b(?=\s*[,}])"), F.lit("not a number"))
        .when(F.col("value").rlike(r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"), F.lit("lone surrogate"))
        .when(F.col("l.run_id") != run_id, F.lit("another run"))
        .when(F.col("l.command") != command, F.lit("another command"))
    )
    return parsed.select("value", "l", problem.alias("problem"))


def load_config(path: str, into):
    """A dataclass from a TOML file, byte-order mark or not; unknown keys and wrong types are refused."""
    with open(path, encoding="utf-8-sig") as f:
        return _filled(into, tomllib.loads(f.read()), "")


def _filled(kind, values: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    out = {}
    for key, value in values.items():
        if key == "parallel" and not where:
            raise ValueError("there is no [parallel] table: Spark plans the work")
        if key not in known:
            raise ValueError(f"unknown key {where}{key}")
        default = getattr(kind(), key)
        if is_dataclass(default):
            value = _filled(type(default), value, f"{where}{key}.")
        elif isinstance(default, tuple):
            value = tuple(value)
        elif default is not None and type(value) is not type(default):
            raise ValueError(f"{where}{key} must be {type(default).__name__}")
        out[key] = value
    return kind(**out)


def sidecars(run_ids: list[str], root: str, folder: str = ".corpusloom", prefix: str = "corpusloom") -> list[str]:
    """Where runs keep their manifest and report, each once, in the order named."""
    return list(dict.fromkeys(f"{root}/{folder}/{prefix}-{run}-{kind}" for run in run_ids for kind in ("manifest.jsonl", "report.json")))
