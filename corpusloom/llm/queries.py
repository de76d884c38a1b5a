"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import decontaminate
from .extract import extract
from .idstore import token_ids
from .lm import score
from .packing import pack
from .quality import classify
from .rules import judge
from .secrets import scan
from .simhash import near_duplicates
from .warc import archive


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every document among the benchmark's windows of 10 words.

    Null and wordless texts have no words and are clean; items without identifier hit but aren't listed; repeated
    rows and identifiers give repeated rows; no documents give none, no items leave all clean; other columns go.
    """
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    Null and empty html give an empty text, long and broken pages take linear time; repeated rows give repeated
    rows; no pages give none; other columns go.
    """
    return extract(table(spark, sf_dir, "pages"))


def op3_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document.

    Null and empty texts score the mean label, without labels all score 0.5; null identifiers are not held out;
    of rows that repeat a labelled identifier the smallest text is learned from; no documents give none; other
    columns go.
    """
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token-id files say of every document.

    Null texts are empty, with their end id; null identifiers come first; rows that repeat an identifier are
    documents of their own, in the order of their texts' hashes; no documents give none; other columns go.
    """
    return token_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the class of every document.

    Null and wordless texts have fingerprint zero and link like others; rows without identifier get the least one
    of their class, or null; repeated rows are one class; no documents give none; other columns go.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=2, shingle=3)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of every page.

    Null html is empty; repeated rows of a first page stay responses once; rows without identifier revisit; no
    pages give none; other columns go.
    """
    return archive(table(spark, sf_dir, "pages"), least=100)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document and the rules' verdict.

    Null texts have no words and fail the base rules; without labels these decide alone; repeated rows give
    repeated rows; no documents give none; other columns go.
    """
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base and the model's score of every document.

    Null texts are their end token; rows without identifier train; repeated rows are scored apart; without
    training documents scores follow from zero counts; no documents give none; other columns go.
    """
    return score(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 1024 ids.

    Null texts are their end id; rows that repeat an identifier, or have none, are documents of their own; no
    documents give none; other columns go.
    """
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document.

    Null and empty texts have none; repeated rows give repeated rows; ties of place go by the listed kinds; no
    documents give none; other columns go.
    """
    return scan(table(spark, sf_dir, "documents")).drop("base", "linked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_main_text": op2_main_text,
    "op3_quality_vote": op3_quality_vote,
    "op4_token_ids": op4_token_ids,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_gru_score": op8_gru_score,
    "op9_packing": op9_packing,
    "op10_secret_links": op10_secret_links,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP1 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS x FROM s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
g AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM d, (SELECT DISTINCT n FROM s), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
h AS (SELECT rid, g.n, k, item_id FROM g JOIN p ON g.n = p.n AND g.x = p.x),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (WHERE item_id IS NOT NULL)), ',') AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)"""

_OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)"""


def _sql_pattern(pattern: str) -> str:
    """A quoted pattern in which letters of either case are spelled out, as DuckDB folds more than ASCII."""
    either = lambda m: re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", m[1])
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: f"(?:{either(m)})", pattern).replace("'", "''")


def _spans(name: str, pattern: str, keep: str = "true") -> str:
    """Spans of a pattern: where what lies between the matches says that they are."""
    quoted = _sql_pattern(pattern)
    return f"""{name}0 AS (SELECT rid, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS found FROM d WHERE regexp_matches(t, '{quoted}')),
{name}1 AS (SELECT rid, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM {name}0),
{name}2 AS (SELECT rid, found[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(found[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS s FROM {name}1),
{name} AS (SELECT rid, '{name}' AS kind, s, s + length(hit) AS e FROM {name}2 WHERE {keep})"""


def _op10() -> str:
    from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, IDENT, KEY40

    value = _sql_pattern(ASSIGN)
    parts = [
        _spans("assign", ASSIGN, f"length(regexp_extract(hit, '{value}', 2)) >= 6"),
        _spans("access", ACCESS),
        _spans("hex", HEX),
        _spans("ident", IDENT),
        _spans("key40", KEY40, "length(hit) = 40 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')"),
        _spans("endpoint", ENDPOINT),
    ]
    near = lambda kinds: f"EXISTS (SELECT 1 FROM a AS o WHERE o.rid = a.rid AND o.kind IN ({kinds}) AND o.s <= a.e + 200 AND o.e >= a.s - 200)"
    secret, name = near("'assign', 'hex', 'key40'"), near("'ident', 'access'")
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r){}, '')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), {", ".join(parts)},
a AS (SELECT *, 1 AS r FROM assign UNION ALL SELECT *, 2 FROM access UNION ALL SELECT *, 3 FROM hex UNION ALL SELECT *, 4 FROM ident UNION ALL SELECT *, 5 FROM key40 UNION ALL SELECT *, 6 FROM endpoint),
k AS (SELECT * FROM a WHERE r <= 3 OR (kind = 'ident' AND {secret}) OR (kind = 'key40' AND {name}) OR (kind = 'endpoint' AND {secret} AND {name})),
g AS (SELECT rid, count(*) FILTER (WHERE r = 1) AS n_assign, count(*) FILTER (WHERE r = 2) AS n_access, count(*) FILTER (WHERE r = 3) AS n_hex, {listed.format(" FILTER (WHERE r <= 3)")} AS base, {listed.format("")} AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": _OP1, "op6_warc": _OP6, "op10_secret_links": _op10()}
