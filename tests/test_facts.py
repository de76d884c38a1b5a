"""Facts of bytes against plain Python, on random bytes."""

import os
import random

import pytest
from corpusloom.functions.detect import best_charset, decoded, front_error, legacy_charset
from corpusloom.functions.facts import utf16_suspect, with_facts
from corpusloom.queries import QUERIES
from pyspark.sql import functions as F


def samples(n=300):
    rng = random.Random(9)
    pool = [b"a", b"\r", b"\n", b"\r\n", b"\x00", b"\xc3\xa9", b"\xff", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80"]
    heads = [b"", b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff", b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"]
    return [b"", b"\xff\xfe\x00\x00"] + [rng.choice(heads) + b"".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def facts(b):
    import codecs

    bom = next((n for n, m in [("utf-32-le", codecs.BOM_UTF32_LE), ("utf-32-be", codecs.BOM_UTF32_BE), ("utf-8", codecs.BOM_UTF8), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE)] if b.startswith(m)), None)
    try:
        b.decode("utf-8")
        valid = True
    except UnicodeDecodeError:
        valid = False
    crlf = b.count(b"\r\n")
    return (bom, valid, 0 in b, sum(x > 127 for x in b), crlf, b.count(b"\n") - crlf, b.count(b"\r") - crlf)


def test_facts(spark):
    data = samples()
    df = with_facts(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i int, content binary"))
    rows = df.orderBy("i").select("bom", "utf8_valid", "nul_bytes", "non_ascii_bytes", "crlf", "lf", "cr").collect()
    assert [tuple(r) for r in rows] == [facts(b) for b in data]


def test_utf16_suspicion(spark):
    data = ["some plain text".encode("utf-16-le"), "some plain text".encode("utf-16-be"), b"abc\x00", b"\x00\x00\x00", b"plain text", b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i int, c binary")
    found = [r[0] for r in df.orderBy("i").select(F.coalesce(utf16_suspect(F.col("c")), F.lit(False))).collect()]
    assert found[:2] == [True, True] and found[3] is False


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_utf16_suspicion_is_of_whole_texts(spark, tmp_path):
    """Letters past the first 400 decide too, and short texts have rows."""
    from corpusloom.queries import QUERIES

    texts = ["a" * 400 + "\u6f22" * 5000] * 6 + ["", "a", "ab", "plain text"] + ["\u6f22" * 400 + "a" * 5000] * 6
    found = {r["doc_id"]: r["suspect"] for r in QUERIES["flt05_utf16_suspect"](spark, documents(spark, tmp_path, texts)).collect()}

    def suspect(b):
        even, odd = b[::2].count(0), b[1::2].count(0)
        return len(b) >= 4 and 4 * (even + odd) >= len(b) and 10 * max(even, odd) >= 9 * (even + odd)

    def dirty(i, t):
        return t + {0: "\n", 3: "\ntail"}.get(i % 8, "") if i % 8 != 6 else "\t " + t

    encode = [lambda x: x.encode("utf-16-le"), lambda x: x.encode("utf-16-be"), lambda x: x.encode() + b"\0\0"]
    assert found == {i: suspect(encode[i % 3](dirty(i, t))) for i, t in enumerate(texts)}
    assert not any(found[i] for i in range(6)) and found[10] and found[12]


def test_legacy_queries_take_every_document(spark, tmp_path):
    from corpusloom.queries import QUERIES

    data = documents(spark, tmp_path, ["caf\xe9 d\xe9j\xe0 vu " * 9] * 12)
    rows = {r["doc_id"]: r["error_at"] for r in QUERIES["flt07_legacy_decode"](spark, data).collect()}
    assert rows == dict.fromkeys(range(12))
    assert {r["doc_id"] for r in QUERIES["fct11_legacy_charset"](spark, data).collect()} == set(range(12))


def test_decoding(spark):
    data = [(b"\xef\xbb\xbfa", "utf-8", "utf-8"), ("é".encode("cp1252"), None, "cp1252"), (b"a\xff", None, "utf-8"), (b"a", None, "no-codec"), (b"\xff\xfe\x00\x00" + "x".encode("utf-32-le"), "utf-32-le", "utf-32-le")]
    df = spark.createDataFrame([(i, bytearray(b), m, n) for i, (b, m, n) in enumerate(data)], "i int, c binary, m string, n string").repartition(1)
    rows = df.select("i", decoded("c", "m", "n").alias("d")).orderBy("i").select("d.text", "d.error_at").collect()
    assert [tuple(r) for r in rows] == [("a", None), ("é", None), (None, 1), (None, -1), ("x", None)]


def test_charsets_are_of_the_whole_content(spark):
    """Bytes past the first 64 KiB decide too."""
    head = "caf\xe9 au lait, d\xe9j\xe0 vu. ".encode("cp1252") * 3000
    data = [head, head + b"\x81\x8d\x8f\x90\x9d" * 3]
    assert len(head) > 64 << 10 and best_charset(data[0]) != best_charset(data[1])
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i int, content binary")
    rows = df.select("i", legacy_charset("content").alias("d")).orderBy("i").select("d.name", "d.confidence").collect()
    assert [tuple(r) for r in rows] == [best_charset(b) or (None, None) for b in data]


def test_front_errors():
    good = "title: t\nnormalizer: {}\nsource: {}\noutput: {}\ndate: 2024-01-01"
    assert front_error(good) is None and front_error(None) is None
    assert "repeated" in front_error(good + "\ntitle: u")
    assert front_error("- a") == "not a mapping"
    assert "title" in front_error("normalizer: {}")
    assert "not YAML" in front_error("a: [")


def plain_reason(data):
    """NULs without a mark, told by their number and by how they are spread over even and odd places."""
    if b"\0" not in data or data[:2] in (b"\xff\xfe", b"\xfe\xff") or data[:3] == b"\xef\xbb\xbf":
        return None
    nuls = [i % 2 for i, c in enumerate(data) if c == 0]
    share = max(nuls.count(0), nuls.count(1)) / len(nuls)
    return "utf16-suspect" if len(data) >= 4 and len(nuls) / len(data) >= 0.25 and share >= 0.9 else "nul-bytes"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data here")
def test_nul_split_of_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    make = [lambda t: t.encode() + b"\0", lambda t: t.encode("utf-16-le"), lambda t: t.encode(), lambda t: b"\xff\xfe" + t.encode("utf-16-le")]
    got = {r["doc_id"]: r["reason"] for r in QUERIES["flt04_nul_split"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: plain_reason(make[i % 4](t)) for i, t in docs.items()}
