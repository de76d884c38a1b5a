"""What no built-in expression does: legacy charsets and YAML blocks, in Arrow batches of already filtered rows."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facts import BOM_LENGTH

#: Mappings that a block needs besides its title; the first holds the tool's own facts.
FRONT_PARTS = ("normalizer", "source", "output")

#: As objects, since workers that import this have no session to parse types with.
CHARSET = T.StructType([T.StructField("name", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("method", T.StringType())])
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error_at", T.LongType())])


def best_charset(data: bytes) -> tuple[str, float] | None:
    """The likeliest charset of bytes that aren't UTF-8, with its confidence; None if nothing fits."""
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        from_bytes = None
    if from_bytes is not None:
        found = from_bytes(data).best()
        return None if found is None else (codecs.lookup(found.encoding).name, min(1.0, max(0.0, 1.0 - found.chaos)))
    # Without the library: Windows-1252 if every byte has a letter or mark there.
    try:
        text = data.decode("cp1252")
    except UnicodeDecodeError:
        return None
    odd = sum(not (c.isprintable() or c in "\t\r\n\f") for c in text)
    return ("cp1252", 1.0 - odd / max(1, len(text)))


@F.pandas_udf(CHARSET)
def legacy_charset(content: pd.Series) -> pd.DataFrame:
    found = [best_charset(bytes(c)) for c in content]
    return pd.DataFrame({"name": [f and f[0] for f in found], "confidence": [f and f[1] for f in found], "method": ["charset-normalizer" if f else None for f in found]})


@F.pandas_udf(DECODED)
def decoded(content: pd.Series, bom: pd.Series, name: pd.Series) -> pd.DataFrame:
    """Strict text of bytes after their mark, or where decoding fails (-1 for an unknown codec)."""
    texts, places = [], []
    for data, mark, codec in zip(content, bom, name, strict=True):
        try:
            texts.append(bytes(data)[BOM_LENGTH.get(mark, 0) :].decode(codec or "utf-8"))
            places.append(None)
        except UnicodeDecodeError as e:
            texts.append(None)
            places.append(e.start)
        except LookupError:
            texts.append(None)
            places.append(-1)
    return pd.DataFrame({"text": texts, "error_at": pd.array(places, "Int64")})


def front_error(block: str | None) -> str | None:
    """What is wrong with a YAML block: its syntax, a repeated key, or a missing or mistyped field; None if nothing."""
    if block is None:
        return None
    import yaml

    class Strict(yaml.SafeLoader):
        """Refuses repeated keys, and leaves dates as strings."""

    Strict.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) != len(keys):
            raise yaml.YAMLError("a key is repeated")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Strict.add_constructor("tag:yaml.org,2002:map", mapping)
    try:
        found = yaml.load(block, Strict)
    except yaml.YAMLError as e:
        return f"not YAML: {str(e).splitlines()[0]}"
    if not isinstance(found, dict):
        return "not a mapping"
    if not isinstance(found.get("title"), str) or not found["title"]:
        return "title must be a text"
    for key in FRONT_PARTS:
        if not isinstance(found.get(key), dict):
            return f"{key} must be a mapping"
    if not isinstance(found.get("date", ""), str):
        return "date must be a text"
    for key in ("author", "keywords"):
        if not (isinstance(found.get(key, []), list) and all(isinstance(x, str) for x in found.get(key, []))):
            return f"{key} must be a list of texts"
    return None


@F.pandas_udf(T.StringType())
def front_problem(block: pd.Series) -> pd.Series:
    return block.map(front_error, na_action="ignore").astype(object).where(block.notna(), None)
