"""JSON texts of any nesting: repair and redaction, which have no built-in expression."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SECRET = re.compile("api_?key|token|secret|password|authorization|cookie", re.IGNORECASE)
TEXTS = re.compile("prompt|content|message|answer|text", re.IGNORECASE)


def closed(text: str) -> str:
    """``text`` with the strings, lists and objects closed that it leaves open."""
    open_, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = c == "\\" and not escaped, quoted and (c != '"' or escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_ and open_[-1] == c:
            open_.pop()
    return text + ('"' if quoted else "") + "".join(reversed(open_))


def repair(text: str | None) -> str | None:
    """A JSON object's canonical text: as it is, else out of what stands around it, with trailing commas and open ends mended."""
    if not text:
        return None
    inner = text[text.find("{") :] if "{" in text else text
    whole = inner[: inner.rfind("}") + 1] if "}" in inner else inner
    for attempt in (text, whole, *(re.sub(r",\s*(?=[}\]]|$)", "", x) for x in (whole, closed(inner.rstrip().rstrip(",")), closed(inner)))):
        try:
            found = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


def without_secrets(value: object, metadata_only: bool = False, key: str = "") -> object:
    """A JSON value with secrets masked by key at any depth; in metadata mode texts go too."""
    if SECRET.search(key):
        return "[redacted]"
    if metadata_only and TEXTS.search(key) and isinstance(value, str):
        return "[omitted]"
    if isinstance(value, dict):
        return {k: without_secrets(v, metadata_only, k) for k, v in value.items()}
    return [without_secrets(v, metadata_only) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def repaired_json(values: pd.Series) -> pd.Series:
    return values.map(repair)


def redacted_json(column, metadata_only: bool = False):
    """A column of JSON texts; what isn't JSON stays as it is."""

    @F.pandas_udf(StringType())
    def each(values: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(without_secrets(json.loads(text), metadata_only), ensure_ascii=False) if text else text
            except ValueError:
                return text

        return values.map(one)

    return each(column)
