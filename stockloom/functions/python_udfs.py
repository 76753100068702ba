"""The functions that have no built-in form: exact NFKD fold, text repair and recursive JSON search.

All are Pandas UDFs (Arrow batches).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkd_fold(texts: pd.Series) -> pd.Series:
    """F1, F3, F11, F12 exactly: compatibility decomposition, ASCII only, lower case."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())


@F.pandas_udf(T.StringType())
def repair_text(texts: pd.Series) -> pd.Series:
    """UTF-8 that was read as Latin-1, read again; unchanged where that fails."""

    def one(t):
        if t is None:
            return None
        try:
            return t.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return t

    return texts.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def find_key(payloads: pd.Series, keys: pd.Series) -> pd.Series:
    """Every value of a key anywhere in a JSON text, as JSON; empty for a text that isn't JSON."""
    import json

    def walk(node, key, out):
        if isinstance(node, dict):
            for k, v in node.items():
                if k == key:
                    out.append(json.dumps(v, ensure_ascii=False, sort_keys=True))
                walk(v, key, out)
        elif isinstance(node, list):
            for v in node:
                walk(v, key, out)
        return out

    def one(text, key):
        try:
            return walk(json.loads(text), key, [])
        except (TypeError, ValueError):
            return []

    return pd.Series([one(t, k) for t, k in zip(payloads, keys, strict=True)])
