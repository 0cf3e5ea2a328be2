"""The functions that no built-in expression has, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _made(kind: str, f):
    """The UDF is made at its first use: its type needs a session."""

    def use(*columns) -> Column:
        return F.pandas_udf(f, kind)(*columns)

    use.__doc__ = f.__doc__
    return use


def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two prepared strings (2 M / T)."""
    memo: dict = {}
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        if (x, y) not in memo:
            memo[x, y] = SequenceMatcher(None, x, y).ratio()
        out.append(memo[x, y])
    return pd.Series(out, dtype="float64")


def _nfkc(x: pd.Series) -> pd.Series:
    """Compatibility form of a text."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def _flat(value) -> list[str]:
    if value is None:
        return []
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return [s for v in value for s in _flat(v)]
    return [str(value)]


def _flatten_synonyms(x: pd.Series) -> pd.Series:
    """All strings in a JSON value, nested ones included, in order."""
    import json

    def of(s):
        if s is None:
            return []
        try:
            return _flat(json.loads(s))
        except ValueError:
            return [s]

    return x.map(of)


def _byte_offsets(x: pa.Array) -> pa.Array:
    """UTF-8 bytes before each code point of a text and at its end, by array operations over
    some texts at once; null for a null."""
    return pa.concat_arrays([_offsets_of(x.slice(a, 128)) for a in range(0, len(x) or 1, 128)])


def _offsets_of(x: pa.Array) -> pa.Array:
    x = x.cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(v for v in x.to_pylist() if v), np.uint8)
    ends = np.cumsum(sizes)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    row = np.searchsorted(ends, first, "right")
    chars = np.bincount(row, minlength=len(sizes))
    lists = np.cumsum(chars + 1)
    out = np.empty(len(first) + len(sizes), np.int32)
    last = np.zeros(len(out), bool)
    last[lists - 1] = True
    out[~last], out[last] = first - (ends - sizes)[row], sizes
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lists]).astype(np.int32)), pa.array(out), mask=x.is_null())


def byte_offsets(text) -> Column:
    """``text.byte_offsets`` for whole documents."""
    return F.arrow_udf(_byte_offsets, "array<int>")(text)


sequence_ratio = _made("double", _sequence_ratio)
nfkc = _made("string", _nfkc)
flatten_synonyms = _made("array<string>", _flatten_synonyms)
