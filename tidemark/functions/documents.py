"""JSON documents: differences, and setting or removing a nested field. Objects nest freely, so these run in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: No value; a constant that stays itself when it travels to a task.
_ABSENT = ...


def _parsed(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def _dumped(value) -> str | None:
    return None if value is _ABSENT else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _differences(before, after, path: str) -> Iterator[dict]:
    if isinstance(before, dict) and isinstance(after, dict):
        for key in dict.fromkeys([*before, *after]):
            yield from _differences(before.get(key, _ABSENT), after.get(key, _ABSENT), f"{path}.{key}" if path else key)
    elif _dumped(before) != _dumped(after):
        yield {"path": path, "before": _dumped(before), "after": _dumped(after)}


def _diff(before: pd.Series, after: pd.Series) -> pd.Series:
    pairs = ((_parsed(a), _parsed(b)) for a, b in zip(before, after, strict=True))
    return pd.Series([list(_differences(a, b, "")) if a is not None and b is not None else [] for a, b in pairs], dtype=object)


def diff(before: Column, after: Column) -> Column:
    """(path, before, after) of the leaves that differ, by the keys of `before` first; arrays are compared whole.

    A field that one side lacks is null there. No differences where a side is null or no JSON.
    """
    return F.pandas_udf(_diff, "array<struct<path: string, before: string, after: string>>")(before, after)


def _changed(text: str | None, path: list[str], value) -> str | None:
    top = _parsed(text)
    if not isinstance(top, dict) or not path:
        return text
    at = top
    for key in path[:-1]:
        if not isinstance(at.get(key), dict):
            if value is _ABSENT:
                return text
            at[key] = {}
        at = at[key]
    if value is _ABSENT:
        at.pop(path[-1], None)
    else:
        at[path[-1]] = value
    return _dumped(top)


def set_path(document: Column, path: list[str], value) -> Column:
    """The document with the field at `path` set; missing objects on the way are made."""

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _changed(t, path, value))

    return put(document)


def remove_path(document: Column, path: list[str]) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _changed(t, path, _ABSENT))

    return cut(document)


def front_matter(text: Column) -> Column:
    """struct(matter, body) of a text that starts with a block between lines of ---; else a null matter and the whole text."""
    start = F.regexp_replace(text, r"^\s+", "")
    parts = F.split(start, "---", -1)
    found = F.startswith(start, F.lit("---")) & (F.size(parts) >= 3)
    body = F.regexp_replace(F.array_join(F.slice(parts, 3, F.size(parts)), "---"), r"^\s+", "")
    return F.struct(F.when(found, F.element_at(parts, 2)).alias("matter"), F.when(found, body).otherwise(text).alias("body"))


_ABOVE, _FOUND = "array<struct<indent: int, key: string>>", "array<struct<path: string, value: string, entry: int>>"


def _read(matter: Column, listed: str) -> Column:
    """Array of struct(path, value, entry) from `key: value` lines nested by indentation. entry: how many items the list at the path
    `listed` had begun by then."""
    none = F.struct(F.array().cast(_ABOVE).alias("above"), F.array().cast(_FOUND).alias("found"), F.lit(0).alias("entry"))
    keys = lambda above: F.transform(above, lambda a: a["key"])

    def add(state: Column, line: Column) -> Column:
        item = F.ltrim(line).startswith("- ")
        indent = F.length(line) - F.length(F.ltrim(line)) + F.when(item, 2).otherwise(0)
        key = F.regexp_extract(line, r"^\s*(?:- )?([A-Za-z_][\w-]*):(?:\s|$)", 1)
        raw = F.btrim(F.when(key != "", F.regexp_extract(line, r"^\s*(?:- )?[\w-]+:\s*(.*)$", 1)).otherwise(F.regexp_extract(line, r"^\s*- (.*)$", 1)))
        value = F.regexp_replace(F.regexp_replace(raw, r"\s+#.*$|^#.*$", ""), r"""^(["'])(.*)\1$""", "$2")
        above = F.filter(state["above"], lambda a: a["indent"] < indent)
        begins = item & (F.array_join(keys(above), ".") == listed)
        entry = state["entry"] + F.when(begins, 1).otherwise(0)
        path = F.array_join(F.concat(keys(above), F.when(key != "", F.array(key)).otherwise(F.array().cast("array<string>"))), ".")
        next_above = F.when(key != "", F.concat(above, F.array(F.struct(indent.cast("int").alias("indent"), key.alias("key"))))).otherwise(state["above"])
        next_found = F.when(value != "", F.concat(state["found"], F.array(F.struct(path.alias("path"), value.alias("value"), entry.alias("entry"))))).otherwise(state["found"])
        return F.struct(next_above.alias("above"), next_found.alias("found"), entry.alias("entry"))

    return F.aggregate(F.split(F.coalesce(matter, F.lit("")), r"\r?\n"), none, add, lambda s: s["found"])


def settings(matter: Column) -> Column:
    """Array of struct(path, value) from `key: value` lines nested by indentation; paths have dots, list items repeat theirs."""
    return F.transform(_read(matter, ""), lambda x: F.struct(x["path"], x["value"]))


def entries(matter: Column, path: str) -> Column:
    """Array of arrays of struct(path, value): the settings of each object in the list at a path, paths from the object on.

    setting() reads a field of one of them.
    """
    own = F.filter(_read(matter, path), lambda x: x["path"].startswith(f"{path}."))
    numbers = F.array_distinct(F.transform(own, lambda x: x["entry"]))
    return F.transform(numbers, lambda n: F.transform(F.filter(own, lambda x: x["entry"] == n), lambda x: F.struct(F.substring(x["path"], F.lit(len(path) + 2), F.length(x["path"])).alias("path"), x["value"])))


def setting(found: Column, path: str, default: str | None = None) -> Column:
    """The first value at a path of `settings`, or the default."""
    values = F.filter(found, lambda x: x["path"] == path)
    return F.coalesce(F.when(F.size(values) > 0, F.element_at(values, 1)["value"]), F.lit(default))
