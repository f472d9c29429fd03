"""A subset of JSON Schema compiled into a checker, for use in batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame

Check = Callable[[object, str], list[str]]

_TYPES: dict[str, Callable[[object], bool]] = {
    "null": lambda v: v is None, "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def _is_time(v: str) -> bool:
    try:
        return datetime.fromisoformat(v.replace("Z", "+00:00")).tzinfo is not None
    except ValueError:
        return False


def compile_schema(schema: dict, root: dict | None = None) -> Check:
    """A checker of (value, path) that gives error codes `path: rule`. References inside the schema may recurse."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        made: list[Check] = []

        def later(v: object, path: str) -> list[str]:
            if not made:
                made.append(compile_schema(target, root))
            return made[0](v, path)

        return later
    checks: list[Check] = []
    rule = lambda name, holds: checks.append(lambda v, p: [] if holds(v) else [f"{p}: {name}"])
    s = schema
    same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    if "type" in s:
        kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
        rule("type", lambda v: any(_TYPES[k](v) for k in kinds))
    if "const" in s:
        rule("const", lambda v: same(v, s["const"]))
    if "enum" in s:
        rule("enum", lambda v: any(same(v, x) for x in s["enum"]))
    on = lambda kind, f: lambda v: not _TYPES[kind](v) or f(v)
    for name, kind, f in (
        ("minLength", "string", lambda v: len(v) >= s["minLength"]), ("maxLength", "string", lambda v: len(v) <= s["maxLength"]), ("pattern", "string", lambda v: re.search(s["pattern"], v) is not None),
        ("minimum", "number", lambda v: v >= s["minimum"]), ("maximum", "number", lambda v: v <= s["maximum"]), ("minItems", "array", lambda v: len(v) >= s["minItems"]), ("maxItems", "array", lambda v: len(v) <= s["maxItems"]),
    ):
        if name in s:
            rule(name, on(kind, f))
    if s.get("format") == "date-time":
        rule("format", on("string", _is_time))
    if s.get("uniqueItems"):
        rule("uniqueItems", on("array", lambda v: len({json.dumps(x, sort_keys=True) for x in v}) == len(v)))
    fields = {k: compile_schema(x, root) for k, x in s.get("properties", {}).items()}
    if fields or "required" in s or s.get("additionalProperties") is False:

        def of_object(v: object, p: str) -> list[str]:
            if not isinstance(v, dict):
                return []
            out = [f"{p}.{k}: required" for k in s.get("required", ()) if k not in v]
            if s.get("additionalProperties") is False:
                out += [f"{p}.{k}: additionalProperties" for k in sorted(v) if k not in fields]
            return out + [e for k, c in fields.items() if k in v for e in c(v[k], f"{p}.{k}")]

        checks.append(of_object)
    first = [compile_schema(x, root) for x in s.get("prefixItems", ())]
    rest = compile_schema(s["items"], root) if isinstance(s.get("items"), dict) else None
    if first or rest or s.get("items") is False:

        def of_array(v: object, p: str) -> list[str]:
            if not isinstance(v, list):
                return []
            out = [e for i, (c, x) in enumerate(zip(first, v)) for e in c(x, f"{p}[{i}]")]
            if s.get("items") is False and len(v) > len(first):
                out.append(f"{p}: items")
            return out + ([e for i, x in enumerate(v[len(first) :], len(first)) for e in rest(x, f"{p}[{i}]")] if rest else [])

        checks.append(of_array)
    return lambda v, p: [e for c in checks for e in c(v, p)]


def schema_errors(rows: DataFrame, id_col: str, json_col: str, schema: dict) -> DataFrame:
    """(id, errors) of each JSON text; a text that is not JSON has the code `$: json`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check = compile_schema(schema)

        def one(text: str | None) -> list[str]:
            try:
                return check(json.loads(text or ""), "$")
            except ValueError:
                return ["$: json"]

        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "errors": [one(t) for t in b[json_col]]})

    return rows.select(id_col, json_col).mapInPandas(run, f"{id_col} {dict(rows.dtypes)[id_col]}, errors array<string>")
