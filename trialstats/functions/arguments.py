"""Fingerprints and type checks of logged tool-call arguments."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types


@F.pandas_udf(types.StringType())
def _canonical(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        try:
            value = json.loads(t)
        except ValueError:
            value = t
        return json.dumps(value, separators=(",", ":"), sort_keys=True)

    return text.map(one)


def args_sha256(text: Column) -> Column:
    """Hash of the canonical JSON of an argument text; a text that is no JSON is hashed as a
    string."""
    return F.sha2(_canonical(text), 256)


# The variant types that each declared type accepts.
KINDS = {
    "string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY<.*", "object": "OBJECT<.*",
    "integer": r"(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\((19|[23][0-9]),0\))",
    "number": r"(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\([0-9]+,[0-9]+\)|FLOAT|DOUBLE)",
}
#: step of a path that stands for every element of an array
EACH = object()
DEPTH = 1


@dataclass(frozen=True)
class Check:
    """At ``path``: the value is of one of ``kinds``, or an object there holds ``key``."""

    path: tuple
    kinds: tuple[str, ...] | None = None
    key: str | None = None


def compile_schema(schema: dict) -> list[Check]:
    """Checks of a small JSON schema: types down to the values of depth 1's members, required keys down to depth 1."""
    checks, open_ = [], [((), schema)]
    while open_:
        path, part = open_.pop()
        kinds = part.get("type")
        if kinds:
            checks.append(Check(path, kinds=(kinds,) if isinstance(kinds, str) else tuple(kinds)))
        if len(path) > DEPTH:
            continue
        checks += [Check(path, key=k) for k in part.get("required", ())]
        open_ += [((*path, k), p) for k, p in part.get("properties", {}).items()]
        if isinstance(part.get("items"), dict):
            open_.append(((*path, EACH), part["items"]))
    return checks


def _member(value: Column, key: str) -> Column:
    quote = "'" if '"' in key else '"'
    return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")


def _holds(value: Column, path: tuple, check: Check) -> Column:
    kind = F.schema_of_variant(value)
    if not path:
        if check.key is not None:
            return F.coalesce(~kind.startswith("OBJECT") | _member(value, check.key).isNotNull(), F.lit(True))
        accepted = "|".join(KINDS[k] for k in check.kinds if k in KINDS)
        return F.coalesce(kind.rlike(f"^({accepted})$"), F.lit(False)) if accepted else F.lit(False)
    step, rest = path[0], path[1:]
    if step is EACH:
        elements = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce(~kind.startswith("ARRAY") | F.forall(elements, lambda x: _holds(x, rest, check)), F.lit(False))
    member = _member(value, step)
    return F.coalesce(~kind.startswith("OBJECT"), F.lit(True)) | member.isNull() | _holds(member, rest, check)


def matches_schema(value: Column, schema: dict) -> Column:
    """Predicate of a variant: all compiled checks of the schema hold; false for a null value."""
    checks = (_holds(value, c.path, c) for c in compile_schema(schema))
    return F.coalesce(reduce(lambda a, b: a & b, checks, value.isNotNull()), F.lit(False))
