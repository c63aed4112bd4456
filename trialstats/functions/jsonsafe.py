"""Strict JSON output: no NaN, no infinities, fixed number text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(c: Column) -> Column:
    inf = F.lit(float("inf"))
    text = lambda t: F.parse_json(F.lit(t))
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(None).cast("variant"))
        .when(c == inf, text('"inf"')).when(c == -inf, text('"-inf"')).otherwise(c.cast("variant"))
    )


def jsonable(c: Column, kind: T.DataType) -> Column:
    """A copy of a column safe for strict JSON: NaN becomes null and infinities become texts."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _number(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: jsonable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: jsonable(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[jsonable(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    return c


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one strict JSON text, keys in alphabetical order, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    safe = F.struct(*[jsonable(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    return df.select(F.to_json(safe, {"ignoreNullFields": "false"}).alias("value"))


def significant(c: Column, digits: int = 10) -> Column:
    """Shortest decimal text with at most ``digits`` significant digits; with an exponent below 1e-4 and from
    10^digits on."""
    sci = F.format_string(f"%.{digits - 1}e", c.cast("double"))
    exponent = F.regexp_extract(sci, "e([-+][0-9]+)$", 1).try_cast("int")
    plain = F.regexp_replace(sci.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    whole = sci.try_cast("decimal(38,0)").cast("string")
    return (
        F.when(c == 0, "0").when(exponent.isNull(), c.cast("string"))
        .when((exponent < -4) | (exponent >= digits), F.regexp_replace(sci, r"\.?0+e", "e"))
        .when(sci.try_cast("decimal(38,20)") % 1 == 0, whole).otherwise(plain)
    )
