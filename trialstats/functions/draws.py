"""Hash-derived random draws as column expressions.

A draw is ``f(sha256(canonical JSON array [scope, *parts]))``. It has no state and no order, so
any partitioning of the table gives the same values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_53 = float(1 << 53)


def json_string(col: Column | str) -> Column:
    """JSON string literal of a text column: ASCII only, short escapes, lower-case hex.

    Text without special characters is only quoted. Otherwise it is cut into plain runs and
    single special characters, and only the latter are rewritten.
    """
    col = F.col(col) if isinstance(col, str) else col
    plain = r"[ !#-\[\]-~]"
    pieces = F.regexp_extract_all(col, F.lit(rf"{plain}+|(?s:.)"), F.lit(0))
    short = {'"': r"\"", "\\": r"\\", "\n": r"\n", "\r": r"\r", "\t": r"\t",
             "\b": r"\b", "\f": r"\f"}

    def rewrite(p: Column) -> Column:
        out = F.when(p.rlike(rf"^{plain}+\z"), p)
        for raw, escaped in short.items():
            out = out.when(p == F.lit(raw), F.lit(escaped))
        utf16 = F.lower(F.hex(F.encode(p, "UTF-16BE")))
        return out.otherwise(F.regexp_replace(utf16, "(.{4})", r"\\u$1"))

    escaped = F.array_join(F.transform(pieces, rewrite), "")
    return F.concat(
        F.lit('"'), F.when(col.rlike(rf"^{plain}*\z"), col).otherwise(escaped), F.lit('"')
    )


def token(col: Column | str) -> Column:
    """Quoted JSON text of an identifier that is known to hold only plain ASCII."""
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit('"'), col.cast("string"), F.lit('"'))


def number(col: Column | str) -> Column:
    """JSON text of an integer column (or of a double whose text both sides agree on)."""
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("string")


def payload(scope: str, *parts) -> Column:
    """Canonical JSON array. Columns must already be JSON text; Python values are encoded."""
    pieces: list[Column] = []
    text = "[" + json.dumps(scope)
    for part in parts:
        text += ","
        if isinstance(part, Column):
            pieces += [F.lit(text), part]
            text = ""
        else:
            text += json.dumps(part, separators=(",", ":"), sort_keys=True)
    pieces.append(F.lit(text + "]"))
    return F.concat(*pieces)


def digest(scope: str, *parts) -> Column:
    return F.sha2(payload(scope, *parts), 256)


def unit_of(h: Column) -> Column:
    """[0, 1) from the top 53 bits of a hex digest."""
    top56 = F.conv(F.substring(h, 1, 14), 16, 10).cast("bigint")
    return F.shiftright(top56, 3).cast("double") / F.lit(TWO_53)


def u32_of(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def seed64_of(h: Column) -> Column:
    """The first 64 bits shifted right by one (a signed base for ``conv`` keeps all 64)."""
    return F.shiftrightunsigned(F.conv(F.substring(h, 1, 16), 16, -10).cast("bigint"), 1)


def unit(scope: str, *parts) -> Column:
    return unit_of(digest(scope, *parts))


def u32(scope: str, *parts) -> Column:
    return u32_of(digest(scope, *parts))


def seed64(scope: str, *parts) -> Column:
    return seed64_of(digest(scope, *parts))


def choice_weighted(u: Column, items: Sequence, weights: Sequence[float]) -> Column:
    """The item whose cumulative weight first exceeds ``u``; the last one takes the slack."""
    if len(items) != len(weights) or not items:
        raise ValueError("items and weights need the same, non-zero length")
    total = float(sum(weights))
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must be non-negative with a positive sum")
    threshold = u * F.lit(total)
    chain, reached = None, 0.0
    for item, weight in zip(items[:-1], weights):
        reached += float(weight)
        test = threshold < F.lit(reached)
        chain = F.when(test, F.lit(item)) if chain is None else chain.when(test, F.lit(item))
    picked = F.lit(items[-1]) if chain is None else chain.otherwise(F.lit(items[-1]))
    outside = (u < 0) | (u >= 1)
    return F.when(outside, F.raise_error(F.lit("u must be in [0, 1)"))).otherwise(picked)


def integer(u: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo + F.floor(u * (hi - lo + 1))).cast("bigint")


def chance(u: Column, p) -> Column:
    return u < p


def pick(u: Column, items: Sequence) -> Column:
    return choice_weighted(u, items, [1] * len(items))


def normal(scope: str, *parts) -> Column:
    """Standard normal from two uniforms; the first is flipped so its logarithm exists."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - unit(scope, *parts, "u1")))
    return radius * F.cos(F.lit(2.0) * F.pi() * unit(scope, *parts, "u2"))


def pilot_seed(root_seed: int, level: Column) -> Column:
    """Seed of a pilot data set; scoped apart from the main seed."""
    return F.pmod(seed64("pilot", root_seed, number(level)), F.lit(1 << 31))
