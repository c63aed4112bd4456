"""Named queries over the given tables, each with the SQL another engine can check it by."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("cells", "inference", "design", "records", "reports", "live", "storage")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), attribute)
        clash = set(part) & set(out)
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
