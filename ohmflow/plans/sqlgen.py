"""Helpers that spell repeated SQL fragments for the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence


def rnd(expr: str, digits: int) -> str:
    """Round half away from zero on the binary value — the same arithmetic as
    ``ohmflow.operators.common.rounded`` — and turn -0.0 into 0.0."""
    scale = f"{10 ** digits}.0"
    return f"(round(({expr}) * {scale}) / {scale} + 0.0)"


def r6(expr: str) -> str:
    return rnd(expr, 6)


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def unpivot_sql(table: str, ids: Sequence[str], cols: Sequence[str],
                var: str = "feature", value: str = "value") -> str:
    idl = ", ".join(ids)
    sep = ", " if ids else ""
    return union_all([f"SELECT {idl}{sep}'{c}' AS {var}, {c} AS {value} FROM {table}"
                      for c in cols])
