"""Named table operators with typed arguments: run(name, params, tables) gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_KINDS = {"string": str, "int": int, "double": (int, float), "boolean": bool}
_tools: dict[str, tuple[dict[str, str], Callable[..., DataFrame]]] = {}


def tool(name: str, **params: str):  # noqa: ANN201
    """Register f(tables, **params) under a name; params map argument names to kinds."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _tools:
            raise ValueError(f"two tools named {name}")
        _tools[name] = params, f
        return f

    return add


def run(name: str, params: dict, tables: dict[str, DataFrame]) -> DataFrame:
    kinds, f = _tools[name]
    if set(params) != set(kinds):
        raise ValueError(f"{name} takes {sorted(kinds)}")
    for k, v in params.items():
        if not isinstance(v, _KINDS[kinds[k]]):
            raise TypeError(f"{k} of {name} must be a {kinds[k]}")
    return f(tables, **params)


def tools() -> dict[str, dict[str, str]]:
    return {k: dict(p) for k, (p, _) in _tools.items()}
