"""Where catalog modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(spark, sf_dir) under its name, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def pr(x: str, digits: int = 2) -> str:
    """pyround() in the oracle's SQL."""
    return f"(cast(format('{{:.{digits}f}}', cast({x} as double)) as double) + 0.0)"
