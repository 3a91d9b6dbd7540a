"""All queries of the library by name, each with the SQL that a second engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "factor_returns_wls"


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLE[key] = oracle
        return f

    return add


# The modules register their queries as they load.
from panelforge.plans import accounts, crosssections, identities, operations, portfolios, pricing, relational, risks, snapshots, staged, styles, windows  # noqa: E402, F401
