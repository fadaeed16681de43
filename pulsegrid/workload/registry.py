"""Query registry: a Spark plan, an output contract and an optional SQL equivalent.

The contract string names the output columns in order. A suffix normalises a
column the same way on both sides: ``:i`` is a 64-bit integer, ``:d`` a date as
ISO text, ``:4`` a double rounded to four places, no suffix leaves the column alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .duck import with_views
from .frames import Frames


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Frames], DataFrame]
    contract: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(contract: str) -> list[tuple[str, str | None]]:
    parts = [p.strip() for p in contract.replace("\n", " ").split(",") if p.strip()]
    return [tuple(p.split(":")) if ":" in p else (p, None) for p in parts]


def apply_contract(df: DataFrame, contract: str) -> DataFrame:
    out = []
    for name, rule in _columns(contract):
        c = F.col(name)
        if rule == "i":
            c = c.cast("bigint")
        elif rule == "d":
            c = c.cast("date").cast("string")
        elif rule is not None:
            c = F.round(c.cast("double"), int(rule))
        out.append(c.alias(name))
    return df.select(*out)


def contract_sql(body: str, contract: str) -> str:
    out = []
    for plain, rule in _columns(contract):
        name = f'"{plain}"'
        if rule == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif rule == "d":
            out.append(f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}")
        elif rule is not None:
            r = f"round(CAST({name} AS DOUBLE), {rule})"
            out.append(f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM ({body}) AS body"


def query(name: str, contract: str, sql: str | None = None):
    """Register a plan under a name; ``sql`` may refer to the views in ``duck``."""

    def add(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        full = None if sql is None else with_views(contract_sql(sql, contract))
        REGISTRY[name] = Query(name, build, contract, full)
        return build

    return add
