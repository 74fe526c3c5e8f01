"""Registry of queries and of the SQL that each must agree with.

A query is declared with its output columns as ``name:kind`` where kind is
``i`` integer, ``f`` double or nullable integer (compared after rounding to 6 digits),
``d`` date or ``s`` text.  Both sides are brought to the same types through that list.  A tiny
offset before rounding keeps exact ties on one side in both engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import CTES


@dataclass(frozen=True)
class Check:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, columns: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` under ``name``; ``sql`` may use the shared CTEs."""
    typed = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build):
        CHECKS[name] = Check(name, typed, build, sql)
        return build

    return register


def run(c: Check, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.build(spark, sf_dir)
    casts = {
        "i": lambda x: x.cast("long"),
        "f": lambda x: F.round(x.cast("double") + 1e-9, 6) + F.lit(0.0),
        "d": lambda x: x.cast("date").cast("string"),
        "s": lambda x: x.cast("string"),
    }
    return out.select(*[casts[kind](F.col(col)).alias(col) for col, kind in c.columns])


def oracle(c: Check) -> str | None:
    if c.sql is None:
        return None
    casts = {
        "i": "CAST({0} AS BIGINT) AS {0}",
        "f": "round(CAST({0} AS DOUBLE) + 1e-9, 6) + 0.0 AS {0}",
        "d": "CAST(CAST({0} AS DATE) AS VARCHAR) AS {0}",
        "s": "CAST({0} AS VARCHAR) AS {0}",
    }
    select = ", ".join(casts[kind].format(col) for col, kind in c.columns)
    used = _needed(c.sql)
    recursive = "RECURSIVE " if "/*recursive*/" in c.sql or any("/*recursive*/" in CTES[u] for u in used) else ""
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in used]
    body = c.sql.strip()
    if body.upper().startswith("WITH "):
        own, final = _split_with(body)
        parts.append(own)
        body = final
    head = f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else ""
    return f"{head}SELECT {select} FROM ({body}) result"


def _split_with(body: str) -> tuple[str, str]:
    """Split ``WITH a AS (...) ---- SELECT ...`` at the marker line."""
    own, final = body[5:].split("----")
    return own.strip(), final.strip()


def _needed(sql: str) -> set[str]:
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, cte in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(cte)
    return needed
