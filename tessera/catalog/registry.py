"""Registered queries: one Spark builder per operator ID, plus (where the
operator is SQL-expressible) the equivalent DuckDB SQL over the same
parquet tables.

Conventions: every computed column is aliased identically in both; doubles
are rounded to 10 significant digits in both (``rnd`` / ``RND``); counts are BIGINT; results carry the row id
so comparisons are order-insensitive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = normalise_sql(sql.strip())
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def normalise_sql(sql: str) -> str:
    """Expand every ``RND(expr[, n])`` marker of the oracle SQL into the
    engine-independent rounding used on the Spark side
    (``functions.columns.rnd``: 10 significant digits). Plain ``round`` is
    left alone: it is part of a feature's definition."""
    from tessera.functions.columns import sql_rnd
    out, i = [], 0
    while True:
        j = sql.find("RND(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, cut = 0, j + 3, None
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                cut = k
            k += 1
        out.append(sql[i:j])
        expr = sql[j + 4:(cut if cut is not None else k)]
        out.append(sql_rnd(normalise_sql(expr)))
        i = k + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table. Time features are defined in UTC (epoch arithmetic on
    ``timestamp_ntz`` columns goes through the session time zone), so the
    session is pinned to UTC whatever session the caller built."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every catalog module so their ``register`` calls run."""
    import importlib
    for m in ("events", "flagship", "rollup", "scalar", "target", "category", "missing", "modeling",
              "sampling", "select", "model", "io"):
        try:
            importlib.import_module(f"tessera.catalog.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"tessera.catalog.{m}":
                raise
