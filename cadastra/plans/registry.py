"""Registry of the runnable queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadastra.plans.adapters import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its oracle text when SQL can say it."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, **ctes)
        return fn

    return wrap


# Oracle spellings of the shared helpers in cadastra.functions.numbers.
def rnd(x: str, dp: int = 0) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * {10**dp}::DOUBLE + 0.5::DOUBLE) / {10**dp}::DOUBLE)"


def tot(x: str, dp: int = 2) -> str:
    return rnd(rnd(f"sum({x})", dp + 4), dp)


def avg(x: str, dp: int = 0) -> str:
    return rnd(f"{tot(x)} / nullif(count({x}), 0)", dp)


def shr(a: str, b: str, dp: int = 0) -> str:
    return rnd(f"100.0::DOUBLE * ({a}) / nullif(({b})::DOUBLE, 0)", dp)


def chg(a: str, b: str, dp: int = 1) -> str:
    return (f"(CASE WHEN ({a})::DOUBLE <> 0 AND ({b})::DOUBLE <> 0 THEN "
            + rnd(f"100.0::DOUBLE * (({a})::DOUBLE / ({b})::DOUBLE - 1.0::DOUBLE)", dp) + " END)")


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def med(x: str, cond: str | None = None, dp: int = 0) -> str:
    inner = f"median({x})" + (f" FILTER (WHERE {cond})" if cond else "")
    return rnd(rnd(inner, 4), dp)
