"""Query registry: each entry pairs a Spark plan with SQL for an independent engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelytics.session import configure
from zonelytics.sources.adapters import ADAPTERS, Tables


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a plan. ``digits`` rounds floating columns alike on both sides.

    Sums of doubles depend on the order of addition, so results are compared
    after rounding. The half is nudged by 1e-4 of the last place, which keeps
    decimal ties (common in averages over 16 readings) on one side.
    """

    def register(plan):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, plan, sql, digits or {})
        return plan

    return register


def cols(names: str, n: int = 6) -> dict[str, int]:
    return {c: n for c in names.split()}


def run(entry: Entry, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = entry.plan(Tables(configure(spark), sf_dir))
    return df.withColumns(
        {c: F.floor(F.col(c) * F.lit(float(10**n)) + F.lit(0.5001)) / F.lit(float(10**n)) for c, n in entry.digits.items()}
    ) if entry.digits else df


def build_sql(entry: Entry) -> str | None:
    if entry.sql is None:
        return None
    used: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"\b[a-z_]+\b", text):
            if word in ADAPTERS and word not in used:
                need(ADAPTERS[word])
                if word not in used:
                    used.append(word)

    need(entry.sql)
    ctes = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', ADAPTERS[n])})" for n in used)
    head = f"WITH {ctes}\n" if ctes else ""
    rounding = ", ".join(
        f"floor({c} * 1e{n} + 0.5001e0) / 1e{n} AS {c}" for c, n in entry.digits.items()
    )
    star = f"* REPLACE ({rounding})" if rounding else "*"
    return f"{head}SELECT {star} FROM (\n{entry.sql.strip()}\n) q"
