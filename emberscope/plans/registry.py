"""Query registry: a Spark plan and, where SQL can say it, the matching SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.plans.bindings import Tables
from emberscope.plans.sql_views import with_views

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so sums in another order print the same."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register a plan; ``doubles`` are the SQL columns rounded like the plan's."""

    def register(build: Callable[[Tables], DataFrame]):
        text = None
        if sql is not None:
            body = sql.strip()
            if doubles:
                fixed = ", ".join(
                    f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0::DOUBLE AS {c}" for c in doubles
                )
                body = f"SELECT * REPLACE ({fixed}) FROM (\n{body}\n) AS result"
            text = with_views(body)
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, lambda t: rounded(build(t)), text)
        return build

    return register
