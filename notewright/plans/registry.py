"""The table of registered queries: a Spark function and, where possible, equal SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Run
    sql: str | None


CATALOG: dict[str, Registered] = {}


def register(sql: str | None = None) -> Callable[[Run], Run]:
    """Add a function to the catalog under its own name."""
    def add(run: Run) -> Run:
        if run.__name__ in CATALOG:
            raise ValueError(f"{run.__name__} is registered twice")
        CATALOG[run.__name__] = Registered(run, sql)
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns and turn booleans into 0 and 1, as the SQL side does."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            # Adding 0.0 turns a rounded -0.0 into 0.0.
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind == "boolean":
            column = column.cast("int")
        columns.append(column.alias(field.name))
    return df.select(*columns)
