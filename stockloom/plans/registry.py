"""Registration of queries with the SQL that each must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import RELATIONS, Inputs, common_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(inputs) -> DataFrame; relations that the SQL names are put before it.  Without SQL, only rows are checked."""

    def register(f: Callable[[Inputs], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            used = [r for r in RELATIONS if re.search(rf"\b{r}\b", sql)]
            head = common_sql(used) if used else ""
            body = sql.strip()
            ORACLE_SQL[name] = head + (",\n" + body[5:] if used and body.upper().startswith("WITH ") else "\n" + body)
        return f

    return register
