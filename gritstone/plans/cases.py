"""Queries whose texts are made of a table's numbers: case n of a list stands in each row whose key leaves the remainder n.

The SQL gives the values that the rule demands for each case, written down by hand, so it shares nothing with the expression.
`{k}` in a text or a value stands for the row's key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE, KEY = "part", "p_partkey"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else f"CAST({value} AS BIGINT)"


def made(spark: SparkSession, sf_dir: str, texts: Sequence[str | None]) -> DataFrame:
    """key and text of every row of the table."""
    table = F.array(*(F.lit(t) for t in texts))
    rows = spark.read.parquet(f"{sf_dir}/{TABLE}.parquet").select(F.col(KEY).cast("long").alias("k"), (F.col(KEY) % len(texts)).cast("int").alias("c"))
    return rows.select("k", "c", F.replace(F.get(table, F.col("c")), F.lit("{k}"), F.col("k").cast("string")).alias("text"))


def by_cases(queries: dict, oracles: dict, name: str, names: Sequence[str], cases: Sequence[tuple], columns: Callable[[Column], Sequence[Column]]) -> None:
    """Register a query of k and `names` over cases (text, value of each name), with its SQL."""
    texts = [c[0] for c in cases]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return made(spark, sf_dir, texts).select("k", *(c.alias(n) for n, c in zip(names, columns(F.col("text")), strict=True)))

    def shown(n: str, at: int) -> str:
        keyed = any(isinstance(c[at], str) and "{k}" in c[at] for c in cases)
        return f"replace({n}, '{{k}}', CAST({KEY} AS VARCHAR)) AS {n}" if keyed else n

    rows = ", ".join(f"({n}, " + ", ".join(_literal(v) for v in c[1:]) + ")" for n, c in enumerate(cases))
    picked = ", ".join(shown(n, i) for i, n in enumerate(names, 1))
    queries[name] = run
    oracles[name] = f"SELECT CAST({KEY} AS BIGINT) AS k, {picked} FROM {TABLE} JOIN (VALUES {rows}) AS e(c, {', '.join(names)}) ON {KEY} % {len(cases)} = c"
