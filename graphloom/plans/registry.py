"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.plans import graph_queries, text_queries

FOUND = text_queries.FOUND | graph_queries.FOUND


def widened(query):
    """The query with its 32-bit integers as 64-bit ones, which is what SQL's counts and ranks are."""

    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({name: df[name].cast("long") for name, kind in df.dtypes if kind == "int"})

    return run


def queries() -> dict:
    return {name: widened(query) for name, (query, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
