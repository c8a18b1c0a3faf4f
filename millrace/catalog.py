"""Every registered query of the rollout-analytics part, with the SQL that must give the same rows.

A query is a function of (session, folder of the tables). `register` files it under its own name; the SQL, where
one can say it, names the fixture views of millrace.plans.views, which are put before it as common tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql is not None:
            from millrace.plans.views import with_views

            ORACLES[f.__name__] = with_views(sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded once, at the output, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def load_all() -> None:
    from millrace.plans import q_batch, q_eval, q_extra, q_groups, q_losses, q_more, q_prep, q_score, q_stream, q_text, q_tokens  # noqa: F401


load_all()
