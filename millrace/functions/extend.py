"""Extension points: scorers from files, batched scorers, guarded rows, and registries by name."""

from __future__ import annotations

import importlib.util
import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import competition
from millrace.operators.tokens import overlong_penalty


def from_file(path: str, name: str, **bound: Any) -> Callable:
    """A function of a Python file that the user names, with keyword arguments bound. The file is run: it must be the user's own."""
    spec = importlib.util.spec_from_file_location(f"custom_{abs(hash(path))}", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return partial(getattr(module, name), **bound)


class Registry(dict):
    """Things by name; a name can be taken once."""

    def add(self, name: str) -> Callable[[Any], Any]:
        def put(thing: Any) -> Any:
            if self.get(name, thing) is not thing:
                raise ValueError(f"{name} is taken")
            self[name] = thing
            return thing

        return put

    def __missing__(self, name: str) -> Any:
        raise KeyError(f"no {name}; there are {', '.join(sorted(self)) or 'none'}")


#: Readers of datasets (a session and options to a frame), row generators, tools (a row to rows) and order keys.
DATASETS, GENERATORS, TOOLS, ORDERS = Registry(), Registry(), Registry(), Registry()
#: Scoring strategies: from a frame and the names of its response and truth to the frame with a score.
STRATEGIES = Registry()


@DATASETS.add("parquet")
def parquet_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@DATASETS.add("json_lines")
def json_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@GENERATORS.add("repeat")
def repeated_rows(df: DataFrame, times: int = 2) -> DataFrame:
    """Each row `times` times, with a column copy from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


@TOOLS.add("word_count")
def word_count_tool(df: DataFrame, text: str) -> DataFrame:
    """One row for each distinct word of a row's text, with its count: one row to many."""
    words = df.withColumn("word", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))))
    return words.groupBy(*df.columns, "word").agg(F.count("*").alias("n"))


@ORDERS.add("shortest")
def shortest_first(text: str) -> Column:
    return F.length(text)


@ORDERS.add("random")
def random_order(text: str) -> Column:
    return F.md5(text)


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """TimeoutError in the block after `seconds`; for the main thread of a worker, where Python functions run."""

    def stop(*_: Any) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def score_rows(df: DataFrame, score: Callable[[str, str], float], response: str, truth: str, seconds: float = 10.0, model_score: str | None = None) -> DataFrame:
    """df with score and error: row by row in Arrow batches; a failure or a row over its time scores 0 and says why.

    A model's own score, where there is one, stands in place of the rule, which is then not run for that row.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
    out = df.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error"))

    def one(a: Any, b: Any, given: Any) -> tuple[float, str | None]:
        if given is not None and given == given:
            return float(given), None
        try:
            with time_limit(seconds):
                return float(score(a, b)), None
        except Exception as e:  # a scorer is the user's: whatever it raises is the row's, not the job's
            return 0.0, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = batch[model_score] if model_score else [None] * len(batch)
            made = [one(a, b, g) for a, b, g in zip(batch[response], batch[truth], given, strict=True)]
            yield batch.assign(score=[m[0] for m in made], error=[m[1] for m in made])

    return out.mapInPandas(run, schema)


def verified_rows(df: DataFrame, verify: Callable[[str, str], float], response: str, truth: str, seconds: float = 10.0, timeout_score: float = 0.0) -> DataFrame:
    """df with score, from an outside verifier that is given the truth in a box: `timeout_score` where it takes too long, 0 where it fails."""
    boxed = df.withColumn("_truth", F.concat(F.lit("\\boxed{"), F.col(truth), F.lit("}")))
    scored = score_rows(boxed, verify, response, "_truth", seconds)
    return scored.withColumn("score", F.when(F.col("error") == "TimeoutError", timeout_score).otherwise(F.col("score"))).drop("_truth")


def score_batches(df: DataFrame, score: Callable[[list[str], list[str]], list[float]], response: str, truth: str) -> DataFrame:
    """df with score, from a function of whole batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[float(x) for x in score(batch[response].tolist(), batch[truth].tolist())])

    return df.select("*", F.lit(None).cast("double").alias("score")).mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def apply_parts(df: DataFrame, parts: int, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over each batch of a frame dealt to `parts` by its keys."""
    return df.repartition(parts, *keys).mapInPandas(lambda batches: (f(b) for b in batches), schema)


@STRATEGIES.add("naive")
def naive(df: DataFrame, response: str, truth: str, score: Callable[[str, str], float], model_score: str | None = None) -> DataFrame:
    """Row by row; a model's score, where there is one, stands."""
    return score_rows(df, score, response, truth, model_score=model_score).drop("error")


@STRATEGIES.add("batch")
def batch(df: DataFrame, response: str, truth: str, score: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    return score_batches(df, score, response, truth)


@STRATEGIES.add("dapo")
def with_overlong_penalty(df: DataFrame, response: str, truth: str, score: Callable[[str, str], float], length: str, longest: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """Row by row, less a penalty for the last `buffer` tokens before the longest response."""
    scored = naive(df, response, truth, score)
    return scored.withColumn("score", F.col("score") + overlong_penalty(F.col(length), longest, buffer, factor))


@STRATEGIES.add("prime")
def competition_rule(df: DataFrame, response: str, truth: str) -> DataFrame:
    """1 where the stated answer is right by the competition rules, else 0."""
    return df.withColumn("score", F.when(competition.scored(F.col(response), F.col(truth))["correct"], 1.0).otherwise(0.0))
