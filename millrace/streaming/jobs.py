"""Incremental variants: resumable loading, quotas, growing tables, adaptive coefficients, curriculum feedback, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.io import work_folder  # noqa: F401  the folder of a job's output and position


def stream_of(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A parquet folder, or one file, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent()))
    return reader.parquet(path)


def drain(rows: DataFrame, out: str, position: str, mode: str = "append") -> None:
    """Write what is new since the position was kept, and stop. Called again with the same position, it goes on from there."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", position).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_each(rows: DataFrame, position: str, use: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Hand each micro-batch to `use`, then stop; a batch that is retried comes with the number it had."""
    query = rows.writeStream.foreachBatch(use).outputMode(mode).option("checkpointLocation", position).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def grow(rows: DataFrame, out: str, position: str, generate: Callable[[DataFrame], DataFrame]) -> None:
    """Append each batch and the rows generated from it; a retried batch replaces its own folder, so that no row comes twice."""

    def use(batch: DataFrame, number: int) -> None:
        batch.unionByName(generate(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain_each(rows, position, use)


def until_quota(rows: DataFrame, quota: int, run: str = "run", order: str = "step") -> DataFrame:
    """Rows of each run, in order within a micro-batch, until `quota` have been let through; state is one count a run.

    Of a micro-batch's parts only the rows that may still be let through are held.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        taken: pd.DataFrame | None = None
        for part in parts:
            taken = (part if taken is None else pd.concat([taken, part])).sort_values(order).head(max(0, quota - seen))
        state.update((seen + (0 if taken is None else len(taken)),))
        if taken is not None:
            yield taken

    return rows.groupBy(run).applyInPandasWithState(step, rows.schema, "n long", "append", GroupStateTimeout.NoTimeout)


def adaptive_beta(rows: DataFrame, start: float, target: float, horizon: float, n: int, run: str = "run", kl: str = "kl") -> DataFrame:
    """(run, steps, beta): the coefficient after all steps so far, times 1 + clip(kl / target - 1, 0.2) n / horizon at each.

    A product does not ask for the order of its factors, so the parts of a micro-batch are taken one at a time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beta, steps = state.get if state.exists else (start, 0)
        for part in parts:
            beta *= float((1 + (part[kl] / target - 1).clip(-0.2, 0.2) * n / horizon).prod())
            steps += len(part)
        state.update((beta, steps))
        yield pd.DataFrame({run: [key[0]], "steps": [steps], "beta": [beta]})

    return rows.groupBy(run).applyInPandasWithState(step, f"{run} string, steps long, beta double", "beta double, steps long", "update", GroupStateTimeout.NoTimeout)


def mean_scores(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Feedback for a curriculum: the mean score of each prompt so far, the next order's key."""
    return rows.groupBy(uid).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


def windowed_counts(rows: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums for each window of event time; rows later than `late` are left out once their window has closed."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
