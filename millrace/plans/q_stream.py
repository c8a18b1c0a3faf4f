"""Queries that drain a stream of the events table and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import r6, register
from millrace.streaming import jobs as S


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY event_type")
def stream_resumable_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drained twice from one position: the second time there is nothing new, and no row comes twice."""
    folder = S.work_folder(spark, "load")
    for _ in range(2):
        S.drain(S.stream_of(spark, f"{sf_dir}/events.parquet"), f"{folder}/out", f"{folder}/position")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


@register("SELECT run, step FROM (SELECT event_type AS run, event_id AS step, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 25")
def stream_until_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.work_folder(spark, "quota")
    rows = S.stream_of(spark, f"{sf_dir}/events.parquet", 1000).select(F.col("event_type").alias("run"), F.col("event_id").alias("step"))
    S.drain(S.until_quota(rows, 25), f"{folder}/out", f"{folder}/position")
    return spark.read.parquet(f"{folder}/out").select("run", "step")


@register("SELECT user_id % 10 AS k, count(*) * 2 AS n FROM events GROUP BY 1")
def stream_growing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is stored with as many rows again that are made from it."""
    folder = S.work_folder(spark, "grow")
    rows = S.stream_of(spark, f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("k"), "event_id")
    S.grow(rows, f"{folder}/out", f"{folder}/position", lambda batch: batch.withColumn("event_id", -F.col("event_id") - 1))
    return spark.read.parquet(f"{folder}/out").groupBy("k").agg(F.count("*").alias("n"))


@register("""WITH RECURSIVE s AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, value FROM events), b AS (SELECT run, step, 0.2 * (1 + greatest(-0.2, least(0.2, value / 50 - 1)) * 10 / 1000) AS beta FROM s WHERE step = 1
    UNION ALL SELECT s.run, s.step, b.beta * (1 + greatest(-0.2, least(0.2, s.value / 50 - 1)) * 10 / 1000) FROM b JOIN s ON s.run = b.run AND s.step = b.step + 1) SELECT run, max(step) AS steps, round(arg_max(beta, step), 9) + 0.0 AS beta FROM b GROUP BY run""")
def stream_adaptive_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.work_folder(spark, "beta")
    rows = S.stream_of(spark, f"{sf_dir}/events.parquet", 1000).select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("kl"))
    found = S.adaptive_beta(rows, 0.2, 50, 1000, 10)
    S.drain_each(found, f"{folder}/position", lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}"), "update")
    last = spark.read.parquet(f"{folder}/out").groupBy("run").agg(F.max_by(F.struct("steps", "beta"), "batch").alias("x"))
    return last.select("run", "x.steps", (F.round("x.beta", 9) + 0.0).alias("beta"))


@register("SELECT user_id AS uid, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM events GROUP BY user_id")
def stream_curriculum_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.work_folder(spark, "curriculum")
    rows = S.stream_of(spark, f"{sf_dir}/events.parquet", 1000).select(F.col("user_id").alias("uid"), F.col("value").alias("score"))
    S.drain_each(S.mean_scores(rows), f"{folder}/position", lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out"), "complete")
    return spark.read.parquet(f"{folder}/out").select("uid", r6("mean").alias("mean"), "n")


@register("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.work_folder(spark, "windows")
    counts = S.windowed_counts(S.stream_of(spark, f"{sf_dir}/events.parquet", 1000), "ts", "1 day", "10 minutes", "event_type")
    S.drain_each(counts, f"{folder}/position", lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out"), "complete")
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select(F.unix_timestamp("window.start").alias("day"), "event_type", "n", (F.round("total", 4) + 0.0).alias("total"))
