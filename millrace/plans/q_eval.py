"""Queries on evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.operators import evaluate as E
from millrace.plans import views as V


@register("SELECT data_source, round(avg(m), 6) + 0.0 AS score FROM (SELECT data_source, uid, avg(score) AS m FROM rollouts GROUP BY ALL) GROUP BY data_source")
def eval_mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mean_of_means(V.rollouts(spark, sf_dir), "data_source", "uid", "score").select("data_source", r6("score").alias("score"))


@register("SELECT data_source, round(avg(m), 6) + 0.0 AS score FROM (SELECT data_source, uid, avg(CASE WHEN data_source LIKE '1%' THEN CAST(acc AS INT) WHEN data_source LIKE '2%' THEN score / 100 ELSE len END) AS m FROM rollouts GROUP BY ALL) GROUP BY data_source")
def eval_score_by_source_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("data_source").startswith("1"), F.col("acc").cast("int").cast("double")).when(F.col("data_source").startswith("2"), F.col("score") / 100).otherwise(F.col("len"))
    return E.mean_of_means(V.rollouts(spark, sf_dir).withColumn("s", rule), "data_source", "uid", "s").select("data_source", r6("score").alias("score"))


@register("""WITH p AS (SELECT data_source, uid, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std FROM rollouts GROUP BY ALL)
    SELECT data_source, concat('mean@', n) AS metric, round(avg(mean), 6) + 0.0 AS value FROM p GROUP BY ALL UNION ALL SELECT data_source, concat('std@', n), round(avg(std), 6) + 0.0 FROM p GROUP BY ALL""")
def validation_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mean_std_at_n(V.rollouts(spark, sf_dir)).select("data_source", "metric", r6("value").alias("value"))


@register("""WITH r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score, idx) AS i, count(*) OVER (PARTITION BY uid) AS s FROM rollouts),
    n AS (SELECT r.*, k.n FROM r JOIN (SELECT unnest([2, 4, 8, 16, 32]) AS n) k ON k.n < s UNION ALL SELECT r.*, s FROM r WHERE s > 1)
    SELECT uid, CAST(n AS INT) AS n, round(sum(score * (power(i / s, n) - power((i - 1) / s, n))), 6) + 0.0 AS best, round(sum(score * (power((s - i + 1) / s, n) - power((s - i) / s, n))), 6) + 0.0 AS worst FROM n GROUP BY uid, n""")
def expected_best_worst_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.expected_extremes(V.rollouts(spark, sf_dir)).select("uid", "n", r6("best").alias("best"), r6("worst").alias("worst"))


@register()
def validation_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled best, worst and majority metrics; the seeded draws have no counterpart in SQL."""
    return E.bootstrap_metrics(V.rollouts(spark, sf_dir), times=200)


@register("""WITH m AS (SELECT data_source, count(*) AS n, avg(score) AS v FROM rollouts GROUP BY data_source, uid), a AS (SELECT data_source, concat('mean@', n) AS metric, n, avg(v) AS v FROM m GROUP BY ALL), b AS (SELECT *, max(n) OVER (PARTITION BY data_source) AS top FROM a)
    SELECT concat(CASE WHEN contains(metric, concat('@', top)) THEN 'val-core' ELSE 'val-aux' END, '/', data_source, '/reward/', metric) AS name, round(v, 6) + 0.0 AS value FROM b""")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = V.rollouts(spark, sf_dir).groupBy("data_source", "uid").agg(F.count("*").alias("n"), F.avg("score").alias("v"))
    a = per.groupBy("data_source", "n").agg(F.avg("v").alias("v")).withColumn("metric", F.concat(F.lit("mean@"), F.col("n").cast("string")))
    a = a.withColumn("top", F.max("n").over(Window.partitionBy("data_source")))
    return a.select(F.concat(E.section(F.lit("reward"), F.col("metric"), F.col("top")), F.lit("/"), "data_source", F.lit("/reward/"), "metric").alias("name"), r6("v").alias("value"))


@register("""WITH e AS (SELECT concat(CASE user_id % 3 WHEN 0 THEN 'max_' WHEN 1 THEN 'timing_min_' ELSE 'avg_' END, event_type) AS name, value FROM events)
    SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM e GROUP BY name""")
def reduce_metrics_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 3
    e = table(spark, sf_dir, "events").select(F.concat(F.when(u == 0, "max_").when(u == 1, "timing_min_").otherwise("avg_"), "event_type").alias("name"), "value")
    return E.reduce_by_name(e).select("name", r6("value").alias("value"))


@register("""WITH s AS (SELECT uid, sum(reward) AS score, sum(reward * mask) AS rew, sum(mask) AS len FROM tokens GROUP BY uid), m AS (SELECT max(len) AS top FROM s)
    SELECT round(avg(score), 6) + 0.0 AS score_mean, round(max(score), 6) + 0.0 AS score_max, round(min(score), 6) + 0.0 AS score_min, round(avg(rew), 6) + 0.0 AS reward_mean, round(avg(len), 6) + 0.0 AS len_mean, CAST(max(len) AS BIGINT) AS len_max, CAST(min(len) AS BIGINT) AS len_min,
    round(avg(CASE WHEN len = top THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS clip_ratio, (SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) + 0.0 FROM tokens WHERE mask = 1) AS explained FROM s, m""")
def batch_data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tokens(spark, sf_dir)
    s = t.groupBy("uid").agg(F.sum("reward").alias("score"), F.sum(F.col("reward") * F.col("mask")).alias("rew"), F.sum("mask").alias("len"))
    top = s.agg(F.max("len").alias("top"))
    rows = s.crossJoin(F.broadcast(top)).agg(
        r6(F.avg("score")).alias("score_mean"), r6(F.max("score")).alias("score_max"), r6(F.min("score")).alias("score_min"), r6(F.avg("rew")).alias("reward_mean"), r6(F.avg("len")).alias("len_mean"),
        F.max("len").alias("len_max"), F.min("len").alias("len_min"), r6(F.avg(F.when(F.col("len") == F.col("top"), 1.0).otherwise(0.0))).alias("clip_ratio"),
    )
    explained = t.where("mask = 1").agg(r6(1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5)).alias("explained"))
    return rows.crossJoin(F.broadcast(explained))


@register("""WITH x AS (SELECT event_type AS phase, sum(value) AS s, sum(user_id % 50) AS resp, sum(user_id % 50 + 20) AS tot FROM events GROUP BY event_type)
    SELECT phase, round(s, 6) + 0.0 AS seconds, round(s * 1000 / CASE WHEN phase LIKE 'c%' THEN resp ELSE tot END, 6) + 0.0 AS ms_per_token FROM x""")
def timing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 50
    x = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.sum("value").alias("s"), F.sum(u).alias("resp"), F.sum(u + 20).alias("tot"))
    return x.select("phase", r6("s").alias("seconds"), r6(F.col("s") * 1000 / F.when(F.col("phase").startswith("c"), F.col("resp")).otherwise(F.col("tot"))).alias("ms_per_token"))


@register("SELECT event_type AS run, round(sum(user_id) / (sum(value) * 8), 6) + 0.0 AS tokens_per_gpu_second FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(r6(F.sum("user_id") / (F.sum("value") * 8)).alias("tokens_per_gpu_second"))


@register("SELECT event_type AS agent, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high, round(avg(value), 6) + 0.0 AS mean, arg_max(event_id, [value, -event_id]) AS slowest FROM events GROUP BY event_type")
def agent_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    slowest = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("agent")).agg(r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"), r6(F.avg("value")).alias("mean"), slowest.alias("slowest"))


@register("SELECT data_source, round(6.0 * 7e9 * sum(len) + 12.0 * 32 * 128 * 28 * sum(len * len), 0) + 0.0 AS flops FROM rollouts GROUP BY data_source")
def flops_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rollouts(spark, sf_dir).groupBy("data_source").agg((F.round(E.flops(F.col("len"), 7e9, 32, 128, 28), 0) + 0.0).alias("flops"))


@register("""WITH p AS (SELECT uid, max(score) AS chosen, min(score) AS rejected FROM rollouts GROUP BY uid HAVING count(*) > 1)
    SELECT round(avg(chosen), 6) + 0.0 AS chosen, round(avg(rejected), 6) + 0.0 AS rejected, round(avg(chosen - rejected), 6) + 0.0 AS margin, round(avg(-ln(1 / (1 + exp(-0.1 * (chosen - rejected))))), 6) + 0.0 AS loss FROM p""")
def preference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.rollouts(spark, sf_dir).groupBy("uid").agg(F.max("score").alias("c"), F.min("score").alias("r"), F.count("*").alias("n")).where("n > 1")
    gap = F.col("c") - F.col("r")
    return p.agg(r6(F.avg("c")).alias("chosen"), r6(F.avg("r")).alias("rejected"), r6(F.avg(gap)).alias("margin"), r6(F.avg(-F.log(1 / (1 + F.exp(-0.1 * gap))))).alias("loss"))


@register("SELECT uid, array_to_string(list(pred ORDER BY idx), ',') AS preds, count(*) AS n FROM rollouts GROUP BY uid")
def metric_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.array_sort(F.collect_list(F.struct("idx", "pred")))
    return V.rollouts(spark, sf_dir).groupBy("uid").agg(F.array_join(F.transform(seen, lambda x: x["pred"]), ",").alias("preds"), F.count("*").alias("n"))


@register("SELECT coalesce(data_source, 'all') AS data_source, coalesce(pred, 'all') AS pred, count(*) AS n, round(avg(score), 6) + 0.0 AS score FROM rollouts GROUP BY ROLLUP (data_source, pred)")
def score_rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.rollouts(spark, sf_dir).rollup("data_source", "pred").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("score"))
    return g.select(F.coalesce("data_source", F.lit("all")).alias("data_source"), F.coalesce("pred", F.lit("all")).alias("pred"), "n", "score")


@register("SELECT l.quality, l.toxic, count(*) AS n, round(avg(d.n_chars), 6) + 0.0 AS chars FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), r6(F.avg("n_chars")).alias("chars"))
