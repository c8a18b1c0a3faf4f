"""Queries on resampling, collation and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.functions import extend
from millrace.functions import extract as X
from millrace.operators import prep as P
from millrace.operators import resample as R
from millrace.operators import tokens as T
from millrace.plans import views as V


@register()
def filtered_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples drawn by the square of their score, with return, in each batch of 256 prompts."""
    rows = V.rollouts(spark, sf_dir).withColumns({"row": F.col("uid") * 64 + F.col("idx"), "batch": F.floor(F.col("uid") / 256)})
    w = Window.partitionBy("batch")
    rows = rows.withColumn("w", R.weight(F.col("score") / 100, "pow", F.max("score").over(w), F.min("score").over(w)))
    return R.draw(rows, "batch", "row", "w", 3)


@register("SELECT CAST(uid % 4 AS INT) AS worker, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS high, round(min(value), 6) + 0.0 AS low, round(stddev_samp(value), 6) + 0.0 AS std, round(sum(value * mask) / sum(mask), 6) + 0.0 AS masked FROM tokens GROUP BY 1")
def distributed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.tokens(spark, sf_dir).groupBy((F.col("uid") % 4).cast("int").alias("worker"))
    v = F.col("value")
    return g.agg(F.count("*").alias("n"), r6(F.avg(v)).alias("mean"), r6(F.max(v)).alias("high"), r6(F.min(v)).alias("low"), r6(F.stddev_samp(v)).alias("std"), r6(F.sum(v * F.col("mask")) / F.sum("mask")).alias("masked"))


@register("SELECT event_type AS name, round(avg(s), 6) + 0.0 AS seconds FROM (SELECT event_type, user_id % 4 AS worker, sum(value) AS s FROM events GROUP BY ALL) GROUP BY event_type")
def timing_mean_over_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("worker")).agg(F.sum("value").alias("s"))
    return per.groupBy(F.col("event_type").alias("name")).agg(r6(F.avg("s")).alias("seconds"))


COV = """c AS (SELECT uid, t, (sqrt(logp) - (SELECT sum(sqrt(logp) * mask) / (sum(mask) + 1e-8) FROM tokens)) * (sqrt(reward) - (SELECT sum(sqrt(reward) * mask) / (sum(mask) + 1e-8) FROM tokens)) AS cov, logp, ref FROM tokens WHERE mask = 1)"""


def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = V.tokens(spark, sf_dir), F.col("mask")
    means = t.agg(T.masked_mean(F.sqrt("logp"), m).alias("a"), T.masked_mean(F.sqrt("reward"), m).alias("b"))
    cov = (F.sqrt("logp") - F.col("a")) * (F.sqrt("reward") - F.col("b"))
    return t.where("mask = 1").crossJoin(F.broadcast(means)).select("uid", "t", cov.alias("cov"), "logp", "ref")


@register(f"WITH {COV} SELECT count(*) AS n, round(sum(k), 4) + 0.0 AS penalty FROM (SELECT abs(logp - ref) AS k FROM c ORDER BY cov DESC, uid, t LIMIT (SELECT greatest(CAST(floor(count(*) * 0.02) AS BIGINT), 1) FROM c))")
def covariance_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.top_covariance(covariances(spark, sf_dir), "cov", 0.02, "uid", "t")
    return top.agg(F.count("*").alias("n"), (F.round(F.sum(F.abs(F.col("logp") - F.col("ref"))), 4) + 0.0).alias("penalty"))


@register(f"WITH {COV} SELECT CAST(least(greatest(floor(count(*) * 0.001), 1), count(*) FILTER (WHERE cov > 0.02 AND cov < 0.05)) AS BIGINT) AS clipped, count(*) AS n FROM c")
def covariance_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.covariance_clip(covariances(spark, sf_dir), "cov", 0.001, 0.02, 0.05, F.xxhash64("uid", "t"))
    return rows.agg(F.sum(1 - F.col("keep")).alias("clipped"), F.count("*").alias("n"))


@register("SELECT CAST(floor(doc_id / 16) AS BIGINT) AS batch, count(*) AS n, array_to_string(list(lang ORDER BY doc_id), ',') AS langs, CAST(max(n_chars) AS BIGINT) AS widest FROM documents GROUP BY 1")
def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch as one row of arrays, in order, with the width that padding would take."""
    seen = F.array_sort(F.collect_list(F.struct("doc_id", "lang")))
    g = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 16).alias("batch"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.transform(seen, lambda x: x["lang"]), ",").alias("langs"), F.max("n_chars").alias("widest"))


@register(r"""WITH w AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole, sum(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))) AS parts FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(parts AS BIGINT) AS tokens, parts = len(regexp_extract_all(whole, '[^ \t\n\x0b\f\r]+')) AS agree FROM w""")
def token_sequence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages' tokens one after another, held against the tokens of the whole; the former count where they differ."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(seen.alias("x"))
    parts = F.flatten(F.transform("x", P.tokens_of))
    return g.select("conv_id", F.size(parts).cast("long").alias("tokens"), (parts == P.tokens_of(F.array_join("x", " "))).alias("agree"))


@register("SELECT uid, array_to_string(list_filter(list(CASE WHEN mask = 0 THEN 0 ELSE t END ORDER BY t), lambda x: x <> 0), ' ') AS kept, CAST(max(count(*)) OVER (PARTITION BY floor(uid / 256)) AS BIGINT) AS longest FROM tokens GROUP BY uid")
def ragged_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists padded at the left to the longest of their micro-batch (256 uids), and stripped of padding again."""
    rows = V.tokens(spark, sf_dir).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "mask"))), lambda x: F.when(x["mask"] == 0, 0).otherwise(x["t"])).alias("x"), F.count("*").alias("n"))
    longest = F.max("n").over(Window.partitionBy(F.floor(F.col("uid") / 256)))
    padded = rows.withColumn("longest", longest).withColumn("p", F.concat(F.array_repeat(F.lit(0), (F.col("longest") - F.col("n")).cast("int")), F.col("x")))
    return padded.select("uid", F.array_join(F.filter("p", lambda v: v != 0).cast("array<string>"), " ").alias("kept"), "longest")


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.5::DOUBLE WHEN contains(response, concat('Final Answer: ', truth)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM answers")
def scoring_with_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule in guarded Arrow batches; rows with a model's score keep that."""
    rows = V.answers(spark, sf_dir).select("doc_id", "response", "truth", F.when(F.col("doc_id") % 4 == 0, 0.5).alias("model"))
    return extend.score_rows(rows, lambda response, truth: float(f"Final Answer: {truth}" in response), "response", "truth", 5.0, "model").select("doc_id", "score")


@register("SELECT doc_id, round(greatest(CASE WHEN a = truth THEN 1.0 ELSE 0.0 END + least(-(n_chars - 9000) / 1000 * 1.0, 0.0), -1.0), 6) + 0.0 AS score, n_chars > 9000 AS overlong FROM (SELECT *, replace(replace(regexp_extract_all(right(response, 300), 'Final Answer: (-?[0-9.,]+)', 1)[-1], ',', ''), '$', '') AS a FROM answers)")
def overlong_reward_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's score with the penalty for overlong responses, held at -1."""
    own = F.when(X.final_answer(F.col("response")) == F.col("truth"), 1.0).otherwise(0.0)
    total = F.greatest(own + T.overlong_penalty(F.col("n_chars"), 10_000, 1000, 1.0), F.lit(-1.0))
    return V.answers(spark, sf_dir).select("doc_id", r6(total).alias("score"), (F.col("n_chars") > 9000).alias("overlong"))
