"""Queries on groups of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register
from millrace.operators import groups as G
from millrace.plans import views as V

ONE = "count(*) OVER (PARTITION BY uid)"
MEAN = "avg(score) OVER (PARTITION BY uid)"


def advantage(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return G.estimator(name)(V.rollouts(spark, sf_dir), **options).select("uid", "idx", r6("advantage").alias("advantage"))


def sql_of(value: str) -> str:
    return f"SELECT uid, idx, round({value}, 6) + 0.0 AS advantage FROM rollouts"


@register(sql_of(f"CASE WHEN {ONE} = 1 THEN score / (1 + 1e-6) ELSE (score - {MEAN}) / (stddev_samp(score) OVER (PARTITION BY uid) + 1e-6) END"))
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(spark, sf_dir, "grpo")


@register(sql_of(f"CASE WHEN {ONE} = 1 THEN score ELSE score - {MEAN} END"))
def grpo_advantage_without_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(spark, sf_dir, "grpo", by_std=False)


@register("""SELECT uid, idx, round(CASE WHEN n < 2 THEN NULL WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage FROM (
    SELECT *, max(CASE WHEN k = 2 THEN score END) OVER (PARTITION BY uid) AS second FROM (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, idx) AS k, count(*) OVER (PARTITION BY uid) AS n, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM rollouts))""")
def pass_at_k_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(spark, sf_dir, "pass_at_k")


@register(sql_of(f"CASE WHEN {ONE} > 1 THEN {ONE} / greatest({ONE} - 1, 1) * (score - {MEAN}) ELSE score END"))
def rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(spark, sf_dir, "rloo")


@register(sql_of(f"score - CASE WHEN {ONE} > 1 THEN sum(len * score) OVER (PARTITION BY uid) / sum(len) OVER (PARTITION BY uid) ELSE 0 END"))
def opo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(spark, sf_dir, "opo")


@register(sql_of(f"(SELECT count(*) / greatest(1, count(*) FILTER (WHERE score <> 0)) FROM rollouts) * (score - CASE WHEN {ONE} = 1 THEN 0 ELSE {MEAN} END)"))
def gpg_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantage(spark, sf_dir, "gpg")


@register(f"""WITH b AS (SELECT uid, idx, len, score - CASE WHEN {ONE} = 1 THEN 0 ELSE {MEAN} END AS x FROM rollouts),
    m AS (SELECT sum(x * len) / (sum(len) + 1e-8) AS mu FROM b), v AS (SELECT sum(power(x - mu, 2) * len) / (sum(len) + 1e-8) * sum(len) / (sum(len) - 1) AS va FROM b, m)
    SELECT uid, idx, round((x - mu) / sqrt(va + 1e-8), 6) + 0.0 AS advantage FROM b, m, v""")
def reinforce_baseline_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row stands for `len` equal tokens, so whitening over tokens weighs rows by their length."""
    b = G.baseline(V.rollouts(spark, sf_dir))
    mean = b.agg((F.sum(F.col("advantage") * F.col("len")) / (F.sum("len") + 1e-8)).alias("mu"))
    var = b.crossJoin(F.broadcast(mean)).agg(((F.sum(F.pow(F.col("advantage") - F.col("mu"), 2) * F.col("len")) / (F.sum("len") + 1e-8)) * F.sum("len") / (F.sum("len") - 1)).alias("va"), F.first("mu").alias("mu"))
    return b.crossJoin(F.broadcast(var)).select("uid", "idx", r6((F.col("advantage") - F.col("mu")) / F.sqrt(F.col("va") + 1e-8)).alias("advantage"))


@register("SELECT uid, idx, round(n * power(cd, n - 1), 6) + 0.0 AS weight FROM (SELECT *, count(*) OVER (PARTITION BY uid) AS n, cume_dist() OVER (PARTITION BY uid ORDER BY score) AS cd FROM rollouts)")
def best_of_n_dpo_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_of_n_weight(V.rollouts(spark, sf_dir)).select("uid", "idx", r6("weight").alias("weight"))


@register("SELECT uid, idx, acc FROM (SELECT *, max(CAST(acc AS INT)) OVER (PARTITION BY uid) AS hi, min(CAST(acc AS INT)) OVER (PARTITION BY uid) AS lo, count(*) OVER (PARTITION BY uid) AS n FROM rollouts) WHERE hi <> lo OR n = 1")
def dynamic_sampling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.rollouts(spark, sf_dir).withColumn("m", F.col("acc").cast("int"))
    return G.dynamic_filter(rows, "m").select("uid", "idx", "acc")


@register("""SELECT uid, idx, passes FROM (SELECT uid, idx, avg(CAST(acc AS DOUBLE)) OVER (PARTITION BY uid) BETWEEN 0.2 AND 0.8 AND max(len) OVER (PARTITION BY uid) < 49 AS passes FROM rollouts) ORDER BY passes DESC, uid, idx LIMIT 500""")
def accuracy_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.accuracy_band(V.rollouts(spark, sf_dir), 0.2, 0.8, 50, 500, F.col("acc")).select("uid", "idx", "passes")


@register("""WITH votes AS (SELECT uid, pred AS vote, count(*) AS n, min(idx) AS f, arg_min(score, idx) AS value FROM rollouts GROUP BY uid, pred)
    SELECT uid, vote, n, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) AS k FROM votes) WHERE k = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.majority(V.rollouts(spark, sf_dir)).select("uid", "vote", "n", r6("value").alias("value"))


@register("""SELECT uid, CAST(max(CASE WHEN hi_k = 1 THEN idx END) AS INT) AS chosen, CAST(max(CASE WHEN lo_k = 1 THEN idx END) AS INT) AS rejected, round(max(score) - min(score), 6) + 0.0 AS margin FROM (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, idx) AS hi_k, row_number() OVER (PARTITION BY uid ORDER BY score, idx) AS lo_k FROM rollouts) GROUP BY uid HAVING max(score) > min(score)""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.preference_pairs(V.rollouts(spark, sf_dir)).select("uid", "chosen", "rejected", r6("margin").alias("margin"))


@register("""SELECT a.uid, CAST(a.idx AS INT) AS i, CAST(b.idx AS INT) AS j, round(a.score - b.score, 6) + 0.0 AS d_score, CAST(a.acc AS INT) - CAST(b.acc AS INT) AS d_acc FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.idx < b.idx""")
def group_pair_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_pairs(V.rollouts(spark, sf_dir)).select("uid", "i", "j", r6("d_score").alias("d_score"), "d_acc")


@register("""WITH p AS (SELECT a.uid, a.score - b.score AS ds, CAST(a.acc AS INT) - CAST(b.acc AS INT) AS da FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.idx < b.idx)
    SELECT uid, round(CASE WHEN sum(abs(da)) = 0 THEN 0.5 ELSE sum(CASE WHEN ds * da > 0 THEN abs(da) ELSE 0 END) / sum(abs(da)) END, 6) + 0.0 AS agreement FROM p GROUP BY uid""")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = G.group_pairs(V.rollouts(spark, sf_dir))
    gap = F.sum(F.abs("d_acc"))
    return pairs.groupBy("uid").agg(r6(F.when(gap == 0, 0.5).otherwise(F.sum(F.when(F.col("d_score") * F.col("d_acc") > 0, F.abs("d_acc")).otherwise(0)) / F.greatest(gap, F.lit(1)))).alias("agreement"))


@register("SELECT data_source, avg(CASE WHEN (score > 180) = acc THEN 1.0 ELSE 0.0 END) AS sign_accuracy FROM rollouts GROUP BY data_source")
def sign_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rollouts(spark, sf_dir).groupBy("data_source").agg(F.avg(F.when((F.col("score") > 180) == F.col("acc"), 1.0).otherwise(0.0)).alias("sign_accuracy"))


@register("""WITH m AS (SELECT uid, max(score) AS m, avg(score) AS mean FROM rollouts GROUP BY uid) SELECT uid, round(ln(avg(exp(0.5 * (score - m)))) / 0.5 + max(m), 6) + 0.0 AS soft, round(max(mean), 6) + 0.0 AS mean FROM rollouts JOIN m USING (uid) GROUP BY uid""")
def softmean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("uid")
    rows = V.rollouts(spark, sf_dir).withColumns({"m": F.max("score").over(w), "mean": F.avg("score").over(w)})
    return rows.groupBy("uid").agg(r6(G.softmean(F.col("score"), 0.5)[1](F.col("m"))).alias("soft"), r6(F.max("mean")).alias("mean"))


@register("SELECT r.uid, r.idx, round(g.mean, 6) + 0.0 AS mean, g.n FROM rollouts r JOIN (SELECT uid, avg(score) AS mean, count(*) AS n FROM rollouts GROUP BY uid) g ON r.uid = g.uid")
def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("uid")
    return V.rollouts(spark, sf_dir).select("uid", "idx", r6(F.avg("score").over(w)).alias("mean"), F.count("*").over(w).alias("n"))


@register("SELECT p.id, r.idx, p.ability, round(r.score, 6) + 0.0 AS score FROM prompts p JOIN rollouts r ON p.id = r.uid")
def prompt_rollout_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = V.prompts(spark, sf_dir), V.rollouts(spark, sf_dir)
    return p.join(r, p.id == r.uid).select("id", "idx", "ability", r6("score").alias("score"))


@register("""WITH g AS (SELECT uid, count(*) AS rows, uid % 20 AS gen FROM rollouts GROUP BY uid HAVING max(CAST(acc AS INT)) <> min(CAST(acc AS INT))), b AS (SELECT gen, count(*) AS n, sum(rows) AS rows FROM g GROUP BY gen),
    c AS (SELECT *, sum(n) OVER (ORDER BY gen) AS reached FROM b) SELECT gen, n, CAST(rows AS BIGINT) AS rows, CAST(reached AS BIGINT) AS reached FROM c WHERE reached - n < 200 AND gen < 10""")
def accumulate_until_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of varied groups, in the order of generation, until 200 prompts are reached or ten generations were made."""
    rows = V.rollouts(spark, sf_dir).withColumn("m", F.col("acc").cast("int"))
    groups = rows.groupBy("uid").agg(F.count("*").alias("rows"), F.max("m").alias("hi"), F.min("m").alias("lo")).where("hi <> lo")
    batches = groups.groupBy((F.col("uid") % 20).alias("gen")).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return batches.withColumn("reached", F.sum("n").over(Window.orderBy("gen"))).where("reached - n < 200 AND gen < 10")


@register("""WITH s AS (SELECT *, sum(CASE WHEN mask = 1 THEN reward ELSE 0 END) OVER (PARTITION BY uid) AS row_reward FROM tokens), c AS (SELECT uid, t, mask, sum(reward * mask) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret, row_reward FROM s)
    SELECT uid, t, round(ret, 6) + 0.0 AS ret, round((ret - row_reward / 2) * mask, 6) + 0.0 AS advantage FROM c""")
def remax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns-to-go minus a greedy baseline, here half the response's reward."""
    w = Window.partitionBy("uid")
    to_go = F.sum(F.col("reward") * F.col("mask")).over(w.orderBy("t").rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum(F.when(F.col("mask") == 1, F.col("reward")).otherwise(0)).over(w)
    return V.tokens(spark, sf_dir).select("uid", "t", r6(to_go).alias("ret"), r6((to_go - whole / 2) * F.col("mask")).alias("advantage"))


@register("""WITH w AS (SELECT uid, idx, CASE WHEN acc THEN 1.0 ELSE 0.0 END AS a, score, count(*) OVER (PARTITION BY uid) AS n FROM rollouts), l AS (SELECT uid, idx, CASE WHEN n > 1 THEN (a - avg(a) OVER (PARTITION BY uid)) * n / greatest(n - 1, 1) ELSE a END * 5 + CASE WHEN n > 1 THEN (score - avg(score) OVER (PARTITION BY uid)) * n / greatest(n - 1, 1) ELSE score END AS x FROM w),
    s AS (SELECT avg(x) AS mu, var_samp(x) AS va FROM l) SELECT uid, idx, round((x - mu) / sqrt(va + 1e-8), 6) + 0.0 AS advantage FROM l, s""")
def two_source_rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out advantages of two reward sources, weighted and whitened over all rows."""
    rows = V.rollouts(spark, sf_dir).withColumn("a", F.when(F.col("acc"), 1.0).otherwise(0.0))
    both = G.rloo(G.rloo(rows, "a").withColumnRenamed("advantage", "x"), "score").select("uid", "idx", (F.col("x") * 5 + F.col("advantage")).alias("x"))
    stats = both.agg(F.avg("x").alias("mu"), F.var_samp("x").alias("va"))
    return both.crossJoin(F.broadcast(stats)).select("uid", "idx", r6((F.col("x") - F.col("mu")) / F.sqrt(F.col("va") + 1e-8)).alias("advantage"))
