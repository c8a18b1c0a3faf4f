"""Queries on token-level measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.operators import tokens as T
from millrace.plans import views as V
from millrace.sources.io import ranked_in_runs

WHITE = """m AS (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM x), v AS (SELECT mu, sum(power(x - mu, 2) * mask) / (sum(mask) + 1e-8) * max(n) / (max(n) - 1) AS va FROM x, m GROUP BY mu)"""


@register("SELECT uid, round(sum(value * mask), 6) + 0.0 AS s, round(sum(value * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS mean FROM tokens GROUP BY uid")
def masked_mean_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tokens(spark, sf_dir).groupBy("uid").agg(r6(T.masked_sum(F.col("value"), F.col("mask"))).alias("s"), r6(T.masked_mean(F.col("value"), F.col("mask"))).alias("mean"))


@register(f"WITH x AS (SELECT uid, t, mask, value AS x FROM tokens), {WHITE} SELECT uid, t, round((x - mu) / sqrt(va + 1e-8), 6) + 0.0 AS white FROM x, v")
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.whiten(V.tokens(spark, sf_dir), "value", "mask", "white").select("uid", "t", r6("white").alias("white"))


@register("""WITH r AS (SELECT uid, sum(value * mask) AS s, sum(mask) AS n FROM tokens GROUP BY uid)
    SELECT 'token-mean' AS mode, (SELECT round(sum(value * mask) / (sum(mask) + 1e-8), 6) + 0.0 FROM tokens) AS loss UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) + 0.0 FROM r
    UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / (n + 1e-8)), 6) + 0.0 FROM r UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 16, 6) + 0.0 FROM r""")
def loss_aggregation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, out = V.tokens(spark, sf_dir), None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = T.loss_aggregate(t, "value", "mask", "uid", mode, 16).select(F.lit(mode).alias("mode"), r6("loss").alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@register("""SELECT uid, t, round(logp - ref, 6) + 0.0 AS k1, round(abs(logp - ref), 6) + 0.0 AS a, round(0.5 * (logp - ref) * (logp - ref), 6) + 0.0 AS k2,
    round(greatest(-10.0, least(10.0, exp(greatest(-20.0, least(20.0, ref - logp))) - greatest(-20.0, least(20.0, ref - logp)) - 1)), 6) + 0.0 AS k3 FROM tokens2""".replace("tokens2", "(SELECT uid, t, sqrt(logp) AS logp, sqrt(abs(ref) + 0.1) AS ref FROM tokens)"))
def kl_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tokens(spark, sf_dir).select("uid", "t", F.sqrt("logp").alias("logp"), F.sqrt(F.abs("ref") + 0.1).alias("ref"))
    return t.select("uid", "t", *[r6(T.kl(F.col("logp"), F.col("ref"), k)).alias(n) for k, n in (("k1", "k1"), ("abs", "a"), ("k2", "k2"), ("k3", "k3"))])


@register("""WITH x AS (SELECT uid, t, mask, reward * 10 - 0.4 AS adv, exp(greatest(-20.0, least(20.0, sqrt(logp) - sqrt(abs(ref) + 0.1)))) AS ratio FROM tokens),
    y AS (SELECT *, -adv * ratio AS p, -adv * greatest(0.8, least(1.2, ratio)) AS c FROM x), z AS (SELECT *, greatest(p, c) AS f FROM y)
    SELECT round(sum(CASE WHEN adv < 0 THEN least(-adv * 3.0, f) ELSE f END * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS loss, round(sum(CASE WHEN c > p THEN 1.0 ELSE 0 END * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS clip_fraction,
    round(sum(CASE WHEN f > -adv * 3.0 AND adv < 0 THEN 1.0 ELSE 0 END * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS dual_fraction FROM z""")
def clipped_policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = V.tokens(spark, sf_dir), F.col("mask")
    p = T.clipped_objective(F.sqrt("logp"), F.sqrt(F.abs("ref") + 0.1), F.col("reward") * 10 - 0.4)
    return t.agg(*[r6(T.masked_mean(p[k], m)).alias(n) for k, n in (("loss", "loss"), ("clipped", "clip_fraction"), ("dual_clipped", "dual_fraction"))])


@register("""WITH x AS (SELECT mask, power(value * 20 - reward * 10, 2) AS a, power(greatest(0.5 - 0.3, least(0.5 + 0.3, value * 20)) - reward * 10, 2) AS b FROM tokens)
    SELECT round(0.5 * sum(greatest(a, b) * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS loss, round(sum(CASE WHEN b > a THEN 1.0 ELSE 0 END * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS clip_fraction FROM x""")
def clipped_value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss, clip = T.value_loss(F.col("value") * 20, F.lit(0.5), F.col("reward") * 10, 0.3)
    return V.tokens(spark, sf_dir).agg(r6(0.5 * T.masked_mean(loss, F.col("mask"))).alias("loss"), r6(T.masked_mean(clip, F.col("mask"))).alias("clip_fraction"))


@register("""WITH RECURSIVE k AS (SELECT uid, t, mask, sqrt(reward + 0.03) AS reward, sqrt(value + 0.02) AS value FROM tokens), n AS (SELECT uid, max(t) AS last FROM k GROUP BY uid), g AS (
    SELECT k.uid, k.t, k.mask, CASE WHEN k.mask = 1 THEN reward - value ELSE 0.0 END AS a, CASE WHEN k.mask = 1 THEN reward - value ELSE 0.0 END + value AS ret, CASE WHEN k.mask = 1 THEN value ELSE 0.0 END AS nv FROM k JOIN n ON k.uid = n.uid AND k.t = n.last
    UNION ALL SELECT k.uid, k.t, k.mask, CASE WHEN k.mask = 1 THEN k.reward + 0.99 * g.nv - k.value + 0.99 * 0.95 * g.a ELSE g.a END, CASE WHEN k.mask = 1 THEN k.reward + 0.99 * g.nv - k.value + 0.99 * 0.95 * g.a ELSE g.a END + k.value, CASE WHEN k.mask = 1 THEN k.value ELSE g.nv END FROM g JOIN k ON k.uid = g.uid AND k.t = g.t - 1)
    SELECT uid, CAST(t AS INT) AS t, round(a, 6) + 0.0 AS advantage, round(ret, 6) + 0.0 AS ret FROM g""")
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards and values are roots, which have no half-way ties at the last place that is kept."""
    t = V.tokens(spark, sf_dir).withColumns({"reward": F.sqrt(F.col("reward") + 0.03), "value": F.sqrt(F.col("value") + 0.02)})
    return T.gae(t, 0.99, 0.95).select("uid", "t", r6("advantage").alias("advantage"), r6("ret").alias("ret"))


@register("""WITH RECURSIVE n AS (SELECT uid, max(t) AS last FROM tokens GROUP BY uid), g AS (SELECT k.uid, k.t, k.mask, sqrt(reward) AS x FROM tokens k JOIN n ON k.uid = n.uid AND k.t = n.last
    UNION ALL SELECT k.uid, k.t, k.mask, sqrt(k.reward) + 0.9 * g.x * g.mask FROM g JOIN tokens k ON k.uid = g.uid AND k.t = g.t - 1), x AS (SELECT * FROM g), m AS (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM x), v AS (SELECT mu, sum(power(x - mu, 2) * mask) / (sum(mask) + 1e-8) * max(m.n) / (max(m.n) - 1) AS va FROM x, m GROUP BY mu)
    SELECT uid, CAST(t AS INT) AS t, round(x, 6) + 0.0 AS ret, round((x - mu) / sqrt(va + 1e-8) * mask, 6) + 0.0 AS advantage FROM x, v""")
def reinforce_plus_plus_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.discounted_returns(V.tokens(spark, sf_dir).withColumn("reward", F.sqrt("reward")), 0.9)
    return T.whiten(r, "ret", "mask", "w").select("uid", "t", r6("ret").alias("ret"), r6(F.col("w") * F.col("mask")).alias("advantage"))


@register("SELECT uid, t, CAST(greatest(sum(mask) OVER w - 1, 0) AS BIGINT) AS position, CAST((sum(mask) OVER w - 1) * mask AS BIGINT) AS masked_position FROM tokens WINDOW w AS (PARTITION BY uid ORDER BY t)")
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.sum("mask").over(Window.partitionBy("uid").orderBy("t"))
    return V.tokens(spark, sf_dir).select("uid", "t", F.greatest(seen - 1, F.lit(0)).alias("position"), ((seen - 1) * F.col("mask")).alias("masked_position"))


@register("SELECT uid, t, CASE WHEN coalesce(sum(1 - mask) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS keep FROM tokens")
def response_mask_to_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.eos_mask(V.tokens(spark, sf_dir), F.col("mask") == 0).select("uid", "t", "keep")


@register("""WITH k AS (SELECT uid, sum((sqrt(logp) - sqrt(abs(ref) + 0.1)) * mask) / (sum(mask) + 1e-8) AS kl FROM tokens GROUP BY uid), b AS (SELECT avg(kl) AS cur FROM k)
    SELECT t.uid, t.t, round(sqrt(reward) - 0.1 * (sqrt(logp) - sqrt(abs(ref) + 0.1)) * mask, 6) + 0.0 AS shaped, round(0.1 * (1 + greatest(-0.2, least(0.2, cur / 0.05 - 1)) * 64 / 10000), 9) + 0.0 AS next_beta FROM tokens t, b""")
def kl_shaped_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tokens(spark, sf_dir).withColumn("d", T.kl(F.sqrt("logp"), F.sqrt(F.abs("ref") + 0.1), "k1"))
    now = t.groupBy("uid").agg(T.masked_mean(F.col("d"), F.col("mask")).alias("kl")).agg(F.avg("kl").alias("cur"))
    beta = 0.1 * (1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("cur") / 0.05 - 1)) * 64 / 10000)
    return t.crossJoin(F.broadcast(now)).select("uid", "t", r6(F.sqrt("reward") - 0.1 * F.col("d") * F.col("mask")).alias("shaped"), (F.round(beta, 9) + 0.0).alias("next_beta"))


@register("""WITH RECURSIVE s AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, value FROM events), b AS (SELECT run, step, 0.2 * (1 + greatest(-0.2, least(0.2, value / 50 - 1)) * 10 / 1000) AS beta FROM s WHERE step = 1
    UNION ALL SELECT s.run, s.step, b.beta * (1 + greatest(-0.2, least(0.2, s.value / 50 - 1)) * 10 / 1000) FROM b JOIN s ON s.run = b.run AND s.step = b.step + 1) SELECT run, max(step) AS steps, round(arg_max(beta, step), 9) + 0.0 AS beta FROM b GROUP BY run""")
def adaptive_kl_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient is a product of a factor for each step: a fold that an aggregate of logarithms tells at once."""
    factor = 1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("value") / 50 - 1)) * 10 / 1000
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("steps"), (F.round(0.2 * F.exp(F.sum(F.log(factor))), 9) + 0.0).alias("beta"))


@register("SELECT round(max(d), 6) + 0.0 AS high, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d), 6) + 0.0 AS std FROM (SELECT abs(exp(-logp) - exp(-abs(ref))) AS d FROM tokens WHERE mask = 1)")
def probability_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.exp(-F.col("logp")) - F.exp(-F.abs("ref")))
    return V.tokens(spark, sf_dir).where("mask = 1").agg(r6(F.max(d)).alias("high"), r6(F.avg(d)).alias("mean"), r6(F.stddev_samp(d)).alias("std"))


@register("""WITH m AS (SELECT sum(sqrt(logp) * mask) / (sum(mask) + 1e-8) AS a, sum(sqrt(reward) * mask) / (sum(mask) + 1e-8) AS b FROM tokens)
    SELECT uid, t, round((sqrt(logp) - a) * (sqrt(reward) - b), 6) + 0.0 AS cov FROM tokens, m WHERE mask = 1 ORDER BY (sqrt(logp) - a) * (sqrt(reward) - b) DESC, uid, t LIMIT 50""")
def top_covariance_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, m = V.tokens(spark, sf_dir), F.col("mask")
    means = t.agg(T.masked_mean(F.sqrt("logp"), m).alias("a"), T.masked_mean(F.sqrt("reward"), m).alias("b"))
    cov = (F.sqrt("logp") - F.col("a")) * (F.sqrt("reward") - F.col("b"))
    return t.where("mask = 1").crossJoin(F.broadcast(means)).withColumn("c", cov).orderBy(F.col("c").desc(), "uid", "t").limit(50).select("uid", "t", r6("c").alias("cov"))


@register("""WITH k AS (SELECT uid, t, abs(sqrt(logp) - sqrt(abs(ref) + 0.1)) AS kl FROM tokens), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY kl DESC, t) AS rank FROM k)
    SELECT r.uid, CAST(r.rank AS INT) AS rank, r.t, round(r.kl, 6) + 0.0 AS kl, count(*) AS context FROM r JOIN k ON k.uid = r.uid AND k.t BETWEEN r.t - 2 AND r.t + 2 WHERE r.rank <= 2 GROUP BY ALL""")
def kl_hot_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("uid")
    k = V.tokens(spark, sf_dir).select("uid", "t", F.abs(F.sqrt("logp") - F.sqrt(F.abs("ref") + 0.1)).alias("kl"))
    around = F.count("*").over(w.orderBy("t").rowsBetween(-2, 2))
    return k.select("uid", F.row_number().over(w.orderBy(F.col("kl").desc(), "t")).alias("rank"), "t", r6("kl").alias("kl"), around.alias("context")).where("rank <= 2")


@register("SELECT vec_id, round(mx + ln(z) - zx / z, 6) + 0.0 AS entropy FROM (SELECT vec_id, max(mx) AS mx, sum(exp(x - mx)) AS z, sum(exp(x - mx) * x) AS zx FROM (SELECT vec_id, list_max(embedding)::DOUBLE AS mx, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)")
def entropy_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(T.entropy(F.col("embedding").cast("array<double>"))).alias("entropy"))


@register("SELECT uid, idx, round(least(-(len - 40) / 10 * 0.7, 0.0), 6) + 0.0 AS penalty, len > 40 AS overlong FROM rollouts")
def overlong_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rollouts(spark, sf_dir).select("uid", "idx", r6(T.overlong_penalty(F.col("len"), 50, 10, 0.7)).alias("penalty"), (F.col("len") > 40).alias("overlong"))


@register("SELECT uid, idx, CAST(len AS INT) AS width, round(score, 6) + 0.0 AS last, round(score, 6) + 0.0 AS total FROM rollouts")
def reward_at_last_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.rollouts(spark, sf_dir).select("uid", "idx", T.at_last_token(r6("score"), F.col("len")).alias("r"))
    return rows.select("uid", "idx", F.size("r").alias("width"), F.element_at("r", -1).alias("last"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("""WITH a AS (SELECT uid, list(t ORDER BY t) AS x, count(*) AS n FROM tokens GROUP BY uid)
    SELECT uid, array_to_string(CASE WHEN n <= 4 THEN list_concat(x, list_resize([]::BIGINT[], 4 - n, 0)) ELSE x[:4] END, ' ') AS right_cut, array_to_string(CASE WHEN n <= 4 THEN list_concat(list_resize([]::BIGINT[], 4 - n, 0), x) ELSE x[-4:] END, ' ') AS left_cut,
    array_to_string(CASE WHEN n <= 5 THEN list_concat(x, list_resize([]::BIGINT[], 5 - n, 0)) ELSE list_concat(x[:2], x[-3:]) END, ' ') AS middle_cut, n > 6 AS too_long FROM a""")
def pad_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.tokens(spark, sf_dir).groupBy("uid").agg(F.sort_array(F.collect_list("t")).alias("x"))
    x, pad = F.col("x"), F.lit(0)
    show = lambda c: F.array_join(c.cast("array<string>"), " ")
    return a.select("uid", show(T.pad_or_cut(x, 4, pad, False, "right")).alias("right_cut"), show(T.pad_or_cut(x, 4, pad, True, "left")).alias("left_cut"), show(T.pad_or_cut(x, 5, pad, False, "middle")).alias("middle_cut"), T.pad_or_cut(x, 6, pad).isNull().alias("too_long"))


@register("SELECT uid, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY floor(uid / 256) ORDER BY uid) - n AS BIGINT) AS start, CAST(max(n) OVER (PARTITION BY floor(uid / 256)) AS BIGINT) AS longest, CAST((8 - n % 8) % 8 AS BIGINT) AS pad FROM (SELECT uid, sum(mask) AS n FROM tokens GROUP BY uid)")
def ragged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of the rows of each micro-batch (256 uids) in its packed token array."""
    g = V.tokens(spark, sf_dir).groupBy("uid").agg(F.sum("mask").alias("n"))
    w = Window.partitionBy(F.floor(F.col("uid") / 256))
    return g.select("uid", "n", (F.sum("n").over(w.orderBy("uid")) - F.col("n")).alias("start"), F.max("n").over(w).alias("longest"), ((8 - F.col("n") % 8) % 8).alias("pad"))


@register("""WITH c AS (SELECT event_type, event_id, user_id % 3 AS k FROM events), l AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY event_type ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM c), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM l)
    SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type, island ORDER BY event_id) - 1 AS INT) AS rollout_n FROM g""")
def trace_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("user_id") % 3).alias("k"))
    return ranked_in_runs(c, "event_type", ["event_id"], "k", "n").select("event_type", "event_id", F.col("n").cast("int").alias("rollout_n"))


@register("""WITH r AS (SELECT uid, idx, 1.0 / (1 + exp(-(score - 150) / 50)) AS s FROM rollouts), m AS (SELECT max(s) AS hi, min(s) AS lo FROM r)
    SELECT uid, idx, round(power(abs(s), 2) + 1e-8, 6) + 0.0 AS pow_weight, round(CASE WHEN s = hi OR s = lo THEN 1.0 ELSE 0.0 END + 1e-8, 6) + 0.0 AS max_min_weight, round(CASE WHEN s = hi THEN 0.4 ELSE 0.1 END + 1e-8, 6) + 0.0 AS max_random_weight FROM r, m""")
def resampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    r = V.rollouts(spark, sf_dir).select("uid", "idx", (1 / (1 + F.exp(-(F.col("score") - 150) / 50))).alias("s"))
    m = r.agg(F.max("s").alias("hi"), F.min("s").alias("lo"))
    return r.crossJoin(F.broadcast(m)).select("uid", "idx", r6(F.pow(F.abs(s), 2) + 1e-8).alias("pow_weight"), r6(F.when((s == F.col("hi")) | (s == F.col("lo")), 1.0).otherwise(0.0) + 1e-8).alias("max_min_weight"), r6(F.when(s == F.col("hi"), 0.4).otherwise(0.1) + 1e-8).alias("max_random_weight"))


@register("SELECT round(avg(-reward * ratio), 6) + 0.0 AS gpg_loss, round(avg(-ln(1 / (1 + exp(-(sqrt(logp) - ratio))))), 6) + 0.0 AS dpo_loss FROM (SELECT *, exp(-sqrt(logp)) AS ratio FROM tokens WHERE mask = 1)")
def policy_loss_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.exp(-F.sqrt("logp"))
    return V.tokens(spark, sf_dir).where("mask = 1").agg(r6(F.avg(-F.col("reward") * ratio)).alias("gpg_loss"), r6(F.avg(-F.log(1 / (1 + F.exp(-(F.sqrt("logp") - ratio)))))).alias("dpo_loss"))
