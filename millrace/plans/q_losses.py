"""Queries on policy and preference losses, estimators by name, and full batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import r6, register
from millrace.operators import groups as G
from millrace.operators import losses as L
from millrace.operators import tokens as T
from millrace.plans import views as V

#: Tokens of a policy step: log probabilities now and before, and an advantage.
STEP = "s AS (SELECT uid, t, mask, -sqrt(logp) AS logp, -sqrt(abs(ref) + 0.1) AS old, reward * 40 - 2 AS adv FROM tokens)"


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tokens(spark, sf_dir).select("uid", "t", "mask", (-F.sqrt("logp")).alias("logp"), (-F.sqrt(F.abs("ref") + 0.1)).alias("old"), (F.col("reward") * 40 - 2).alias("adv"))


def _mean(x: str) -> str:
    return f"sum(({x}) * mask) / (sum(mask) + 1e-8)"


def _row(name: str, loss: str, clip: str, kl: str, lower: str, source: str = "x") -> str:
    parts = ", ".join(f"round({_mean(x)}, 6) + 0.0 AS {n}" for x, n in ((loss, "loss"), (clip, "clip_fraction"), (kl, "kl"), (lower, "lower_fraction")))
    return f"SELECT '{name}' AS name, {parts} FROM {source}"


LOSSES_SQL = f"""WITH {STEP}, x AS (SELECT *, exp(logp - old) AS ratio, -adv * exp(logp - old) AS p, -adv * greatest(0.8, least(1.2, exp(logp - old))) AS c FROM s),
    m AS (SELECT {_mean("adv")} AS a, {_mean("logp")} AS b, avg(adv) FILTER (WHERE mask > 0) AS a1, avg(logp) FILTER (WHERE mask > 0) AS b1, sum(mask) AS n FROM x),
    y AS (SELECT x.*, CASE WHEN mask > 0 AND c <= p THEN (adv - a) * (logp - b) END AS cov, (adv - a1) * (logp - b1) AS cov1, n FROM x, m),
    k AS (SELECT *, CASE WHEN mask > 0 AND row_number() OVER (PARTITION BY mask ORDER BY cov1 DESC, uid, t) <= greatest(CAST(floor(n * 0.01) AS BIGINT), 1) THEN 1.0 ELSE 0.0 END AS top FROM y)
    {_row("vanilla", "CASE WHEN adv < 0 THEN least(-adv * 3.0, greatest(p, c)) ELSE greatest(p, c) END", "CASE WHEN c > p THEN 1.0 ELSE 0 END", "old - logp", "CASE WHEN greatest(p, c) > -adv * 3.0 AND adv < 0 THEN 1.0 ELSE 0 END")}
    UNION ALL {_row("gpg", "-logp * adv", "0.0", "0.0", "0.0")}
    UNION ALL {_row("clip_cov", "CASE WHEN cov > 0.5 AND cov < 0.9 THEN 0 ELSE greatest(p, c) END", "CASE WHEN cov > 0.5 AND cov < 0.9 THEN 1.0 ELSE 0 END", "old - logp", "0.0", "y")}
    UNION ALL {_row("kl_cov", "p + top * 2.0 * abs(logp - old)", "0.0", "abs(logp - old)", "0.0", "k")}"""


@register(LOSSES_SQL)
def policy_losses_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each registered loss over all tokens; the share of clip_cov takes in its whole band, so that no draw decides."""
    options: dict[str, dict] = {"vanilla": {}, "gpg": {}, "clip_cov": {"share": 1.0, "least": 0.5, "most": 0.9}, "kl_cov": {"share": 0.01, "coefficient": 2.0}}
    s, out = step(spark, sf_dir), None
    for name, own in options.items():
        row = L.policy_loss(name)(s, **own).select(F.lit(name).alias("name"), *[r6(c).alias(c) for c in ("loss", "clip_fraction", "kl", "lower_fraction")])
        out = row if out is None else out.unionByName(row)
    return out


@register("""WITH p AS (SELECT uid, max(score) / 100 AS c, min(score) / 100 AS r, avg(score) / 200 AS rc, avg(len) / 50 AS rr FROM rollouts GROUP BY uid HAVING count(*) > 1), x AS (SELECT *, (c - r) - (rc - rr) AS d FROM p)
    SELECT round(avg(ln(1 + exp(-0.5 * d))), 6) + 0.0 AS sigmoid, round(avg(0.9 * ln(1 + exp(-0.5 * d)) + 0.1 * ln(1 + exp(0.5 * d))), 6) + 0.0 AS smoothed, round(avg(power(d - 1.0, 2)), 6) + 0.0 AS ipo, round(avg(ln(1 + exp(-0.5 * (c - r)))), 6) + 0.0 AS free FROM x""")
def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.rollouts(spark, sf_dir).groupBy("uid").agg((F.max("score") / 100).alias("c"), (F.min("score") / 100).alias("r"), (F.avg("score") / 200).alias("rc"), (F.avg("len") / 50).alias("rr"), F.count("*").alias("n")).where("n > 1")
    x = [F.col(c) for c in ("c", "r", "rc", "rr")]
    kinds = {"sigmoid": {}, "smoothed": {"smoothing": 0.1}, "ipo": {"kind": "ipo"}, "free": {"reference_free": True}}
    return p.agg(*[r6(F.avg(L.preference_loss(*x, 0.5, **own))).alias(n) for n, own in kinds.items()])


@register("WITH r AS (SELECT uid, sum((reward - 0.05) * mask) * 5 AS s, CASE WHEN uid % 3 = 0 THEN 1.0 ELSE 0.0 END AS acc FROM tokens GROUP BY uid) SELECT round(avg(acc * ln(1 + exp(-s)) + (1 - acc) * ln(1 + exp(s))), 6) + 0.0 AS loss FROM r")
def ce_dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tokens(spark, sf_dir).withColumn("score", F.col("reward") - 0.05)
    return L.ce_dpo_loss(t, "score", F.col("uid") % 3 == 0, 5.0).select(r6("loss").alias("loss"))


@register("""WITH x AS (SELECT uid, idx, score, len, data_source, avg(score) OVER w AS mu, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd, sum(len * score) OVER w / sum(len) OVER w AS base FROM rollouts WINDOW w AS (PARTITION BY uid))
    SELECT uid, idx, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END, 6) + 0.0 AS grpo, round(CASE WHEN n > 1 THEN n / (n - 1) * (score - mu) ELSE score END, 6) + 0.0 AS rloo,
    round(CASE WHEN n > 1 THEN score - base ELSE score END, 6) + 0.0 AS opo, round(CASE WHEN n = 1 THEN score ELSE score - mu END, 6) + 0.0 AS baseline, round(score - len, 6) + 0.0 AS remax FROM x""")
def estimators_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response-level estimators taken from the registry, one after another over the same groups."""
    rows = V.rollouts(spark, sf_dir)
    for name, column in (("grpo", "grpo"), ("rloo", "rloo"), ("opo", "opo"), ("reinforce_plus_plus_baseline", "baseline"), ("remax", "remax")):
        rows = G.estimator(name)(rows).withColumnRenamed("advantage", column)
    return rows.select("uid", "idx", *[r6(c).alias(c) for c in ("grpo", "rloo", "opo", "baseline", "remax")])


GAE = """WITH RECURSIVE n AS (SELECT uid, max(t) AS last FROM tokens GROUP BY uid), g AS (
    SELECT k.uid, k.t, k.mask, CASE WHEN k.mask = 1 THEN reward - value ELSE 0.0 END AS a, CASE WHEN k.mask = 1 THEN reward - value ELSE 0.0 END + value AS ret, CASE WHEN k.mask = 1 THEN value ELSE 0.0 END AS nv FROM tokens k JOIN n ON k.uid = n.uid AND k.t = n.last
    UNION ALL SELECT k.uid, k.t, k.mask, CASE WHEN k.mask = 1 THEN k.reward + 0.97 * g.nv - k.value + 0.97 * 0.93 * g.a ELSE g.a END, CASE WHEN k.mask = 1 THEN k.reward + 0.97 * g.nv - k.value + 0.97 * 0.93 * g.a ELSE g.a END + k.value, CASE WHEN k.mask = 1 THEN k.value ELSE g.nv END FROM g JOIN tokens k ON k.uid = g.uid AND k.t = g.t - 1)"""


@register(GAE + """, x AS (SELECT uid, t, mask, a AS x FROM g), m AS (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM x), v AS (SELECT mu, sum(power(x - mu, 2) * mask) / (sum(mask) + 1e-8) * max(m.n) / (max(m.n) - 1) AS va FROM x, m GROUP BY mu)
    SELECT uid, CAST(t AS INT) AS t, round((x - mu) / sqrt(va + 1e-8), 6) + 0.0 AS advantage FROM x, v""")
def gae_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised advantages by their name, whitened over all masked tokens."""
    return G.token_estimator("gae")(V.tokens(spark, sf_dir), gamma=0.97, lam=0.93).select("uid", "t", r6("advantage").alias("advantage"))


STATS = ("mean", "avg"), ("max", "max"), ("min", "min")


@register(GAE + f""", f AS (SELECT g.uid, g.t, g.mask, g.a, g.ret, k.reward, k.value FROM g JOIN tokens k ON k.uid = g.uid AND k.t = g.t), s AS (SELECT uid, sum(reward) AS score, sum(reward * mask) AS rew, sum(mask) AS len, uid % 11 AS prompt, uid % 4 AS turns FROM f GROUP BY uid)
    SELECT * FROM (SELECT {", ".join(f"round({sql}(CASE WHEN mask = 1 THEN {c} END), 6) + 0.0 AS {name}_{stat}" for c, name in (("a", "advantages"), ("ret", "returns"), ("value", "values")) for stat, sql in STATS)},
    round(1 - var_samp(CASE WHEN mask = 1 THEN ret - value END) / (var_samp(CASE WHEN mask = 1 THEN ret END) + 1e-5), 6) + 0.0 AS explained FROM f),
    (SELECT {", ".join(f"round({sql}({c}), 6) + 0.0 AS {name}_{stat}" for c, name in (("score", "score"), ("rew", "rewards"), ("CAST(len AS DOUBLE)", "response_length"), ("CAST(prompt AS DOUBLE)", "prompt_length"), ("CAST(turns AS DOUBLE)", "num_turns")) for stat, sql in STATS)},
    round(avg(CASE WHEN len = 7 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS response_clip_ratio, round(avg(CASE WHEN prompt = 10 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS prompt_clip_ratio FROM s)""")
def batch_metrics_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked statistics of advantages, returns and values; scores, lengths with the share at their limits, and turns."""
    t = V.tokens(spark, sf_dir)
    g = T.gae(t, 0.97, 0.93).join(t.select("uid", "t", "reward", "value"), ["uid", "t"])
    s = g.groupBy("uid").agg(F.sum("reward").alias("score"), F.sum(F.col("reward") * F.col("mask")).alias("rewards"), F.sum("mask").alias("response_length")).withColumns({"prompt_length": F.col("uid") % 11, "num_turns": F.col("uid") % 4})
    own = {"mean": F.avg, "max": F.max, "min": F.min}
    masked = lambda c: F.when(F.col("mask") == 1, F.col(c))
    tokens = [r6(f(masked(c))).alias(f"{n}_{k}") for c, n in (("advantage", "advantages"), ("ret", "returns"), ("value", "values")) for k, f in own.items()]
    left = F.when(F.col("mask") == 1, F.col("ret") - F.col("value"))
    tokens.append(r6(1 - F.var_samp(left) / (F.var_samp(masked("ret")) + 1e-5)).alias("explained"))
    rows = [r6(f(F.col(n).cast("double"))).alias(f"{n}_{k}") for n in ("score", "rewards", "response_length", "prompt_length", "num_turns") for k, f in own.items()]
    share = lambda c, most: r6(F.avg(F.when(F.col(c) == most, 1.0).otherwise(0.0)))
    rows += [share("response_length", 7).alias("response_clip_ratio"), share("prompt_length", 10).alias("prompt_clip_ratio")]
    return g.agg(*tokens).crossJoin(F.broadcast(s.agg(*rows)))
