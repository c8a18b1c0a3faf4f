"""Policy losses by name, and losses of preference and reward models.

A policy loss takes a long frame of tokens with the columns uid, t, logp, old, adv and mask, and gives one row: loss,
clip_fraction, kl and lower_fraction. `mode` is one of the aggregations of millrace.operators.tokens.loss_aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import resample as R
from millrace.operators import tokens as T

PolicyLoss = Callable[..., DataFrame]
POLICY_LOSSES: dict[str, PolicyLoss] = {}


def register_policy_loss(name: str) -> Callable[[PolicyLoss], PolicyLoss]:
    """File a loss under its name; a later one of the same name takes its place."""

    def put(f: PolicyLoss) -> PolicyLoss:
        POLICY_LOSSES[name] = f
        return f

    return put


def policy_loss(name: str) -> PolicyLoss:
    if name not in POLICY_LOSSES:
        raise ValueError(f"no policy loss {name}; there are {', '.join(sorted(POLICY_LOSSES))}")
    return POLICY_LOSSES[name]


def one_row(tokens: DataFrame, loss: Column, mode: str, width: int | None, **reported: Column) -> DataFrame:
    """The aggregated loss beside the masked means of what is reported; 0 for what is not."""
    own = tokens.withColumn("_loss", loss)
    m = F.col("mask")
    report = own.agg(*[F.coalesce(T.masked_mean(reported.get(n, F.lit(0.0)).cast("double"), m), F.lit(0.0)).alias(n) for n in ("clip_fraction", "kl", "lower_fraction")])
    return T.loss_aggregate(own, "_loss", "mask", "uid", mode, width).crossJoin(F.broadcast(report))


@register_policy_loss("vanilla")
def vanilla(tokens: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2, dual: float = 3.0, width: int | None = None) -> DataFrame:
    """The clipped objective with its dual clip."""
    p = T.clipped_objective(F.col("logp"), F.col("old"), F.col("adv"), low, high, dual)
    return one_row(tokens, p["loss"], mode, width, clip_fraction=p["clipped"], kl=F.col("old") - F.col("logp"), lower_fraction=p["dual_clipped"])


@register_policy_loss("gpg")
def gpg(tokens: DataFrame, mode: str = "token-mean", width: int | None = None) -> DataFrame:
    """-log p times the advantage."""
    return one_row(tokens, -F.col("logp") * F.col("adv"), mode, width)


def with_covariance(tokens: DataFrame, soft: bool) -> DataFrame:
    """cov = (adv - mean) (logp - mean) over the masked tokens; `soft` takes the masked mean with its small denominator."""
    m = F.col("mask")
    mean = (lambda c: T.masked_mean(F.col(c), m)) if soft else (lambda c: F.avg(F.when(m > 0, F.col(c))))
    means = tokens.agg(mean("adv").alias("_a"), mean("logp").alias("_b"))
    return tokens.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("adv") - F.col("_a")) * (F.col("logp") - F.col("_b"))).drop("_a", "_b")


@register_policy_loss("clip_cov")
def clip_cov(tokens: DataFrame, mode: str = "token-mean", share: float = 0.0002, low: float = 0.2, high: float = 0.2, least: float = 1.0, most: float = 5.0, width: int | None = None) -> DataFrame:
    """The clipped objective without `share` of the masked tokens, drawn by a hash from those not clipped whose covariance is in (least, most)."""
    if share <= 0:
        raise ValueError("the share must be above 0")
    ratio = F.exp(F.col("logp") - F.col("old"))
    plain, clipped = -F.col("adv") * ratio, -F.col("adv") * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    rows = with_covariance(tokens, soft=True).withColumn("cov", F.when((F.col("mask") > 0) & (clipped <= plain), F.col("cov")))
    n = int(rows.agg(F.sum("mask")).first()[0] or 0)
    band = rows.where((F.col("cov") > least) & (F.col("cov") < most)).orderBy(F.xxhash64("uid", "t"), "uid", "t").limit(max(int(share * n), 1)).select("uid", "t", F.lit(0.0).alias("_keep"))
    kept = rows.join(band, ["uid", "t"], "left").withColumn("_keep", F.coalesce("_keep", F.lit(1.0)))
    return one_row(kept, F.greatest(plain, clipped) * F.col("_keep"), mode, width, clip_fraction=1 - F.col("_keep"), kl=F.col("old") - F.col("logp"))


@register_policy_loss("kl_cov")
def kl_cov(tokens: DataFrame, mode: str = "token-mean", share: float = 0.0002, coefficient: float = 1.0, width: int | None = None) -> DataFrame:
    """The plain objective with a penalty of |log ratio| on the share of masked tokens whose covariance is largest."""
    if share <= 0:
        raise ValueError("the share must be above 0")
    d = F.col("logp") - F.col("old")
    rows = with_covariance(tokens, soft=False)
    top = R.top_covariance(rows.where("mask > 0"), "cov", share, "uid", "t").select("uid", "t", F.lit(1.0).alias("_top"))
    rows = rows.join(top, ["uid", "t"], "left")
    loss = -F.col("adv") * F.exp(d) + F.coalesce("_top", F.lit(0.0)) * coefficient * F.abs(d)
    return one_row(rows, loss, mode, width, kl=F.abs(d))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-F.abs(x))) + F.least(x, F.lit(0.0))


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False) -> Column:
    """Loss of a pair from its log probabilities under the policy and the reference: sigmoid (with label smoothing) or ipo."""
    x = (chosen - rejected) - (F.lit(0.0) if reference_free else ref_chosen - ref_rejected)
    if kind == "sigmoid":
        return -log_sigmoid(beta * x) * (1 - smoothing) - log_sigmoid(-beta * x) * smoothing
    if kind == "ipo":
        return F.pow(x - 1 / (2 * beta), 2)
    raise ValueError(f"no loss {kind}; there are sigmoid and ipo")


def ce_dpo_loss(tokens: DataFrame, score: str, acc: Column, beta: float, uid: str = "uid", mask: str = "mask") -> DataFrame:
    """One row: cross entropy of sigmoid(beta * masked sum of token scores) with each response's accuracy (logs held at -100)."""
    rows = tokens.groupBy(uid).agg(F.sum(F.col(score) * F.col(mask)).alias("s"), F.max(acc.cast("double")).alias("acc"))
    held = lambda x: F.greatest(x, F.lit(-100.0))
    x = beta * F.col("s")
    return rows.agg(F.avg(-(F.col("acc") * held(log_sigmoid(x)) + (1 - F.col("acc")) * held(log_sigmoid(-x)))).alias("loss"))
