"""Group-relative statistics: advantages per prompt, group filters, votes and pairs.

All take a frame with a group column (`uid`), an order within the group (`idx`) and a score. Every window has the
one specification, so that Spark shuffles once by the group for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _group(uid: str = "uid") -> Window:
    return Window.partitionBy(uid)


def grpo(df: DataFrame, score: str = "score", uid: str = "uid", by_std: bool = True) -> DataFrame:
    """(score - mean) / (sample deviation + 1e-6) per group; a group of one has mean 0 and deviation 1."""
    w = _group(uid)
    one = F.count("*").over(w) == 1
    centred = F.col(score) - F.when(one, 0.0).otherwise(F.avg(score).over(w))
    return df.withColumn("advantage", centred / (F.when(one, 1.0).otherwise(F.stddev_samp(score).over(w)) + EPS) if by_std else centred)


def pass_at_k(df: DataFrame, score: str = "score", uid: str = "uid", idx: str = "idx", by_std: bool = True) -> DataFrame:
    """Only the best sample gets the gap to the second best, over the deviation; groups of one get null (they are an error)."""
    w = _group(uid)
    order = w.orderBy(F.col(score).desc(), F.col(idx))
    second = F.nth_value(score, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.col(score) - second
    value = gap / (F.stddev_samp(score).over(w) + EPS) if by_std else gap
    best = F.row_number().over(order) == 1
    return df.withColumn("advantage", F.when(F.count("*").over(w) < 2, F.lit(None)).when(best, value).otherwise(0.0))


def rloo(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """Leave-one-out: n / (n - 1) times the distance to the mean; a group of one keeps its score."""
    w = _group(uid)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n > 1, n / F.greatest(n - 1, F.lit(1)) * (F.col(score) - F.avg(score).over(w))).otherwise(F.col(score)))


def opo(df: DataFrame, score: str = "score", length: str = "len", uid: str = "uid") -> DataFrame:
    """Distance to the length-weighted mean; a group of one keeps its score."""
    w = _group(uid)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count("*").over(w) > 1, base).otherwise(0.0))


def gpg(df: DataFrame, score: str = "score", uid: str = "uid", f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm, alpha = rows / max(1, rows with a score other than 0), over all rows."""
    w = _group(uid)
    alpha = df.agg((F.count("*") / F.greatest(F.lit(1), F.sum(F.when(F.col(score) != 0, 1).otherwise(0)))).alias("_alpha"))
    centred = F.col(score) - F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg(score).over(w))
    return df.withColumn("_centred", centred).crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("_alpha") * F.col("_centred") / f_norm).drop("_alpha", "_centred")


def baseline(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """The score minus its group's mean (a group of one: minus 0), before whitening."""
    w = _group(uid)
    return df.withColumn("advantage", F.col(score) - F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg(score).over(w)))


def best_of_n_weight(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """n P(score <= own)^(n - 1) per group."""
    w = _group(uid)
    n = F.count("*").over(w)
    return df.withColumn("weight", n * F.pow(F.cume_dist().over(w.orderBy(score)), n - 1))


def remax(df: DataFrame, score: str = "score", greedy: str = "len") -> DataFrame:
    """The score minus that of the prompt's greedy response, given in a column."""
    return df.withColumn("advantage", F.col(score) - F.col(greedy))


def two_source_rloo(df: DataFrame, score: str = "score", acc: str = "acc", uid: str = "uid") -> DataFrame:
    """Leave-one-out of the model's score plus leave-one-out of the accuracy."""
    first = rloo(df, score, uid).withColumnRenamed("advantage", "_first")
    both = rloo(first.withColumn("_acc", F.col(acc).cast("double")), "_acc", uid)
    return both.withColumn("advantage", F.col("_first") + F.col("advantage")).drop("_first", "_acc")


#: Estimators of a response's advantage by name; a caller may add its own.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "grpo": grpo, "pass_at_k": pass_at_k, "rloo": rloo, "opo": opo, "gpg": gpg, "reinforce_plus_plus_baseline": baseline, "remax": remax, "prime": two_source_rloo,
}


def token_estimator(name: str) -> Callable[..., DataFrame]:
    """Estimators of a token's advantage: gae and reinforce_plus_plus, each whitened over the masked tokens of all rows.

    They take tokens (uid, t, reward, value, mask) and give (uid, t, mask, ret, advantage); `resampled`, where given, is
    applied to what gae returns.
    """
    from millrace.operators import tokens as T

    def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, resampled: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        found = T.whiten(T.gae(df, gamma, lam), "advantage", "mask", "advantage")
        return resampled(found) if resampled else found

    def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0) -> DataFrame:
        found = T.whiten(T.discounted_returns(df, gamma), "ret", "mask", "advantage")
        return found.withColumn("advantage", F.col("advantage") * F.col("mask"))

    found = {"gae": gae, "reinforce_plus_plus": reinforce_plus_plus}
    if name not in found:
        raise ValueError(f"no estimator of tokens {name}; there are {', '.join(sorted(found))}")
    return found[name]


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name]


def register_estimator(name: str, f: Callable[..., DataFrame]) -> None:
    if ESTIMATORS.get(name, f) is not f:
        raise ValueError(f"estimator {name} exists")
    ESTIMATORS[name] = f


def dynamic_filter(df: DataFrame, metric: str = "score", uid: str = "uid") -> DataFrame:
    """Groups whose metric varies, and groups of one: largest and smallest differ exactly where the deviation is above 0."""
    w = _group(uid)
    marked = df.withColumn("_varied", (F.max(metric).over(w) != F.min(metric).over(w)) | (F.count("*").over(w) == 1))
    return marked.where("_varied").drop("_varied")


def accuracy_band(df: DataFrame, lo: float, hi: float, longest: float, rows: int, acc: Column, length: str = "len", uid: str = "uid") -> DataFrame:
    """Groups with a mean accuracy in [lo, hi] and no sample near the cap come first; the first `rows` rows stay."""
    w = _group(uid)
    ok = F.avg(acc.cast("double")).over(w).between(lo, hi) & (F.max(length).over(w) < longest - 1)
    return df.withColumn("passes", ok).orderBy(F.col("passes").desc(), uid, "idx").limit(rows)


def majority(df: DataFrame, vote: str = "pred", value: str = "score", uid: str = "uid", idx: str = "idx") -> DataFrame:
    """The value of the first sample with the most frequent vote; of equally frequent votes the one seen first."""
    votes = df.groupBy(uid, vote).agg(F.count("*").alias("n"), F.min(idx).alias("first"), F.min_by(value, idx).alias("value"))
    return votes.groupBy(uid).agg(F.max_by(F.struct(F.col(vote).alias("vote"), "n", "value"), F.struct("n", -F.col("first"))).alias("w")).select(uid, "w.vote", "w.n", "w.value")


def preference_pairs(df: DataFrame, score: str = "score", uid: str = "uid", idx: str = "idx") -> DataFrame:
    """For each group with two scores or more, its best (chosen) and worst (rejected) sample; ties to the first."""
    g = df.groupBy(uid).agg(
        F.max_by(idx, F.struct(score, -F.col(idx))).alias("chosen"), F.min_by(idx, F.struct(score, idx)).alias("rejected"), F.max(score).alias("hi"), F.min(score).alias("lo"),
    )
    return g.where("hi > lo").select(uid, "chosen", "rejected", (F.col("hi") - F.col("lo")).alias("margin"))


def group_pairs(df: DataFrame, score: str = "score", acc: str = "acc", uid: str = "uid", idx: str = "idx") -> DataFrame:
    """The pairs (i < j) of each group's samples with the differences of score and accuracy. Groups are a prompt's samples."""
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col(f"a.{uid}") == F.col(f"b.{uid}")) & (F.col(f"a.{idx}") < F.col(f"b.{idx}")))
    return pairs.select(F.col(f"a.{uid}").alias(uid), F.col(f"a.{idx}").alias("i"), F.col(f"b.{idx}").alias("j"), (F.col(f"a.{score}") - F.col(f"b.{score}")).alias("d_score"), (F.col(f"a.{acc}").cast("int") - F.col(f"b.{acc}").cast("int")).alias("d_acc"))


def softmean(x: Column, beta: float) -> tuple[Column, Callable[[Column], Column]]:
    """For an aggregation: max(x), and from it the soft mean (1 / beta) log(mean(exp(beta x))) (at beta 0 the mean)."""
    if beta == 0:
        return F.max(x), lambda m: F.avg(x)
    return F.max(x), lambda m: F.log(F.avg(F.exp(beta * (x - m)))) / beta + F.max(m)
