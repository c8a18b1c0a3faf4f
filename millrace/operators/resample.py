"""Resampling of a batch by weights, and policy losses that pick tokens by covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = ("pow", "max_min", "max_random")


def weight(score: Column, kind: str, high: Column, low: Column, power: float = 2.0) -> Column:
    """abs(s)^power; 1 for the batch's extremes and 0 else; 0.4 for its largest and 0.1 else; each plus 1e-8."""
    if kind == "pow":
        return F.pow(F.abs(score), power) + 1e-8
    if kind == "max_min":
        return F.when((score == high) | (score == low), 1.0).otherwise(0.0) + 1e-8
    if kind == "max_random":
        return F.when(score == high, 0.4).otherwise(0.1) + 1e-8
    raise ValueError(f"no weights {kind}; there are {', '.join(WEIGHTS)}")


def draw(df: DataFrame, batch: str, row: str, w: str, seed: int, slots: int = 1024) -> DataFrame:
    """(batch, row, n): how often each row is drawn when each batch is resampled, with return, to its own size.

    Draw j of a batch falls at a hashed uniform place on the line of its cumulative weights. Lines are cut into `slots`,
    so that draws meet rows by an equal slot and then by range, never all with all.
    """
    b = Window.partitionBy(batch)
    line = df.select(batch, row, F.col(w).alias("w"), F.sum(w).over(b.orderBy(row).rowsBetween(Window.unboundedPreceding, 0)).alias("to"), F.sum(w).over(b).alias("all"), F.count("*").over(b).alias("size"))
    line = line.withColumns({"lo": (F.col("to") - F.col("w")) / F.col("all"), "hi": F.col("to") / F.col("all")})
    last = slots - 1
    held = line.withColumn("slot", F.explode(F.sequence(F.least(F.floor(F.col("lo") * slots), F.lit(last)), F.least(F.floor(F.col("hi") * slots), F.lit(last)))))
    sizes = line.groupBy(batch).agg(F.first("size").alias("size"))
    j = F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))).alias("j")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(batch).cast("string"), "j"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    draws = sizes.select(batch, j).withColumn("u", u).withColumn("slot", F.floor(F.col("u") * slots))
    met = held.join(draws, [batch, "slot"]).where((F.col("u") > F.col("lo")) & (F.col("u") <= F.col("hi")))
    return met.groupBy(batch, row).agg(F.count("*").alias("n"))


def covariance_clip(df: DataFrame, cov: str, share: float, low: float, high: float, mark: Column) -> DataFrame:
    """keep = 0 for `share` of all tokens, taken in hash order from those whose covariance lies in (low, high); 1 else.

    Only the tokens of the band are ranked.
    """
    n = df.agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("n")).first()["n"]
    band = df.where((F.col(cov) > low) & (F.col(cov) < high)).withColumn("_mark", mark).orderBy("_mark").limit(n)
    return df.withColumn("_mark", mark).join(band.select("_mark", F.lit(0).alias("_out")), "_mark", "left").withColumn("keep", F.coalesce("_out", F.lit(1))).drop("_mark", "_out")


def top_covariance(df: DataFrame, cov: str, share: float, *keys: str) -> DataFrame:
    """The share of tokens with the largest covariance: those that a divergence penalty is laid on."""
    n = df.agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("n")).first()["n"]
    return df.orderBy(F.col(cov).desc(), *keys).limit(n)
