"""Evaluation metrics over scored samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_of_means(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """Mean score per source of the rows' mean scores."""
    return df.groupBy(source, row).agg(F.avg(score).alias("m")).groupBy(source).agg(F.avg("m").alias("score"))


def mean_std_at_n(df: DataFrame, source: str = "data_source", prompt: str = "uid", score: str = "score") -> DataFrame:
    """(source, metric, value): mean@N and std@N (population) of each prompt, averaged over the source's prompts of that N."""
    per = df.groupBy(source, prompt).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    long = per.select(source, F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m}@"), F.col("n").cast("string")).alias("metric"), F.col(m).alias("value")) for m in ("mean", "std")])).alias("x"))
    return long.groupBy(source, "x.metric").agg(F.avg("x.value").alias("value"))


def sizes(n: Column) -> Column:
    """The sample sizes that are reported for n samples: 2, 4, 8, ... below n, and n itself; none for one sample."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda p: p < n)
    return F.when(n > 1, F.concat(powers, F.array(n.cast("int")))).otherwise(F.array().cast("array<int>"))


def expected_extremes(df: DataFrame, uid: str = "uid", score: str = "score", idx: str = "idx") -> DataFrame:
    """(uid, n, best, worst): the exact expectation of the largest and smallest of n draws with return from each group."""
    w = Window.partitionBy(uid)
    ranked = df.select(uid, score, F.row_number().over(w.orderBy(score, idx)).alias("i"), F.count("*").over(w).alias("size"))
    rows = ranked.withColumn("n", F.explode(sizes(F.col("size"))))
    p = lambda k: F.pow(k / F.col("size"), F.col("n"))
    i, s = F.col("i"), F.col("size")
    best = F.sum(F.col(score) * (p(i) - p(i - 1)))
    worst = F.sum(F.col(score) * (p(s - i + 1) - p(s - i)))
    return rows.groupBy(uid, "n").agg(best.alias("best"), worst.alias("worst"))


@cache
def draws(size: int, subset: int, times: int, seed: int) -> np.ndarray:
    """times x subset indices below `size`, drawn with return by the legacy generator: a function of its arguments alone."""
    generator = np.random.RandomState(seed)
    return np.stack([generator.choice(size, size=subset, replace=True) for _ in range(times)])


def bootstrap(values: np.ndarray, subset: int, reduce, times: int = 1000, seed: int = 42) -> tuple[float, float]:
    """Mean and population deviation of `reduce` over resamples."""
    if not len(values):
        raise ValueError("nothing to resample")
    found = reduce(np.asarray(values)[draws(len(values), subset, times, seed)])
    return float(found.mean()), float(found.std())


#: Prompts of one size that are resampled together.
TOGETHER = 256


def resampled(values: np.ndarray, votes: np.ndarray | None, subset: int, times: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of best, worst and (with votes) majority of resamples of each row of prompts with equally many samples."""
    at = draws(values.shape[1], subset, times, seed)
    taken = values[:, at]
    kinds = {"best": taken.max(2), "worst": taken.min(2)}
    if votes is not None:
        own = votes[:, at]
        counts = (own[:, :, :, None] == own[:, :, None, :]).sum(3)  # the first place with the largest count is the vote met first
        kinds["maj"] = np.take_along_axis(taken, counts.argmax(2)[:, :, None], 2)[:, :, 0]
    return {k: (x.mean(1), x.std(1)) for k, x in kinds.items()}


def bootstrap_metrics(df: DataFrame, source: str = "data_source", uid: str = "uid", idx: str = "idx", score: str = "score", vote: str | None = "pred", times: int = 1000, seed: int = 42, batches: int | None = None) -> DataFrame:
    """(source, metric, value): best@n, worst@n and maj@n, mean and std, resampled in each prompt and averaged per source.

    Prompts are dealt to batches by a hash; those of a batch that have equally many samples are resampled together.
    Sums and counts leave a batch.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([source, uid, idx])
        codes = pd.factorize(g[vote])[0] if vote else None
        values = g[score].to_numpy(float)
        new = ((g[source] != g[source].shift()) | (g[uid] != g[uid].shift())).to_numpy()
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(g)))
        names = g[source].to_numpy()[starts]
        rows: list[tuple] = []
        for n in np.unique(sizes[sizes > 1]).tolist():
            subsets = [1 << k for k in range(1, n.bit_length() + 1) if 1 << k < n] + [n]
            own = np.flatnonzero(sizes == n)
            for a in range(0, len(own), TOGETHER):
                part = own[a : a + TOGETHER]
                at = starts[part][:, None] + np.arange(n)[None, :]
                for m in subsets:
                    for kind, found in resampled(values[at], codes[at] if vote else None, m, times, seed).items():
                        for name, x in zip(("mean", "std"), found, strict=True):
                            sums = pd.DataFrame({"s": names[part], "x": x}).groupby("s", dropna=False)["x"].agg(["sum", "size"])
                            rows += [(s, f"{kind}@{m}/{name}", r["sum"], int(r["size"])) for s, r in sums.iterrows()]
        return pd.DataFrame(rows, columns=[source, "metric", "total", "n"])

    parts = batches or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [source, uid, idx, score, *([vote] if vote else [])]
    found = df.select(*columns, F.pmod(F.xxhash64(uid), F.lit(parts)).alias("_batch")).groupBy("_batch").applyInPandas(lambda g: run(g), f"{source} string, metric string, total double, n long")
    return found.groupBy(source, "metric").agg((F.sum("total") / F.sum("n")).alias("value"))


def section(variable: Column, metric: Column, largest: Column) -> Column:
    """val-core for the mean, maj and best metrics of the core variable at the largest n, else val-aux."""
    core = (variable.isin("acc", "reward")) & (metric.startswith("mean") | metric.startswith("maj") | metric.startswith("best")) & F.contains(metric, F.concat(F.lit("@"), largest.cast("string")))
    return F.when(core, "val-core").otherwise("val-aux")


def reduce_by_name(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """One value a name: the largest if the name has `max` in it, else the smallest if it has `min`, else the mean."""
    g = df.groupBy(name).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mean"))
    return g.select(name, F.when(F.instr(name, "max") > 0, F.col("hi")).when(F.instr(name, "min") > 0, F.col("lo")).otherwise(F.col("mean")).alias(value))


def flops(lengths: Column, params: float, heads: int, head_dim: int, layers: int) -> Column:
    """Aggregate: 6 params sum(len) + 12 sum(len^2) heads head_dim layers, of a dense transformer's step."""
    return 6 * params * F.sum(lengths) + 12.0 * heads * head_dim * layers * F.sum(lengths * lengths)


@dataclass(frozen=True)
class Architecture:
    """A transformer's sizes. `experts` (with `chosen` of them a token, `shared` for all) make it a mixture after `dense_layers`; `latent` ranks make its attention latent."""

    hidden: int
    layers: int
    vocabulary: int
    heads: int
    kv_heads: int
    head_dim: int
    inner: int
    experts: int = 0
    chosen: int = 0
    shared: int = 0
    expert_inner: int = 0
    dense_layers: int = 0
    #: Ranks of queries (0: full) and of keys with values, and the sizes of the rotated part of a key and of a value.
    latent: tuple[int, int, int, int] | None = None

    def attention_weights(self) -> int:
        if self.latent is None:
            return self.hidden * self.head_dim * 2 * (self.heads + self.kv_heads)
        q_rank, kv_rank, rotated, value = self.latent
        queries = self.heads * self.head_dim
        own = (self.hidden + queries) * q_rank if q_rank else self.hidden * queries
        return own + self.hidden * (kv_rank + rotated) + self.heads * (self.head_dim - rotated + value) * kv_rank + self.heads * value * self.hidden

    def weights(self) -> int:
        """Weights that a token meets: gated inner layers, attention, and the embedding twice."""
        dense = 3 * self.hidden * self.inner
        mixed = 3 * self.hidden * self.expert_inner * (self.chosen + self.shared) + self.hidden * self.experts
        n_dense = self.dense_layers if self.experts else self.layers
        return n_dense * dense + (self.layers - n_dense) * mixed + self.layers * self.attention_weights() + 2 * self.vocabulary * self.hidden

    def flops(self, lengths: Column) -> Column:
        return flops(lengths, float(self.weights()), self.heads, self.head_dim, self.layers)


#: Peak operations a second of devices, by a part of their name; the first that fits counts.
DEVICES = (
    ("MI300X", 1336e12), ("H100", 989e12), ("H800", 989e12), ("H200", 989e12), ("A100", 312e12), ("A800", 312e12),
    ("L40", 181.05e12), ("L20", 119.5e12), ("H20", 148e12), ("910B", 354e12), ("RTX 3070 Ti", 21.75e12),
)


def device_flops(device: Column) -> Column:
    """The peak of a device by its name; null for an unknown one."""
    out = F.when(F.contains(device, F.lit(DEVICES[0][0])), DEVICES[0][1])
    for name, peak in DEVICES[1:]:
        out = out.when(F.contains(device, F.lit(name)), peak)
    return out
