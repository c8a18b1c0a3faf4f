"""Token-level operators on the long form (row, position, value, mask) and on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 1e-8


def masked_sum(x: Column, mask: Column) -> Column:
    return F.sum(x * mask)


def masked_mean(x: Column, mask: Column) -> Column:
    """sum(x mask) / (sum(mask) + 1e-8), over what is grouped."""
    return F.sum(x * mask) / (F.sum(mask) + SMALL)


def whiten(df: DataFrame, x: str, mask: str, out: str, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) over the masked tokens of all rows; var has Bessel's correction.

    Two one-row aggregates, each broadcast: the mean first, as the variance is taken about it.
    """
    mean = df.agg(masked_mean(F.col(x), F.col(mask)).alias("_mu"))
    with_mean = df.crossJoin(F.broadcast(mean))
    n = F.sum(mask)
    var = with_mean.agg((masked_mean(F.pow(F.col(x) - F.col("_mu"), 2), F.col(mask)) * n / F.when(n > 1, n - 1)).alias("_va"))
    value = (F.col(x) - F.col("_mu")) / F.sqrt(F.col("_va") + SMALL)
    return with_mean.crossJoin(F.broadcast(var)).withColumn(out, value if shift_mean else value + F.col("_mu")).drop("_mu", "_va")


def loss_aggregate(df: DataFrame, loss: str, mask: str, uid: str, mode: str, width: int | None = None) -> DataFrame:
    """One row with the loss, by token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    x, m = F.col(loss), F.col(mask)
    if mode == "token-mean":
        return df.agg(masked_mean(x, m).alias("loss"))
    rows = df.groupBy(uid).agg(F.sum(x * m).alias("s"), F.sum(m).alias("n"))
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.col("s") / (F.col("n") + SMALL)).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        if not width:
            raise ValueError("the padded width is asked for: ragged rows do not hold it")
        return rows.agg((F.sum("s") / width).alias("loss"))
    raise ValueError(f"no mode {mode}")


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token estimators of the divergence: k1 (kl), abs, k2 (mse), k3 (low_var_kl)."""
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        k = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(k) - k - 1))
    raise ValueError(f"no estimator {kind}")


def clipped_objective(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> dict[str, Column]:
    """The clipped loss of a token with its dual clip for negative advantages, and whether each clip acts."""
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logp - old)))
    plain, clipped = -adv * ratio, -adv * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    first = F.greatest(plain, clipped)
    second = F.least(-adv * dual, first)
    return {"loss": F.when(adv < 0, second).otherwise(first), "clipped": (clipped > plain).cast("int"), "dual_clipped": ((first > -adv * dual) & (adv < 0)).cast("int")}


def value_loss(value: Column, old: Column, ret: Column, clip: float = 0.5) -> tuple[Column, Column]:
    """The larger of the squared errors of the value and of the value held near the old one, and whether the clip acts."""
    held = F.greatest(old - clip, F.least(old + clip, value))
    a, b = F.pow(value - ret, 2), F.pow(held - ret, 2)
    return F.greatest(a, b), (b > a).cast("int")


#: Steps of a response that are folded together; what passes from one run to the next is a linear function.
STEPS = 256
#: The state of a fold: what passes on, the value at the step, and the step's mask and value.
STATE = "next:double,last:double,m:int,v:double"


def folded(df: DataFrame, uid: str, t: str, fields: dict[str, Column], start: Column, step: Callable[[Column, Column], Column], out: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """A fold over each response from its end, its state kept at each step: (uid, t, the columns of `out`).

    A response's tokens are gathered to one array (a response is bounded). Only every STEPS-th state is appended to
    an array, and the states between are folded again from there, so that the work is not the square of the length.
    """
    steps = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), *[c.alias(n) for n, c in fields.items()]))))
    rows = df.groupBy(uid).agg(steps.alias("steps"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("steps") - 1) / STEPS).cast("int")), lambda i: F.slice("steps", i * STEPS + 1, F.lit(STEPS)))

    def over(chunk: Column, state: Column) -> Column:
        return F.aggregate(chunk, state, step)

    first = F.struct(start.alias("s"), F.array().cast(f"array<struct<{STATE}>>").alias("all"))
    heads = F.aggregate(F.col("chunks"), first, lambda a, c: F.struct(over(c, a["s"]).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")))["all"]

    def inside(chunk: Column, head: Column) -> Column:
        kept = F.struct(head.alias("s"), F.array().cast(f"array<struct<t:bigint,{STATE}>>").alias("all"))

        def one(a: Column, x: Column) -> Column:
            return F.transform(F.array(step(a["s"], x)), lambda s: F.struct(s.alias("s"), F.concat(a["all"], F.array(F.struct(x["t"].cast("bigint").alias("t"), *[s[n].alias(n) for n in ("next", "last", "m", "v")]))).alias("all")))[0]

        return F.aggregate(chunk, kept, one)["all"]

    states = rows.select(uid, "steps", chunks.alias("chunks")).select(uid, "chunks", heads.alias("heads"))
    every = states.select(uid, F.explode(F.arrays_zip("chunks", "heads")).alias("z")).select(uid, F.explode(inside(F.col("z.chunks"), F.col("z.heads"))).alias("x"))
    return every.select(uid, F.col("x.t").cast("int").alias(t), *[f(F.col("x")).alias(n) for n, f in out.items()])


def gae(df: DataFrame, gamma: float, lam: float, uid: str = "uid", t: str = "t", reward: str = "reward", value: str = "value", mask: str = "mask") -> DataFrame:
    """(uid, t, mask, advantage, ret): generalised advantages; masked steps pass the next value and the running sum on."""

    def step(s: Column, x: Column) -> Column:
        a = x["r"] + gamma * s["next"] - x["v"] + gamma * lam * s["last"]
        on = x["m"] == 1
        return F.struct(F.when(on, x["v"]).otherwise(s["next"]).alias("next"), F.when(on, a).otherwise(s["last"]).alias("last"), x["m"].cast("int").alias("m"), x["v"].alias("v"))

    fields = {"r": F.col(reward).cast("double"), "v": F.col(value).cast("double"), "m": F.col(mask)}
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.lit(0).alias("m"), F.lit(0.0).alias("v"))
    return folded(df, uid, t, fields, start, step, {mask: lambda x: x["m"], "advantage": lambda x: x["last"], "ret": lambda x: x["last"] + x["v"]})


def discounted_returns(df: DataFrame, gamma: float, uid: str = "uid", t: str = "t", reward: str = "reward", mask: str = "mask") -> DataFrame:
    """Reversed discounted sums whose carry is reset where the mask is 0."""

    def step(s: Column, x: Column) -> Column:
        now = x["r"] + gamma * s["next"]
        return F.struct((now * x["m"]).alias("next"), now.alias("last"), x["m"].cast("int").alias("m"), F.lit(0.0).alias("v"))

    fields = {"r": F.col(reward).cast("double"), "m": F.col(mask)}
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.lit(0).alias("m"), F.lit(0.0).alias("v"))
    return folded(df, uid, t, fields, start, step, {mask: lambda x: x["m"], "ret": lambda x: x["last"]})


def eos_mask(df: DataFrame, is_end: Column, uid: str = "uid", t: str = "t") -> DataFrame:
    """keep = 1 up to and including the first end token of a row."""
    before = F.sum(is_end.cast("int")).over(Window.partitionBy(uid).orderBy(t).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("keep", F.when(F.coalesce(before, F.lit(0)) == 0, 1).otherwise(0))


def pad_or_cut(x: Column, size: int, pad: Column, left_pad: bool = False, truncation: str = "error") -> Column:
    """An array of `size`: padded on one side, or cut at the left, right or middle; too long for `error`: null."""
    n, missing = F.size(x), F.array_repeat(pad, F.greatest(F.lit(0), size - F.size(x)))
    padded = F.concat(missing, x) if left_pad else F.concat(x, missing)
    half = size // 2
    cuts: dict[str, Callable[[], Column]] = {
        "left": lambda: F.slice(x, n - size + 1, F.lit(size)), "right": lambda: F.slice(x, 1, size),
        "middle": lambda: F.concat(F.slice(x, 1, half), F.slice(x, n - (size - half) + 1, F.lit(size - half))), "error": lambda: F.lit(None),
    }
    return F.when(n <= size, padded).otherwise(cuts[truncation]())


def entropy(logits: Column) -> Column:
    """logsumexp(x) - sum(softmax(x) x) of an array."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return top + F.log(z) - F.aggregate(F.zip_with(e, logits, lambda p, v: p * v), F.lit(0.0), lambda a, v: a + v) / z


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """0 up to longest - buffer tokens, then falling to -factor at the longest."""
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))


def at_last_token(reward: Column, length: Column) -> Column:
    """An array of `length` values: the reward at the last one, 0 before."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1)).cast("int")), lambda i: F.when(i == length, reward).otherwise(0.0))).otherwise(F.array().cast("array<double>"))


def merged_paths(base: Column, sizes: Column) -> Column:
    """Where the paths of a block stand when they are put one after another: (path, start, end, position, next_position).

    All paths start at the block's position, and what follows goes on from the longest of them. Tokens of two paths
    do not see each other: the spans that a path does not see are those of the others.
    """
    before = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.transform(sizes, lambda n, i: F.struct(i.alias("path"), (base + before[i]).alias("start"), (base + before[i] + n).alias("end"), base.alias("position"), (base + F.array_max(sizes)).alias("next_position")))
