"""Length-balanced partitions: one batch is one task's own, never the whole table."""

from __future__ import annotations

import heapq
from functools import total_ordering

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@total_ordering
class _Last:
    """Sorts a key the other way round in a heap."""

    def __init__(self, key: tuple):
        self.key = key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: k lists of indices with nearly equal sums.

    A solution is k bins (sum, number of items, items) from the fullest; the two solutions with the widest gap between
    fullest and emptiest bin are joined, full against empty, until one is left. `equal_size` starts from
    whole rows of k items of near length.
    """
    ranked = sorted((n, i) for i, n in enumerate(lengths))
    if equal_size and len(ranked) % k:
        raise ValueError(f"{len(ranked)} rows do not make {k} parts of equal size")
    starts = [ranked[a : a + k] for a in range(0, len(ranked), k)] if equal_size else [[x] for x in ranked]
    heap = []

    def put(bins: list[tuple]) -> None:
        bins.sort(reverse=True)
        heapq.heappush(heap, (_Last((bins[0][0] - bins[-1][0], bins[0])), len(heap), bins))

    for start in starts:
        put([(n, 1, ((i, n),)) for n, i in start] + [(0, 0, ())] * (k - len(start)))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        put([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b), strict=True)])
    return [[i for i, _ in items] for _, _, items in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item, in the given order, to the lightest bin so far (the first of equals)."""
    bias = sum(lengths) + 1 if equal_size else 0
    bins: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, j) for j in range(k)]
    for i, n in enumerate(lengths):
        load, j = heapq.heappop(heap)
        bins[j].append(i)
        heapq.heappush(heap, (load + n + bias, j))
    return bins


def micro_batches(lengths: list[int], budget: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """Micro-batches of about `budget` tokens: as many as the tokens ask for (at least `least`, a multiple of `multiple`,
    at most the rows), balanced, and in falling order of the squared lengths' sum, which stands for attention's work.
    """
    if max(lengths, default=0) > budget:
        raise ValueError("a row is longer than the budget")
    k = max(least, min(len(lengths), -(-sum(lengths) // budget)))
    k = -(-k // multiple) * multiple
    if k > len(lengths):
        raise ValueError(f"{len(lengths)} rows do not fill {k} micro-batches")
    parts = differencing(lengths, k)
    return sorted(parts, key=lambda p: (sum(lengths[i] ** 2 for i in p), min(p, default=0)), reverse=True)


def balanced(df: DataFrame, batch: str, row: str, length: str, k: int, method: str = "differencing") -> DataFrame:
    """(batch, row, part): each batch's rows over k parts of about equal length."""
    of = {"differencing": differencing, "greedy": greedy}[method]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(row).reset_index(drop=True)
        parts = of(g[length].astype(int).tolist(), k)
        found = [(i, p) for p, own in enumerate(parts) for i in own]
        return pd.DataFrame({batch: g[batch].iloc[0], row: [g[row].iloc[i] for i, _ in found], "part": [p for _, p in found]})

    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, f"{batch} {df.schema[batch].dataType.simpleString()}, {row} {df.schema[row].dataType.simpleString()}, part int")


def rebalanced(df: DataFrame, part: str, parts: int) -> DataFrame:
    """The rows dealt so that each part is one partition of its own: a rank that reads a partition has its part's tokens."""
    return df.repartitionById(parts, F.col(part).cast("int"))


def imbalance(df: DataFrame, batch: str, part: str, length: str) -> DataFrame:
    """(batch, high, low, gap): the largest and smallest sum of a part of each batch, and their difference."""
    sums = df.groupBy(batch, part).agg(F.sum(length).alias("s"))
    return sums.groupBy(batch).agg(F.max("s").alias("high"), F.min("s").alias("low"), (F.max("s") - F.min("s")).alias("gap"))


def dynamic_batches(df: DataFrame, batch: str, row: str, length: str, budget: int) -> DataFrame:
    """(batch, row, micro, place): each batch's rows in micro-batches under a token budget; row restores the order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(row).reset_index(drop=True)
        found = [(i, m, p) for m, own in enumerate(micro_batches(g[length].astype(int).tolist(), budget)) for p, i in enumerate(own)]
        return pd.DataFrame({batch: g[batch].iloc[0], row: [g[row].iloc[i] for i, _, _ in found], "micro": [m for _, m, _ in found], "place": [p for _, _, p in found]})

    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, f"{batch} {df.schema[batch].dataType.simpleString()}, {row} {df.schema[row].dataType.simpleString()}, micro int, place int")
