"""Batch algebra on frames with an explicit row number (0, 1, ...): position is a column, never an accident of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.io import placed


def select_columns(df: DataFrame, names: list[str], row: str = "row_id") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.select(row, *[n for n in names if n != row])


def pop_columns(df: DataFrame, names: list[str], row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The named columns, and the rest; both keep the row number."""
    return select_columns(df, names, row), df.drop(*[n for n in names if n != row])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    if len(set(names.values())) != len(names):
        raise ValueError("two columns would get one name")
    return df.withColumnsRenamed(names)


def union_columns(a: DataFrame, b: DataFrame, row: str = "row_id") -> DataFrame:
    """Columns of both, joined by row; a shared column must agree (null equals null, NaN equals NaN), or the query fails."""
    shared = [c for c in b.columns if c in a.columns and c != row]
    joined = a.alias("a").join(b.alias("b"), F.col(f"a.{row}").eqNullSafe(F.col(f"b.{row}")), "full_outer")
    ok = F.col(f"a.{row}").isNotNull() & F.col(f"b.{row}").isNotNull()
    for c in shared:
        ok = ok & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    checked = joined.withColumn("_ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the frames differ in rows or in a shared column")).cast("boolean")))
    return checked.where("_ok").select(*[F.col(f"a.{c}") for c in a.columns], *[F.col(f"b.{c}") for c in b.columns if c not in a.columns])


def chunk(df: DataFrame, k: int, n: int, row: str = "row_id", padded: bool = False) -> DataFrame:
    """chunk = which of k equal parts of n rows; n must divide unless `padded` (the last parts are then shorter)."""
    if n % k and not padded:
        raise ValueError(f"{n} rows do not make {k} equal chunks")
    size = -(-n // k)
    return df.withColumn("chunk", F.floor(F.col(row) / size))


def split(df: DataFrame, size: int, row: str = "row_id") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(row) / size))


def pad_to_divisor(df: DataFrame, divisor: int, n: int, row: str = "row_id") -> DataFrame:
    """Rows after the n-th repeat the first ones, in turn, up to a multiple of `divisor`; is_pad marks them."""
    pad = -n % divisor
    turns = -(-pad // n) if pad else 0
    again = df.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(max(turns - 1, 0))))).withColumn("_at", F.col("_turn") * n + F.col(row)).where(F.col("_at") < pad)
    again = again.withColumn(row, (F.col("_at") + n).cast(df.schema[row].dataType)).drop("_turn", "_at")
    return df.withColumn("is_pad", F.lit(False)).unionByName(again.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def repeat(df: DataFrame, n: int, rows: Column, interleave: bool = True, row: str = "row_id") -> DataFrame:
    """Each row n times: a, a, b, b (interleaved) or a, b, a, b. `rows`: how many there are."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.col(row) * n + F.col("_k") if interleave else F.col("_k") * rows + F.col(row)
    return out.withColumn("place", place).drop("_k")


def repeat_by(df: DataFrame, count: Column, row: str = "row_id") -> DataFrame:
    """Each row as often as `count` says, none for 0."""
    return df.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))


def reorder(df: DataFrame, permutation: DataFrame, row: str = "row_id") -> DataFrame:
    """permutation: (place, row_id); the frame with the place each row goes to."""
    return df.join(permutation, row)


def inverse(permutation: DataFrame, row: str = "row_id") -> DataFrame:
    return permutation.select(F.col("place").alias(row), F.col(row).alias("place"))


def take(df: DataFrame, rows: DataFrame, row: str = "row_id") -> DataFrame:
    return df.join(rows, row, "left_semi")


def stride(df: DataFrame, start: int, stop: int, step: int, row: str = "row_id") -> DataFrame:
    r = F.col(row)
    return df.where((r >= start) & (r < stop) & ((r - start) % step == 0))


def unfold(df: DataFrame, column: str, width: int) -> DataFrame:
    """Each array of width k values becomes one row for each run of `width`; other columns repeat."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(column), F.lit(1)), F.lit(width))
    parts = F.transform(starts, lambda s: F.slice(column, s, width))
    return df.select(*[c for c in df.columns if c != column], F.posexplode(parts).alias("part", column))


def fold(df: DataFrame, column: str, group: int, row: str = "row_id") -> DataFrame:
    """Runs of `group` rows become one, with an array of the column in row order."""
    seen = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(column).alias("v"))))
    return df.groupBy(F.floor(F.col(row) / group).alias(row)).agg(F.transform(seen, lambda x: x["v"]).alias(column))


def epochs(df: DataFrame, batch: int, n: int, times: int, seed: int, key: str = "row_id") -> DataFrame:
    """(epoch, batch_id) of each row: each epoch shuffles by a hash of its own; the last short batch is dropped."""
    out: DataFrame | None = None
    for epoch in range(times):
        mixed = df.withColumn("_mark", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"))))
        one = placed(mixed, ["_mark", key]).select(*df.columns, F.lit(epoch).alias("epoch"), F.floor(F.col("_place") / batch).alias("batch_id"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("batch_id") < n // batch)
