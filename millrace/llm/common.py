"""Helpers that the corpus operators share."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoint() has a folder: the cluster's shared one, or, in local mode only, a temporary one.

    Arrow batches are made smaller than Spark's default, as they hold whole texts; a size that was set stays.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-"))
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default, with which a batch of texts takes tens of megabytes on both sides
        spark.conf.set(ARROW_ROWS, "1000")
    return spark


def map_text(
    docs: DataFrame,
    make: Callable[[], Callable[[str], tuple]],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of `docs` with new columns computed from each whole text, in Arrow batches.

    `make` is called once a task and returns the function of a text (null: empty) that gives the new values.
    A column of `docs` whose name is among the new ones (in any case) is replaced; `keep` limits the others.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    at = kept.index(text_col) if text_col in kept else len(kept)
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    source = docs.select(*[quoted(c) for c in kept], *([] if text_col in kept else [quoted(text_col)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, of = to_arrow_schema(schema), make()
        for batch in batches:
            values = [of(x or "") for x in texts(batch.column(at))]
            columns = zip(*values, strict=True) if values else ([] for _ in fields)
            made = [pa.array(list(v), arrow.field(len(kept) + i).type) for i, v in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, schema=arrow)

    return source.mapInArrow(run, schema)


def texts(column: pa.Array, step: int = 512) -> Iterator[str | None]:
    """The values of an Arrow column, a few at a time: a batch's texts are never all Python strings at once."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str):
    return F.col(f"`{name.replace('`', '``')}`")


SIMPLE = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def field(name: str, kind: str | T.DataType) -> T.StructField:
    return T.StructField(name, SIMPLE[kind] if isinstance(kind, str) else kind)


def structs(**kinds: str) -> T.ArrayType:
    """An array of structs with these fields."""
    return T.ArrayType(T.StructType([field(n, k) for n, k in kinds.items()]))


def components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int | None = None) -> DataFrame:
    """(node, component) for each node of the links; component is the smallest node that can be reached.

    Alternates large-star and small-star rounds, so that a long chain needs few of them. Each round ends in a
    checkpoint, which cuts the lineage and survives a lost executor. Links with a null end are left out. Rounds go on
    until the links no longer change; with `most_rounds`, links that still change by then are an error.
    """
    with_checkpoints(links.sparkSession)
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for made in itertools.count():
        if made == most_rounds:
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(ends.select("u"), "u", "left_anti")
    return ends.unionByName(roots.select("u", F.col("u").alias("component"))).withColumnRenamed("u", "node")
