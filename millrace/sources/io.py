"""Readers and writers: parquet lists, split slices, JSON lines, dumps by step, templates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
#: The five-field record of a prompt.
PROMPT = T.StructType([
    T.StructField("data_source", T.StringType()), T.StructField("prompt", MESSAGES), T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType())])),
    T.StructField("extra_info", T.StructType([T.StructField(n, T.LongType() if n == "index" else T.StringType()) for n in ("split", "index", "answer", "question", "reward_method")])),
])


def read_parquet(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files in one frame, columns by name; `file_no` tells their order in the list."""
    reader = spark.read.schema(schema) if schema else spark.read
    out: DataFrame | None = None
    for i, path in enumerate(paths):
        part = reader.parquet(path).withColumn("file_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path")
    return out


#: Rows that a range should hold, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096


def placed(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """df with _place, a row's number from 0 in the order of a unique key, and _all, the number of rows.

    The place of a row is its place in a range of the key plus the rows of the ranges before, so that no task sorts all
    rows; there are as many ranges as the rows ask for, and at least one a shuffle partition. Their bounds come from a sample
    of bounded size in hash order: they are values, the same wherever used. A row finds its range by halving.
    """
    keys = df.select(*order)
    if ranges is None:
        ranges = min(MOST_RANGES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE_ROWS)))
    sample = sorted(tuple(r) for r in keys.dropna().orderBy(F.xxhash64(*order)).limit(ranges * 20).collect())
    cuts = sample[:: max(1, len(sample) // ranges)]
    own = F.struct(*order)
    bounds = F.array(*[F.struct(*[F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in zip(order, cut, strict=True)]) for cut in cuts]) if cuts else F.array(own)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.try_element_at(bounds, middle + 1) <= own
        return F.when(s["lo"] >= s["hi"], s).when(above, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    ranged = df.withColumn("_range", F.aggregate(steps, start, halve)["lo"])
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_range").select(*df.columns, place.alias("_place"), "_all")  # before: one row a range


def ranked_in(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with a row's number from 0 in its key's order; a key with most rows is sorted in ranges like any."""
    rows = placed(df, [key, *order])
    firsts = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"))
    return rows.join(firsts, rows[key].eqNullSafe(F.col("_key"))).select(*df.columns, (F.col("_place") - F.col("_first")).alias(name))


#: Rows of a run in which a running maximum is taken; then it is taken over the runs.
RUN = 1 << 16


def ranked_in_runs(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with a row's number from 0 among the rows before it, in its key's order, that have its value one after another.

    Rows are placed in ranges, meet the one before by its place, and find where their run of values starts by a
    maximum inside blocks of places and one over the blocks: no key is one task's.
    """
    rows = placed(df.select(key, *order, value), [key, *order]).drop("_all")
    before = rows.select((F.col("_place") + 1).alias("_place"), F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_met"))
    same = F.coalesce((F.col("_key").eqNullSafe(F.col(key))) & (F.col("_value") == F.col(value)) & F.col("_met"), F.lit(False))
    rows = rows.join(before, "_place", "left").withColumns({"_start": F.when(~same, F.col("_place")), "_block": F.floor(F.col("_place") / RUN)})
    inside = F.max("_start").over(Window.partitionBy("_block").orderBy("_place"))
    blocks = rows.groupBy("_block").agg(F.max("_start").alias("_last"))
    earlier = F.max("_last").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", inside).join(blocks.select("_block", earlier.alias("_earlier")), "_block")
    return rows.select(key, *order, value, (F.col("_place") - F.coalesce("_inside", "_earlier")).alias(name))


def split_slice(df: DataFrame, start: float, stop: float, order: list[str]) -> DataFrame:
    """Rows from the share `start` to `stop` of the table in the order of a unique key, like train[:75%]."""
    rows = placed(df, order)
    inside = (F.col("_place") >= F.floor(F.col("_all") * start)) & (F.col("_place") < F.floor(F.col("_all") * stop))
    return rows.where(inside).select(*df.columns)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a stated schema; a line that does not fit gives nulls and stands in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, body) of documents whose `contents` is a title line and then the text."""
    rows = read_json_lines(spark, path, "id string, contents string")
    return rows.select("id", *title_and_body(F.col("contents")))


def title_and_body(contents: Column) -> tuple[Column, Column]:
    first = F.substring_index(contents, "\n", 1)
    return F.trim(F.replace(first, F.lit('"'), F.lit(""))).alias("title"), F.when(F.instr(contents, "\n") > 0, F.substring(contents, F.length(first) + 2, F.length(contents))).otherwise("").alias("body")


def write_dump(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines in a folder for each step; writing a step again replaces it alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def read_dump(spark: SparkSession, path: str, schema: T.StructType | str, mask: str | None = None) -> DataFrame:
    """Dumped rows with their step; text that matches `mask` becomes `*`."""
    rows = spark.read.schema(schema).json(path)
    if mask is None:
        return rows
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.regexp_replace(c, mask, "*") for c in texts})


def dumped_rows(spark: SparkSession, path: str, schema: T.StructType | str, order: str, mask: str | None = None, step: str = "step") -> DataFrame:
    """A dump as it is viewed: text masked, and row_no, a row's number in its step, which the schema states as a whole number."""
    rows = read_dump(spark, path, schema, mask)
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy(step).orderBy(order)) - 1)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; in local mode only, a temporary one where none is named."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_records(df: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def template(path: str) -> Column:
    """A text file as a literal, read once by the driver; for prompt templates, which are short."""
    with open(path, encoding="utf-8") as f:
        text = f.read(1 << 20)
    return F.lit(text)


def filled(form: Column, problem: Column) -> Column:
    return F.replace(form, F.lit("{Problem}"), problem)


def flattened(df: DataFrame, prefix: str = "", sep: str = "/") -> DataFrame:
    """(name, value) of every numeric leaf of nested structs, names joined by `sep`."""

    def leaves(schema: T.StructType, path: str, at: str) -> list[tuple[str, str]]:
        out = []
        for f in schema.fields:
            name, place = f"{path}{sep}{f.name}" if path else f.name, f"{at}.`{f.name}`" if at else f"`{f.name}`"
            out += leaves(f.dataType, name, place) if isinstance(f.dataType, T.StructType) else [(name, place)] if isinstance(f.dataType, T.NumericType) else []
        return out

    pairs = [F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in leaves(df.schema, prefix, "")]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
