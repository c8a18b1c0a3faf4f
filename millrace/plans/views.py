"""Fixture views over the driver's tables, once as DataFrames and once as SQL common tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAGGED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat('<Parallel><Path>', lang, ' one two</Path><Path>', source, '</Path></Parallel><Summary>s</Summary> ', text) WHEN 2 THEN concat('<Parallel><Path>', lang, '</Path></Parallel><Summary>s</Summary> ', text) ELSE concat('<Parallel><Path>a b c</Path><Path>', source, ' d</Path></Parallel> ', text) END"
ANSWERED = "concat(text, ' Final Answer: ', CAST(CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars + 1 ELSE n_chars END AS VARCHAR), CASE doc_id % 5 WHEN 0 THEN '.' WHEN 1 THEN ',000' ELSE '' END)"

VIEWS = {
    "rollouts": """SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx,
        o_orderpriority AS data_source, l_returnflag AS pred, l_linestatus = 'O' AS acc, sqrt(l_extendedprice * (1 - l_discount)) AS score, l_quantity AS len
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "tokens": """SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t,
        l_discount + 0.0 AS reward, l_tax + 0.0 AS value, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, l_quantity / 100 AS logp, l_tax * 3 - l_discount AS ref FROM lineitem""",
    "answers": f"SELECT doc_id, lang, source, n_chars, text, {ANSWERED} AS response, {TAGGED} AS tagged, CAST(n_chars AS VARCHAR) AS truth FROM documents",
    "prompts": """SELECT o_orderkey AS id, concat('Customer ', c_name, ' asks: what is ', CAST(o_orderkey % 97 AS VARCHAR), ' plus ', CAST(o_custkey % 89 AS VARCHAR), '?') AS question,
        concat('We add.\n#### ', CAST(1000 + o_orderkey % 97 + o_custkey % 89 AS VARCHAR), CASE WHEN o_orderkey % 7 = 0 THEN ',000' ELSE '' END) AS answer, o_orderpriority AS ability, c_mktsegment AS data_source, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey""",
}


def with_views(sql: str) -> str:
    """The SQL after the common tables of the views that it names."""
    used = {n: v for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)}
    if not used:
        return sql
    head = ", ".join(f"{n} AS ({v})" for n, v in used.items())
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.strip().startswith(start):
            return f"{start}{head}, {sql.strip()[len(start) :]}"
    return f"WITH {head} {sql}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line() -> Window:
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of prompts: an order is a prompt, a line one of its samples."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    rows = lines.join(orders.select("o_orderkey", "o_orderpriority"), lines.l_orderkey == orders.o_orderkey)
    return rows.select(
        F.col("l_orderkey").alias("uid"), F.row_number().over(_line()).alias("idx"), F.col("o_orderpriority").alias("data_source"), F.col("l_returnflag").alias("pred"),
        (F.col("l_linestatus") == "O").alias("acc"), F.sqrt(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"), F.col("l_quantity").alias("len"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-level measures: an order is a response, a line one of its tokens."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.row_number().over(_line()).alias("t"), (F.col("l_discount") + 0.0).alias("reward"), (F.col("l_tax") + 0.0).alias("value"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"), (F.col("l_quantity") / 100).alias("logp"), (F.col("l_tax") * 3 - F.col("l_discount")).alias("ref"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses that end in a final answer, and as text with path tags, well formed or not."""
    docs = read(spark, sf_dir, "documents")
    spark_sql = {k: v.replace("VARCHAR", "STRING") for k, v in (("response", ANSWERED), ("tagged", TAGGED))}
    return docs.select("doc_id", "lang", "source", "n_chars", "text", F.expr(spark_sql["response"]).alias("response"), F.expr(spark_sql["tagged"]).alias("tagged"), F.col("n_chars").cast("string").alias("truth"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions with worked answers."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = orders.join(customer.select("c_custkey", "c_name", "c_mktsegment"), orders.o_custkey == customer.c_custkey)
    a, b = F.col("o_orderkey") % 97, F.col("o_custkey") % 89
    return rows.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Customer "), "c_name", F.lit(" asks: what is "), a.cast("string"), F.lit(" plus "), b.cast("string"), F.lit("?")).alias("question"),
        F.concat(F.lit("We add.\n#### "), (1000 + a + b).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ",000").otherwise("")).alias("answer"), F.col("o_orderpriority").alias("ability"), F.col("c_mktsegment").alias("data_source"), F.col("o_orderstatus").alias("status"),
    )
