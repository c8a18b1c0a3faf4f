"""Queries on batch algebra, balancing and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.operators import balance as L
from millrace.operators import batch as B
from millrace.operators import retrieval as R
from millrace.plans import views as V
from millrace.sources.io import placed, ranked_in

ROWS = "(SELECT o_orderkey AS row_id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders)"
N = "(SELECT count(*) FROM orders)"


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of orders; keys run from 0, so a row's place is its key."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@register(f"SELECT row_id, cust, status AS state FROM {ROWS}")
def batch_select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rename(B.pop_columns(batch(spark, sf_dir), ["cust", "status"])[0], {"status": "state"})


@register(f"SELECT a.row_id, a.cust, a.status, a.price FROM {ROWS} a JOIN {ROWS} b USING (row_id)")
def batch_union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    return B.union_columns(b.select("row_id", "cust", "status"), b.select("row_id", "status", "price"))


@register(f"SELECT row_id, CAST(floor(row_id / ceil({N} / 7)) AS BIGINT) AS chunk FROM {ROWS}")
def batch_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    return B.chunk(b, 7, b.count(), padded=True).select("row_id", "chunk")


@register(f"SELECT row_id, CAST(floor(row_id / 64) AS BIGINT) AS chunk FROM {ROWS} WHERE floor(row_id / 64) < floor({N} / 64)")
def batch_split_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    return B.split(b, 64).where(F.col("chunk") < b.count() // 64).select("row_id", "chunk")


@register(f"SELECT row_id, cust, FALSE AS is_pad FROM {ROWS} UNION ALL SELECT row_id + {N}, cust, TRUE FROM {ROWS} WHERE row_id < (64 - {N} % 64) % 64")
def batch_pad_to_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir).select("row_id", "cust")
    return B.pad_to_divisor(b, 64, b.count())


@register(f"SELECT row_id, cust FROM {ROWS}")
def batch_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir).select("row_id", "cust")
    return B.unpad(B.pad_to_divisor(b, 64, b.count()))


@register(f"SELECT row_id, row_id * 3 + k AS place FROM {ROWS}, range(3) r(k)")
def batch_repeat_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.repeat(batch(spark, sf_dir), 3, F.lit(0)).select("row_id", "place")


@register(f"SELECT row_id, row_id + k * {N} AS place FROM {ROWS}, range(3) r(k)")
def batch_repeat_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    return B.repeat(b, 3, F.lit(b.count()), interleave=False).select("row_id", "place")


@register(f"SELECT row_id, k AS copy FROM {ROWS}, range(4) r(k) WHERE k < cust % 4")
def batch_repeat_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.repeat_by(batch(spark, sf_dir), F.col("cust") % 4).select("row_id", "copy")


@register(f"SELECT row_id, cust, {N} - 1 - row_id AS place FROM {ROWS}")
def batch_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reordered there and back and there again: a permutation and its inverse cancel."""
    b = batch(spark, sf_dir).select("row_id", "cust")
    p = b.select("row_id", (F.lit(b.count() - 1) - F.col("row_id")).alias("place"))
    there = B.reorder(b, p).select(F.col("place").alias("row_id"), "cust")
    back = B.reorder(there, B.inverse(p)).select(F.col("place").alias("row_id"), "cust")
    return B.reorder(back, p)


@register(f"SELECT row_id, cust FROM {ROWS} WHERE row_id IN (SELECT doc_id FROM labels) AND row_id >= 3 AND row_id < {N} - 9 AND (row_id - 3) % 2 = 0")
def batch_take_and_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    b = batch(spark, sf_dir)
    return B.stride(B.take(b, rows), 3, b.count() - 9, 2).select("row_id", "cust")


@register("SELECT vec_id, CAST(k AS INT) AS part, round(list_sum(embedding[k * 16 + 1 : k * 16 + 16])::DOUBLE, 4) + 0.0 AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), range(4) r(k)")
def batch_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return B.unfold(e, "v", 16).select("vec_id", "part", (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("s"))


@register(f"SELECT CAST(floor(row_id / 5) AS BIGINT) AS row_id, array_to_string(list(cust ORDER BY row_id), ',') AS cust FROM {ROWS} GROUP BY 1")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold(batch(spark, sf_dir), "cust", 5).select("row_id", F.array_join(F.col("cust").cast("array<string>"), ",").alias("cust"))


@register(f"""SELECT row_id, epoch, batch_id FROM (SELECT row_id, CAST(e AS INT) AS epoch, CAST(floor((row_number() OVER (PARTITION BY e ORDER BY md5(concat('7:', e, ':', row_id)), row_id) - 1) / 100) AS BIGINT) AS batch_id FROM {ROWS}, range(2) r(e)) WHERE batch_id < floor({N} / 100)""")
def batch_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch(spark, sf_dir)
    return B.epochs(b, 100, b.count(), 2, 7).select("row_id", "epoch", "batch_id")


@register("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@register(f"SELECT row_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('s', row_id)), row_id) <= floor({N} * 0.8) THEN 'train' ELSE 'test' END AS split FROM {ROWS}")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a hash, cut at an exact number of rows."""
    rows = batch(spark, sf_dir).select("row_id", F.md5(F.concat(F.lit("s"), F.col("row_id").cast("string"))).alias("h"))
    return placed(rows, ["h", "row_id"]).select("row_id", F.when(F.col("_place") < F.floor(F.col("_all") * 0.8), "train").otherwise("test").alias("split"))


@register("SELECT doc_id, source FROM documents ORDER BY md5(concat('42', text)), doc_id LIMIT 20")
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.lit("42"), "text")), "doc_id").limit(20).select("doc_id", "source")


@register("SELECT uid, idx, round(score, 6) + 0.0 AS score FROM rollouts ORDER BY coalesce(score, 0) DESC, uid, idx LIMIT 100")
def top_scored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rollouts(spark, sf_dir).orderBy(F.coalesce("score", F.lit(0)).desc(), "uid", "idx").limit(100).select("uid", "idx", r6("score").alias("score"))


@register("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INT) AS place FROM documents")
def curriculum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranked_in(table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id"), "source", ["n_chars", "doc_id"], "place")
    return docs.select("doc_id", (F.col("place") + 1).cast("int").alias("place"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of 512 by id: what one balancing step sees, whatever a source's share of the rows."""
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 512).alias("batch"), "doc_id", "n_chars")


@register()
def length_balanced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's documents over eight parts of about equal length, by largest differencing."""
    return L.balanced(steps(spark, sf_dir), "batch", "doc_id", "n_chars", 8)


@register()
def greedy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.balanced(steps(spark, sf_dir), "batch", "doc_id", "n_chars", 8, "greedy")


@register()
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dynamic_batches(steps(spark, sf_dir), "batch", "doc_id", "n_chars", 200_000)


@register("""WITH b AS (SELECT source, doc_id, n_chars, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5) AS blk FROM documents), s AS (SELECT source, blk, sum(n_chars) AS s FROM b GROUP BY ALL)
    SELECT source, CAST(max(s) AS BIGINT) AS high, CAST(min(s) AS BIGINT) AS low, CAST(max(s) - min(s) AS BIGINT) AS gap, round(avg(s), 6) + 0.0 AS mean FROM s GROUP BY source""")
def imbalance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranked_in(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "place")
    s = docs.select("source", "n_chars", F.floor(F.col("place") / 5).alias("blk")).groupBy("source", "blk").agg(F.sum("n_chars").alias("s"))
    return s.groupBy("source").agg(F.max("s").alias("high"), F.min("s").alias("low"), (F.max("s") - F.min("s")).alias("gap"), r6(F.avg("s")).alias("mean"))


@register("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS cid, list_sum(list_transform(range(1, 65), lambda i: qv[i] * c.embedding[i]::DOUBLE)) AS score FROM q, embeddings c)
    SELECT qid, cid, round(score, 6) + 0.0 AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM s) WHERE rank <= 5""")
def dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = R.top_k_dense(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "cid"), 5, vector="embedding")
    return found.select("qid", "cid", r6("score").alias("score"), "rank")


BM25 = r"""q AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS term FROM benchmark WHERE item_id % 100 = 0),
    w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents), sz AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
    x AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT qid, doc_id AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / mean))) AS score FROM q JOIN tf USING (term) JOIN d USING (term), sz GROUP BY ALL),
    h AS (SELECT qid, doc, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS INT) AS rank FROM s QUALIFY rank <= 5)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return R.bm25(table(spark, sf_dir, "documents"), q, 5)


@register(f"WITH {BM25} SELECT qid, doc, round(score, 5) + 0.0 AS score, rank FROM h")
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("qid", "doc", (F.round("score", 5) + 0.0).alias("score"), "rank")


@register(f"WITH {BM25} SELECT qid, md5(array_to_string(list(concat('Doc ', rank, ' (Title: ', source, ')', chr(10), text) ORDER BY rank), concat(chr(10), '---', chr(10)))) AS passages FROM h JOIN documents ON doc = doc_id GROUP BY qid")
def formatted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.col("text").alias("body"))
    return R.formatted_hits(hits(spark, sf_dir), docs).select("qid", F.md5("passages").alias("passages"))
