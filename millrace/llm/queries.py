"""The queries opN_<name>: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import fertility, importance, langmix, licenses, mixing, mtree, packing, secrets, simhash, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(C.tables(spark, sf_dir, "documents"), words_each=3, radius=2, keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(C.tables(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, most=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(C.tables(spark, sf_dir, "documents"), keep=["doc_id"]).drop("blocks")


@query
def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(C.tables(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"], second=vocabulary("word_bpe_49k.json"))


@query
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.tables(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = langmix.train(docs.where(~held & F.col("lang").isNotNull()))
    return langmix.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(C.tables(spark, sf_dir, "documents"), keep=["doc_id"], vocabulary=vocabulary("word_bpe_49k.json")).drop("found")


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(C.tables(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", "taken", "draws")


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.tables(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(C.tables(spark, sf_dir, "documents"), length=400, with_kept=False)


@query
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(C.tables(spark, sf_dir, "documents"), C.tables(spark, sf_dir, "labels"), keep=["doc_id"])
