"""A corpus pipeline over `documents`: classify, remove near copies, redact secrets, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them one after another, each over what
the one before has written to the shared checkpoint folder. All but the last return the columns of documents, whatever
further ones there are and whatever their names. An empty table passes through; repeated rows count each until the
second stage, which keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import importance, mixing, packing, secrets, simhash
from millrace.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def counted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, of `rows`, with n_chars anew from the text."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*[n_chars if c == "n_chars" else C.quoted(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the clean labelled documents; what it does not keep goes.

    A null or empty text goes where the labels tell anything; documents equal in id and text go or stay together.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of a column can be one of the operator's
    rated = importance.resample(docs.select(*[C.quoted(c).alias(k) for c, k in own.items()]), C.tables(spark, sf_dir, "labels").withColumnRenamed("doc_id", own["doc_id"]), id_col=own["doc_id"], text_col=own["text"])
    return rated.where("kept").select(*[F.col(k).alias(c) for c, k in own.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: wide SimHashes find the candidates, five-word shingles decide (similarity of 0.8 or more).

    It is the one with the smallest id, null ids last. Null, empty and blank texts are one group.
    """
    return simhash.without_near_copies(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, and n_chars follows; a null text stays null, with null n_chars."""
    return counted(secrets.redacted(docs, vocabulary=vocabulary("word_bpe_49k.json")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document, its text cut to the words drawn, by shard and place; texts without words have none."""
    return counted(mixing.mix(docs, names=(C.unused(docs, "shard"), C.unused(docs, "place"))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens, each from one document; a null or empty text is its end token alone."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, most=4096, cached=50_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secret_spans),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: No stage after the first can be told in SQL: n-gram models, XXH64 of shingles and a vocabulary's merges decide.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.with_checkpoints(spark)
    docs = C.tables(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
