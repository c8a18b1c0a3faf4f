"""The registered queries themselves, with their production parameters, on the smallest tables; models against plain loops."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fertility, langmix, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

#: The columns that each query must return, with their types; more may follow.
COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_importance_resampling": "doc_id bigint, kept boolean",
    "op5_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_power_of_two_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_tokeniser_fertility": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_language_mixture": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = queries.QUERIES[name](spark, SF)
    have = dict(found.dtypes)
    for column, kind in (c.split() for c in COLUMNS[name].split(", ")):
        assert have[column] == kind
    rows = found.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if name.startswith("op9"):
        vectors = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
        asked = [i for i in vectors if i % 50 == 0]
        assert len(rows) == 5 * len(asked) and {r.query_id for r in rows} == set(asked)
        for q in asked[:4]:
            best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
            assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in best]
    elif name.startswith("op6"):
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in rows)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())


def test_reruns_of_the_mix_agree(spark):
    runs = [sorted(tuple(r) for r in queries.op2_mix_sources(spark, SF).select("doc_id", "taken").collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def test_held_out_accuracy(spark):
    """Predictions on the fold that was not learnt from."""
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 200").collect()}
    found = [r for r in queries.op8_language_mixture(spark, "/root/testdata/sf0.01").where("held_out").collect() if r.doc_id in truth]
    assert len(found) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.95 * len(found)


def test_expectation_maximisation_in_plain_loops():
    rng = random.Random(5)
    counts = [float(rng.randrange(1, 6)) for _ in range(30)]
    p = [[rng.random() + 0.01 for _ in range(3)] for _ in range(30)]
    share = [1 / 3] * 3
    for _ in range(12):
        new = [0.0] * 3
        for c, row in zip(counts, p, strict=True):
            total = sum(s * x for s, x in zip(share, row, strict=True))
            for k in range(3):
                new[k] += c * share[k] * row[k] / total
        new = [x / sum(counts) for x in new]
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-3
        share = new
        if done:
            break
    fit = sum(c * math.log(sum(s * x for s, x in zip(share, row, strict=True))) for c, row in zip(counts, p, strict=True))
    got, value = langmix.em(np.array(counts), np.array(p), np.full(3, 1 / 3), 12)
    assert got.tolist() == pytest.approx(share) and value == pytest.approx(fit)


def test_bands_against_sorted_measures(spark):
    """Whether a document is kept, from quartiles of sorted measures."""
    rows = queries.op7_tokeniser_fertility(spark, SF).collect()

    def quartile(values, q):
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]

    for r in rows:
        own = [x for x in rows if x.band_key == r.band_key and x.n_tokens > 0]
        inside = True
        for m, floor in fertility.LEAST.items():
            low, mid, high = (quartile([x[m] for x in own], q) for q in (0.25, 0.5, 0.75)) if own else (0, 0, 0)
            width = math.sqrt(max(1.0, 256 / max(r.n_tokens, 1))) * fertility.SPREAD[m] * max(high - low, floor)
            inside &= {"chars_per_token": abs(r[m] - mid) <= width, "chars_per_token_2": abs(r[m] - mid) <= width, "byte_share": r[m] <= mid + width, "token_entropy": r[m] >= mid - width}[m]
        assert r.kept == (not r.base_failed and inside), r.doc_id


def test_fertility_measures_against_the_tokenizers(spark):
    """Tokens, byte tokens and entropy of each document, word by word through both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    piece = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    word = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    found = {r.doc_id: r for r in queries.op7_tokeniser_fertility(spark, SF).collect()}
    odd = "İstanbul ΣΑΣ x1,y2 日本 ¡Hola! a\x1cb <|endoftext|> naïve… ##% don't"
    count = fertility.counter(queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("word_bpe_49k.json"))
    assert count(odd.encode().split())[1] == sum(len(word.encode(w.decode(), add_special_tokens=False).ids) for w in odd.encode().split())
    for d in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        words = [w.decode() for w in (d.text or "").encode().split()]
        ids = [i for w in words for i in piece.encode(w)]
        others = sum(len(word.encode(w, add_special_tokens=False).ids) for w in words)
        r = found[d.doc_id]
        share = [ids.count(i) / len(ids) for i in set(ids)]
        assert r.n_tokens == len(ids) and r.token_entropy == pytest.approx(-sum(p * math.log2(p) for p in share))
        assert r.chars_per_token_2 == pytest.approx(sum(map(len, words)) / others if others else 0.0) and r.byte_share == pytest.approx(sum(piece.is_byte(i) for i in ids) / len(ids) if ids else 0.0)


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_suffix_dedup", "op5_simhash_near_dedup", "op7_tokeniser_fertility", "op8_language_mixture", "op10_secret_scan", "op2_mix_sources", "op6_power_of_two_packing"])
def test_very_long_texts(spark, tmp_path, name):
    """A text of some megabytes, one of one letter, and a short one that repeats a part of the first."""
    rng = random.Random(6)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(1 << 20):x}" for _ in range(300_000))
    rows = [(1, long, "en", "web", len(long)), (2, "z" * 1_000_000, "en", "web", 1_000_000), (3, long[1000:2000], "fr", None, 1000), (4, None, None, "web", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path)).where(F.col("doc_id").isNotNull()).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, 4}
    if name.startswith("op3"):
        gone = {r.doc_id: r.n_removed for r in found}
        assert gone == {1: 1000, 2: 1_000_000, 3: 1000, 4: 0}
