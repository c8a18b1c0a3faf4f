"""Language identification by inference of each document's mixture of languages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Hash buckets of the character n-grams (of three characters), a power of two.
BUCKETS = 1 << 15
#: Languages that a model may hold: BUCKETS times as many counts go to the driver and to each task.
MOST_LANGUAGES = 512
#: Characters worked on at a time.
CHUNK = 1 << 20
_ALPHA: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log probability of each bucket in each language: BUCKETS x languages.
    log_p: np.ndarray


def letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text in lower case, with a space for each other character; None if no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    alpha, out = letters(), None
    if not alpha[points].any():
        return None
    for at in range(0, len(points), CHUNK):
        part = points[max(0, at - 2) : at + CHUNK]
        part = part * alpha[part]
        mixed = part[2:] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[:-2] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        mixed >>= np.uint32(33 - BUCKETS.bit_length())
        found = np.bincount(mixed, minlength=BUCKETS)
        out = found if out is None else out + found
    return out


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.5) -> Model:
    """n-gram counts of every document with a language: one row for each language and bucket reaches the driver.

    Languages are counted first; more than MOST_LANGUAGES are an error before anything is collected. Null texts and texts without a
    letter add nothing, repeated rows count each, rows without a language are left out, and an empty table gives a
    model without languages. Other columns are not read.
    """
    spoken = docs.where(C.quoted(lang_col).isNotNull()).select(C.quoted(lang_col).cast("string")).distinct().limit(MOST_LANGUAGES + 1).count()
    if spoken > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: a model holds no more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), C.texts(batch.column(1)), strict=True):
                if (found := grams(text or "")) is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += found
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(C.quoted(lang_col).isNotNull()).select(C.quoted(lang_col).cast("string"), C.quoted(text_col)).mapInArrow(run, "lang string, bucket int, n long")
    packed = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(packed["lang"].unique()))
    counts = np.full((BUCKETS, len(languages)), smooth)
    for k, lang in enumerate(languages):
        own = packed[packed["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(0)))


def em(counts: np.ndarray, p: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the mixture after some rounds, and the log likelihood (relative to p's scaling)."""
    share, total = start, counts.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * ((counts / mixed) @ p) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def predictor(model: Model, penalty: float = 3.0, rounds: int = 12) -> Callable[[str], tuple]:
    """The languages of a text: expectation-maximisation over all of them, then over nested sets, largest share first.

    A set with k languages costs penalty * (k - 1) * log(n-grams); the set with the best penalised likelihood is taken.
    """

    scaled = np.exp(model.log_p - model.log_p.max(1, keepdims=True)) if model.languages else model.log_p

    def predict(text: str) -> tuple:
        found = grams(text)
        if found is None or not model.languages:
            return "und", 0.0, []
        at = np.flatnonzero(found)
        counts, log_p, p = found[at].astype(float), model.log_p[at], scaled[at]
        k = len(model.languages)
        share, _ = em(counts, p, np.full(k, 1 / k), rounds)
        order = np.argsort(-share, kind="stable")
        best, chosen = -np.inf, None
        for size in range(1, k + 1):
            own = order[:size]
            if size > 1 and share[own[-1]] < 1e-3:
                break
            if size == 1:
                fit, value = np.ones(1), float(counts @ np.log(np.maximum(p[:, own[0]], 1e-300)))
            else:
                fit, value = em(counts, p[:, own], share[own] / share[own].sum(), rounds)
            value -= penalty * (size - 1) * np.log(counts.sum() + 1)
            if value <= best:
                break
            best, chosen = value, (own, fit)
        own, fit = chosen
        ranked = sorted(zip(fit.tolist(), (model.languages[i] for i in own), strict=True), key=lambda x: (-x[0], x[1]))
        # how sure: the leading language's share, times its probability against the runner-up on the whole text
        single = counts @ log_p
        edge = np.sort(single)[::-1]
        sure = 1.0 if k == 1 else 1 / (1 + np.exp(-min(50.0, max(-50.0, (edge[0] - edge[1]) / 10))))
        return ranked[0][1], min(1.0, max(0.0, float(ranked[0][0] * sure))), [{"lang": name, "share": x} for x, name in ranked]

    return predict


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and mixture (the chosen languages with their shares, largest first).

    A null text, or one without a letter, is `und` with score 0 and no mixture, as is any if the model is empty.
    Columns of `docs` with the new names are replaced; repeated rows are judged one by one.
    """
    fields = [C.field("lang_pred", "string"), C.field("score", "double"), C.field("mixture", C.structs(lang="string", share="double"))]
    return C.map_text(docs, lambda: predictor(model), fields, text_col, keep)
