"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Hash buckets of each of the two models, and buckets that travel together.
BUCKETS, SEGMENT = 1 << 18, 1 << 12
#: Labelled documents that a model is fitted on at most: half for the target, half to find the cut.
LABELLED = 50_000
#: Expected count that a bucket must exceed to weigh in; scales of the two ratios.
PRIOR, WORD_SCALE, RUN_SCALE = 3.0, 30.0, 1000.0
#: A run of letters speaks against a text below this log ratio; distinct runs of a text of usual size.
AGAINST, USUAL_RUNS = -0.7, 1000.0
#: Both ratios of a document without a word.
NOTHING = -1000.0
#: Bins of keys that are counted at a time, and how often a bin is cut into as many.
BINS, LEVELS = 2048, 4
#: Columns of counts on their way.
SUMS = "segment int, part int, sums binary"


def word_grams(text: str) -> np.ndarray:
    """Buckets of a text's words and pairs of words, in ASCII lower case."""
    words = text.encode().lower().split()
    one = np.fromiter(map(crc32, words), np.uint32, len(words))
    two = (one[:-1] * np.uint32(0x9E3779B1)) ^ (one[1:] + np.uint32(0x7F4A7C15))
    both = np.concatenate([one, two]) * np.uint32(0x85EBCA6B)
    return (both ^ (both >> np.uint32(15))) % np.uint32(BUCKETS)


def letter_grams(text: str) -> np.ndarray:
    """Buckets of a text's runs of four bytes, in ASCII lower case, with white space as blanks around and between."""
    raw = np.frombuffer(b" " + b" ".join(text.encode().lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return raw[:0]
    code = (raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24) * np.uint32(0x9E3779B1)
    return (code ^ (code >> np.uint32(15))) % np.uint32(BUCKETS)


@dataclass(frozen=True)
class Model:
    """log(target / raw) of each bucket: of words and pairs, and of runs of letters."""

    words: np.ndarray
    letters: np.ndarray

    def ratios(self, text: str) -> tuple[float, float]:
        """Log likelihood ratios, made equal in length: the mean of words and pairs, and the sum of the distinct runs that speak against the text.

        The one sees a text that is unlike the target throughout, the other a few words that the target never has.
        Chance adds to that sum with the square root of the runs in a short text and in proportion to them in a long one.
        """
        grams = word_grams(text)
        if not len(grams):
            return NOTHING, NOTHING
        runs = letter_grams(text)
        seen = np.zeros(BUCKETS, bool)
        seen[runs] = True
        size = max(1, int(np.count_nonzero(seen)))
        against = self.letters[np.unique(runs[self.letters[runs] < AGAINST])]
        return float(self.words[grams].mean()), float(against.sum(dtype=np.float64) / max((USUAL_RUNS * size) ** 0.5, size))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Both counts as one corpus size, each with the prior of the raw model: buckets with little evidence weigh little."""
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32)


def labelled_sample(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """(_id, _good, _toxic, _clean, _fits): at most `most` labelled ids in hash order; `_fits` marks the half that makes the target model."""
    ids = labels.where(C.quoted(id_col).isNotNull()).groupBy(C.quoted(id_col).alias("_id")).agg((F.min("quality") == 1).alias("_good"), (F.max("toxic") == 1).alias("_toxic"))
    mark = F.xxhash64(F.lit(11), "_id")
    return ids.where(F.col("_good").isNotNull() & F.col("_toxic").isNotNull()).withColumn("_clean", F.col("_good") & ~F.col("_toxic")).orderBy(mark, "_id").limit(most).withColumn("_fits", F.pmod(mark, F.lit(2)) == 0)


def counted(rows: DataFrame) -> DataFrame:
    """(segment, part, sums): each task's n-gram counts of rows (_text, _target), in segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, BUCKETS), np.int64)  # raw and target words, raw and target letters
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for text, target in zip(C.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for k, grams in ((0, word_grams(text or "")), (2, letter_grams(text or ""))):
                    found[k].append(grams)
                    held += len(grams)
                    if target:
                        found[k + 1].append(grams)
                if held > 1_000_000:
                    for k in range(4):
                        sums[k] += np.bincount(np.concatenate([*found[k], np.zeros(0, np.uint32)]), minlength=BUCKETS)
                    found, held = [[], [], [], []], 0
            for k in range(4):
                sums[k] += np.bincount(np.concatenate([*found[k], np.zeros(0, np.uint32)]), minlength=BUCKETS)
        part = TaskContext.get().partitionId() % 64  # a task that is run again sends its counts to the same reducer
        flat = sums.ravel()
        at = range(0, len(flat), SEGMENT)
        yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT for i in at], pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array([flat[i : i + SEGMENT].astype("<i8").tobytes() for i in at], pa.binary())], names=["segment", "part", "sums"])

    return rows.mapInArrow(run, SUMS)


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """n-gram counts of all documents (raw) and of the sample's clean half (target). `sample` is bounded, so it is broadcast."""
    rows = docs.select(C.quoted(id_col).alias("_id"), C.quoted(text_col).alias("_text")).join(F.broadcast(sample), "_id", "left").select("_text", F.coalesce(F.col("_clean") & F.col("_fits"), F.lit(False)).alias("_target"))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.int64)
        for x in table["sums"].to_pylist():
            total += np.frombuffer(x, "<i8")
        return pa.table({"segment": table["segment"][:1], "part": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    added = counted(rows).groupBy("segment", "part").applyInArrow(add, SUMS).groupBy("segment").applyInArrow(add, SUMS)
    sums = np.zeros((4, BUCKETS), np.int64)  # 8 MB whatever the input
    for r in added.toLocalIterator():
        sums.reshape(-1, SEGMENT)[r.segment] = np.frombuffer(bytes(r.sums), "<i8")
    return Model(log_ratio(sums[1], sums[0]), log_ratio(sums[3], sums[2]))


def cut_of(values: list[tuple[float, bool, bool]], loss: float = 5.0) -> float:
    """The value under which most bad and fewest clean documents lie, of (value, clean, bad); a lost clean one counts `loss` times."""
    clean, bad = np.sort([v for v, c, _ in values if c]), np.sort([v for v, _, b in values if b])
    if not len(clean) or not len(bad):
        return float("-inf")
    cuts = np.unique(np.concatenate([clean, bad]))
    cost = loss * np.searchsorted(clean, cuts, "left") / len(clean) + 1 - np.searchsorted(bad, cuts, "left") / len(bad)
    at = int(np.argmin(cost))
    return float((cuts[at] + cuts[at - 1]) / 2) if at else float(cuts[0])


def gumbel(*parts: Column) -> Column:
    u = (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> Column | None:
    """A condition on (key, mark) that holds for exactly k of the rows, those with the largest keys; equal rows count alike.

    BINS bins of keys are counted, finer LEVELS times inside the bin of the cut, and the rows of the last bin are
    counted by key and mark, so that equal rows are one. None: no row. `keys` must not hold more than a few columns;
    it is read once for each level, for its ends, and for the last bin.
    """
    if k <= 0:
        return F.lit(False)
    ends = keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    if ends["low"] is None:
        return None
    inside, left, low, width = keys, k, ends["low"], (ends["high"] - ends["low"]) / BINS
    for _ in range(LEVELS if width > 0 else 0):
        at = F.floor((F.col("key") - F.lit(low)) / F.lit(width))
        order = Window.orderBy(F.col("bin").desc())
        bins = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("sum", F.sum("n").over(order))
        reached = bins.where(F.col("sum") >= left).orderBy(F.col("bin").desc()).first()
        if reached is None:
            return None
        inside, left, low, width = inside.where(at == reached["bin"]), left - (reached["sum"] - reached["n"]), low + reached["bin"] * width, width / BINS
    order = Window.orderBy(F.col("key").desc(), F.col("mark"))
    rows = inside.groupBy("key", "mark").agg(F.count("*").alias("n"))
    last = rows.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") >= left).orderBy(F.col("key").desc(), F.col("mark")).first()
    return None if last is None else (F.col("key") > last["key"]) | ((F.col("key") == last["key"]) & (F.col("mark") <= last["mark"]))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 0.1, seed: int = 5, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs with log_weight, key and kept: a sample without return of the documents like the target.

    The target is the clean labelled text (quality 1, toxic 0) of half of a bounded sample of `labels`; raw is all
    documents. On the other half, one cut is set between clean and low quality on the ratio of words, and one between
    clean and toxic on the ratio of letters; log_weight is the lesser of the two ratios above their cuts. key =
    log_weight / temperature + Gumbel noise of a hash, and the k largest keys are kept: k is `share` of all rows, or
    (None) as many as weigh 0 or more. At a low temperature that keeps clean documents and mixes only those
    near the cut. A null or empty text has NOTHING as its ratios; repeated rows are sampled alike, all or none; a
    cut without labels of its two kinds rejects nothing. Columns of `docs` with the new names are replaced. Empty
    in, empty out.
    """
    C.with_checkpoints(docs.sparkSession)
    sample = labelled_sample(labels, id_col, labelled).checkpoint()
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, id_col, text_col))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("log_weight", "key", "kept")]
    mark = F.xxhash64(F.lit(seed), C.quoted(id_col).cast("string"), C.quoted(text_col))
    marked = docs.select(*[C.quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], C.quoted(id_col).alias("_id"), mark.alias("mark"), C.quoted(text_col).alias("_text"))
    columns, narrow = [f"k{i}" for i in range(len(keep))], text_col not in keep

    def make() -> Callable[[str], tuple]:
        return model.value.ratios

    def rated(names: list[str]) -> DataFrame:
        return C.map_text(marked, make, [C.field("words", "double"), C.field("letters", "double")], "_text", names)

    ratios = rated([*columns, "_id", "mark"] if narrow else ["_id", "mark"]).checkpoint()
    held = ratios.join(F.broadcast(sample.where(~F.col("_fits"))), "_id").select("words", "letters", "_clean", "_good", "_toxic").collect()  # about `labelled` / 2 ids
    cuts = cut_of([(r[0], r[2], not r[3]) for r in held]), cut_of([(r[1], r[2], r[4]) for r in held])

    def keyed(rows: DataFrame) -> DataFrame:
        over = [(F.col(c) - F.lit(cut)) * F.lit(scale) for c, cut, scale in zip(("words", "letters"), cuts, (WORD_SCALE, RUN_SCALE), strict=True) if cut > float("-inf")]
        weight = F.least(*over) if len(over) > 1 else over[0] if over else F.lit(0.0)
        return rows.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") / F.lit(temperature) + gumbel(F.lit(seed), F.col("mark")))

    scored = keyed(ratios)
    n = scored.count()
    k = scored.where("log_weight >= 0").count() if share is None else round(share * n)
    taken = kth_largest(scored.select("key", "mark"), k) if k < n else F.lit(True)
    out = scored if narrow else keyed(rated([*columns, "mark"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "log_weight", "key", (taken if taken is not None else F.lit(False)).alias("kept"))
