"""Quality rules on tokeniser fertility: what a public vocabulary makes of a text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import word_tokens

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Words kept in each of a worker's two caches of counts.
CACHED_WORDS = 500_000
#: Up to so many bands their table (a narrow row each) is broadcast; a larger one is joined by shuffles, its keys salted.
MOST_BANDS, SALTS = 10_000, 32
#: First bytes of a script's UTF-8 sequences, from and to (exclusive); fixed values of Unicode.
SCRIPTS = (("latin", 0xC3, 0xC9), ("greek", 0xCE, 0xD0), ("cyrillic", 0xD0, 0xD4), ("hebrew", 0xD6, 0xD8), ("arabic", 0xD8, 0xDC), ("indic", 0xE0, 0xE1), ("kana", 0xE3, 0xE4), ("han", 0xE4, 0xEA), ("hangul", 0xEA, 0xEE))
MEASURES = ("chars_per_token", "chars_per_token_2", "byte_share", "token_entropy")
#: Interquartile ranges from the median to a band's end, and the least that such a range counts.
SPREAD = {"chars_per_token": 5.0, "chars_per_token_2": 4.0, "byte_share": 6.0, "token_entropy": 1.75}
LEAST = {"chars_per_token": 0.05, "chars_per_token_2": 0.05, "byte_share": 0.01, "token_entropy": 0.1}
#: Marks the number, behind a word's ids, of its tokens in the second vocabulary.
SECOND = 1 << 31
FIELDS = [C.field(n, k) for n, k in (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("n_tokens", "long"), ("chars_per_token", "double"), ("chars_per_token_2", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("script", "string"))]
_COUNTERS: dict[tuple[str, str | None], Callable] = {}


def counter(path: str, second: str | None = None) -> Callable[[list[bytes]], tuple[int, int, int, float]]:
    """A function from words to tokens, tokens in the second vocabulary, byte-fallback tokens and the entropy of the tokens in bits.

    Each word is encoded by itself, once for as long as it is kept: its ids, and the marked number of its tokens in the second.
    """
    if (path, second) in _COUNTERS:
        return _COUNTERS[path, second]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    is_byte = np.array([model.is_byte(i) for i in range(size)])
    others = word_tokens(second) if second else lambda word: 0
    four, join = [i.to_bytes(4, "little") for i in range(size)], b"".join
    young: dict[bytes, bytes] = {}
    old: dict[bytes, bytes] = {}

    def count(words: list[bytes]) -> tuple[int, int, int, float]:
        nonlocal young, old
        try:
            packed = join(map(young.__getitem__, words))
        except KeyError:
            need = [w for w in dict.fromkeys(words) if w not in young]
            if len(young) + len(need) > CACHED_WORDS:
                young, old = {}, young
                need = list(dict.fromkeys(words))
            new = []
            for w in need:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
            texts = [w.decode() for w in new]
            for w, text, ids in zip(new, texts, model.encode(texts, num_threads=1), strict=True):
                young[w] = join([four[i] for i in ids]) + (SECOND | others(text)).to_bytes(4, "little")
            packed = join(map(young.__getitem__, words))
        every = np.frombuffer(packed, "<u4")
        marked = every >= SECOND
        ids = every[~marked]
        if not len(ids):
            return 0, 0, 0, 0.0
        counts = np.bincount(ids) if len(ids) > 4000 else np.unique(ids, return_counts=True)[1]
        p = counts[counts > 0] / len(ids)
        return len(ids), int((every[marked] ^ np.uint32(SECOND)).sum(dtype=np.int64)), int(is_byte[ids].sum()), float(-(p * np.log2(p)).sum())

    return _COUNTERS.setdefault((path, second), count)


def repeated_words(words: list[bytes], each: int = 8) -> int:
    """Words that stand in a window of `each` words found twice or more in the text, the first one included."""
    n = len(words) - each + 1
    if n < 2:
        return 0
    rolled, width = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64), 1
    rolled ^= rolled >> np.uint64(29)
    factor = 0x9E3779B97F4A7C15
    while width < each:  # the hash of twice as many words, or of as many as are left
        step = min(width, each - width)
        rolled = rolled[: len(rolled) - step] * np.uint64(factor) + rolled[step:]
        width, factor = width + step, factor * factor % (1 << 64)
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    maybe = np.zeros(n, bool)  # equal hashes: now the words themselves decide
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    places = np.flatnonzero(maybe).tolist()
    counts = Counter(tuple(words[i : i + each]) for i in places)
    marks = np.zeros(len(words) + 1, np.int64)
    for i in places:
        if counts[tuple(words[i : i + each])] > 1:
            marks[i] += 1
            marks[i + each] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def script_of(raw: bytes) -> str:
    """The script with the most characters, judged by the first bytes of UTF-8 sequences and ASCII letters; none without."""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    found = {name: int(seen[a:b].sum()) for name, a, b in SCRIPTS}
    found["latin"] += int(seen[65:91].sum() + seen[97:123].sum())
    name, n = max(found.items(), key=lambda x: (x[1], x[0]))
    return name if n else "none"


def measurer(path: str, second: str | None = None) -> Callable[[str], tuple]:
    count = counter(path, second)

    def measure(text: str) -> tuple:
        raw = text.encode()
        words = raw.split()
        symbols = len(SYMBOLS.findall(text)) if any(c in raw for c in b"#*$%&|<>") else 0
        seen: set[bytes] = set()
        dup = 0
        for line in raw.split(b"\n"):
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
        n, again = len(words), repeated_words(words)
        chars = len(text) - (len(raw) - sum(map(len, words)))  # what stands between words is one byte a character
        tokens, others, by_byte, entropy = count(words)
        per = lambda x, y: x / y if y else 0.0
        return n, chars, symbols, dup, again, n < 20 or 100 * again > 30 * n, tokens, per(chars, tokens), per(chars, others), per(by_byte, tokens), entropy, script_of(raw)

    return measure


def bands(measured: DataFrame, key: str = "band_key", spread: dict[str, float] | None = None) -> DataFrame:
    """(key, mid_<m>, width_<m>): the median of all the key's documents, and so many interquartile ranges."""
    quantiles = measured.where("n_tokens > 0").groupBy(key).agg(*[F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES])

    def width(m: str) -> Column:
        return (SPREAD | (spread or {}))[m] * F.greatest(F.col(m)[2] - F.col(m)[0], F.lit(LEAST[m]))

    return quantiles.select(key, *[F.col(m)[1].alias(f"mid_{m}") for m in MEASURES], *[width(m).alias(f"width_{m}") for m in MEASURES])


def fertility_rules(docs: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", keep: list[str] | None = None, spread: dict[str, float] | None = None, steady: int = 256, second: str | None = None) -> DataFrame:
    """Measure each whole text and keep it if the base rules and the bands of its language or script hold.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_tokens, chars_per_token,
    chars_per_token_2 (in the vocabulary `second`, a word BPE; 0 without one), byte_share (of tokens that stand for
    one byte), token_entropy (bits), script, band_key and kept. A document's
    band is that of `lang_col`, or of its script where the language is null: median of all such documents, give or
    take `spread` (by measure) interquartile ranges, wider by sqrt(steady / n_tokens) under `steady` tokens, as measures of
    short texts scatter. Of the entropy only the lower end rejects, and of the byte share only the upper.
    A null text has no words: its counts are 0 and it fails the base rules. Columns of `docs` with the new names
    are replaced; repeated rows are judged one by one; an empty table gives an empty one.
    """
    kept_cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in FIELDS} | {"band_key", "kept"}]
    own = {c: f"k{i}" for i, c in enumerate(dict.fromkeys([*kept_cols, text_col, *([lang_col] if lang_col in docs.columns else [])]))}  # no column can be one of the names below
    C.with_checkpoints(docs.sparkSession)
    inner = [own[c] for c in own if c in kept_cols or c == lang_col]
    measured = C.map_text(docs.select(*[C.quoted(c).alias(k) for c, k in own.items()]), lambda: measurer(vocabulary, second), FIELDS, own[text_col], inner)
    script = F.concat(F.lit("script:"), F.col("script"))
    measured = measured.withColumn("band_key", F.coalesce(F.col(own[lang_col]).cast("string"), script) if lang_col in own else script).checkpoint()
    limits = bands(measured, spread=spread).checkpoint()
    slack = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(steady)) / F.greatest(F.col("n_tokens"), F.lit(1))))
    tests = [
        *[F.abs(F.col(m) - F.col(f"mid_{m}")) <= slack * F.col(f"width_{m}") for m in MEASURES[:2]],
        F.col("byte_share") <= F.col("mid_byte_share") + slack * F.col("width_byte_share"),
        F.col("token_entropy") >= F.col("mid_token_entropy") - slack * F.col("width_token_entropy"),
    ]
    kept = ~F.col("base_failed") & F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))
    if limits.count() <= MOST_BANDS:
        banded = measured.join(F.broadcast(limits), "band_key", "left")
    else:
        limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        banded = measured.withColumn("salt", F.pmod(F.xxhash64("n_words", "word_chars", "token_entropy"), F.lit(SALTS))).join(limits, ["band_key", "salt"], "left")
    return banded.select(*[F.col(own[c]).alias(c) for c in kept_cols], *[f.name for f in FIELDS], "band_key", kept.alias("kept"))
