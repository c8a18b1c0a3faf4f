"""Packing by power-of-two decomposition: every sequence is one piece of one document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words kept in each of a worker's two caches; when the young one is full it replaces the old one.
CACHED_WORDS = 250_000
#: White space that str.split() knows but the fast path leaves to the tokenizer, and the start of a special token.
UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
#: A word of letters only, then marks only: two pieces that the pre-tokenizer keeps apart.
PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?#*$%&|<>]+)")
_ENCODERS: dict[str, Callable[[str], bytes]] = {}
_COUNTERS: dict[str, Callable[[str], int]] = {}


def lengths(n: int, most: int) -> list[int]:
    """Pieces of n ids: as many of the largest size as fit, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def encoder(path: str, cached: int | None = None) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers.

    A worker makes it once and keeps its words from task to task; one with its own number of `cached` words goes with
    its task.

    The vocabulary drops white space and never merges across it, so a text's ids are its words' ids one after
    another, and a word is looked up if it has been met. A new word of letters goes to the vocabulary's model as the
    normalizer and the pre-tokenizer would pass it on; any other goes through the whole tokenizer, as does a
    text with unusual white space or with special tokens.
    """
    if path in _ENCODERS and cached is None:
        return _ENCODERS[path]
    import unicodedata

    from tokenizers import Tokenizer

    tokenizer, most = Tokenizer.from_file(path), cached or CACHED_WORDS
    model, letters = tokenizer.model, byte_letters()
    four = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def lowered(word: str) -> str:
        if word.isascii():
            return word.lower()
        word = unicodedata.normalize("NFC", word)
        return "".join([c.lower() for c in word]) if "\u03a3" in word else word.lower()  # only a capital sigma depends on its place

    def of_letters(low: str) -> bytes:
        return b"".join([four[t.id] for t in model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(letters))])

    def make(word: str) -> bytes:
        if word.isalpha():
            low = lowered(word)
            if low.isascii() or low.isalpha():
                return of_letters(low)
        elif (m := PLAIN.fullmatch(word)) and (m[1].isascii() or (m[1].isalpha() and lowered(m[1]).isalpha())):
            return known[m[1]] + marks[m[2]]
        return b"".join([four[i] for i in tokenizer.encode(word, add_special_tokens=False).ids])

    class Marks(dict):
        def __missing__(self, run: str) -> bytes:
            ids = b"".join([four[t.id] for t in model.tokenize(run)])
            if len(self) < most:
                self[run] = ids
            return ids

    old: dict[str, bytes] = {}
    join, tokenize, number = b"".join, model.tokenize, attrgetter("id")

    class Known(dict):
        """Words met of late; when it is full, it takes the place of those met before."""

        def __missing__(self, word: str) -> bytes:
            if word in old:
                ids = old[word]
            elif word.isascii() and word.isalpha():
                ids = join([four[i] for i in map(number, tokenize(word.lower()))])
            else:
                ids = make(word)
            if len(self) >= most:
                old.clear()
                old.update(self)
                self.clear()
            self[word] = ids
            return ids

    known, marks = Known(), Marks()

    def tokens(word: str) -> int:
        """How many ids a word has; nothing is kept."""
        if word.isascii() and word.isalpha():
            return len(tokenize(word.lower()))
        if (m := PLAIN.fullmatch(word)) and m[1].isascii() and m[1].isalpha():
            return len(tokenize(m[1].lower())) + len(marks[m[2]]) // 4
        return len(tokenizer.encode(word, add_special_tokens=False).ids) if UNUSUAL.search(word) else len(make(word)) // 4

    def encode(text: str) -> bytes:
        if UNUSUAL.search(text):
            return b"".join([four[i] for i in tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(known.__getitem__, text.split()))

    if cached is not None:
        return encode
    _COUNTERS[path] = tokens
    return _ENCODERS.setdefault(path, encode)


def word_tokens(path: str) -> Callable[[str], int]:
    """A function from a word to the number of its ids."""
    encoder(path)
    return _COUNTERS[path]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", cached: int | None = None) -> DataFrame:
    """Cut each document's ids, `end_id` last, into power-of-two pieces of at most `most` ids; each is a sequence.

    Returns `id_col`, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, bucket (log2 of the
    length), sequence_id and offset. Sequences need no padding: all of one bucket have one length, and a batch is
    taken from one bucket. A null or empty text gives one piece with `end_id` alone. Repeated rows, and rows with
    a null id, are packed one by one. Other columns of `docs` are not carried. One pass, no shuffle; a sequence_id
    is made from the partition and the row in it, and holds its bucket in the last four bits. `cached`: words that a
    task keeps; by default a worker keeps CACHED_WORDS from task to task.
    """
    if most & (most - 1) or not 1 <= most <= 1 << 15:
        raise ValueError("most must be a power of two up to 32768")
    fields = [C.field(n, k) for n, k in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("bucket", "int"))]
    schema = C.T.StructType([docs.schema[id_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encode, end = to_arrow_schema(schema), encoder(vocabulary, cached), np.array([end_id], "<u4").tobytes()

        def batch_of(key: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            at, *columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([key.take(pa.array(at))] + [pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns)], schema=arrow)

        for batch in batches:
            rows, held = [], 0
            for at, text in enumerate(C.texts(batch.column(1))):
                ids = encode(text or "") + end
                start, n = 0, len(ids) // 4
                for length in lengths(n, most):
                    rows.append((at, start, length, ids[4 * start : 4 * (start + length)], n, length.bit_length() - 1))
                    start += length
                held += n
                if held > 4_000_000:
                    yield batch_of(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(batch.column(0), rows)

    pieces = docs.select(C.quoted(id_col), C.quoted(text_col)).mapInArrow(run, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id() * 16 + F.col("bucket"), "offset": F.lit(0).cast("long")})
