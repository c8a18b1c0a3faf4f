"""Exact repeated-string removal: suffixes told apart by the ranks of a difference-cover sample, one bucket at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text in a batch (a longer document is a batch of its own), sampled names and bytes of entries that a bucket should hold.
BATCH_BYTES, BUCKET_NAMES, BUCKET_BYTES = 4 << 20, 1 << 20, 8 << 20
#: Positions hashed, and entries compared, at a time.
CHUNK, COMPARED = 1 << 20, 1 << 15
#: Batches that share a sampled string from which its suffixes are dealt one by one, not by the string.
HOT = 4096
#: Bytes of a name that only chooses samples, and of a digest by which equal strings are one.
NAME, DIGEST = 5, 16
#: Kinds of replies to a batch: bits of its sampled names that stand twice, and in HOT batches; masks of its entries; bits of its single suffixes; marks of documents that are copies, and of the first of each.
SAMPLE, POPULAR, ENTRY, SINGLE, COPY, FIRST = range(6)
SALTS = 32
BASE, SPREAD = 6364136223846793005, 0x9E3779B97F4A7C15


@cache
def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """(v, D) with v <= most, v = q^2 + q + 1 for a prime q: each residue modulo v is a difference of two of the q + 1 in D.

    D holds the places of the zeros of a linear recurrence of degree three over the integers modulo q.
    """
    for q in (p for p in range(int(most**0.5), 1, -1) if p * p + p + 1 <= most and all(p % k for k in range(2, p))):
        v = q * q + q + 1
        for code in range(q**3):
            a, b, c = code % q, code // q % q, code // q // q
            s = [0, 0, 1]
            while len(s) < v:
                s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
            zeros = [i for i, x in enumerate(s) if x == 0]
            if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
                return v, np.array(zeros)
    return 1, np.array([0])


@cache
def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def letters() -> np.ndarray:
    """A random odd number for each byte, the same everywhere."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(SPREAD)
    for shift in (30, 27, 31):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x | np.uint64(1)


def hashes_at(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the `length` bytes from each of the ascending positions."""
    out, table = np.empty(len(at), np.uint64), powers(CHUNK + length + 1)
    for start in range(0, len(raw), CHUNK):
        lo, hi = np.searchsorted(at, (start, start + CHUNK))
        if lo == hi:
            continue
        part = raw[start : start + CHUNK + length]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters()[part] * table[: len(part)], out=sums[1:])
        i = at[lo:hi] - start
        h = (sums[i + length] - sums[i]) * table[CHUNK - i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(SPREAD)
        out[lo:hi] = h ^ (h >> np.uint64(29))
    return out


class Batch:
    """The documents of a batch, one after another, in an order that only their rows decide."""

    def __init__(self, table: pa.Table):
        marks, texts = table["mark"].to_pylist(), table["text"].cast(pa.binary()).to_pylist()
        texts = [x or b"" for x in texts]
        order = sorted(range(len(marks)), key=lambda i: (marks[i], texts[i]))
        self.ids = table["id"].take(pa.array(order, pa.int64()))
        self.texts = [texts[i] for i in order]
        self.marks = [marks[i] for i in order]
        sizes = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)

    def samples(self, cover: tuple[int, np.ndarray], length: int) -> np.ndarray:
        """The sampled positions from which `length` bytes stay in their document."""
        v, residues = cover
        at = (np.arange(0, len(self.raw) + v, v)[:, None] + residues[None, :]).ravel()
        at = at[at < len(self.raw)]
        return at[at + length <= self.ends[np.searchsorted(self.ends, at, "right")]]

    def whole(self, marks: dict[int, object]) -> np.ndarray:
        """Whether each position is in a document with one of these marks."""
        chosen = np.fromiter((m in marks for m in self.marks), bool, len(self.marks))
        return np.repeat(chosen, self.ends - self.starts)


class Names:
    """A batch's distinct hashes: `bits` of each for the bucket, then NAME bytes that name the string in it."""

    def __init__(self, hashes: np.ndarray, bits: int):
        self.low = min(8 * NAME, 64 - bits)
        self.values, self.of, counts = np.unique(hashes >> np.uint64(64 - bits - self.low), return_inverse=True, return_counts=True)
        self.many = counts > 1
        self.buckets = (self.values >> np.uint64(self.low)).astype(np.int64)

    def parts(self) -> Iterator[tuple[int, slice]]:
        return runs(self.buckets)

    def messages(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(bucket, kind, names in order, whether each stands here more than once)"""
        own = (self.values & np.uint64((1 << self.low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME]
        for bucket, at in self.parts():
            yield bucket, SAMPLE, own[at].tobytes(), np.packbits(self.many[at]).tobytes()

    def told(self, replies: dict[int, bytes]) -> np.ndarray:
        """The bit that was replied for each hash given."""
        return bits_told(self.buckets, replies)[self.of]


def runs(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, where it is) of ascending buckets."""
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(buckets[a]), slice(a, b)


def bits_told(buckets: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(buckets), bool)
    for bucket, at in runs(buckets):
        if (bits := replies.get(bucket)) is not None:
            out[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at.stop - at.start).astype(bool)
    return out


class Entries:
    """The distinct fixed-size rows of bytes that a batch sends; their leading bits are the bucket."""

    def __init__(self, rows: np.ndarray, bits: int):
        width = rows.shape[1]
        flat, self.of, counts = np.unique(np.ascontiguousarray(rows).view(f"V{width}").ravel(), return_inverse=True, return_counts=True)
        self.rows = flat.view(np.uint8).reshape(-1, width)
        self.many = counts > 1
        self.buckets = (np.ascontiguousarray(self.rows[:, :8]).view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)

    def messages(self, kind: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        for bucket, at in runs(self.buckets):
            yield bucket, kind, self.rows[at].tobytes(), np.packbits(self.many[at]).tobytes()


def digests(own: Batch, at: np.ndarray, length: int) -> np.ndarray:
    """A row of DIGEST bytes for the string at each position; equal rows are taken as equal strings."""
    view = memoryview(own.raw)
    joined = b"".join([blake2b(view[p : p + length], digest_size=DIGEST).digest() for p in at.tolist()])
    return np.frombuffer(joined, np.uint8).reshape(-1, DIGEST)


def entries_at(own: Batch, at: np.ndarray, sampled: int, around: int) -> np.ndarray:
    """Digest of the sampled string, how many bytes its document has before and after it (`around` at most), and these bytes."""
    doc = np.searchsorted(own.ends, at, "right")
    before, after = np.minimum(around, at - own.starts[doc]), np.minimum(around, own.ends[doc] - at - sampled)
    out = np.zeros((len(at), DIGEST + 4 + 2 * around), np.uint8)
    out[:, :DIGEST] = digests(own, at, sampled)
    out[:, DIGEST : DIGEST + 4] = np.stack([before, after], 1).astype("<u2").view(np.uint8)
    if around:
        padded = np.concatenate([np.zeros(around, np.uint8), own.raw, np.zeros(around, np.uint8)])
        windows, steps = np.lib.stride_tricks.sliding_window_view(padded, around), np.arange(around)
        left = out[:, DIGEST + 4 : DIGEST + 4 + around]
        for a in range(0, len(at), CHUNK // 8):
            part = slice(a, a + CHUNK // 8)
            left[part] = windows[at[part]] * (steps >= (around - before[part])[:, None])
            out[part, DIGEST + 4 + around :] = windows[at[part] + around + sampled] * (steps < after[part][:, None])
    return out


def tied(rows: np.ndarray, many: np.ndarray, around: int) -> np.ndarray:
    """For each entry, the offsets d (0 to `around`) at which the suffix that starts d bytes before its sample ties with another one.

    Samples of one rank (digest) hold equal strings. Two of their suffixes at one offset tie if the d bytes before
    and the `around` - d bytes after are equal too: entries are sorted by hashes of these, and neighbours compared
    byte by byte. An entry that its batch holds more than once ties wherever its document is long enough.
    """
    keys = np.ascontiguousarray(rows[:, :DIGEST]).view("<u8")
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, rows, many = keys[order], rows[order], many[order]
    sizes = np.ascontiguousarray(rows[:, DIGEST : DIGEST + 4]).view("<u2").astype(np.int64)
    before, after = sizes[:, 0], sizes[:, 1]
    found = np.zeros((len(rows), around + 1), bool)
    steps = np.arange(around + 1)
    found[many] = (steps <= before[many][:, None]) & (around - steps <= after[many][:, None])
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    rank = np.cumsum(new) - 1
    shared = np.bincount(rank)[rank] > 1
    at = np.flatnonzero(shared)
    text = rows[:, DIGEST + 4 :]
    starts = np.flatnonzero(np.concatenate([[True], rank[at][1:] != rank[at][:-1]])) if len(at) else at
    cuts = [0]
    for s in [*starts.tolist(), len(at)]:  # some ranks at a time
        if s - cuts[-1] > COMPARED or s == len(at):
            cuts.append(s)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found[at[a:b]] |= ties_of(rank[at[a:b]], text[at[a:b]], before[at[a:b]], after[at[a:b]], around)
    out = np.empty_like(found)
    out[order] = found
    return out


def ties_of(rank: np.ndarray, text: np.ndarray, before: np.ndarray, after: np.ndarray, around: int) -> np.ndarray:
    found = np.zeros((len(rank), around + 1), bool)
    code, base = letters()[text], np.uint64(BASE)
    behind = np.zeros((len(rank), around + 1), np.uint64)  # hashes of the first bytes after the sample
    for k in range(around):
        behind[:, k + 1] = behind[:, k] * base + code[:, around + k]
    ahead = rank.astype(np.uint64) * np.uint64(SPREAD)  # of the rank and the last d bytes before it
    for d in range(around + 1):
        if d:
            ahead = ahead * base + code[:, around - d]
        fits = np.flatnonzero((before >= d) & (after >= around - d))
        key = ((ahead[fits] ^ (ahead[fits] >> np.uint64(31))) * np.uint64(SPREAD)) + behind[fits, around - d]
        order = np.argsort(key)
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        one, two = fits[order[same]], fits[order[same + 1]]
        equal = (rank[one] == rank[two]) & (text[one, around - d : 2 * around - d] == text[two, around - d : 2 * around - d]).all(1)
        if equal.all():
            found[one, d] = found[two, d] = True
            continue
        groups: dict[tuple[int, bytes], list[int]] = {}  # two strings share a hash: their bytes decide
        for i in np.unique(np.concatenate([one, two])).tolist():
            groups.setdefault((int(rank[i]), text[i, around - d : 2 * around - d].tobytes()), []).append(i)
        for own in groups.values():
            if len(own) > 1:
                found[own, d] = True
    return found


REPLIES = "batch long, kind int, bucket long, bits binary"


def replied(rows: list[tuple]) -> pa.Table:
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "bucket": pa.array([r[2] for r in rows], pa.int64()), "bits": pa.array([r[3] for r in rows], pa.binary())})


def sample_replies(messages: DataFrame, hot: int) -> DataFrame:
    """Sort one bucket's sampled names at a time; tell each batch which of its own stand elsewhere too, and in `hot` batches."""

    def run(table: pa.Table) -> pa.Table:
        own = []
        for x in table["names"].to_pylist():
            wide = np.zeros((len(x) // NAME, 8), np.uint8)
            wide[:, :NAME] = np.frombuffer(x, np.uint8).reshape(-1, NAME)
            own.append(wide.view("<u8").ravel())
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(table["many"].to_pylist(), own, strict=True)]
        every = np.sort(np.concatenate(own))
        again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[v[m] for v, m in zip(own, many, strict=True)]]))
        popular = np.unique(every[hot - 1 :][every[hot - 1 :] == every[: len(every) - hot + 1]]) if len(every) >= hot else every[:0]
        rows = []
        for batch, bucket, v in zip(table["batch"].to_pylist(), table["bucket"].to_pylist(), own, strict=True):
            for kind, among in ((SAMPLE, again), (POPULAR, popular)):
                if len(among) and (found := among[np.minimum(np.searchsorted(among, v), len(among) - 1)] == v).any():
                    rows.append((batch, kind, bucket, np.packbits(found).tobytes()))
        return replied(rows)

    return messages.groupBy("bucket").applyInArrow(run, REPLIES)


def suffix_replies(messages: DataFrame, around: int) -> DataFrame:
    """Sort one bucket's suffixes at a time, by the ranks of their samples; tell each batch which of its own tie."""

    def run(table: pa.Table) -> pa.Table:
        out, kinds = [], table["kind"].to_numpy()
        batches, buckets, names, repeats = (table[c].to_pylist() for c in ("batch", "bucket", "names", "many"))
        for kind, width in ((ENTRY, DIGEST + 4 + 2 * around), (SINGLE, DIGEST)):
            at = np.flatnonzero(kinds == kind).tolist()
            if not at:
                continue
            rows = np.frombuffer(b"".join([names[i] for i in at]), np.uint8).reshape(-1, width)
            sizes = [len(names[i]) // width for i in at]
            many = np.concatenate([np.unpackbits(np.frombuffer(repeats[i], np.uint8), count=n).astype(bool) for i, n in zip(at, sizes, strict=True)])
            found = tied(rows, many, around) if kind == ENTRY else again(rows, many)[:, None]
            ends = np.cumsum(sizes)
            for i, a, b in zip(at, (ends - sizes).tolist(), ends.tolist(), strict=True):
                if found[a:b].any():
                    out.append((batches[i], kind, buckets[i], np.packbits(found[a:b]).tobytes()))
        return replied(out)

    return messages.groupBy("bucket").applyInArrow(run, REPLIES)


def again(rows: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether each digest stands more than once."""
    _, of, counts = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_inverse=True, return_counts=True)
    times = counts + np.bincount(of, many, len(counts))
    return times[of] > 1


def as_messages(batch: int, rows: Iterator[tuple]) -> pa.Table:
    rows = list(rows)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "names": pa.array([r[2] for r in rows], pa.binary()), "many": pa.array([r[3] for r in rows], pa.binary())})


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that starts anywhere else too, in any document.

    Returns `id_col`, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with `with_kept` also spans
    (start, end) and kept (the bytes left). Strings are judged on the input and never cross documents. A null text
    is empty; a repeated row is another document; rows with a null id are judged like any; empty in, empty out. Columns
    of `docs` other than the two are not carried, so their names cannot clash.

    Suffixes are told apart by their first `length` bytes. Positions in a difference cover (residues D modulo v) are
    sampled, and their first `sampled` = length - v + 1 bytes ranked. Two equal strings of `length` bytes have, at one
    offset d < v, samples with equal ranks: the long part of a tie is resolved by these, and only the d bytes before
    and the v - 1 - d bytes after are compared. So a live sample (one whose rank another one has) brings its v suffixes
    to its rank's bucket as one entry, and buckets are sorted one at a time. Short names find the live samples first,
    where a false tie only adds work; ranks are those of 128-bit BLAKE2b digests, in place of a lexicographic order,
    as a removal asks for equality alone. Strings that HOT batches share are dealt suffix by suffix, by
    digests of their whole `length` bytes, so that no bucket grows with them. Equal entries of a batch are sent once,
    and of equal documents (by SHA-256) only the first sends its own. A batch holds documents of BATCH_BYTES
    together; a longer document is a batch, and takes some 20 times its size of a task's memory.
    """
    spark = docs.sparkSession
    cover = difference_cover(max(1, length // 7))
    v, around = cover[0], cover[0] - 1
    sampled, width = length - around, DIGEST + 4 + 2 * around
    total = docs.agg(F.sum(F.octet_length(C.quoted(text_col)))).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * BATCH_BYTES)))
    density, hot = len(cover[1]) / v, HOT

    def bits_for(each: float) -> int:
        return max(5, int(np.ceil(np.log2(max(1.0, total * density / each)))))

    name_bits, entry_bits = bits_for(BUCKET_NAMES), bits_for(4 * BUCKET_BYTES / width)
    mark = F.xxhash64(C.quoted(id_col).cast("string"), C.quoted(text_col))
    batch_of = F.pmod(F.xxhash64(mark), F.lit(batches))
    dealt = docs.select(batch_of.alias("batch"), mark.alias("mark"), C.quoted(id_col).alias("id"), C.quoted(text_col).alias("text")).repartition(parts, "batch")

    def live_samples(own: Batch, kinds: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Samples that send entries, and the starts of suffixes that are sent one by one."""
        at = own.samples(cover, sampled)
        names = Names(hashes_at(own.raw, at, sampled), name_bits)
        live = names.told(kinds.get(SAMPLE, {}))
        if COPY in kinds:  # a copy's strings are known to repeat, and the first copy sends them
            live &= ~own.whole(kinds[COPY])[at]
        popular = names.told(kinds.get(POPULAR, {})) & live if POPULAR in kinds else np.zeros(len(at), bool)
        singles = np.unique((at[popular][:, None] - np.arange(v)[None, :]).ravel())
        singles = singles[singles >= 0]
        doc = np.searchsorted(own.ends, singles, "right")
        return at[live & ~popular], singles[singles + length <= own.ends[doc]]

    def sent(own: Batch, kinds: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, Entries, np.ndarray, Entries]:
        at, singles = live_samples(own, kinds)
        return at, Entries(entries_at(own, at, sampled, around), entry_bits), singles, Entries(digests(own, singles, length), entry_bits)

    def in_kinds(table: pa.Table) -> dict[int, dict[int, bytes]]:
        out: dict[int, dict[int, bytes]] = {}
        for kind, bucket, bits in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["bits"].to_pylist(), strict=True):
            out.setdefault(kind, {})[bucket] = bits
        return out

    def sample(table: pa.Table) -> pa.Table:
        own = Batch(table)
        return as_messages(table["batch"][0].as_py(), Names(hashes_at(own.raw, own.samples(cover, sampled), sampled), name_bits).messages())

    def gather(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return as_messages(0, iter(()))
        _, entries, _, singles = sent(Batch(table), in_kinds(replies))
        return as_messages(table["batch"][0].as_py(), iter([*entries.messages(ENTRY), *singles.messages(SINGLE)]))

    def tied_starts(own: Batch, kinds: dict[int, dict[int, bytes]]) -> np.ndarray:
        at, entries, singles, others = sent(own, kinds)
        masks = np.zeros((len(entries.rows), v), bool)
        for bucket, part in runs(entries.buckets):
            if (bits := kinds.get(ENTRY, {}).get(bucket)) is not None:
                masks[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=(part.stop - part.start) * v).reshape(-1, v)
        starts = [singles[bits_told(others.buckets, kinds.get(SINGLE, {}))[others.of]]]
        for d in range(v):
            starts.append(at[masks[:, d][entries.of]] - d)
        return np.unique(np.concatenate(starts))

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        own, kinds = Batch(table), in_kinds(replies)
        gone = own.whole(kinds.get(COPY, {}) | kinds.get(FIRST, {}))
        if ENTRY in kinds or SINGLE in kinds:
            covered = np.zeros(len(own.raw) + 1, np.int32)
            at = tied_starts(own, kinds)
            covered[at] += 1  # starts are distinct, and so are ends
            covered[at + length] -= 1
            gone |= np.cumsum(covered[:-1]) > 0
        n_removed, n_spans, shas, spans, kept = [], [], [], [], []
        for text, a, b in zip(own.texts, own.starts.tolist(), own.ends.tolist(), strict=True):
            part = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]])))
            left = own.raw[a:b][~part].tobytes() if len(edges) else text
            n_removed.append(int(part.sum()))
            n_spans.append(len(edges) // 2)
            shas.append(sha256(left).hexdigest())
            if with_kept:
                spans.append([{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                kept.append(left)
        columns = {"id": own.ids, "n_bytes": pa.array([len(t) for t in own.texts], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        if with_kept:
            columns |= {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())}
        return pa.table(columns)

    kind = "bucket long, batch long, kind int, names binary, many binary"
    known = docs.where(F.octet_length(C.quoted(text_col)) >= length).select(batch_of.alias("batch"), mark.alias("mark"), F.sha2(C.quoted(text_col), 256).alias("same"), F.pmod(mark, F.lit(SALTS)).alias("salt"))
    firsts = known.groupBy("same").agg(F.count("*").alias("n"), F.min("mark").alias("first")).where("n > 1").select("same", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    copies = known.join(firsts, ["same", "salt"]).select("batch", F.when(F.col("mark") == F.col("first"), FIRST).otherwise(COPY).alias("kind"), F.col("mark").alias("bucket"), F.lit(None).cast("binary").alias("bits"))
    told = sample_replies(dealt.groupBy("batch").applyInArrow(sample, kind), hot).unionByName(copies).repartition(parts, "batch")
    entries = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(gather, kind)
    replies = told.unionByName(suffix_replies(entries, around)).repartition(parts, "batch")
    fields = [C.T.StructField("id", docs.schema[id_col].dataType), *[C.field(n, k) for n, k in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"))]]
    fields += [C.field("spans", C.structs(start="long", end="long")), C.field("kept", "binary")] if with_kept else []
    return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cut, C.T.StructType(fields)).withColumnRenamed("id", id_col)
