"""Near-duplicates: SimHash classes by covering locality-sensitive hashing, and exact shingle similarity of candidates that wide SimHashes find."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Up to so many fingerprints of a bucket are compared with one another; a larger bucket meets at middle points.
COMPARED = 256
#: Words of 64 bits of a wide SimHash; candidates differ in APART of its bits at most, and in APART_IN_TWO of its first two words.
WORDS, APART, APART_IN_TWO = 3, 60, 48
#: A table has one more SimHash word, cut into slices of so many bits: candidates agree in a slice. Distinct texts that a group of a table should hold.
SLICE, SLICES, GROUP = 12, 5, 1 << 18
#: The chance that a bit of two texts at a Jaccard similarity of 0.8 differs (at most; 0.1516 for long texts), and that no table has a common slice for them.
DIFFERS, MISSED = 0.1612, 1e-9
#: Shingles of a block of texts that are compared exactly; two blocks are held at a time.
BLOCK = 1_000_000


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(text: str, words_each: int, seed: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included, in ASCII lower case; of all its words if there are fewer."""
    from xxhash import xxh64_intdigest as xx

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    each = min(words_each, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - each + 1].tolist()
    ends = ends[each - 1 :].tolist()
    return np.fromiter((xx(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), "<u8", len(starts))


def fingerprinter(words_each: int = 3, seed: int = 42) -> Callable[[str], int]:
    """SimHash of a text: a bit is 1 if it is set in over half of its shingles' hashes; 0 for a text without words."""

    def fingerprint(text: str) -> int:
        hashes = shingle_hashes(text, words_each, seed)
        return majority_bits(hashes) if len(hashes) else 0

    return fingerprint


def masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits such that any `radius` bits are all outside at least one of them.

    Bit i has a random non-zero vector m(i) of radius+1 bits, and mask v holds bit i if <m(i), v> is odd. At most
    `radius` vectors leave a non-zero v at right angles to all of them: two words that differ there agree on v.
    """
    vectors = [random.Random(f"{seed}:{i}").randrange(1, 1 << (radius + 1)) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def near(prints: np.ndarray, radius: int, free: list[int]) -> list[tuple[int, int]]:
    """A forest of links that joins the fingerprints of a bucket exactly as all links within `radius` would.

    `prints`: distinct, unsigned; they agree outside the `free` bits. Each link goes to the smallest of its tree.
    """
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(pairs: np.ndarray) -> None:
        for i, j in pairs.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)

    if len(prints) <= COMPARED:
        join(np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius, 1)))
    else:  # two within radius share a point that is within half of it (rounded up) of one, and within the rest of the other
        far, close = (radius + 1) // 2, radius // 2
        flips = [np.uint64(0)]
        for _ in range(far):
            flips = list(dict.fromkeys([*flips, *(f ^ np.uint64(1 << b) for f in flips for b in free)]))
        points = np.concatenate([prints ^ f for f in flips])
        owner = np.tile(np.arange(len(prints)), len(flips))
        apart = np.repeat(np.fromiter((int(f).bit_count() for f in flips), np.int64, len(flips)), len(prints))
        order = np.lexsort((owner, apart, points))
        points, owner, apart = points[order], owner[order], apart[order]
        new = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
        first = np.repeat(new, np.diff(np.append(new, len(points))))  # the closest owner of each point: all others are within radius of it
        met = (apart[first] <= close) & (owner != owner[first])
        join(np.unique(np.stack([owner[first][met], owner[met]], 1), axis=0))
    return [(i, root(i)) for i in range(len(prints)) if root(i) != i]


def bucket_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of a forest over distinct fingerprints (column fp), found table by table of covering masks."""
    tables = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("x")).select("x.t", "x.key", "fp")
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = [[b for b in range(64) if not m >> b & 1] for m in tables]
        left = np.empty((0, 3), np.int64)

        def found(rows: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
            links = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    own = rows[a:b, 2]
                    links += [(int(own[i]), int(own[j])) for i, j in near(own.view(np.uint64), radius, free[int(rows[a, 0])])]
            return links

        def arrow(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        def cut(rows: np.ndarray) -> np.ndarray:
            return np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1

        held = [left]
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            if not len(rows):
                continue
            inside = cut(rows)
            first = held[-1]
            if not len(inside) and (not len(first) or (first[-1, :2] == rows[0, :2]).all()):
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            cuts = cut(rows)
            yield arrow(found(rows, np.concatenate([[0], cuts])))
            held = [rows[cuts[-1] :]] if len(cuts) else [rows]
        rows = np.concatenate(held)
        if len(rows):
            yield arrow(found(rows, np.array([0, len(rows)])))

    return dealt.mapInArrow(run, "a long, b long")


def simhash_classes(docs: DataFrame, words_each: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) with fp (long) and component_id, the smallest id reachable by links.

    Fingerprints link at `radius` or fewer differing bits; equal ones are one node, however many rows they have,
    and all-pairs are never formed. A null text is empty; texts with no word have fingerprint zero and link like
    any other. A row with a null id joins its class but does not name it (null only if the whole class has none).
    Repeated rows stay, each with its class. An empty table gives an empty one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("fp", "component_id")]
    C.with_checkpoints(docs.sparkSession)
    marked = C.map_text(docs, lambda: (lambda f: lambda text: (f(text),))(fingerprinter(words_each)), [C.field("fp", "long")], text_col, list(dict.fromkeys([id_col, *keep])))
    marked = marked.checkpoint()
    prints = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    linked = C.components(bucket_links(prints.select("fp"), radius))
    named = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return marked.join(classes, "fp", "left").select(*[C.quoted(c) for c in keep], "fp", "component_id")


def simhash_words(hashes: np.ndarray, count: int) -> np.ndarray:
    """`count` independent SimHashes of 64 bits: of each, a bit is 1 if it is set in over half of the hashes as mixed for that word."""
    ones, lanes = np.zeros((8, count, 8), np.int64), np.uint64(0x0101010101010101)
    salts = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 240):  # a byte counts up to 255
        x = hashes[at : at + 240, None] + salts
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(odd)
        x ^= x >> np.uint64(31)
        for j in range(8):  # bit j of each of the eight bytes
            ones[j] += ((x >> np.uint64(j)) & lanes).sum(0, dtype=np.uint64).view(np.uint8).reshape(count, 8)
    return np.packbits((ones * 2 > len(hashes)).transpose(1, 2, 0), axis=-1, bitorder="little").reshape(count, 8).view("<u8").ravel()


def wide_simhash(words_each: int, count: int, seed: int = 42) -> Callable[[str], np.ndarray]:
    """`count` SimHash words of a text's distinct word shingles; all zero for a text without a word."""
    return lambda text: simhash_words(np.unique(shingle_hashes(text, words_each, seed)), count)


def table_plan(texts: int) -> tuple[int, int]:
    """(tables, bits): so many tables, each dealt into 2^bits groups that hold about GROUP of the texts.

    Two texts meet in a table if they agree in the bits that deal it and in one of its slices. There are as many tables as
    leave a chance of MISSED that texts at a Jaccard similarity of 0.8 meet in none.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, texts) / GROUP))))
    agree = 1 - DIFFERS
    return int(np.ceil(np.log(MISSED) / np.log1p(-(agree**bits) * (1 - (1 - agree**SLICE) ** SLICES)))), bits


def slices(words: np.ndarray) -> list[np.ndarray]:
    return [(words >> np.uint64(SLICE * i)) & np.uint64((1 << SLICE) - 1) for i in range(SLICES)]


def band_keys(words_each: int, texts: int = 1) -> Callable[[str], list[int]]:
    """The keys by which a text meets others of a table of so many: the slices of its SimHash words, each with its place."""
    tables, bits = table_plan(texts)
    of = wide_simhash(words_each, WORDS + tables * (1 + (bits > 0)))

    def keys(text: str) -> list[int]:
        words = of(text)
        dealt = words[WORDS + tables :] >> np.uint64(64 - bits) if bits else np.zeros(tables, np.uint64)
        found = np.stack([dealt << np.uint64(SLICE) | x for x in slices(words[WORDS : WORDS + tables])]).ravel()
        return (np.arange(len(found), dtype=np.uint64) << np.uint64(SLICE + bits) | found).astype(np.int64).tolist()

    return keys


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let a[i] and b[i] have one label, the least of all they are joined with; labels are places of roots."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def reach(prints: np.ndarray, own: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): links that join the fingerprints at the places `own` as all pairs within `apart` would, one seen being compared with those not yet reached only."""
    ends, starts, left = [], [], own
    while len(left):
        pivot, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, min(256, (1 << 21) // len(left)))
            now, front = front[:step], front[step:]
            hit = (np.bitwise_count(prints[now][:, None] ^ prints[left][None]).sum(2, dtype=np.int64) <= apart).any(0)
            ends.append(left[hit])
            starts.append(np.full(len(ends[-1]), pivot))
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return (np.concatenate(starts), np.concatenate(ends)) if ends else (own[:0], own[:0])


def wide_forest(words: np.ndarray, prints: np.ndarray, apart: int = APART) -> np.ndarray:
    """For each wide fingerprint of a group the place of the least that it is joined with: by a common slice of its word and `apart` or fewer differing bits.

    Inside a bucket of a slice all are compared, by their distance in an order of buckets by size. More than COMPARED are reached
    from one another instead, which takes a time in proportion for many near copies.
    """
    label = np.arange(len(words))
    for key in slices(words):
        _, of, counts = np.unique(key, return_inverse=True, return_counts=True)
        size = counts[of]
        order = np.lexsort((key, -size))
        size, key = size[order], key[order]
        large = int(np.searchsorted(-size, -COMPARED, "left"))  # in buckets of over COMPARED
        ends = np.append(np.flatnonzero(key[1:large] != key[: max(0, large - 1)]) + 1, large).tolist() if large else []
        for a, b in zip([0, *ends[:-1]], ends, strict=True) if large else ():
            join_labels(label, *reach(prints, order[a:b], apart))
        order, size, key = order[large:], size[large:], key[large:]
        columns = [np.ascontiguousarray(prints[order, c]) for c in range(WORDS)]
        found, held = [], 0
        for j in range(1, int(size[0]) if len(size) else 1):
            n = int(np.searchsorted(-size, -j, "left"))  # larger buckets than j
            differ = np.bitwise_count(columns[0][: n - j] ^ columns[0][j:n]) + np.bitwise_count(columns[1][: n - j] ^ columns[1][j:n])
            at = np.flatnonzero((differ <= APART_IN_TWO) & (key[: n - j] == key[j:n]))
            at = at[differ[at] + np.bitwise_count(columns[2][at] ^ columns[2][at + j]) <= apart]
            at = at[label[order[at]] != label[order[at + j]]]
            found.append((order[at], order[at + j]))
            held += len(at)
            if held > 1 << 16:
                join_labels(label, *map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
        if held:
            join_labels(label, *map(np.concatenate, zip(*found, strict=True)))
    return label


def text_mark(text: Column) -> Column:
    """16 bytes by which equal texts are one (MD5); a null text is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def wide_links(marked: DataFrame, words_each: int, texts: int, apart: int = APART) -> DataFrame:
    """(a, b): links of forests over the names of marked (name, _text), whose wide SimHashes differ in `apart` or fewer bits and meet in a table.

    A text sends its fingerprint and a word to one group of each table; equal texts of an Arrow batch send one. Fingerprints
    and words that are equal are one in a group. Each text has one link at most in a group, to the least name of its tree.
    """
    tables, bits = table_plan(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = wide_simhash(words_each, WORDS + tables * (1 + (bits > 0)))
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for name, text in zip(batch["name"].to_pylist(), C.texts(batch["_text"]), strict=True):
                if name not in found:
                    found[name] = of(text or "")
            if not found:
                continue
            names, words = np.fromiter(found, np.int64, len(found)), np.stack(list(found.values()))
            sent: list[tuple[int, bytes, bytes, bytes]] = []
            for t in range(tables):
                to = (words[:, WORDS + tables + t] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
                order = np.argsort(to, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    sent.append((t << bits | int(to[at[0]]), names[at].tobytes(), words[at, WORDS + t].tobytes(), words[at, :WORDS].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sent], pa.int64() if i == 0 else pa.binary()) for i in range(4)], names=["part", "names", "words", "prints"])

    def link(table: pa.Table) -> pa.Table:
        names, words, prints = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("names", "<i8"), ("words", "<u8"), ("prints", "<u8")))
        rows = np.column_stack([prints.reshape(-1, WORDS), words])
        order = np.lexsort((names, *rows.T))
        names, rows = names[order], rows[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
        first = np.flatnonzero(new)
        label = wide_forest(np.ascontiguousarray(rows[first, WORDS]), np.ascontiguousarray(rows[first, :WORDS]), apart)
        least = names[first]  # of each fingerprint, then of its tree: the tables of one class of texts then send the same links
        np.minimum.at(least, label, names[first])
        root = least[label[np.cumsum(new) - 1]]
        linked = names != root
        return pa.table({"a": pa.array(names[linked], pa.int64()), "b": pa.array(root[linked], pa.int64())})

    sent = marked.select("name", "_text").mapInArrow(run, "part long, names binary, words binary, prints binary")
    return sent.groupBy("part").applyInArrow(link, "a long, b long")


def exact_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of links that joins sets exactly as all pairs with a Jaccard similarity of `similarity` or more would.

    `sets`: arrays of distinct hashes, in order of size. Each is held against those after it that size allows and
    that are not yet of its tree. Two empty sets are equal.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    none = int(np.searchsorted(sizes, 0, "right"))
    links = [(0, j) for j in range(1, none)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if none == len(sets):
        return links
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held, label = np.zeros(len(values), bool), np.arange(len(sets))
    for i in range(none, len(sets) - 1):
        to = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-6, "right"))
        if to == i + 1 or (label[i + 1 : to] == label[i]).all():
            continue
        held[ids[starts[i] : ends[i]]] = True
        both = np.add.reduceat(held[ids[starts[i + 1] : ends[to - 1]]], starts[i + 1 : to] - starts[i + 1], dtype=np.int64)
        held[ids[starts[i] : ends[i]]] = False
        like = i + 1 + np.flatnonzero(both / (sizes[i] + sizes[i + 1 : to] - both) >= similarity)
        others, at = np.unique(label[like], return_index=True)
        links += [(i, int(like[k])) for k, other in zip(at.tolist(), others.tolist(), strict=True) if other != label[i]]
        label[np.isin(label, others)] = label[i]
    return links


def exact_links(texts: DataFrame, groups: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """(a, b): links of a forest over nodes of one component whose shingles have a Jaccard similarity of `similarity` or more.

    texts (node, name, _text) may repeat a node; groups (name, component). The shingle sets of a component meet in one
    group, or, beyond `BLOCK` shingles, in one for each two of its blocks in order of size that can hold such a pair.
    """

    def make() -> Callable[[str], tuple]:
        def of(text: str) -> tuple[int, bytes]:
            found = np.unique(shingle_hashes(text, words_each, 42))
            return len(found), found.tobytes()

        return of

    once = texts.groupBy("node", "name").agg(F.first("_text").alias("_text")).join(groups, "name")  # copies meet in each task first
    sets = C.map_text(once, make, [C.field("size", "long"), C.field("hashes", "binary")], "_text", ["node", "component"]).checkpoint()
    # shingles up to each text in the order of size and node: inside runs of one size and of nodes that begin alike, then over the runs
    run = ["component", "size", "run"]
    rows = sets.select("node", "component", "size", F.substring(F.hex("node"), 1, 2).alias("run"))
    runs = rows.groupBy(*run).agg(F.sum("size").alias("held"))
    over = Window.partitionBy("component").orderBy("size", "run")
    runs = runs.select(*run, (F.sum("held").over(over) - F.col("held")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy(*run).orderBy("node"))
    placed = rows.withColumn("inside", inside).join(runs, run).select("node", "component", "size", F.floor((F.col("before") + F.col("inside")) / F.lit(BLOCK)).alias("block"))
    blocks = placed.groupBy("component", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    later = blocks.select("component", F.col("block").alias("j"), F.col("least").alias("other"))
    met = blocks.join(later, "component").where((F.col("block") <= F.col("j")) & (F.col("other") * F.lit(similarity) <= F.col("most") + 1))
    cells = met.select("component", F.col("block").alias("i"), "j", F.explode(F.array_distinct(F.array("block", "j"))).alias("block"))
    dealt = sets.select("node", "size", "hashes").join(placed.drop("size").join(cells, ["component", "block"]), "node")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("node", "ascending")])
        nodes, found = table["node"].to_pylist(), exact_forest([np.frombuffer(x.as_buffer(), "<u8") for x in table["hashes"]], similarity)
        return pa.table({name: pa.array([nodes[x[k]] for x in found], pa.binary()) for k, name in enumerate("ab")})

    return dealt.groupBy("component", "i", "j").applyInArrow(link, "a binary, b binary")


def near_classes(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, text_col: str = "text", apart: int = APART) -> DataFrame:
    """(mark, component): for each distinct text that is near another one, the class it belongs to.

    mark = MD5 of the text, by which equal texts are one. Candidates have wide SimHashes (`WORDS` words of 64 bits, of their distinct
    `words_each`-word shingles) that differ in `apart` or fewer bits, and meet in a table that slices of further SimHash words
    make. A bit differs with a chance that the Jaccard similarity s bounds, whatever the edits: for s of 0.8 or more by
    `DIFFERS` (0.1875 for a text of four shingles and one more; see README for the chances of a miss).
    Two candidates are linked if and only if s is `similarity` or more, taken exactly. Null and blank texts have no shingle and are near
    one another; a text with fewer words is one shingle. Repeated rows are one text; empty in, empty out; only the text is read.
    """
    C.with_checkpoints(docs.sparkSession)
    marked = docs.select(text_mark(C.quoted(text_col)).alias("node"), C.quoted(text_col).alias("_text"))
    marked = marked.select("node", F.xxhash64("node").alias("name"), "_text")
    groups = C.components(wide_links(marked, words_each, docs.count(), apart)).withColumnRenamed("node", "name")
    return C.components(exact_links(marked, groups, words_each, similarity)).select(F.col("node").alias("mark"), "component")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of equal or near-equal texts: the one with the smallest id (null ids last).

    Texts without a word are one group. Rows that tie on the id are told apart by their text, then by a hash of their
    other columns; of rows equal in all one is kept. Columns and their order stay, whatever their names.
    """
    classes = near_classes(docs, text_col=text_col, **options)
    mark = text_mark(C.quoted(text_col))
    keys = docs.select(mark.alias("mark"), C.quoted(id_col).alias("id")).groupBy("mark").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    group = keys.join(classes, "mark", "left").withColumn("group", F.coalesce("component", "mark"))
    best = group.groupBy("group").agg(F.min(F.struct("least", "mark")).alias("b")).select(F.col("b.mark").alias("__mark"))
    columns = [F.col(f"r.k{i}").alias(c) for i, c in enumerate(docs.columns)]
    own = F.struct(*[C.quoted(c).alias(f"k{i}") for i, c in enumerate(docs.columns)])
    plain = [C.quoted(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(own.alias("row"), mark.alias("__mark"), F.struct(C.quoted(id_col).isNull(), C.quoted(id_col), F.xxhash64(*plain)).alias("order"))
    firsts = rows.groupBy("__mark").agg(F.min_by("row", "order").alias("r"))  # equal texts meet in each task first
    return firsts.join(best, "__mark", "left_semi").select(*columns)
