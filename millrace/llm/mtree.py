"""Exact top-k inner-product search: best-first over M-trees of paged metric nodes."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows of a tree, entries of a page, and queries of a block: what a task holds.
TREE_ROWS, PAGE, BLOCK_ROWS = 4096, 512, 2048
#: Cells that rows are dealt to by their nearest pivot at most; a larger table has more trees in a cell.
MOST_CELLS = 1024
#: Added to bounds, in proportion, against the rounding of square roots.
SLACK = 1e-9
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)


@dataclass
class Node:
    """A page: entries with their distances to the page's routing object; child pages, or vectors in a leaf."""

    #: Vectors of the entries (of a leaf), or routing objects of the child pages.
    vectors: np.ndarray
    norms2: np.ndarray
    to_parent: np.ndarray
    ids: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    radii: np.ndarray | None = None
    #: The largest squared norm below each child.
    most2: np.ndarray | None = None


def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - to) ** 2).sum(1))


def build(vectors: np.ndarray, ids: np.ndarray, routing: np.ndarray) -> Node:
    """An M-tree over the rows, whose routing object is given: leaves of PAGE rows, dealt to the nearest of sampled rows."""
    norms2 = (vectors**2).sum(1)
    if len(vectors) <= PAGE:
        return Node(vectors, norms2, distance(vectors, routing), ids)
    fan = min(PAGE, -(-len(vectors) // (PAGE // 2)))
    seeds = vectors[np.linspace(0, len(vectors) - 1, fan).astype(int)]
    nearest = np.argmin((seeds**2).sum(1)[None, :] - 2 * vectors @ seeds.T, 1)
    parts = [np.flatnonzero(nearest == k) for k in range(fan)]
    if max(map(len, parts)) > len(vectors) * 3 // 4:  # mostly equal rows: deal them evenly
        parts = np.array_split(np.argsort(nearest, kind="stable"), fan)
    parts = [p for p in parts if len(p)]
    centres = np.stack([vectors[p[np.argmin(distance(vectors[p], vectors[p].mean(0)))]] for p in parts])
    children = [build(vectors[p], ids[p], c) for p, c in zip(parts, centres, strict=True)]
    radii = np.array([distance(vectors[p], c).max() for p, c in zip(parts, centres, strict=True)])
    return Node(centres, (centres**2).sum(1), distance(centres, routing), None, children, radii, np.array([norms2[p].max() for p in parts]))


def search(root: Node, routing: np.ndarray, query: np.ndarray, own: int | None, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """(score, id) of the k best rows, of equal scores the smaller ids, and how many rows were computed.

    One row with the id `own` and the query's vector takes no part: the query's own. Rows that score under `floor`
    may be missing. A page waits by the largest score that may lie in it. From the distance D of the query to the
    page's routing object and an entry's stored distance e to it, the entry is no nearer than |D - e|, which bounds
    its score by its norm: only entries whose bound reaches the k-th best score so far are computed.
    """
    q2, qn = float((query**2).sum()), float(np.sqrt((query**2).sum()))
    best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
    waiting = [(-np.inf, 0, root, float(np.sqrt(((query - routing) ** 2).sum())))]
    n = computed = 0
    while waiting:
        bound, _, node, d = heapq.heappop(waiting)
        least = max(floor, best[0][0]) if len(best) == k else floor
        if -bound < least:
            break
        gap = np.abs(d - node.to_parent)
        if node.ids is not None:
            upper = (q2 + node.norms2 - gap * gap) / 2
            at = np.flatnonzero(upper + SLACK * (q2 + node.norms2) + SLACK >= least)
            computed += len(at)
            scores = node.vectors[at] @ query
            for i in np.flatnonzero(scores >= least).tolist():
                item = (int(scores[i]), -int(node.ids[at[i]]))
                if own is not None and -item[1] == own and (node.vectors[at[i]] == query).all():
                    own = None
                elif len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            continue
        near = np.maximum(0.0, gap - node.radii)
        upper = (q2 + node.most2 - near * near) / 2
        at = np.flatnonzero(upper + SLACK * (q2 + node.most2) + SLACK >= least)
        computed += len(at)
        dots = node.vectors[at] @ query
        far = np.sqrt(np.maximum(0.0, q2 + node.norms2[at] - 2 * dots))
        upper = bounds(q2, qn, dots, far, node.radii[at], node.most2[at])
        for i, u, f in zip(at.tolist(), upper.tolist(), far.tolist(), strict=True):
            if u >= least:
                n += 1
                heapq.heappush(waiting, (-u, n, node.children[i], f))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


def bounds(q2: np.ndarray | float, qn: np.ndarray | float, dots: np.ndarray, far: np.ndarray, radii: np.ndarray, most2: np.ndarray) -> np.ndarray:
    """The largest score that a row can have within `radii` of an object, with norms of at most sqrt(most2)."""
    near = np.maximum(0.0, far - radii)
    return np.minimum(dots + qn * radii, (q2 + most2 - near * near) / 2) + SLACK * (q2 + most2 + qn * radii) + SLACK


def compared(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """What `search` finds, for numbers too large for doubles: every row in whole numbers of any size."""
    whole = [int(x) for x in query]
    scores = [(-sum(a * int(b) for a, b in zip(whole, row, strict=True)), int(i)) for row, i in zip(vectors, ids, strict=True)]
    for at, (row, i) in enumerate(zip(vectors, ids, strict=True)):
        if int(i) == own and (row == query).all():
            del scores[at]
            break
    return [(-s, i) for s, i in heapq.nsmallest(k, scores)]


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component as double; rows with a null id, or a null or non-finite x, are left out."""
    x = F.transform(C.quoted(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) != float("inf")))
    floor = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)
    return rows.where(C.quoted(id_col).isNotNull() & C.quoted(vector_col).isNotNull() & fine).select(C.quoted(id_col).cast("long").alias("id"), F.transform(x, lambda c: floor(c * scale)).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


class Cells:
    """Pivots of one length of vectors; then each cell's radius, largest norm and number of trees. A small table, whatever the input."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms2 = pivots, (pivots**2).sum(1)
        self.radii, self.most2, self.trees = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)

    def known(self, cell: int, n: int, far: float, norm2: float) -> None:
        self.radii[cell], self.most2[cell], self.trees[cell] = far * (1 + SLACK) + SLACK, norm2 * (1 + SLACK), -(-n // TREE_ROWS)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argmin(self.norms2[None, :] - 2 * rows @ self.pivots.T, 1)
        return at, distance(rows, self.pivots[at])

    def uppers(self, asks: np.ndarray) -> np.ndarray:
        """For each query and cell, the largest score that a row of the cell may have."""
        q2 = (asks**2).sum(1)[:, None]
        dots = asks @ self.pivots.T
        far = np.sqrt(np.maximum(0.0, q2 + self.norms2[None, :] - 2 * dots))
        far = np.maximum(0.0, far - SLACK * (1 + far) - np.sqrt(SLACK * (q2 + self.norms2[None, :])))
        upper = bounds(q2, np.sqrt(q2), dots, far, self.radii[None, :], self.most2[None, :])
        return np.where(np.isnan(upper), np.inf, upper) + np.where(self.trees[None, :] > 0, 0.0, -np.inf)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", measure: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product with each query, exactly.

    Components are floor(scale * x); ties go to the smaller id; a query meets every row but its own, and only vectors
    of its own length; fewer candidates give fewer rows. Vectors that are null or hold a null or non-finite
    component take no part on either side, nor does a null id. Repeated rows are candidates and queries each. Empty
    in, empty out. Scores are whole numbers of any size, taken in doubles only where these are exact; one beyond a
    long is returned as the largest or smallest long. Other columns are not carried, so their names cannot clash.

    Of equal vectors only the k + 1 smallest ids can be found, and the others are dropped before any shuffle, so
    that a common vector is no hot key. Rows go to the nearest of at most MOST_CELLS pivots (rows in hash order), and
    a cell to trees of about TREE_ROWS; the cells' radii and largest norms are a small table. A query is searched
    first in a tree of the cell that promises most; with the k-th score found it then goes only to cells whose
    bound reaches that score. In a tree the search is best first over pages. With `measure`: (query_id, computed),
    how many rows or routing objects were computed for each query, beside the table of cells.
    """
    spark = rows.sparkSession
    C.with_checkpoints(spark)
    first = Window.partitionBy("v").orderBy("id")
    vectors = whole_vectors(rows, id_col, vector_col, scale).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("id", "v", F.size("v").alias("dims")).checkpoint()
    asked = whole_vectors(queries, id_col, vector_col, scale).groupBy("id", "v").agg(F.count("*").alias("times")).withColumns({"dims": F.size("v"), "same": F.xxhash64("id", "v")}).checkpoint()
    cells: dict[int, Cells] = {}
    for r in vectors.groupBy("dims").count().collect():  # a table's vectors have one length, or a few
        most = min(MOST_CELLS, -(-r["count"] // TREE_ROWS))
        pivots = vectors.where(F.col("dims") == r["dims"]).orderBy(F.xxhash64(F.lit(3), "v"), "id").limit(most).select("v").collect()
        cells[r["dims"]] = Cells(np.array([p["v"] for p in pivots], float).reshape(len(pivots), r["dims"]))
    bare = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, dims in by_length(batches, "dims"):
            v = matrix(own["v"], dims)
            at, far = bare.value[dims].nearest(v)
            yield record(id=own["id"], v=own["v"], dims=own["dims"], cell=pa.array(at, pa.int64()), far=pa.array(far), norm2=pa.array((v**2).sum(1)))

    placed = vectors.mapInArrow(place, "id long, v array<double>, dims int, cell long, far double, norm2 double").checkpoint()
    table = placed.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm2").alias("norm2"))
    for r in table.collect():  # MOST_CELLS rows for a length
        cells[r["dims"]].known(r["cell"], r["n"], r["far"], r["norm2"])
    shared = spark.sparkContext.broadcast(cells)
    trees = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(TREE_ROWS)))
    dealt = placed.join(F.broadcast(table.select("dims", "cell", "n")), ["dims", "cell"]).select("dims", "cell", F.pmod(F.xxhash64("id", "v"), trees).alias("tree"), "id", "v")
    keys = ["dims", "cell", "tree", "block"]

    def sent(home: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The trees that a query goes to: one of the cell that promises most, then all others that its k-th score leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, dims in by_length(batches, "dims"):
                if dims not in shared.value:
                    continue
                table = shared.value[dims]
                for a in range(0, own.num_rows, 1024):
                    part = own.slice(a, 1024)
                    q, same = matrix(part["v"], dims), part["same"].to_numpy()
                    best = np.argmax(np.where(table.trees[None, :] > 0, q @ table.pivots.T, -np.inf), 1)
                    tree = np.abs(same) % table.trees[best]
                    if home:
                        at, cell, floor = np.arange(len(q)), best, np.full(len(q), -np.inf)
                    else:
                        least = part["floor"].to_numpy()
                        at, cell = np.nonzero(table.uppers(q) >= least[:, None])
                        times = table.trees[cell]
                        at, cell = np.repeat(at, times), np.repeat(cell, times)
                        every = np.concatenate([np.arange(n) for n in times.tolist()]) if len(times) else times
                        new = (cell != best[at]) | (every != tree[at])
                        at, cell, tree = at[new], cell[new], every[new]
                        floor = least[at]
                    for c in range(0, len(at), 4096):
                        one = slice(c, c + 4096)
                        which = pa.array(at[one])
                        yield record(dims=part["dims"].take(which), cell=pa.array(cell[one], pa.int64()), tree=pa.array(tree[one], pa.int64()), id=part["id"].take(which), v=part["v"].take(which), same=part["same"].take(which), floor=pa.array(floor[one]))

        return run

    def searched(met: DataFrame) -> DataFrame:
        """Each tree meets the queries sent to it, BLOCK_ROWS or so at a time."""
        met = met.checkpoint()
        blocks = met.groupBy("dims", "cell", "tree").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks"))
        trees = dealt.join(blocks, ["dims", "cell", "tree"]).select("dims", "cell", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v")
        asks = met.join(blocks, ["dims", "cell", "tree"]).withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, blocks.count()))  # small rows, much work: not to be coalesced
        return trees.repartition(parts, *keys).groupBy(*keys).cogroup(asks.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, "query_id long, same long, vec_id long, score decimal(38,0), computed long")

    def run(own: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and block.num_rows:
            dims = own["dims"][0].as_py()
            ids, v, asks = own["id"].to_numpy(), matrix(own["v"], dims), matrix(block["v"], dims)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            root, most = build(v, ids, v[0]), float(np.sqrt((v**2).sum(1).max()))
            for q, qid, same, floor in zip(asks, block["id"].to_pylist(), block["same"].to_pylist(), block["floor"].to_pylist(), strict=True):
                if most * np.sqrt((q**2).sum()) < EXACT:
                    found, computed = search(root, v[0], q, qid, k, floor)
                else:
                    found, computed = compared(v, ids, q, qid, k), len(v)
                out += [(qid, same, i, within(s), 0) for s, i in found]
                out.append((qid, same, None, None, computed))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64())
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["query_id", "same", "vec_id", "score", "computed"])

    met = "dims int, cell long, tree long, id long, v array<double>, same long, floor double"
    near = searched(asked.select("id", "v", "same", "dims").mapInArrow(sent(True), met)).checkpoint()
    order = Window.partitionBy("query_id", "same").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    reached = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "same", F.col("score").cast("double").alias("floor"))
    floor = F.coalesce(F.col("floor") - F.abs("floor") * SLACK, F.lit(float("-inf")))  # as a double it may be rounded up
    asks = asked.join(reached, ["id", "same"], "left").select("id", "v", "same", "dims", floor.alias("floor"))
    found = near.unionByName(searched(asks.mapInArrow(sent(False), met)))
    if measure:
        return found.groupBy("query_id").agg(F.sum("computed").alias("computed"))
    times = asked.select(F.col("id").alias("query_id"), "same", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1))
    return ranked(found).join(times, ["query_id", "same"]).select("query_id", "rank", "vec_id", F.greatest(low, F.least(high, F.col("score"))).cast("long").alias("score"))


def within(score: int) -> Decimal:
    """The score, or the nearest number of 38 digits."""
    most = 10**38 - 1
    return Decimal(max(-most, min(most, score)))


def record(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows of each batch, one length of vectors at a time."""
    for batch in batches:
        sizes = batch[column].to_numpy()
        for dims in np.unique(sizes).tolist():
            yield batch.filter(pa.array(sizes == dims)), dims
