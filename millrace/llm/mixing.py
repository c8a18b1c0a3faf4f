"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Up to so many sources their table is broadcast; a larger one is joined by shuffles.
MOST_SOURCES = 100_000
#: Columns of sources in a node of the tree; with more sources, several share one, and their draws are dealt together.
MOST_COLUMNS = 512
#: Draws, or blocks, of a run that is ranked on its own.
RUN = 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once."""
    return F.transform(F.array(value), use)[0]


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` taken without return from `population` are among its `marked`, by inversion at u.

    Weights go from the mode by the ratio of neighbouring ones, out to 12 standard deviations: one fold down to the
    lowest, one up for the sum above, and one up from the lowest that stops where u is reached. Only sums are held.
    """

    def body(z: Column) -> Column:
        p, n, d, lo, hi, m, w = (z[x] for x in ("p", "n", "d", "lo", "hi", "m", "w"))
        first, last = F.greatest(lo, m - w), F.least(hi, m + w)
        none = F.array().cast("array<bigint>")

        def rise(k: Column) -> Column:
            return ((n - k) * (d - k)).cast("double") / ((k + 1) * (p - n - d + k + 1)).cast("double")

        def total(steps: Column, ratio: Callable[[Column], Column]) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(steps, start, lambda a, k: let(a["w"] * ratio(k), lambda x: F.struct(x.alias("w"), (a["s"] + x).alias("s"))))

        up = total(F.when(last > m, F.sequence(m, last - 1)).otherwise(none), rise)["s"]
        down = total(F.when(first < m, F.sequence(m - 1, first, F.lit(-1).cast("bigint"))).otherwise(none), lambda k: 1 / rise(k))

        def walk(s: Column) -> Column:
            aim = u * (1.0 + s["up"] + s["down"]["s"])
            start = F.struct(s["down"]["w"].alias("w"), s["down"]["w"].alias("c"), first.alias("k"))
            steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(none)
            return F.aggregate(steps, start, lambda a, k: F.when(a["c"] >= aim, a).otherwise(let(a["w"] * rise(k), lambda x: F.struct(x.alias("w"), (a["c"] + x).alias("c"), (k + 1).alias("k")))))["k"]

        return let(F.struct(up.alias("up"), down.alias("down")), walk)

    lo, hi = F.greatest(F.lit(0).cast("bigint"), drawn - (population - marked)), F.least(marked, drawn)
    mode = F.floor((marked + 1).cast("double") * (drawn + 1).cast("double") / (population + 2).cast("double"))
    share = marked.cast("double") / F.greatest(population, F.lit(1)).cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), drawn.cast("double") * share * (1 - share)))
    z = F.struct(population.alias("p"), marked.alias("n"), drawn.alias("d"), lo.alias("lo"), hi.alias("hi"), F.least(hi, F.greatest(lo, mode)).alias("m"), (F.ceil(spread * 12) + 20).alias("w"))
    return let(z, body)


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, at, n): how many draws of the at-th column each of 2^levels shards gets.

    `quotas`: one row with `counts`, the draws of each column (MOST_COLUMNS at most). A node halves its total; how its halves differ
    by source is a multivariate hypergeometric draw, one source at a time from what is left, keyed by the node.
    """
    nodes = quotas.select(F.lit(1).cast("bigint").alias("node"), "counts")
    for level in range(levels):
        if level == 6:
            nodes = nodes.repartition("node")
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
        half = F.floor((total + F.pmod(F.col("node"), F.lit(2))) / 2)
        start = F.struct(total.alias("p"), half.alias("d"), F.lit(0).alias("i"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, n: Column) -> Column:
            drawn = hypergeometric(a["p"], n, a["d"], uniform(F.lit(seed), F.col("node"), a["i"]))
            return let(drawn, lambda x: F.struct((a["p"] - n).alias("p"), (a["d"] - x).alias("d"), (a["i"] + 1).alias("i"), F.concat(a["out"], F.array(x)).alias("out")))

        split = nodes.withColumn("left", F.aggregate("counts", start, step)["out"])
        left = F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"))
        nodes = split.select(F.explode(F.array(left, right)).alias("x")).select("x.node", "x.counts")
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.posexplode("counts").alias("at", "n"))


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """sizes (source, words, docs) with at (rank of the name, null last), target and quota (its whole words).

    Targets share `share` of all words by weight; one above `cap` times its source's words stops there and the
    excess is shared again. In the order of cap per weight, the first source that the rest's rate leaves under
    its cap fixes the rate. The windows run over one narrow row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("at", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("words") * F.lit(cap)}).withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rate = (F.sum("words").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rated = ranked.withColumn("rate", rate).withColumn("fits", F.when(F.col("rate") <= F.col("full_at"), F.struct("full_at", "at", "rate")))
    rated = rated.withColumn("final", F.coalesce(F.min("fits").over(every)["rate"], F.max("full_at").over(every)))
    target = F.least("most", F.col("final") * F.col("weight"))
    return rated.select("source", "words", "docs", "at", target.alias("target"), F.round(target).cast("bigint").alias("quota"))


def ranked(rows: DataFrame, key: str, run: Column, order: list[str], number: str, before: str | None = None) -> DataFrame:
    """rows with their rank in `key` from 0, and the sum of the column `before` over those ahead; taken in runs, then over them.

    Runs ascend with the order and hold about RUN rows each, so that a key with most rows is not one task's.
    """
    rows = rows.withColumn("run", run)
    inside, over = Window.partitionBy(key, "run").orderBy(*order), Window.partitionBy(key).orderBy("run")
    rows = rows.withColumn("n0", F.row_number().over(inside) - 1)
    if before:
        rows = rows.withColumn("w0", F.sum(before).over(inside) - F.col(before))
    sums = rows.groupBy(key, "run").agg(F.count("*").alias("rn"), F.sum(before or F.lit(0)).alias("rw"))
    sums = sums.select(key, "run", (F.sum("rn").over(over) - F.col("rn")).alias("n1"), (F.sum("rw").over(over) - F.col("rw")).alias("w1"))
    out = rows.join(sums, [key, "run"]).withColumn(number, F.col("n0") + F.col("n1"))
    if before:
        out = out.withColumn("before", F.col("w0") + F.col("w1")).drop("w0", before)
    return out.drop("run", "n0", "n1", "w1")


def with_copies_apart(rows: DataFrame, most: int, salts: int = 32) -> DataFrame:
    """rows where marks of more than `most` rows become a mark for each row, from its number among its equals.

    Equal rows stand for one another, so which of them gets which number does not matter. They are numbered inside
    the partitions, whose counts are then summed, so that no mark is one task's.
    """
    heavy = rows.groupBy("mark").agg(F.count("*").alias("copies")).where(F.col("copies") > most).select("mark").checkpoint()
    if not heavy.limit(1).count():
        return rows
    own = rows.checkpoint().withColumn("part", F.spark_partition_id()).withColumn("salt", F.col("part") % salts)
    heavy = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many, few = own.join(heavy, ["mark", "salt"]), own.join(heavy, ["mark", "salt"], "left_anti")
    counts = many.groupBy("mark", "part").agg(F.count("*").alias("n"))
    counts = counts.select("mark", "part", (F.sum("n").over(Window.partitionBy("mark").orderBy("part")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("mark", "part").orderBy("size"))
    apart = many.join(counts, ["mark", "part"]).withColumn("mark", F.xxhash64("mark", number))
    return few.select(*rows.columns).unionByName(apart.select(*rows.columns))


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block_docs: int = 1024, shard_draws: int = 64, seed: int = 2024, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs with size, source_size, target, taken and draws (epoch, shard, place, words).

    Each source is cut into blocks of about `block_docs` documents by a hash, which is also their random order. A
    source's quota takes all its blocks so many times over, and then the first blocks of one more turn; the last
    document taken is cut to its first words, so a source's words are its quota exactly and no document exceeds
    `cap` times its size. The block draws of all sources are dealt to shards by the splitting tree; a source's
    draws are permuted by the rank of a hash and go to the shards in turn, so that shards are disjoint; `place`
    orders a shard. Beyond MOST_COLUMNS sources, those that share a column of the tree are permuted together, which
    deals them by the same hypergeometric law. A null text has size 0 and takes nothing; null is a source of its own,
    the last. Repeated rows count each. Columns of `docs` with the new names are replaced. Only hashes decide: reruns agree. Empty in, empty out.
    """
    C.with_checkpoints(docs.sparkSession)
    new = ("size", "source_size", "target", "taken", "draws")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    inside = [C.quoted(c).alias(f"k{i}") for i, c in enumerate(keep)]
    words = F.coalesce(F.regexp_count(C.quoted(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    mark = F.xxhash64(F.lit(seed), C.quoted(id_col).cast("string"), C.quoted(text_col), C.quoted(source_col))
    narrow = docs.select(*inside, C.quoted(source_col).alias("source"), words.alias("size"), mark.alias("mark"))
    if text_col not in keep:
        narrow = narrow.checkpoint()
    narrow = with_copies_apart(narrow, block_docs)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    aims = targets(sizes, share, cap, weights).withColumn("buckets", F.ceil(F.col("docs") / F.lit(block_docs)))
    aims = aims.withColumns({"turns": F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("bigint")})
    aims = aims.withColumn("rest", F.col("quota") - F.col("turns") * F.col("words")).checkpoint()
    spread = F.broadcast if aims.count() <= MOST_SOURCES else lambda rows: rows
    small = spread(aims.withColumnRenamed("source", "s"))

    dealt = narrow.join(small, narrow["source"].eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), F.col("buckets")))
    blocks = dealt.groupBy("at", "bucket").agg(F.sum("size").alias("block_words"))
    # words and number of the blocks before each
    blocks = blocks.withColumn("run", F.floor(F.col("bucket") / RUN))
    blocks = ranked(blocks, "at", F.col("run"), ["bucket"], "number", before="block_words")
    blocks = blocks.join(spread(aims.select("at", "turns", "rest")), "at").checkpoint()

    column = F.pmod(F.col("at"), F.lit(MOST_COLUMNS)).alias("column")
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns"))).alias("epoch")
    draws = blocks.select(column, "at", "bucket", "turns", "before", "rest", turn).where("epoch < turns or before < rest").select("column", "at", "bucket", "epoch")
    counts = draws.groupBy("column").agg(F.count("*").alias("draws")).checkpoint()
    total = counts.agg(F.sum("draws")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, total / shard_draws))))
    quotas = counts.agg(F.array_sort(F.collect_list(F.struct("column", "draws"))).alias("columns"))
    names = quotas.select(F.posexplode("columns").alias("i", "c")).select("i", "c.column")
    shards = splitting_tree(quotas.select(F.transform("columns", lambda x: x["draws"]).alias("counts")), levels, seed).withColumnRenamed("at", "i").join(F.broadcast(names), "i")
    along = Window.partitionBy("column").orderBy("shard")
    shards = shards.withColumn("end", F.sum("n").over(along)).where("n > 0").select("column", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("turned"))

    u = uniform(F.lit(seed), F.col("at"), F.col("epoch"), F.col("bucket"))
    draws = draws.join(F.broadcast(counts), "column").withColumns({"u": u, "run": F.floor(u * F.ceil(F.col("draws") / RUN))})
    draws = ranked(draws, "column", F.col("run"), ["u", "at", "epoch", "bucket"], "turned")
    placed = draws.join(shards, ["column", "turned"]).groupBy("at", "bucket").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("own"))  # two or three a block
    placed = blocks.select("at", "bucket", "before").join(placed, ["at", "bucket"], "left")

    in_block = Window.partitionBy("at", "bucket").orderBy("mark", "size")
    seated = dealt.withColumn("inside", F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(placed, ["at", "bucket"])
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    drawn = F.transform(F.coalesce("own", F.array().cast("array<struct<epoch:bigint,shard:bigint>>")), lambda o: F.struct(o["epoch"].alias("epoch"), o["shard"].alias("shard"), F.xxhash64(F.lit(seed), o["shard"], o["epoch"], "mark").alias("place"), F.when(o["epoch"] < F.col("turns"), F.col("size")).otherwise(left).alias("words")))
    drawn = F.filter(drawn, lambda d: d["words"] > 0)
    out = seated.withColumn("draws", drawn)
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d["words"])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "draws")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", names: tuple[str, str] = ("shard", "place"), **options) -> DataFrame:
    """The mix itself: a row of docs for each draw, with its shard and place (order there) under `names`; the text is cut to its words.

    A shard is read, or written by partitionBy, on its own; sorting it by place shuffles it. All columns of docs are
    carried but those called like the two new ones, whatever their names. A null text has no words and no row;
    repeated rows are drawn each; empty in, empty out.
    """
    columns = [c for c in docs.columns if c.lower() not in names]
    own = {c: f"k{i}" for i, c in enumerate(columns)}
    rows = plan(docs.select(*[C.quoted(c).alias(k) for c, k in own.items()]), id_col=own[id_col], source_col=own[source_col], text_col=own[text_col], **options)
    rows = rows.select(*own.values(), "size", F.explode("draws").alias("d"))
    text = F.col(own[text_col])
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("d.words").cast("int")), "")
    rows = rows.withColumn(own[text_col], F.when(F.col("d.words") < F.col("size"), cut).otherwise(text))
    return rows.select(*[F.col(k).alias(c) for c, k in own.items()], F.col("d.shard").alias(names[0]), F.col("d.place").alias(names[1]))
