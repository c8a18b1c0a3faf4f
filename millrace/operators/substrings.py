"""Which of many patterns stand in which of many texts, by one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the patterns that one pass looks for; more patterns take more passes over the texts.
PATTERN_CHARS = 32 << 20
#: Pairs of a batch that are sent on together.
SENT = 100_000


def substrings_found(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str) -> DataFrame:
    """(text_id, pattern_id, whole): each pattern that a text contains, and whether it is all of it.

    The patterns of a pass are an automaton that every task holds, and a text is read through it once; texts and
    patterns never meet pair by pair. An empty pattern stands in every text; nulls stand in none.
    """
    total = patterns.agg(F.sum(F.length(pattern))).first()[0] or 0
    passes = -(-total // PATTERN_CHARS) or 1
    schema = T.StructType([T.StructField("a", texts.schema[text_id].dataType), T.StructField("b", patterns.schema[pattern_id].dataType), T.StructField("whole", T.BooleanType())])
    out: DataFrame | None = None
    for k in range(passes):
        own = patterns.where(F.pmod(F.xxhash64(pattern_id, pattern), F.lit(passes)) == k).where(F.col(pattern).isNotNull()).select(pattern_id, pattern).collect()
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in own])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            ids: dict[str, list] = {}
            for i, p in shared.value:
                ids.setdefault(p, []).append(i)
            everywhere = ids.pop("", [])
            automaton = ahocorasick.Automaton()
            for p in ids:
                automaton.add_word(p, p)
            automaton.make_automaton()

            def sent(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.field(n).type) for n in range(3)], schema=arrow)

            for batch in batches:
                rows: list[tuple] = []
                for at in range(len(batch)):
                    one, value = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                    if value is None:
                        continue
                    found = {p for _, p in automaton.iter(value)} if ids else set()
                    rows += [(one, i, p == value) for p in sorted(found) for i in ids[p]] + [(one, i, value == "") for i in everywhere]
                    if len(rows) > SENT:
                        yield sent(rows)
                        rows = []
                yield sent(rows)

        part = texts.select(text_id, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("a").alias(text_id), F.col("b").alias(pattern_id), "whole")
