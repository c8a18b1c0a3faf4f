"""Functions on text with path tags."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(r"</?(?:Parallel|Path|Summary)>")
ANY_TAG = r"</?Parallel>|</?Path>|</?Summary>"


def format_errors(text: str) -> list[str]:
    """What is wrong with the tags: each block needs two paths and a summary after it. Text without tags is right."""
    open_tags: list[str] = []
    paths: list[int] = []
    errors: list[str] = []
    due, summaries, closed = False, 0, 0
    for at, tag in enumerate(TAG.findall(text)):
        name = tag.strip("</>")
        if tag == "<Parallel>":
            open_tags.append(name)
            paths.append(0)
            due = False
        elif tag == "<Path>":
            open_tags.append(name)
        elif tag in ("</Path>", "</Parallel>"):
            closed += name == "Parallel"
            if not open_tags or open_tags[-1] != name:
                errors.append(f"unexpected {tag} at tag {at}")
                continue
            open_tags.pop()
            if name == "Path":
                if paths:
                    paths[-1] += 1
            else:
                if (n := paths.pop()) < 2:
                    errors.append(f"block closed at tag {at} with {n} paths")
                due = True
        elif tag == "<Summary>":
            if not due:
                errors.append(f"<Summary> at tag {at} follows no block")
            due, summaries = False, summaries + 1
    if open_tags:
        errors.append(f"left open: {', '.join(open_tags)}")
    if due:
        errors.append("no <Summary> after the last block")
    if summaries != closed:
        errors.append(f"{summaries} summaries, {closed} blocks")
    return errors


@F.pandas_udf(T.IntegerType())
def n_format_errors(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(format_errors(t or "")))


def parallel_count(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit("<Parallel>"), F.lit("")))) / 10).cast("int")


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def efficiency(text: Column, mode: str = "max") -> Column:
    """(all - traversed) / all, at least 0: traversed are the words outside blocks, and of each block one path (the
    longest, shortest or mean) and its last inner summary, or without a path all of it. Tags are no words.
    """
    bare = lambda t: word_count(F.regexp_replace(t, ANY_TAG, ""))
    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  use(value) with the value computed once
    outside = bare(F.regexp_replace(text, r"(?s)<Parallel>.*?</Parallel>", ""))
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<Parallel>(.*?)</Parallel>"), F.lit(1))

    def block(b: Column) -> Column:
        summary = F.coalesce(F.try_element_at(F.regexp_extract_all(b, F.lit(r"(?s)<Summary>(.*?)</Summary>"), F.lit(1)), F.lit(-1)), F.lit(""))

        def path(sizes: Column) -> Column:
            mean = F.floor(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(sizes), F.lit(1))).cast("int")
            one = {"max": F.array_max(sizes), "min": F.array_min(sizes), "avg": mean}[mode]
            return F.when(F.size(sizes) == 0, bare(b)).otherwise(one + bare(summary))

        return let(F.transform(F.regexp_extract_all(b, F.lit(r"(?s)<Path>(.*?)</Path>"), F.lit(1)), bare), path)

    walked = outside + F.aggregate(F.transform(blocks, block), F.lit(0), lambda a, x: a + x)
    gain = let(F.struct(bare(text).alias("all"), walked.alias("walked")), lambda n: F.when(n["all"] > 0, F.greatest((n["all"] - n["walked"]) / n["all"], F.lit(0.0))).otherwise(0.0))
    return F.when(F.contains(text, F.lit("<Parallel>")), gain).otherwise(0.0)


def bleu_tokens(text: str) -> list[str]:
    """Words with punctuation apart, except a point or comma between digits."""
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def sentence_bleu(hypothesis: str, reference: str, most: int = 4) -> float:
    """BLEU of one sentence, 0 to 1, by the published definition, with exponential smoothing of orders without a match.

    Orders longer than the hypothesis are left out of the mean.
    """
    h, r = bleu_tokens(hypothesis), bleu_tokens(reference)
    if not h or not r:
        return 0.0
    logs, smooth = [], 1.0
    for n in range(1, most + 1):
        own = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
        if not own:
            break
        other = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        same, total = sum((own & other).values()), sum(own.values())
        if not same:
            smooth *= 2
        logs.append(math.log((same or 1 / smooth) / total))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(sum(logs) / len(logs)) if len(h) < len(r) else math.exp(sum(logs) / len(logs))


def self_bleu(text: str) -> float:
    """Mean over blocks of the mean BLEU of their pairs of paths; 1 for a block with fewer than two, or without blocks."""
    blocks = re.findall(r"(?s)<Parallel>(.*?)</Parallel>", text)
    scores = []
    for block in blocks:
        pairs = [sentence_bleu(p, q) for p, q in combinations(re.findall(r"(?s)<Path>(.*?)</Path>", block), 2)]
        scores.append(sum(pairs) / len(pairs) if pairs else 1.0)
    return sum(scores) / len(scores) if scores else 1.0


@F.pandas_udf(T.DoubleType())
def mean_self_bleu(text: pd.Series) -> pd.Series:
    return text.map(lambda t: self_bleu(t or ""))


def positions(text: str) -> list[int]:
    """Position of each word or tag: paths of a block start at one place, and what follows goes on from the longest."""
    out: list[int] = []
    now, stack = 0, []  # a block: [where its paths start, the furthest end]
    for token in re.findall(rf"{ANY_TAG}|[^\s<]+|<", text):
        if token == "</Parallel>" and stack:
            now = max(now, stack.pop()[1])
        elif token == "<Path>" and stack:
            now = stack[-1][0]
        out.append(now)
        now += 1
        if token == "<Parallel>":
            stack.append([now, now])
        elif token == "</Path>" and stack:
            stack[-1][1] = max(stack[-1][1], now)
    return out


def hidden_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Pairs of token spans (start, end of one path; start, end of a sibling) whose tokens do not see each other."""
    tokens = re.findall(rf"{ANY_TAG}|[^\s<]+|<", text)
    stack: list[list[tuple[int, int]]] = []
    starts: list[int] = []
    out: list[tuple[int, int, int, int]] = []
    for at, token in enumerate(tokens):
        if token == "<Parallel>":
            stack.append([])
        elif token == "<Path>":
            starts.append(at)
        elif token == "</Path>" and starts and stack:
            stack[-1].append((starts.pop(), at + 1))
        elif token == "</Parallel>" and stack:
            out += [(*a, *b) for a, b in combinations(stack.pop(), 2)]
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def position_ids(text: pd.Series) -> pd.Series:
    return text.map(lambda t: positions(t or ""))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("s1", "e1", "s2", "e2")])))
def isolation_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("s1", "e1", "s2", "e2"), x, strict=True)) for x in hidden_spans(t or "")])
