"""Grading of mathematical answers, row by row in Arrow batches; nothing of a text is ever evaluated as code."""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balanced(text: str, at: int) -> int:
    """End of the braces that open first at or after `at`; -1 if they never close."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if text[i] == "}" and depth == 0:
            return i + 1
    return -1


def last_boxed(text: str, wide: bool = False) -> str | None:
    r"""Contents of the last \boxed{...}; with `wide` also of \fbox and of "\boxed x" up to the next dollar sign."""
    at = text.rfind(r"\boxed{" if not wide else r"\boxed")
    if wide and (spaced := text.rfind(r"\boxed ")) >= 0 and spaced == at:
        return text[at + 7 :].split("$")[0]
    if at < 0 and wide:
        at = text.rfind(r"\fbox")
    if at < 0 or (end := balanced(text, at)) < 0:
        return None
    return text[text.index("{", at) + 1 : end - 1]


def braced_fractions(text: str) -> str:
    r"""\frac12 and its like with braces."""
    return re.sub(r"\\frac([^{\s])(?:(\{)|(.))", lambda m: rf"\frac{{{m[1]}}}" + ("{" if m[2] else f"{{{m[3]}}}"), text)


#: What is removed or replaced in a compared answer before its fractions are looked at.
TIDIED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))


def stripped(text: str) -> str:
    """The form in which two answers are compared as strings."""
    for before, after in TIDIED:
        text = text.replace(before, after)
    head, unit, _ = text.partition("\\text{ ")
    text = (head if unit else text).replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not text:
        return text
    text = "0" + text if text[0] == "." else text
    name, equals, rest = text.partition("=")
    if equals and "=" not in rest and len(name) <= 2:
        text = rest
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    text = braced_fractions(text)
    if text == "0.5":
        return r"\frac{1}{2}"
    m = re.fullmatch(r"(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))", text)
    return rf"\frac{{{m[1]}}}{{{m[2]}}}" if m else text


def as_number(text: str) -> Fraction | None:
    """An exact number from digits, a fraction or a percentage; None for anything else, which is not graded by value."""
    t = text.strip().strip("$").replace(",", "").replace(" ", "")
    percent = t.endswith(("%", "\\%"))
    t = t.rstrip("%").rstrip("\\")
    if m := re.fullmatch(r"(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}", stripped(t)):
        value = Fraction(int(m[2]), int(m[3])) * (-1 if m[1] else 1) if int(m[3]) else None
    elif re.fullmatch(r"-?\d+/\d+", t):
        value = Fraction(t) if int(t.split("/")[1]) else None
    elif re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)", t):
        value = Fraction(t)
    else:
        return None
    return value / 100 if percent and value is not None else value


def parts(text: str) -> list[str] | None:
    """Elements of a tuple, set or interval; None if it is none."""
    t = text.strip()
    if len(t) < 2 or t[0] not in "([{" or t[-1] not in ")]}":
        return None
    return [x.strip() for x in t[1:-1].split(",")]


def graded(given: str | None, truth: str | None) -> bool | None:
    """Whether two answers are equal: as compared strings, or exactly as numbers, or element by element.

    None: neither string nor number decides (a symbolic answer), which is reported and never guessed.
    """
    if given is None or truth is None:
        return False
    a, b = stripped(given), stripped(truth)
    if a == b or a.lower().replace(" ", "") == b.lower().replace(" ", ""):
        return True
    x, y = as_number(given), as_number(truth)
    if x is not None and y is not None:
        return any(abs(x - r) <= Fraction(1, 10_000) * abs(r) for r in (y / 100, y, y * 100)) if y else x == 0
    p, q = parts(a), parts(b)
    if p is not None and q is not None:
        if len(p) != len(q) or (a[0], a[-1]) != (b[0], b[-1]):
            return False
        found = [graded(s, t) for s, t in zip(p, q, strict=True)]
        return False if False in found else None if None in found else True
    return None if re.search(r"[a-zA-Z\\]", a + b) else False


def repetition(text: str) -> float:
    """Twice the sum of the longest common prefixes of neighbouring suffixes, over n (n + 1): near 1 for one letter, 0 for none.

    Ranks of the substrings of 1, 2, 4, ... characters sort the suffixes; read back from the longest, they add up to
    the common prefixes. Arrays of numbers only: some 8 bytes a character for each doubling.
    """
    n = len(text)
    if n < 2:
        return 0.0
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while width < n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        levels.append(rank)
        width *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = 0
    for ranks in reversed(levels):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[a[inside]] == ranks[b[inside]]]
        a[same] += width
        b[same] += width
        common += width * len(same)
        width //= 2
    return 2 * common / (n * (n + 1))


#: What may stand before an answer in a sentence.
MARKERS = ("answer:", "answer is:", "answer is", "answers are", "answer are")


def answer_span(text: str) -> str | None:
    """The part of a response that states its answer: a box, or what follows the last marker up to the sentence's end; it must hold a digit."""
    boxed = last_boxed(text, wide=True)
    span = boxed
    if span is None:
        low = text.lower()
        at = max(((low.rfind(m) + len(m), m) for m in MARKERS if m in low), default=None)
        span = re.split(r"\.\s|\n", text[at[0] :])[0].strip().rstrip(".") if at else None
    return span if span and re.search(r"\d", span) else None


@F.pandas_udf(T.StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(lambda t: last_boxed(t or ""))


@F.pandas_udf(T.StringType())
def stripped_answer(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else stripped(t))


@F.pandas_udf(T.BooleanType())
def grade_answer(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([graded(a, b) for a, b in zip(given, truth, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def repetition_share(text: pd.Series) -> pd.Series:
    return text.map(lambda t: repetition(t or ""))


@F.pandas_udf(T.StringType())
def stated_span(text: pd.Series) -> pd.Series:
    return text.map(lambda t: answer_span(t or ""))


def evaluate(expression: str) -> Fraction | None:
    """Value of an expression of integers, + - * / @ (x @ y = 3 x - 2 y) and parentheses; None if it is malformed or divides by 0."""
    tokens, at = re.findall(r"\d+|[-+*/@()]", expression), 0
    if "".join(tokens) != re.sub(r"\s+", "", expression):
        return None

    def factor() -> Fraction:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            value = total()
            if tokens[at] != ")":
                raise ValueError
            at += 1
            return value
        return -factor() if token == "-" else Fraction(int(token))

    def product() -> Fraction:
        nonlocal at
        value = factor()
        while at < len(tokens) and tokens[at] in "*/@":
            sign, at = tokens[at], at + 1
            other = factor()
            value = value * other if sign == "*" else value / other if sign == "/" else 3 * value - 2 * other
        return value

    def total() -> Fraction:
        nonlocal at
        value = product()
        while at < len(tokens) and tokens[at] in "+-":
            sign, at = tokens[at], at + 1
            value = value + product() if sign == "+" else value - product()
        return value

    try:
        value = total()
    except (ValueError, IndexError, ZeroDivisionError):
        return None
    return value if at == len(tokens) else None


def judged(boxed: Column, rule: Column, split: Column) -> Column:
    """The score of a judging model's boxed verdict: 1 for True, else 0; rows of the test split keep the rule's score."""
    return F.when(split == "test", rule).otherwise(F.when(boxed == "True", 1.0).otherwise(0.0))
