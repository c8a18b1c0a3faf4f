"""Grading of competition answers: the stated span, a normal form, equality by value, and the scores made of them.

Texts are read row by row in Arrow batches. Equality that symbolic algebra alone could decide beyond millrace.functions.algebra
is reported as null; scores count it as wrong.
"""

from __future__ import annotations

import math
import re
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import algebra as A
from millrace.functions.grade import balanced, braced_fractions, last_boxed, repetition, stripped

#: Units that fall away, amounts that become powers of ten, and words that part the elements of a list.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
AMOUNTS = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
BETWEEN = ((" or ", " , "), (" and ", " , "))
UNIT = re.compile(rf"(?:{'|'.join(UNITS)})(?:es)?s? *(?:\^[0-9]+)?")
#: What stands before an answer, what stands after one, and the words after which a sentence states it.
BEFORE = ("answer:", "answer is", "answers are")
AFTER = ("is answer", "is the answer", "are answers", "are the answers")
STATES = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")
#: LaTeX commands and the plain text that they become.
PLAIN = (("\\cdot", "*"), ("\\times", "*"), ("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\left", ""), ("\\right", ""), ("\\ ", " "), ("\\,", ""))
#: Exponents of which no value is taken.
NOT_READ = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")
BRACKETS = "()[]"


def plain_latex(text: str) -> str:
    """Fractions, roots, text and a few signs of LaTeX as plain text; a mixed number keeps a space before its fraction."""
    text = braced_fractions(text.replace("\\tfrac", "\\frac").replace("\\dfrac", "\\frac"))
    out, at = [], 0
    while at < len(text):
        m = re.compile(r"\\(frac|sqrt|text|mathrm|textbf)(?=\{)").match(text, at)
        if not m or (end := balanced(text, m.end())) < 0:
            out.append(text[at])
            at += 1
            continue
        first = plain_latex(text[m.end() + 1 : end - 1])
        if m[1] == "frac" and text[end : end + 1] == "{" and (last := balanced(text, end)) > 0:
            under = plain_latex(text[end + 1 : last - 1])
            out.append(f" {first}/{under}" if first.isalnum() and under.isalnum() else f" ({first})/({under})")
            end = last
        else:
            out.append(f"sqrt({first})" if m[1] == "sqrt" else f"({first})" if m[1] == "frac" else first)
        at = end
    text = re.sub(r"\\sqrt ?(\w)", r"sqrt(\1)", "".join(out))
    for command, sign in PLAIN:
        text = text.replace(command, sign)
    return text.replace("{", "").replace("}", "").strip()


def without_thousands(text: str) -> str:
    """Commas before each three digits of a number removed; commas of a list stay."""
    before = None
    while before != text:
        before, text = text, re.sub(r"(\d),(\d{3})(?!\d)", r"\1\2", text)
    return text


def whole(text: str) -> int | None:
    """The whole number that a text states, with commas or a fraction of zeros or not."""
    try:
        value = float(without_thousands(text))
    except ValueError:
        return None
    return round(value) if math.isfinite(value) and abs(value - round(value)) <= 1e-7 else None


def competition_form(text: str | None) -> str | None:
    """The normal form of a competition answer: no units, money or percent signs, plain arithmetic in lower case."""
    if text is None:
        return None
    if m := re.search(r"^\\text\{(.+?)\}$", text):
        text = m[1]
    text = re.sub(r"\\?[$%]", "", text)
    for word, sign in (*BETWEEN, *AMOUNTS):
        text = text.replace(word, sign)
    text = re.sub(r"\^ *\\circ", "", UNIT.sub("", text))
    if text[:1] == "{" and text[-1:] == "}":
        text = text[1:-1]
    text = re.sub(r",\\! *", "", text)
    if "," not in text and (n := whole(text)) is not None:
        text = str(n)
    if "\\" in text:
        text = plain_latex(text)
    text = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub(r"- *", "-", text)).lower()
    n = whole(text)
    return text if n is None else str(n)


def elements(text: str) -> list[str]:
    """The elements of one flat tuple or interval, or the text itself."""
    text = without_thousands(text)
    if not text:
        return []
    flat = len(text) > 2 and text[0] in BRACKETS and text[-1] in BRACKETS and not any(c in BRACKETS for c in text[1:-1])
    return [x.strip() for x in text[1:-1].split(",")] if flat else [text]


def same_value(one: str, two: str) -> bool | None:
    """Whether two expressions are equal; False where there is more than two unknowns, null where the algebra cannot tell."""
    both = f"({one})-({two})"
    unknown = {c for c in both.replace("sqrt", "").replace("frac", "") if c.isalpha()}
    if len(unknown) > 2 or NOT_READ.search(both):
        return False
    try:
        return A.same(one, two)
    except (A.Unsupported, ArithmeticError):
        return None


def every(found: list[bool | None]) -> bool | None:
    return False if False in found else None if None in found else True


def some(found: list[bool | None]) -> bool | None:
    return True if True in found else None if None in found else False


def graded_answer(given: str | None, truth: str) -> bool | None:
    """Equal as compared strings, in the normal form, or element by element: fractions as written, whole numbers strictly, others by value."""
    if given is None:
        return False
    if stripped(given) == stripped(truth):
        return True
    a, b = competition_form(truth), competition_form(given)
    if a == b:
        return True
    if not b or not a:
        return False
    wanted, found = elements(a), elements(b)
    if len(wanted) != len(found) or (len(wanted) > 1 and (a[0], a[-1]) != (b[0], b[-1])):
        return False

    def equal(x: str, y: str) -> bool | None:
        fraction = re.compile(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")
        if fraction.search(x) and fraction.search(y):
            return x == y
        return False if (whole(x) is None) != (whole(y) is None) else same_value(x, y)

    return every([equal(x, y) for x, y in zip(wanted, found, strict=True)])


def number(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def tidied(text: str, pi: float) -> str:
    """Without a leading dollar or a last percent sign; a number with a base as its digits; with pi as a number where that gives one."""
    if re.match(r"\$\d", text):
        return text[1:]
    if re.fullmatch(r"\d+(\.\d+)?\\?%", text):
        return text.rstrip("\\%")
    if "_" in text:
        return str(int(float(text.split("_")[0])))
    if "\\pi" in text:
        plain = re.sub(r"(?<!\d)\\pi", r"1\\pi", text).replace("\\pi", "*pi")
        try:
            return repr(float(A.decimal(A.value_of(plain, Decimal(repr(pi))))))
        except (A.Unsupported, ArithmeticError):
            return plain.replace("pi", repr(pi))
    return text


#: Names of intervals and their brackets.
INTERVALS = (("Interval", "[", "]"), ("Interval.Ropen", "[", ")"), ("Interval.Lopen", "(", "]"), ("Interval.open", "(", ")"))


def interval(text: str) -> str:
    for name, left, right in INTERVALS:
        if m := re.fullmatch(rf"{re.escape(name)}\((.*)\)", text):
            return f"{left}{m[1]}{right}"
    return text


def matrix(text: str) -> list[list[str]] | None:
    """Rows of a LaTeX matrix, of nested brackets, or of Matrix([...]); None for anything else. A literal reader: nothing is evaluated."""
    text = re.sub(r"\s+", " ", text.strip())
    if m := re.fullmatch(r"\\begin\{(?:pmatrix|bmatrix|matrix)\}(.*)\\end\{(?:pmatrix|bmatrix|matrix)\}", text):
        return [[x.strip() for x in row.split("&")] for row in re.split(r"\\\\|\\", m[1]) if row.strip()]
    if m := re.fullmatch(r"Matrix\((.*)\)", text):
        text = m[1].strip()
    if m := re.fullmatch(r"\[ ?(\[[^\[\]]*\](?: ?, ?\[[^\[\]]*\])*) ?\]", text):
        return [[x.strip() for x in row.split(",")] for row in re.findall(r"\[([^\[\]]*)\]", m[1])]
    return None


def close(a: float, b: float, tolerance: float) -> bool:
    return math.isclose(a, b, rel_tol=tolerance)


def math_equal(given: str, truth: str, pi: float = math.pi, tolerance: float = 1e-4, percent: bool = True) -> bool | None:
    """Equal but for case and spaces; as numbers, also a hundred times more or less; but for brackets; element by element; by value."""
    given, truth = tidied(given, pi)[:1000], tidied(truth, pi)
    if given.strip().lower() == truth.strip().lower() or given.replace(" ", "") == truth.replace(" ", ""):
        return True
    a, b = number(given), number(truth)
    if a is not None and b is not None:
        return any(close(x, a, tolerance) for x in ((b / 100, b, b * 100) if percent else (b,)))
    if not given:
        return False
    given, truth = interval(given.strip()), truth.strip()
    p, q = given, truth
    if (p[:1] == "[" and p[-1:] == "]" and q[:1] != "(") or (p[:1] == "(" and p[-1:] == ")" and q[:1] != "["):
        p, q = p.strip(BRACKETS), q.strip(BRACKETS)
    bare = str.maketrans("", "", "{}()")
    if p.translate(bare) == q.translate(bare):
        return True
    rows, wanted = matrix(given), matrix(truth)
    if rows is not None and wanted is not None:
        if [len(r) for r in rows] != [len(r) for r in wanted]:
            return False
        return every([math_equal(x, y, pi, tolerance, percent) for r, w in zip(rows, wanted, strict=True) for x, y in zip(r, w, strict=True)])

    def by_element(xs: list[str], ys: list[str]) -> bool | None:
        return every([math_equal(x.strip(), y.strip(), pi, tolerance, percent) for x, y in zip(xs, ys, strict=True)]) if len(xs) == len(ys) else False

    if truth and given[0] in "([" and given[-1] in ")]" and (given[0], given[-1]) == (truth[0], truth[-1]) and "," in given:
        return by_element(given[1:-1].split(","), truth[1:-1].split(","))
    if "," in given and "," in truth and given.count(",") == truth.count(","):
        if given.startswith("Point") and truth[:1] == "(" and truth[-1:] == ")":
            return by_element(given[given.find("(") + 1 : -1].split(","), truth[1:-1].split(","))
        return by_element(given.split(","), truth.split(","))
    try:
        one, two = plain_latex(given), plain_latex(truth)
        if A.same(one, two):
            return True
        return close(float(A.decimal(A.value_of(one))), float(A.decimal(A.value_of(two))), tolerance) if not A.letters(one) | A.letters(two) else False
    except (A.Unsupported, ArithmeticError):
        return None


def stated(response: str) -> tuple[bool, str]:
    """(whether an answer is stated, its span): after the words before an answer, before those after one, in the last box, in the last sentence."""
    found = False

    def after(text: str, words: tuple[str, ...]) -> str:
        nonlocal found
        for word in words:
            head, mark, tail = text.lower().rpartition(word)
            if mark:
                found, text = True, text[len(head) + len(mark) :].strip()
        return text

    text = after(response, BEFORE)
    for word in AFTER:
        if (at := text.lower().rfind(word)) >= 0:
            found, text = True, text[:at].strip()
    at = max(text.rfind("\\boxed"), -1)
    at = text.rfind("\\fbox") if at < 0 else at
    if at >= 0 and "{" in text[at:] and (end := balanced(text, text.index("{", at))) > 0 and (box := text[text.index("{", at) + 1 : end - 1].strip()):
        found, text = True, box
    if ". " in text:
        text = text.rpartition(". ")[0].strip()
    text = after(text, STATES)
    return found and any(c.isdigit() for c in text), text


def competition_score(response: str, truth: str) -> tuple[bool | None, bool, str]:
    """(correct, well formed, span): the graded answer, else equality by value, with pi also as 3.14."""
    _, span = stated(response)
    first = graded_answer(span, truth)
    if first:
        return True, True, span
    formed = "Step 2:" in response and "\\box" in response
    kinds = (math.pi, 3.14) if "\\pi" in span or "\\pi" in truth else (math.pi,)
    try:
        found = some([math_equal(span, truth, pi) for pi in kinds])
    except (ValueError, ArithmeticError):
        found = False
    return (found if found is not False or first is not None else None), formed, span


def latex_equal(given: str, truth: str) -> bool | None:
    """Equality of LaTeX; long texts that repeat themselves are refused, and an equation equals another up to its sign."""
    if any(len(x) > 128 and repetition(x) > 0.2 for x in (given, truth)):
        return False
    if competition_form(given) == competition_form(truth):
        return True
    sides = [plain_latex(x.strip("$ ")).split("=") for x in (given, truth)]
    try:
        if all(len(s) == 2 for s in sides):
            one, two = (f"({a})-({b})" for a, b in sides)
            return A.same(one, two) or A.same(one, f"-({two})")
        return A.same(sides[0][-1], sides[1][-1])
    except (A.Unsupported, ArithmeticError):
        return math_equal(given.strip("$ "), truth.strip("$ "))


def superset_graded(given: str, truth: str, fast: bool = True) -> bool | None:
    """The most lenient grader: either normal form, elements by value, and (not fast) equality of LaTeX."""
    if "\\boxed" in truth:
        truth = last_boxed(truth, wide=True) or ""
    found = graded_answer(given, truth)
    return found if found or fast else some([found, latex_equal(given, truth)])


def superset_score(response: str, truths: list[str], fast: bool = False) -> tuple[float, float, bool]:
    """(score, format score, correct) of the boxed answer against any of the truths; no box scores nothing."""
    given = last_boxed(response, wide=True) if "\\boxed" in response else None
    if given is None:
        return 0.0, 0.0, False
    right = any(superset_graded(given, t, fast) for t in truths)
    return float(right), 1.0, right


def exact(text: str) -> Fraction | None:
    """The rational value of a text in normal form, if it has one."""
    try:
        value = A.value_of(competition_form(text) or "")
    except (A.Unsupported, ArithmeticError):
        return None
    return value if isinstance(value, Fraction) else None


@F.pandas_udf(T.StringType())
def competition_answer(text: pd.Series) -> pd.Series:
    return pd.Series([competition_form(t) for t in text], dtype=object)


@F.pandas_udf(T.BooleanType())
def graded(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else graded_answer(g, t) for g, t in zip(given, truth, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def equal_by_value(given: pd.Series, truth: pd.Series) -> pd.Series:
    def one(g: str | None, t: str | None) -> bool | None:
        try:
            return False if g is None or t is None else math_equal(g, t)
        except (ValueError, ArithmeticError):
            return False

    return pd.Series([one(g, t) for g, t in zip(given, truth, strict=True)], dtype=object)


SCORED = T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("formed", T.BooleanType()), T.StructField("span", T.StringType())])


@F.pandas_udf(SCORED)
def scored(response: pd.Series, truth: pd.Series) -> pd.DataFrame:
    rows = [competition_score(r or "", t or "") for r, t in zip(response, truth, strict=True)]
    return pd.DataFrame({"correct": pd.Series([r[0] for r in rows], dtype=object), "formed": [r[1] for r in rows], "span": [r[2] for r in rows]})


SUPERSET = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("format_score", T.DoubleType()), T.StructField("acc", T.BooleanType())])


@F.pandas_udf(SUPERSET)
def superset_scored(response: pd.Series, truth: pd.Series) -> pd.DataFrame:
    rows = [superset_score(r or "", [t or ""]) for r, t in zip(response, truth, strict=True)]
    return pd.DataFrame(rows, columns=["score", "format_score", "acc"])


SPAN = T.StructType([T.StructField("stated", T.BooleanType()), T.StructField("span", T.StringType())])


@F.pandas_udf(SPAN)
def stated_answer(response: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stated(r or "") for r in response], columns=["stated", "span"])
