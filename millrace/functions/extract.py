"""Answer extraction and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters from the end of a response that the base scorers read.
TAIL = 300

#: Replacements and removals of the final-answer normaliser, in the order in which they apply.
REPLACED = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3",
    "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
#: Regular expressions of the same normaliser with what they become, in order.
REWRITES = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}"),
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def replaced(text: Column, before: str, after: str) -> Column:
    return F.replace(text, F.lit(before), F.lit(after))


def plain_number(text: Column) -> Column:
    return F.translate(text, ",$", "")


def final_answer(text: Column) -> Column:
    """The last `Final Answer: number` of the last 300 characters, without commas; null if none."""
    found = F.regexp_extract_all(F.substring(text, -TAIL, TAIL), F.lit(r"Final Answer: (-?[0-9.,]+)"), F.lit(1))
    return plain_number(F.try_element_at(found, F.lit(-1)))


def last_number(text: Column) -> Column:
    """The last number-like run of the last 300 characters that is not a lone point; if all are, the first."""
    found = F.regexp_extract_all(F.substring(text, -TAIL, TAIL), F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: ~x.isin("", ".")), F.lit(-1)), F.try_element_at(found, F.lit(1)))


def first_final_answer(text: Column) -> Column:
    """The first `Final Answer: number` of the whole text, with any white space between; null if none."""
    found = F.regexp_extract_all(text, F.lit(r"Final Answer:\s*(-?[0-9.,]+)"), F.lit(1))
    return plain_number(F.try_element_at(found, F.lit(1)))


def hash_answer(text: Column) -> Column:
    """What follows `#### `, without commas."""
    return F.translate(F.try_element_at(F.regexp_extract_all(text, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1)), F.lit(1)), ",", "")


def normalized(answer: Column) -> Column:
    """The final-answer normaliser: what follows the last `=`, then the lists above, then digit commas."""
    out = F.substring_index(answer, "=", -1)
    for before, after in REPLACED:
        out = replaced(out, before, after)
    for word in REMOVED:
        out = replaced(out, word, "")
    for pattern, to in REWRITES:
        out = F.regexp_replace(out, pattern, to)
    out = replaced(out, "$", "")
    return F.trim(F.when(F.regexp_like(replaced(out, ",", ""), F.lit("^[0-9]+$")), replaced(out, ",", "")).otherwise(out))


def stated_answer(text: Column) -> Column:
    """The rest of the line after the last `Final Answer:` in any case; `[INVALID]` if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)Final Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def qa_normalized(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and repeated white space."""
    out = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(a|an|the)\b", " "), r"\s+", " "))


def choice_letter(text: Column) -> Column:
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"), F.lit(1)), F.lit(1)))


def tool_calls(text: Column) -> Column:
    """(name, arguments as JSON) of each well-formed `<tool_call>` of a text."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.transform(raw, lambda r: F.struct(F.get_json_object(r, "$.name").alias("name"), F.get_json_object(r, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_tool_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")


def last_code(text: Column) -> Column:
    """What stands between the last ```` ```python ```` and the next fence."""
    return F.split_part(F.split_part(text, F.lit("```python"), F.lit(-1)), F.lit("```"), F.lit(1))


def tagged_answer(text: Column) -> Column:
    """The contents of the last <answer>...</answer>, trimmed; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def search_score(text: Column, golds: Column, exact: bool = True, form: float = 0.0, most_tags: int = 10) -> Column:
    """1 if the tagged answer is one of the golds (or, not exact, holds one), a quarter of it beyond `most_tags` answer tags; `form` if wrong, 0 without an answer."""
    own = qa_normalized(tagged_answer(text))
    hit = F.exists(golds, lambda g: (qa_normalized(g) == own) if exact else F.contains(own, qa_normalized(g)))
    count = lambda tag: (F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)
    many = (count("<answer>") > most_tags) | (count("</answer>") > most_tags) if exact else F.lit(False)
    return F.when(own.isNull(), 0.0).when(hit, F.when(many, 0.25).otherwise(1.0)).otherwise(form)
