"""Reward compositions over c (correct), p (has a block), n (blocks), f (format right), b (self-BLEU), e (efficiency)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(*cases: tuple[Column, Column | float], otherwise: Column | float) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def sign(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(-1.0)


def word_rewards(c: Column, p: Column, f: Column, b: Column) -> dict[str, Column]:
    """Rules of the word-problem sources: a wrong or missing answer is 0."""
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    return {
        "accuracy_reward": one(c),
        "emphase_acc": pick((c & p, one(f)), otherwise=one(c)),
        "emphase_parallel": pick((c & p & f, 1.2), (c & p, 0.0), (c, 1.0), otherwise=0.0),
        "emphase_parallel_add_diversity": pick((c & p & f, 1.2 - 0.2 * b), (c & p, 0.0), (c, 1.0), otherwise=0.0),
        "accuracy_add_parallel_reward": one(c) + 0.5 * one(p & f),
        "accuracy_times_special_token_reward": one(c & p & f),
        "format_times_accuracy_times_parallel_reward": one(c & p & f),
    }


def math_rewards(c: Column, n: Column, f: Column, b: Column, e: Column, step: Column) -> dict[str, Column]:
    """Rules of the competition sources: a wrong answer is -1."""
    any_block = n >= 1

    def emphasis(bonus: Column | float) -> Column:
        return pick((c & ~any_block, 1.0), (c & any_block & f, bonus), otherwise=-1.0)

    fade = F.exp(-step / 50)
    times = pick((c & any_block & f, 1.0), otherwise=-1.0)
    return {
        "accuracy_reward": sign(c),
        "emphase_acc": emphasis(1.0),
        "emphase_parallel": emphasis(1.2),
        "emphase_parallel_enhance": emphasis(2.0),
        "emphase_parallel_add_diversity": emphasis(1.2 - 0.2 * b),
        "accuracy_add_parallel_reward": sign(c) + F.when(any_block & f, 0.5).otherwise(0.0),
        "accuracy_times_parallel_reward": times,
        "format_times_accuracy_times_parallel_reward": times,
        "accuracy_parallel_reward": sign(c) + F.sqrt(n),
        "accuracy_add_diversity_reward": sign(c) - 0.3 * b,
        "accuracy_add_parallel_add_diversity_reward": sign(c) + F.when(any_block, 1.0).otherwise(0.0) - 0.3 * b,
        "accuracy_add_efficiency_reward": F.when(c, 1 + 0.4 * e).otherwise(-1 + 0.1 * e),
        "accuracy_add_efficiency_reward_decay": F.when(c, 1 + 0.4 * e * fade).otherwise(-1 + 0.1 * e * fade),
        "accuracy_parallel_interv_reward": F.when((step - 1) % 10 < 8, sign(c)).otherwise(emphasis(1.2)),
    }


def family(source: Column) -> Column:
    """The scoring family of a data source, tested in this order; null for an unknown source."""
    rules: tuple[tuple[Column, str], ...] = (
        (source.contains("GSM8k"), "word"),
        (source.isin("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"), "math"),
        ((source == "math_dapo") | source.startswith("aime") | source.contains("APO") | source.contains("HuggingFaceH4/MATH"), "competition"),
        (source.startswith("numina_"), "prime"),
        (source.isin("codecontests", "apps", "codeforces", "taco"), "code"),
        (source == "hiyouga/geometry3k", "geometry"),
        (source.startswith("searchR1_"), "search"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out


def family_or_error(source: Column) -> Column:
    """The scoring family; an unknown source ends the query with an error that names it."""
    return F.coalesce(family(source), F.raise_error(F.concat(F.lit("no scorer for the source "), F.coalesce(source, F.lit("null")))).cast("string"))


def agentic(strict: Column, turns: Column) -> Column:
    """The strict result; when wrong, a little more for each turn of tool use, at most 0."""
    return F.when(strict > 0, strict).otherwise(F.least(F.lit(0.0), strict + (turns - 2) / 2 * 0.1))


def tool_step(now: Column, before: Column, penalty: float = 0.05) -> Column:
    """Reward of a submission: nothing if it improves the score, else minus the penalty."""
    return F.when(now > before, 0.0).otherwise(-penalty)


#: Custom scorers by name: functions from (response, truth) columns to a score column.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(name: str, f: Callable[[Column, Column], Column]) -> None:
    if SCORERS.get(name, f) is not f:
        raise ValueError(f"scorer {name} exists")
    SCORERS[name] = f


def scored(response: Column, truth: Column, name: str, given: Column | None = None) -> Column:
    """A scorer's result, or the model's own score where one is `given`; a failed score counts 0."""
    own = F.coalesce(SCORERS[name](response, truth).cast("double"), F.lit(0.0))
    return own if given is None else F.coalesce(given, own)
