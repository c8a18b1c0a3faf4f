"""Hand-computed cases of competition grading, algebra, repetition, losses and estimators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import algebra as A
from millrace.functions import competition as K
from millrace.functions import rewards
from millrace.functions.grade import repetition
from millrace.operators import groups as G
from millrace.operators import losses as L
from millrace.operators import tokens as T


@pytest.mark.parametrize(
    ("given", "form"),
    [
        ("3\\text{ cm}", "3"), ("12 centimeters^2", "12"), ("\\text{5 cm}", "5"), ("1,234", "1,234".replace(",", "")), ("5 million", "5 *10^6"), ("3 \\frac{1}{2}", "3+1/2"), ("7 3/4", "7+3/4"),
        ("90^\\circ", "90"), ("2 and 3", "2 , 3"), ("- 5", "-5"), ("1.0", "1"), ("\\sqrt{2}", "sqrt(2)"), ("10,\\! 000", "10000"), ("{7}", "7"), ("X+Y", "x+y"), ("$\\frac{a+1}{2}$", "(a+1)/(2)"), ("", ""), (None, None),
    ],
)
def test_competition_form(given, form):
    assert K.competition_form(given) == form


@pytest.mark.parametrize(
    ("given", "truth", "equal"),
    [
        ("\\frac{1}{2}", "1/2", True), ("0.5", "\\frac12", True), ("2/4", "1/2", False), ("(1,2)", "(1, 2)", True), ("[1,2]", "(1,2)", False), ("x+1", "1+x", True), ("\\sqrt{8}", "2\\sqrt{2}", True),
        ("7 3/4", "31/4", True), ("5", "5.0", True), ("5.5", "5", False), ("(1,2,3)", "(1,2)", False), ("a+b+c", "c+b+a", False), (None, "1", False), ("\\frac{x^2-1}{x-1}", "x+1", True), ("x!", "y!", None), ("10,000", "10000", True),
    ],
)
def test_graded_answer(given, truth, equal):
    assert K.graded_answer(given, truth) is equal


@pytest.mark.parametrize(
    ("given", "truth", "equal"),
    [
        ("3.1416", "3.14159", True), ("50", "0.5", True), ("0.5", "50", True), ("3.2", "3.1", False), ("ABC", "abc", True), ("1 000", "1000", True), ("50%", "50", True), ("$12", "12", True), ("101_2", "101", True),
        ("2\\pi", "6.283185", True), ("(1, 2)", "(1.00001, 2)", True), ("(1,2)", "(1,3)", False), ("Interval.open(1,2)", "(1,2)", True), ("Interval.Lopen(1,2)", "(1,2]", True), ("1, 2", "1.0, 2.0", True),
        ("[[1,2],[3,4]]", "\\begin{pmatrix}1 & 2\\\\ 3 & 4\\end{pmatrix}", True), ("Matrix([[1, 2], [3, 5]])", "\\begin{pmatrix}1 & 2\\\\ 3 & 4\\end{pmatrix}", False), ("Point(1,2)", "(1,2)", True), ("\\frac{1}{3}", "0.33333", True), ("x^2", "x^3", False), ("", "1", False),
    ],
)
def test_math_equal(given, truth, equal):
    assert K.math_equal(given, truth) is equal


def test_pi_is_also_taken_as_a_short_decimal():
    assert K.competition_score("The answer is 2\\pi", "6.28")[0] is True and K.math_equal("2\\pi", "6.28") is False
    assert K.competition_score("no number", "5")[0] in (False, None)


def test_spans():
    assert K.stated("We see. The answer is 5") == (True, "5")
    assert K.stated("so \\boxed{\\frac{1}{2}} is the answer") == (True, "\\frac{1}{2}")
    assert K.stated("thus 12 is the answer. End") == (True, "thus 12")
    assert K.stated("we finally get 14") == (True, "14") and K.stated("nothing") == (False, "nothing") and K.stated("the answer is none")[0] is False


def test_superset_grader():
    assert K.superset_score("so \\boxed{x=2y}", ["2y=x"]) == (1.0, 1.0, True) and K.superset_score("so \\boxed{x=2y}", ["2y=x"], fast=True) == (0.0, 1.0, False)
    assert K.superset_score("no box", ["1"]) == (0.0, 0.0, False) and K.superset_score("\\boxed{3}", ["2", "\\boxed{3}"]) == (1.0, 1.0, True)
    assert K.latex_equal("ab" * 100, "ab" * 100) is False


def test_algebra_is_exact_and_bounded():
    assert A.same("(x+1)^2", "x^2+2x+1") and A.same("2pi r", "r*pi*2") and A.same("sqrt(2)", "1.41421356237309504880168872420969807856967") and not A.same("sqrt(2)", "1.41421356237309504880") and A.same("-2^2", "-4") and A.same("2^3^2", "512")
    for bad in ("1/0", "(1", "2**", "9^9^9^9", "x" * 500, "a; b", "(0-1)^(1/2)", "__"):
        with pytest.raises((A.Unsupported, ArithmeticError)):
            A.Reader(bad, 0).value()


def test_repetition_against_sorted_suffixes():
    def brute(t):
        s = sorted(t[i:] for i in range(len(t)))
        common = sum(next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(s, s[1:], strict=False))
        return 2 * common / (len(t) * (len(t) + 1)) if t else 0.0

    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abé") for _ in range(rng.randrange(40)))
        assert repetition(t) == pytest.approx(brute(t))
    assert repetition("a" * 300_000) > 0.99


def test_unknown_source_is_an_error(spark):
    rows = spark.createDataFrame([("nowhere",)], "s string")
    with pytest.raises(Exception, match="no scorer for the source nowhere"):
        rows.select(rewards.family_or_error(F.col("s"))).collect()


def test_policy_loss_registry(spark):
    tokens = spark.createDataFrame([(1, 1, -0.5, -0.6, 1.0, 1), (1, 2, -1.0, -0.2, -2.0, 1), (2, 1, -0.3, -0.3, 9.0, 0)], "uid long, t long, logp double, old double, adv double, mask int")
    with pytest.raises(ValueError, match="no policy loss"):
        L.policy_loss("none")
    L.register_policy_loss("mine")(lambda tokens: tokens)
    assert L.policy_loss("mine")(tokens) is tokens
    del L.POLICY_LOSSES["mine"]
    row = L.policy_loss("vanilla")(tokens).first()
    want = (-1.0 * math.exp(0.1) + 2.0 * 0.8) / 2
    assert row["loss"] == pytest.approx(want) and row["clip_fraction"] == pytest.approx(0.5) and row["kl"] == pytest.approx((-0.1 + 0.8) / 2)
    assert L.policy_loss("gpg")(tokens).first()["loss"] == pytest.approx((0.5 - 2.0) / 2)
    top = L.policy_loss("kl_cov")(tokens, share=0.5, coefficient=10.0).first()["loss"]
    assert top == pytest.approx((-math.exp(0.1) + 2 * math.exp(-0.8) + 10 * 0.1) / 2)
    same = L.policy_loss("clip_cov")(tokens, share=1.0, least=5.0, most=9.0).first()
    assert same["clip_fraction"] == 0 and same["loss"] == pytest.approx(want)
    with pytest.raises(ValueError):
        L.policy_loss("clip_cov")(tokens, share=0.0)


def test_masked_steps_do_not_matter_to_advantages(spark):
    """Values where the mask is 0 change no advantage; long responses fold in runs as short ones do."""
    rng = random.Random(3)
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rows = [[rng.random() for _ in mask] for _ in range(3)]

    def frame(values):
        return spark.createDataFrame([(1, t, rows[0][t], values[t], m) for t, m in enumerate(mask)], "uid long, t int, reward double, value double, mask int")

    a = G.token_estimator("gae")(frame(rows[1]), gamma=0.99, lam=0.95).orderBy("t").collect()
    b = G.token_estimator("gae")(frame([v if m else rows[2][t] for t, (v, m) in enumerate(zip(rows[1], mask, strict=True))]), gamma=0.99, lam=0.95).orderBy("t").collect()
    assert all(x["advantage"] == pytest.approx(y["advantage"]) for x, y, m in zip(a, b, mask, strict=True) if m)
    n = 3 * T.STEPS + 5
    long = spark.range(n).select(F.lit(1).alias("uid"), F.col("id").cast("int").alias("t"), (F.col("id") % 7 / 10.0).alias("reward"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("mask"))
    run, want = 0.0, {}
    for t in range(n - 1, -1, -1):
        run = t % 7 / 10 + 0.9 * run
        want[t] = run
        run *= t % 5 != 0
    got = {r["t"]: r["ret"] for r in T.discounted_returns(long, 0.9).collect()}
    assert len(got) == n and all(got[t] == pytest.approx(want[t]) for t in want)


def test_estimators_are_found_by_name(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 1.0, True), (1, 2, 4.0, 1.0, False)], "uid long, idx long, score double, len double, acc boolean")
    assert [r.advantage for r in G.estimator("remax")(rows).orderBy("idx").collect()] == [1.0, 3.0]
    assert [r.advantage for r in G.estimator("prime")(rows).orderBy("idx").collect()] == [-2.0 + 1.0, 2.0 - 1.0]
    for f in (G.estimator, G.token_estimator):
        with pytest.raises(ValueError):
            f("none")


def test_runs_are_ranked_across_blocks(spark, monkeypatch):
    """Runs of a value that pass the ends of ranges and blocks, in a key that has most rows."""
    from millrace.sources import io

    monkeypatch.setattr(io, "RUN", 7)
    rng = random.Random(2)
    rows = [("hot" if i % 9 else "x", i, rng.choice([1, 1, 1, 2, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(5)
    want, last = {}, {}
    for k, i, v in sorted(rows):
        n = last[k][1] + 1 if k in last and v is not None and last[k][0] == v else 0
        last[k] = (v, n)
        want[i] = n
    assert {r.i: r.n for r in io.ranked_in_runs(df, "k", ["i"], "v", "n").collect()} == want


def test_substrings_in_passes(spark, monkeypatch):
    """Short and empty patterns, nulls, and more patterns than one pass holds."""
    from millrace.operators import substrings as S

    texts = [(1, "the cat sat"), (2, "concatenate"), (3, None), (4, ""), (5, "cat")]
    patterns = [(1, "cat"), (2, "the cat"), (3, ""), (4, None), (5, "dog"), (6, "cat")]
    want = sorted((a, b, t == p) for a, t in texts for b, p in patterns if t is not None and p is not None and p in t)
    t, p = spark.createDataFrame(texts, "a long, t string"), spark.createDataFrame(patterns, "b long, p string")
    for chars in (1 << 20, 3):
        monkeypatch.setattr(S, "PATTERN_CHARS", chars)
        assert sorted(tuple(r) for r in S.substrings_found(t, "a", "t", p, "b", "p").collect()) == want


def test_templates_are_read_and_filled(spark, tmp_path):
    from millrace.sources import io

    (tmp_path / "form.txt").write_text("Solve {Problem} twice: {Problem}")
    row = spark.range(1).select(io.filled(io.template(str(tmp_path / "form.txt")), F.lit("1+1")).alias("x")).first()
    assert row.x == "Solve 1+1 twice: 1+1"


def test_shared_folders_are_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    from millrace.sources import io

    far = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://far:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        io.work_folder(far, "x")
    assert io.work_folder(spark, "x") != io.work_folder(spark, "x")
