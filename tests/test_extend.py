"""Extension points."""

import time

import pytest

from millrace.functions import extend


def test_scorer_from_a_file(tmp_path):
    (tmp_path / "own.py").write_text("def score(a, b, bonus=0):\n    return float(a == b) + bonus\n")
    assert extend.from_file(str(tmp_path / "own.py"), "score", bonus=1)("x", "x") == 2
    with pytest.raises(AttributeError):
        extend.from_file(str(tmp_path / "own.py"), "other")




def test_rows_are_guarded(spark):
    def score(a, b):
        if a == "slow":
            time.sleep(5)
        return {"ok": 1.0}[a]

    df = spark.createDataFrame([("ok", "t", None), ("slow", "t", None), ("bad", "t", None), ("bad", "t", 0.5)], "r string, t string, m double")
    found = [(r.score, r.error) for r in extend.score_rows(df, score, "r", "t", 0.5, "m").collect()]
    assert found == [(1.0, None), (0.0, "TimeoutError"), (0.0, "KeyError"), (0.5, None)]


def test_batches(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "r string, t string")
    assert [r.score for r in extend.score_batches(df, lambda r, t: [x == y for x, y in zip(r, t, strict=True)], "r", "t").collect()] == [1.0, 0.0]


def test_names_are_taken_once():
    own = extend.Registry()
    own.add("a")(1)
    own.add("a")(1)
    with pytest.raises(ValueError):
        own.add("a")(2)
    with pytest.raises(KeyError, match="there are a"):
        own["b"]
