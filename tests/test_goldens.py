"""Hand-computed cases and properties of the operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import extract, grade, rewards, tags
from millrace.operators import balance, batch, evaluate, groups, prep, retrieval, tokens
from millrace.sources import io


def obs(spark, values, **more):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, obs int")


def test_reorder_and_inverse(spark):
    df = obs(spark, [1, 2, 3, 4, 5, 6])
    order = [3, 4, 2, 0, 1, 5]
    p = spark.createDataFrame([(place, row) for place, row in enumerate(order)], "place long, row_id long")
    out = batch.reorder(df, p).orderBy("place")
    assert [r.obs for r in out.collect()] == [4, 5, 3, 1, 2, 6]
    back = batch.reorder(out.select(F.col("place").alias("row_id"), "obs"), batch.inverse(p)).orderBy("place")
    assert [r.obs for r in back.collect()] == [1, 2, 3, 4, 5, 6]


def test_chunk_needs_a_divisor(spark):
    df = obs(spark, range(6))
    assert [r.chunk for r in batch.chunk(df, 2, 6).orderBy("row_id").collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        batch.chunk(df, 5, 6)


@pytest.mark.parametrize(("divisor", "expected"), [(2, "abca"), (3, "abc"), (7, "abcabca")])
def test_pad_cycles_from_the_front(spark, divisor, expected):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "row_id long, c string")
    padded = batch.pad_to_divisor(df, divisor, 3)
    assert "".join(r.c for r in padded.orderBy("row_id").collect()) == expected
    assert "".join(r.c for r in batch.unpad(padded).orderBy("row_id").collect()) == "abc"


def test_repeat_orders(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "row_id long, c string")
    for interleave, expected in ((True, "aabbcc"), (False, "abcabc")):
        assert "".join(r.c for r in batch.repeat(df, 2, F.lit(3), interleave).orderBy("place").collect()) == expected
    counted = df.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(0), F.lit(2)), (F.col("row_id") + 1).cast("int")))
    assert "".join(r.c for r in batch.repeat_by(counted, F.col("n")).orderBy("row_id", "copy").collect()) == "aaacc"


def test_union_of_columns_checks_shared_ones(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "row_id long, x double")
    b = a.withColumn("y", F.lit(1))
    assert batch.union_columns(a, b).count() == 2
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, b.withColumn("x", F.lit(2.0))).collect()
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, b.where("row_id = 0")).collect()


def test_majority_ties_go_to_the_first_seen(spark):
    rows = [(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7), (2, 0, "B", 0.1), (2, 1, "A", 0.2)]
    found = groups.majority(spark.createDataFrame(rows, "uid int, idx int, pred string, score double"))
    assert {(r.uid, r.vote, r.value) for r in found.collect()} == {(1, "A", 0.9), (2, "B", 0.1)}


def test_singletons_of_each_estimator(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 5.0), (2, 0, 1.0, 1.0), (2, 1, 3.0, 3.0)], "uid int, idx int, score double, len double")
    first = lambda name, **o: {(r.uid, r.idx): r.advantage for r in groups.estimator(name)(df, **o).collect()}
    assert first("grpo")[1, 0] == pytest.approx(2.0, abs=1e-5)
    assert first("rloo") == {(1, 0): 2.0, (2, 0): -2.0, (2, 1): 2.0}
    assert first("opo")[2, 0] == pytest.approx(1 - 10 / 4)
    passed = first("pass_at_k", by_std=False)
    assert passed[1, 0] is None and passed[2, 0] == 0 and passed[2, 1] == 2
    with pytest.raises(ValueError):
        groups.estimator("none")
    with pytest.raises(ValueError):
        groups.register_estimator("grpo", groups.rloo)


def test_mean_at_two(spark):
    df = spark.createDataFrame([("s", 1, 0.8), ("s", 1, 0.9)], "data_source string, uid int, score double")
    assert {r.metric: round(r.value, 6) for r in evaluate.mean_std_at_n(df).collect()} == {"mean@2": 0.85, "std@2": 0.05}


def test_bootstrap_bounds():
    mean, _ = evaluate.bootstrap(np.arange(1, 6), 3, lambda x: x.mean(1), 100)
    top, _ = evaluate.bootstrap(np.arange(1, 6), 3, lambda x: x.max(1), 100)
    assert abs(mean - 3) < 0.3 and 3.5 < top < 5
    with pytest.raises(ValueError):
        evaluate.bootstrap(np.array([]), 1, lambda x: x.mean(1))


def test_exact_extremes_agree_with_resampling(spark):
    values = np.random.default_rng(1).random(8)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "uid int, idx int, score double")
    found = {r.n: (r.best, r.worst) for r in evaluate.expected_extremes(df).collect()}
    assert set(found) == {2, 4, 8}
    assert found[4][0] == pytest.approx(evaluate.bootstrap(values, 4, lambda x: x.max(1), 4000)[0], abs=0.02)
    assert found[4][1] == pytest.approx(evaluate.bootstrap(values, 4, lambda x: x.min(1), 4000)[0], abs=0.02)


def python_gae(r, v, m, gamma, lam):
    nxt = last = 0.0
    out = []
    for t in reversed(range(len(r))):
        a = r[t] + gamma * nxt - v[t] + gamma * lam * last
        nxt, last = v[t] * m[t] + (1 - m[t]) * nxt, a * m[t] + (1 - m[t]) * last
        out.append(last)
    return out[::-1]


def test_gae_ignores_values_on_masked_tokens(spark):
    rng = random.Random(3)
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    r = [rng.random() for _ in mask]
    v = [rng.random() for _ in mask]
    w = [x if m else rng.random() for x, m in zip(v, mask, strict=True)]
    rows = [(u, t, r[t], vs[t], mask[t]) for u, vs in ((1, v), (2, w)) for t in range(len(mask))]
    found = tokens.gae(spark.createDataFrame(rows, "uid int, t int, reward double, value double, mask int"), 0.9, 0.8).collect()
    by = {(x.uid, x.t): x.advantage for x in found}
    assert [by[1, t] for t in range(len(mask))] == pytest.approx([by[2, t] for t in range(len(mask))])
    assert [by[1, t] for t in range(len(mask))] == pytest.approx(python_gae(r, v, mask, 0.9, 0.8))


def test_loss_modes_and_their_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 3.0, 1), (2, 5.0, 1), (2, 9.0, 0)], "uid int, x double, mask int")
    loss = lambda mode, width=None: tokens.loss_aggregate(df, "x", "mask", "uid", mode, width).first().loss
    assert loss("token-mean") == pytest.approx(3) and loss("seq-mean-token-sum") == pytest.approx(4.5)
    assert loss("seq-mean-token-mean") == pytest.approx(3.5) and loss("seq-mean-token-sum-norm", 3) == pytest.approx(3)
    with pytest.raises(ValueError):
        loss("seq-mean-token-sum-norm")


@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_every_row_is_in_one_part(lengths, k):
    for parts in (balance.differencing(lengths, k), balance.greedy(lengths, k)):
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(lengths)))


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_micro_batches_cover_all(lengths):
    parts = balance.micro_batches(lengths, 300)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    assert len(parts) == min(len(lengths), -(-sum(lengths) // 300))


def test_differencing_golden():
    assert sorted(sum((8, 7, 6, 5, 4)[i] for i in p) for p in balance.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    equal = balance.differencing([5, 1, 4, 2, 3, 6], 3, True)
    assert [len(p) for p in equal] == [2, 2, 2]
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, True)


@pytest.mark.parametrize(
    ("text", "wrong"),
    [
        ("plain", False),
        ("<Parallel><Path>a</Path><Path>b</Path></Parallel><Summary>s</Summary>", False),
        ("<Parallel><Path>a</Path><Path><Parallel><Path>c</Path><Path>d</Path></Parallel><Summary>t</Summary></Path></Parallel><Summary>s</Summary>", False),
        ("<Parallel><Path>a</Path><Path>b</Path>", True),
        ("<Parallel><Path>a</Path></Parallel><Summary>s</Summary>", True),
        ("<Parallel><Path>a</Path><Path>b</Path></Parallel>", True),
        ("<Summary>s</Summary>", True),
        ("</Path>", True),
    ],
)
def test_tag_format(text, wrong):
    assert bool(tags.format_errors(text)) is wrong


def test_efficiency_by_hand(spark):
    text = "a b <Parallel><Path>c d e </Path><Path>f </Path><Summary>g </Summary></Parallel> h"
    df = spark.createDataFrame([(text,), ("",), ("x",)], "t string")
    found = [r.e for r in df.select(tags.efficiency(F.col("t")).alias("e")).collect()]
    assert found == pytest.approx([(8 - (3 + 3 + 1)) / 8, 0, 0])


def test_self_bleu():
    same = "<Parallel><Path>the cat sat on the mat</Path><Path>the cat sat on the mat</Path></Parallel>"
    assert tags.self_bleu(same) == pytest.approx(1) and tags.self_bleu("none") == 1
    other = "<Parallel><Path>one two three four</Path><Path>five six seven eight</Path></Parallel>"
    assert tags.self_bleu(other) < 0.2


def test_positions_restart_in_each_path():
    found = tags.positions("x <Parallel> <Path> a b </Path> <Path> c </Path> </Parallel> y")
    assert found == [0, 1, 2, 3, 4, 5, 2, 3, 4, 6, 7]
    assert tags.hidden_spans("x <Parallel> <Path> a b </Path> <Path> c </Path> </Parallel> y") == [(2, 6, 6, 9)]


@pytest.mark.parametrize(
    ("text", "strict", "flexible"),
    [("Final Answer: 1,234 Final Answer: -5.", "-5.", "-5."), ("no number", None, None), ("so . and 7", None, "7"), ("x" * 290 + "Final Answer: 12" + "y" * 400, None, None)],
)
def test_extraction(spark, text, strict, flexible):
    df = spark.createDataFrame([(text,)], "t string").select(extract.final_answer(F.col("t")).alias("a"), extract.last_number(F.col("t")).alias("b"))
    assert tuple(df.first()) == (strict, flexible)


@pytest.mark.parametrize(("raw", "clean"), [("x = \\frac12", "\\frac{1}{2}"), ("1,234 dollars", "1234"), ("\\text{5 cm}", "5"), ("$3\\sqrt2$", "3\\sqrt{2}"), ("\\boxed{7}", "7")])
def test_normaliser(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(extract.normalized(F.col("t"))).first()[0] == clean


@pytest.mark.parametrize(
    ("given_", "truth", "equal"),
    [("0.5", "\\frac{1}{2}", True), ("1/2", "\\frac12", True), ("50\\%", "0.5", True), ("3", "4", False), ("(1,2)", "(1, 2)", True), ("(1,2)", "[1,2]", False), ("x+1", "1+x", None), ("1,000", "1000", True), (None, "1", False)],
)
def test_grading_never_guesses(given_, truth, equal):
    assert grade.graded(given_, truth) is equal


def test_boxed():
    assert grade.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert grade.last_boxed("\\boxed{3") is None and grade.last_boxed("none") is None
    assert grade.last_boxed("\\boxed 5$ x", wide=True) == "5" and grade.last_boxed("\\fbox{9}", wide=True) == "9"


def test_expression_reader():
    assert grade.evaluate("(1 + 2) * 3") == 9 and grade.evaluate("2 @ 3") == 0 and grade.evaluate("-4/2") == -2
    for bad in ("1 +", "(1", "1/0", "__import__('os')", "1 2"):
        assert grade.evaluate(bad) is None


def test_repetition():
    assert grade.repetition("aaaa") > 0.2 > grade.repetition("abcd") == 0


def test_reward_family_order(spark):
    df = spark.createDataFrame([("x/GSM8k",), ("DAPO",), ("aime25",), ("unknown",)], "s string")
    assert [r[0] for r in df.select(rewards.family(F.col("s"))).collect()] == ["word", "competition", "competition", None]


def test_custom_scorer_and_model_score(spark):
    rewards.register_scorer("same", lambda response, truth: (response == truth).cast("double"))
    df = spark.createDataFrame([("a", "a", None), ("a", "b", None), (None, "b", None), ("a", "b", 0.7)], "r string, t string, m double")
    found = [r[0] for r in df.select(rewards.scored(F.col("r"), F.col("t"), "same", F.col("m"))).collect()]
    assert found == [1.0, 0.0, 0.0, 0.7]


def test_role_errors(spark):
    rows = [([("system", "a"), ("user", "b")],), ([("user", "a"), ("system", "b")],), ([("robot", "a")],), ([],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(prep.role_errors(F.col("m"))).collect()] == [None, "system after the first turn", "unknown role", None]


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>")
    cut = lambda *a: df.select(tokens.pad_or_cut(F.col("x"), *a)).first()[0]
    assert cut(3, F.lit(0), False, "left") == [3, 4, 5] and cut(3, F.lit(0), False, "right") == [1, 2, 3]
    assert cut(3, F.lit(0), False, "middle") == [1, 4, 5] and cut(3, F.lit(0)) is None and cut(7, F.lit(0), True) == [0, 0, 1, 2, 3, 4, 5]


def test_flops_and_overlong(spark):
    df = spark.createDataFrame([(10.0,), (20.0,)], "n double")
    assert df.agg(evaluate.flops(F.col("n"), 2, 3, 4, 5)).first()[0] == 6 * 2 * 30 + 12 * 3 * 4 * 5 * 500
    assert df.select(tokens.overlong_penalty(F.col("n"), 20, 10, 1.0)).collect()[1][0] == -1.0


def test_split_slice_and_dump(spark, tmp_path):
    df = spark.range(100).withColumn("text", F.concat(F.lit("a1b"), F.col("id").cast("string")))
    assert io.split_slice(df, 0, 0.75, ["id"]).agg(F.max("id"), F.count("*")).first()[:] == (74, 75)
    io.write_dump(df.withColumn("step", F.lit(3)), str(tmp_path / "d"))
    back = io.read_dump(spark, str(tmp_path / "d"), "id long, text string, step int", "[0-9]+")
    assert back.count() == 100 and {r.text for r in back.collect()} == {"a*b*"} and back.select("step").first()[0] == 3
    corpus = spark.createDataFrame([("1", '"T"\nbody\nmore'), ("2", "only")], "id string, contents string")
    corpus.write.json(str(tmp_path / "c"))
    assert {tuple(r) for r in io.read_corpus(spark, str(tmp_path / "c")).collect()} == {("1", "T", "body\nmore"), ("2", "only", "")}


def test_dense_top_k_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.random(4)]) for i in range(40)], "id long, v array<double>")
    q, c = df.where("id < 6").withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "cid")
    one = {tuple(r) for r in retrieval.top_k_dense(q, c, 3).select("qid", "cid", "rank").collect()}
    monkeypatch.setattr(retrieval, "SMALL_QUERIES", 2)
    assert {tuple(r) for r in retrieval.top_k_dense(q, c, 3).select("qid", "cid", "rank").collect()} == one


def test_kl_kinds(spark):
    df = spark.createDataFrame([(-1.0, -2.0)], "a double, b double")
    get = lambda k: df.select(tokens.kl(F.col("a"), F.col("b"), k)).first()[0]
    assert get("k1") == 1 and get("k2") == 0.5 and get("k3") == pytest.approx(math.exp(-1) + 1 - 1)
    with pytest.raises(ValueError):
        get("full")
