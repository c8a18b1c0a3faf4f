"""Queries on answer extraction, tagged text and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.functions import extract as X
from millrace.functions import grade, rewards, tags
from millrace.operators import substrings as S
from millrace.plans import views as V

STRICT = r"replace(replace(regexp_extract_all(right(response, 300), 'Final Answer: (-?[0-9.,]+)', 1)[-1], ',', ''), '$', '')"
FIRST = r"replace(replace(regexp_extract_all(response, 'Final Answer:\s*(-?[0-9.,]+)', 1)[1], ',', ''), '$', '')"


@register(f"SELECT doc_id, {STRICT} AS answer, {STRICT} = truth AS correct FROM answers")
def extract_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.final_answer(F.col("response"))
    return V.answers(spark, sf_dir).select("doc_id", a.alias("answer"), (a == F.col("truth")).alias("correct"))


@register(r"SELECT doc_id, coalesce(list_filter(m, lambda x: x NOT IN ('', '.'))[-1], m[1]) AS answer FROM (SELECT doc_id, regexp_extract_all(right(response, 300), '(-?[0-9.,]+)', 1) AS m FROM answers)")
def extract_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("doc_id", X.last_number(F.col("response")).alias("answer"))


@register(f"SELECT doc_id, {FIRST} AS answer FROM answers")
def extract_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("doc_id", X.first_final_answer(F.col("response")).alias("answer"))


def sql_normalized(column: str) -> str:
    """The normaliser as SQL, from the same lists."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"list_last(string_split({column}, '='))".replace("list_last(", "list_extract(").replace("'='))", "'='), -1)")
    for before, after in X.REPLACED:
        out = f"replace({out}, {q(before)}, {q(after)})"
    for word in X.REMOVED:
        out = f"replace({out}, {q(word)}, '')"
    for pattern, to in X.REWRITES:
        to = {r"\$$3\$": r"$\3$"}.get(to, to.replace("$2", r"\2").replace("$3", r"\3"))
        out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'g')"
    out = f"replace({out}, '$', '')"
    return f"(SELECT trim(CASE WHEN regexp_matches(replace(z, ',', ''), '^[0-9]+$') THEN replace(z, ',', '') ELSE z END) FROM (SELECT {out} AS z))"


STATED = r"coalesce(regexp_extract_all(right(response, 300), '(?i)Final Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]')"
SAMPLES = "(SELECT doc_id, concat('x = ', CASE doc_id % 6 WHEN 0 THEN '\\frac12' WHEN 1 THEN '1,234 dollars' WHEN 2 THEN '\\text{5 cm}' WHEN 3 THEN '$3\\sqrt2$' WHEN 4 THEN '90^\\circ' ELSE CAST(n_chars AS VARCHAR) END) AS raw FROM documents)"


@register(f"SELECT doc_id, {sql_normalized('raw')} AS answer FROM {SAMPLES}")
def normalize_final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    raw = F.concat(F.lit("x = "), F.when(k == 0, r"\frac12").when(k == 1, "1,234 dollars").when(k == 2, r"\text{5 cm}").when(k == 3, r"$3\sqrt2$").when(k == 4, r"90^\circ").otherwise(F.col("n_chars").cast("string")))
    return docs.select("doc_id", X.normalized(raw).alias("answer"))


@register(f"SELECT doc_id, {sql_normalized(STATED)} AS pred, {sql_normalized(STATED)} = {sql_normalized('truth')} AS correct FROM answers")
def minerva_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = X.normalized(X.stated_answer(F.substring("response", -300, 300)))
    return V.answers(spark, sf_dir).select("doc_id", pred.alias("pred"), (pred == X.normalized(F.col("truth"))).alias("correct"))


QA = r"""trim(regexp_replace(regexp_replace(translate(lower({0}), '!""#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))""".replace('""', '"')


@register(f"""WITH g AS (SELECT item_id, {QA.format("text")} AS gold FROM benchmark), d AS (SELECT doc_id, {QA.format("text")} AS pred FROM documents)
    SELECT doc_id, item_id, gold = pred AS em, contains(pred, gold) AS sub_em FROM d JOIN g ON contains(pred, gold)""")
def qa_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golds looked for in predictions, all in one pass over each."""
    g = table(spark, sf_dir, "benchmark").select("item_id", X.qa_normalized(F.col("text")).alias("gold"))
    d = table(spark, sf_dir, "documents").select("doc_id", X.qa_normalized(F.col("text")).alias("pred"))
    found = S.substrings_found(d, "doc_id", "pred", g, "item_id", "gold")
    return found.select("doc_id", "item_id", F.col("whole").alias("em"), F.lit(True).alias("sub_em"))


@register(r"""SELECT id, upper(regexp_extract_all(concat('I think. ', CASE WHEN id % 3 = 0 THEN 'Answer: ' ELSE 'answer : $' END, substr('ABCDE', CAST(id % 5 + 1 AS INT), 1)), '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1)[1]) AS letter FROM prompts""")
def choice_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("I think. "), F.when(F.col("id") % 3 == 0, "Answer: ").otherwise("answer : $"), F.substring(F.lit("ABCDE"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)))
    return V.prompts(spark, sf_dir).select("id", X.choice_letter(text).alias("letter"))


@register(r"SELECT id, TRY_CAST(replace(replace(regexp_extract_all(answer, '#### (-?[0-9.,]+)', 1)[1], ',', ''), '$', '') AS DOUBLE) = TRY_CAST(right(replace(answer, ',', ''), 4) AS DOUBLE) AS equal FROM prompts")
def value_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.hash_answer(F.col("answer")).try_cast("double")
    return V.prompts(spark, sf_dir).select("id", (a == F.right(F.replace("answer", F.lit(","), F.lit("")), F.lit(4)).try_cast("double")).alias("equal"))


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    text = F.concat(F.lit("So \\boxed{0} then "), F.when(k == 0, r"\boxed{\frac{1}{2}}").when(k == 1, r"\boxed{{1},{2}}").when(k == 2, r"\boxed{3").otherwise(F.concat(F.lit(r"\boxed{"), F.col("n_chars").cast("string"), F.lit("}"))))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", text.alias("response"))


@register(r"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\frac{1}{2}' WHEN 1 THEN '{1},{2}' WHEN 2 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS boxed FROM documents")
def last_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(spark, sf_dir).select("doc_id", grade.boxed_answer("response").alias("boxed"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 1 ELSE -1 END AS score FROM documents")
def strict_box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grade.boxed_answer(F.substring("response", -100, 100))
    return boxed(spark, sf_dir).select("doc_id", F.when(own == F.col("n_chars").cast("string"), 1).otherwise(-1).alias("score"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def char_count_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(spark, sf_dir).select("doc_id", F.when(grade.boxed_answer("response") == F.col("n_chars").cast("string"), 1.0).otherwise(0.0).alias("score"))


@register(r"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\frac{1}{2}' WHEN 1 THEN '{1},{2}' WHEN 2 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS given, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN NULL WHEN 2 THEN FALSE ELSE abs(n_chars - 50) <= 0.005 END AS half, CASE doc_id % 4 WHEN 0 THEN '\frac{1}{2}' WHEN 1 THEN '{1},{2}' WHEN 2 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS stripped FROM documents")
def grade_math_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact grading of boxed answers; null where only symbolic algebra could decide."""
    given = grade.boxed_answer("response")
    return boxed(spark, sf_dir).select("doc_id", given.alias("given"), grade.grade_answer(given, F.lit("0.5")).alias("half"), grade.stripped_answer(given).alias("stripped"))


@register("SELECT doc_id, round(0.9 * CASE WHEN doc_id % 4 = 3 OR (doc_id % 4 = 0 AND n_chars = 50) THEN 1.0 ELSE 0.0 END + 0.1::DOUBLE, 6) + 0.0 AS score FROM documents")
def geometry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<think>x</think> "), "response")
    fmt = F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)
    acc = F.when(F.coalesce(grade.grade_answer(grade.boxed_answer("response"), F.col("n_chars").cast("string")), F.lit(False)), 1.0).otherwise(0.0)
    return boxed(spark, sf_dir).select("doc_id", r6(0.9 * acc + 0.1 * fmt).alias("score"))


@register("SELECT doc_id, CAST(n_chars AS VARCHAR) AS span FROM documents")
def answer_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("First we look. The answer is "), F.col("n_chars").cast("string"), F.lit(". Done"))
    return table(spark, sf_dir, "documents").select("doc_id", grade.stated_span(text).alias("span"))


@register()
def repetition_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated substrings in the whole text; over 0.2 is repetitive."""
    share = grade.repetition_share("text")
    return table(spark, sf_dir, "documents").select("doc_id", r6(share).alias("share"), (share > 0.2).alias("repetitive"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN TRUE ELSE FALSE END AS format_ok, doc_id % 4 <> 0 AS has_parallel FROM documents")
def parallel_format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("doc_id", (tags.n_format_errors("tagged") == 0).alias("format_ok"), F.contains("tagged", F.lit("<Parallel>")).alias("has_parallel"))


@register("SELECT doc_id, CAST((length(tagged) - length(replace(tagged, '<Parallel>', ''))) / 10 AS INT) AS blocks FROM answers")
def parallel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("doc_id", tags.parallel_count(F.col("tagged")).alias("blocks"))


WORDS = r"len(regexp_extract_all(regexp_replace({0}, '</?Parallel>|</?Path>|</?Summary>', '', 'g'), '[^ \t\n\x0b\f\r]+'))"


@register(f"""WITH b AS (SELECT doc_id, {WORDS.format("tagged")} AS total, {WORDS.format("regexp_replace(tagged, '<Parallel>.*?</Parallel>', '', 'gs')")} AS outside, regexp_extract_all(tagged, '(?s)<Parallel>(.*?)</Parallel>', 1)[1] AS block FROM answers),
    p AS (SELECT *, list_transform(regexp_extract_all(block, '(?s)<Path>(.*?)</Path>', 1), lambda x: {WORDS.format("x")}) AS sizes FROM b)
    SELECT doc_id, round(CASE WHEN total > 0 THEN greatest((total - outside - coalesce(list_max(sizes), 0)) / total, 0.0) ELSE 0.0 END, 6) + 0.0 AS gain FROM p""")
def efficiency_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("doc_id", r6(tags.efficiency(F.col("tagged"))).alias("gain"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN round(exp((ln(1.0 / 6) + 2 * ln(1.0 / 8)) / 3), 6) ELSE 1.0::DOUBLE END + 0.0 AS bleu FROM answers")
def self_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("doc_id", r6(tags.mean_self_bleu("tagged")).alias("bleu"))


@register(r"SELECT doc_id, n AS tokens, n - 1 - CASE doc_id % 4 WHEN 1 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS furthest FROM (SELECT doc_id, CAST(len(regexp_extract_all(tagged, '</?Parallel>|</?Path>|</?Summary>|[^\s\x0b<]+|<')) AS INT) AS n FROM answers)")
def structured_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tags.position_ids("tagged")
    return V.answers(spark, sf_dir).select("doc_id", F.size(ids).alias("tokens"), F.array_max(ids).alias("furthest"))


@register("SELECT doc_id, 1 AS s1, 6 AS e1, 6 AS s2, CASE WHEN doc_id % 4 = 1 THEN 9 ELSE 10 END AS e2 FROM documents WHERE doc_id % 4 IN (1, 3)")
def path_isolation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.answers(spark, sf_dir).select("doc_id", F.explode(tags.isolation_spans("tagged")).alias("x"))
    return rows.select("doc_id", "x.*")


SIGNALS = f"(SELECT doc_id, coalesce({STRICT} = truth, FALSE) AS c, doc_id % 4 <> 0 AS p, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS n, doc_id % 4 IN (0, 1) AS f, 0.25 AS b, 0.1 AS e, doc_id % 40 AS step FROM answers)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = V.answers(spark, sf_dir), tags.parallel_count(F.col("tagged"))
    c = F.coalesce(X.final_answer(F.col("response")) == F.col("truth"), F.lit(False))
    return a.select("doc_id", c.alias("c"), (n > 0).alias("p"), n.alias("n"), (tags.n_format_errors("tagged") == 0).alias("f"), F.lit(0.25).alias("b"), F.lit(0.1).alias("e"), (F.col("doc_id") % 40).alias("step"))


@register(f"""SELECT doc_id, CAST(c AS INT) + 0.0::DOUBLE AS accuracy_reward, CAST(CASE WHEN c AND p THEN CAST(f AS INT) ELSE CAST(c AS INT) END AS DOUBLE) AS emphase_acc, CAST(CASE WHEN c AND p AND f THEN 1.2 WHEN c AND p THEN 0 WHEN c THEN 1 ELSE 0 END AS DOUBLE) AS emphase_parallel,
    CAST(CASE WHEN c AND p AND f THEN 1.15 WHEN c AND p THEN 0 WHEN c THEN 1 ELSE 0 END AS DOUBLE) AS emphase_parallel_add_diversity, CAST(CAST(c AS INT) + CASE WHEN p AND f THEN 0.5 ELSE 0 END AS DOUBLE) AS accuracy_add_parallel_reward,
    CAST(c AND p AND f AS DOUBLE) AS accuracy_times_special_token_reward, CAST(c AND p AND f AS DOUBLE) AS format_times_accuracy_times_parallel_reward FROM {SIGNALS}""")
def word_problem_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rewards.word_rewards(*(F.col(x) for x in ("c", "p", "f", "b")))
    return signals(spark, sf_dir).select("doc_id", *[r6(v).alias(k) for k, v in found.items()])


def _emphasis(bonus: str) -> str:
    return f"CASE WHEN c AND n < 1 THEN 1.0 WHEN c AND n >= 1 AND f THEN {bonus} ELSE -1.0 END"


SIGN = "CASE WHEN c THEN 1.0 ELSE -1.0 END"
MATH_SQL = {
    "accuracy_reward": SIGN, "emphase_acc": _emphasis("1.0"), "emphase_parallel": _emphasis("1.2"), "emphase_parallel_enhance": _emphasis("2.0"), "emphase_parallel_add_diversity": _emphasis("1.2 - 0.2 * b"),
    "accuracy_add_parallel_reward": f"{SIGN} + CASE WHEN n >= 1 AND f THEN 0.5 ELSE 0 END", "accuracy_times_parallel_reward": "CASE WHEN c AND n >= 1 AND f THEN 1.0 ELSE -1.0 END",
    "format_times_accuracy_times_parallel_reward": "CASE WHEN c AND n >= 1 AND f THEN 1.0 ELSE -1.0 END", "accuracy_parallel_reward": f"{SIGN} + sqrt(n)", "accuracy_add_diversity_reward": f"{SIGN} - 0.3 * b",
    "accuracy_add_parallel_add_diversity_reward": f"{SIGN} + CASE WHEN n >= 1 THEN 1 ELSE 0 END - 0.3 * b", "accuracy_add_efficiency_reward": "CASE WHEN c THEN 1 + 0.4 * e ELSE -1 + 0.1 * e END",
    "accuracy_add_efficiency_reward_decay": "CASE WHEN c THEN 1 + 0.4 * e * exp(-step / 50) ELSE -1 + 0.1 * e * exp(-step / 50) END", "accuracy_parallel_interv_reward": f"CASE WHEN ((step - 1) % 10) < 8 THEN {SIGN} ELSE {_emphasis('1.2')} END",
}


@register(f"SELECT doc_id, {', '.join(f'round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}' for k, v in MATH_SQL.items())} FROM {SIGNALS}")
def competition_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rewards.math_rewards(*(F.col(x) for x in ("c", "n", "f", "b", "e", "step")))
    return signals(spark, sf_dir).select("doc_id", *[r6(v).alias(k) for k, v in found.items()])


@register("""SELECT s AS source, CASE WHEN contains(s, 'GSM8k') THEN 'word' WHEN s IN ('lighteval/MATH') THEN 'math' WHEN s = 'math_dapo' OR s LIKE 'aime%' OR contains(s, 'APO') THEN 'competition' WHEN s LIKE 'numina_%' THEN 'prime' WHEN s IN ('apps', 'taco') THEN 'code' WHEN s LIKE 'searchR1_%' THEN 'search' END AS family,
    count(*) AS n FROM (SELECT ['openai/GSM8k', 'lighteval/MATH', 'math_dapo', 'DAPO', 'aime24', 'numina_x', 'apps', 'searchR1_nq', 'other'][CAST(doc_id % 9 + 1 AS INT)] AS s FROM documents) GROUP BY ALL""")
def reward_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("openai/GSM8k", "lighteval/MATH", "math_dapo", "DAPO", "aime24", "numina_x", "apps", "searchR1_nq", "other")])
    rows = table(spark, sf_dir, "documents").select(F.element_at(names, (F.col("doc_id") % 9 + 1).cast("int")).alias("source"))
    return rows.select("source", rewards.family(F.col("source")).alias("family")).groupBy("source", "family").agg(F.count("*").alias("n"))


@register("SELECT uid, idx, round(CASE WHEN acc THEN 1.0 ELSE least(0.0, -1.0 + (len % 7 - 2) / 2 * 0.1) END, 6) + 0.0 AS agentic, CASE WHEN score > coalesce(lag(score) OVER (PARTITION BY uid ORDER BY idx), 0) THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS step_reward FROM rollouts")
def agentic_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.coalesce(F.lag("score").over(Window.partitionBy("uid").orderBy("idx")), F.lit(0.0))
    return V.rollouts(spark, sf_dir).select("uid", "idx", r6(rewards.agentic(F.when(F.col("acc"), 1.0).otherwise(-1.0), F.col("len") % 7)).alias("agentic"), rewards.tool_step(F.col("score"), before).alias("step_reward"))


CALL = """concat('Let me see. <tool_call>{"name": "', lang, '", "arguments": {"n": ', n_chars, '}}</tool_call> and <tool_call>{bad</tool_call> end')"""


@register(f"""WITH t AS (SELECT doc_id, {CALL} AS x FROM documents), c AS (SELECT doc_id, x, regexp_extract_all(x, '(?s)<tool_call>(.*?)</tool_call>', 1)[1] AS j FROM t)
    SELECT doc_id, 1 AS calls, j::JSON ->> '$.name' AS name, CAST(j::JSON -> '$.arguments' ->> '$.n' AS BIGINT) AS n, regexp_replace(x, '<tool_call>.*?</tool_call>', '', 'gs') AS rest FROM c""")
def tool_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('Let me see. <tool_call>{"name": "'), "lang", F.lit('", "arguments": {"n": '), F.col("n_chars").cast("string"), F.lit("}}</tool_call> and <tool_call>{bad</tool_call> end"))
    t = table(spark, sf_dir, "documents").select("doc_id", text.alias("x")).select("doc_id", "x", X.tool_calls(F.col("x")).alias("calls"))
    first = F.try_element_at("calls", F.lit(1))
    return t.select("doc_id", F.size("calls").alias("calls"), first["name"].alias("name"), F.get_json_object(first["arguments"], "$.n").cast("bigint").alias("n"), X.without_tool_calls(F.col("x")).alias("rest"))


@register("SELECT doc_id, concat(chr(10), 'print(', n_chars, ')', chr(10)) AS code FROM documents")
def code_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Try ```python\nx\n``` or better ```python\nprint("), F.col("n_chars").cast("string"), F.lit(")\n``` as said"))
    return table(spark, sf_dir, "documents").select("doc_id", X.last_code(text).alias("code"))


@register("SELECT uid, round(CASE WHEN min(CAST(acc AS INT)) = 1 THEN 1.0 ELSE avg(CASE WHEN idx <= 10 THEN CAST(acc AS INT) END) END, 6) + 0.0 AS score FROM rollouts GROUP BY uid")
def test_case_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases pass: 1; else the share of the first ten that pass."""
    a = F.col("acc").cast("int")
    return V.rollouts(spark, sf_dir).groupBy("uid").agg(r6(F.when(F.min(a) == 1, 1.0).otherwise(F.avg(F.when(F.col("idx") <= 10, a)))).alias("score"))
