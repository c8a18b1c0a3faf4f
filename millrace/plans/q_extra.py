"""Queries on dumps, balance, benchmark records, computed reward signals, masks, tools and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.functions import extend as X
from millrace.functions import competition, extract, grade, rewards, tags
from millrace.operators import balance as L
from millrace.operators import evaluate as E
from millrace.operators import prep as P
from millrace.operators import tokens as T
from millrace.plans import views as V
from millrace.plans.q_batch import steps
from millrace.plans.q_text import MATH_SQL, STRICT, WORDS
from millrace.sources import io


@register("SELECT CAST(conv_id % 5 AS INT) AS step, conv_id, turn, md5(regexp_replace(text, '[0-9]+', '*', 'g')) AS masked, CAST(row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS INT) AS row_no FROM conversations")
def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines in a folder for each step, one step written again, and read back masked."""
    path = io.work_folder(spark, "dump")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("step"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "conv_id", "turn", "text")
    io.write_dump(rows, path)
    io.write_dump(rows.where("step = 3"), path)
    found = io.dumped_rows(spark, path, "place bigint, conv_id bigint, turn bigint, text string, step int", "place", "[0-9]+")
    return found.select("step", "conv_id", "turn", F.md5("text").alias("masked"), "row_no")


@register("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1")
def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch saved as parquet in files of bounded size, and loaded."""
    path = io.work_folder(spark, "records")
    io.write_records(table(spark, sf_dir, "orders"), path, 5000)
    found = X.DATASETS["parquet"](spark, path)
    return found.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), (F.round(F.sum("o_totalprice"), 2) + 0.0).alias("total"))


@register("SELECT m AS method, CAST(floor(doc_id / 512) AS BIGINT) AS batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, count(DISTINCT doc_id) AS ids, TRUE AS level FROM documents, (SELECT unnest(['differencing', 'greedy']) AS m) GROUP BY 1, 2")
def balanced_parts_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both methods deal every row once; parts of a batch differ by no more than its longest row."""
    rows, out = steps(spark, sf_dir), None
    longest = rows.groupBy("batch").agg(F.max("n_chars").alias("longest"))
    for method in ("differencing", "greedy"):
        dealt = L.balanced(rows, "batch", "doc_id", "n_chars", 8, method).join(rows, ["batch", "doc_id"])
        seen = dealt.groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.countDistinct("doc_id").alias("ids"))
        one = seen.join(L.imbalance(dealt, "batch", "part", "n_chars"), "batch").join(longest, "batch").select(F.lit(method).alias("method"), "batch", "n", "total", "ids", (F.col("gap") <= F.col("longest")).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


@register("""WITH b AS (SELECT CAST(floor(doc_id / 512) AS BIGINT) AS batch, n_chars, ntile(8) OVER (PARTITION BY floor(doc_id / 512) ORDER BY doc_id) AS part FROM documents), s AS (SELECT batch, part, sum(n_chars) AS s FROM b GROUP BY ALL)
    SELECT batch, CAST(max(s) AS BIGINT) AS high, CAST(min(s) AS BIGINT) AS low, CAST(max(s) - min(s) AS BIGINT) AS gap, TRUE AS improved FROM s GROUP BY batch""")
def imbalance_against_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of contiguous eighths of each batch, and whether balanced parts lie no further apart."""
    rows = steps(spark, sf_dir)
    near = L.imbalance(rows.withColumn("part", F.ntile(8).over(Window.partitionBy("batch").orderBy("doc_id"))), "batch", "part", "n_chars")
    level = L.imbalance(L.balanced(rows, "batch", "doc_id", "n_chars", 8).join(rows, ["batch", "doc_id"]), "batch", "part", "n_chars").select("batch", F.col("gap").alias("level"))
    return near.join(level, "batch").select("batch", "high", "low", "gap", (F.col("level") <= F.col("gap")).alias("improved"))


@register("WITH b AS (SELECT CAST(floor(doc_id / 512) AS BIGINT) AS batch, n_chars FROM documents) SELECT batch, count(*) AS n, CAST(greatest(1, least(count(*), ceil(sum(n_chars) / 400000.0))) AS BIGINT) AS micros, TRUE AS fits FROM b GROUP BY batch")
def token_budget_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many micro-batches as the tokens ask for; none passes its even share by more than the longest row."""
    rows = steps(spark, sf_dir)
    micro = L.dynamic_batches(rows, "batch", "doc_id", "n_chars", 400_000).join(rows, ["batch", "doc_id"]).groupBy("batch", "micro").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("longest"))
    g = micro.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("micros"), F.max("s").alias("most"), F.sum("s").alias("total"), F.max("longest").alias("longest"))
    return g.select("batch", "n", "micros", (F.col("most") <= F.col("total") / F.col("micros") + F.col("longest")).alias("fits"))


@register("SELECT 8 AS partitions, 8 AS parts, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents")
def global_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by their part: each of the eight partitions holds exactly one part."""
    rows = steps(spark, sf_dir)
    dealt = L.rebalanced(L.balanced(rows, "batch", "doc_id", "n_chars", 8).join(rows, ["batch", "doc_id"]), "part", 8).withColumn("at", F.spark_partition_id())
    return dealt.agg(F.countDistinct("at").cast("int").alias("partitions"), F.countDistinct("at", "part").cast("int").alias("parts"), F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@register("""WITH r AS (SELECT uid, data_source, count(*) AS s FROM rollouts GROUP BY ALL), n AS (SELECT data_source, k.n FROM r JOIN (SELECT unnest([2, 4, 8, 16, 32]) AS n) k ON k.n < s UNION SELECT data_source, s FROM r WHERE s > 1)
    SELECT data_source, CAST(n AS INT) AS n, TRUE AS best_near, TRUE AS worst_near FROM n""")
def bootstrap_near_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled best and worst of n within five standard errors of their exact expectations."""
    rows, times = V.rollouts(spark, sf_dir), 200
    found = E.bootstrap_metrics(rows, vote=None, times=times)
    at = F.split("metric", "[@/]")
    wide = found.select("data_source", at[1].cast("int").alias("n"), F.concat(at[0], F.lit("_"), at[2]).alias("kind"), "value").groupBy("data_source", "n").pivot("kind", ["best_mean", "best_std", "worst_mean", "worst_std"]).agg(F.first("value"))
    exact = E.expected_extremes(rows).join(rows.select("uid", "data_source").distinct(), "uid").groupBy("data_source", "n").agg(F.avg("best").alias("best"), F.avg("worst").alias("worst"))
    near = lambda kind: (F.abs(F.col(f"{kind}_mean") - F.col(kind)) <= 5 * F.col(f"{kind}_std") / times**0.5 + 1e-9).alias(f"{kind}_near")
    return wide.join(exact, ["data_source", "n"]).select("data_source", "n", near("best"), near("worst"))


COMPUTED = ("emphase_parallel_add_diversity", "accuracy_add_diversity_reward", "accuracy_add_parallel_add_diversity_reward", "accuracy_add_efficiency_reward_decay")  # the efficiency alone is a fraction with half-way ties


@register(f"""WITH w AS (SELECT doc_id, response, truth, {WORDS.format("tagged")} AS total, {WORDS.format("regexp_replace(tagged, '<Parallel>.*?</Parallel>', '', 'gs')")} AS outside, regexp_extract_all(tagged, '(?s)<Parallel>(.*?)</Parallel>', 1)[1] AS block FROM answers),
    p AS (SELECT *, list_max(list_transform(regexp_extract_all(block, '(?s)<Path>(.*?)</Path>', 1), lambda x: {WORDS.format("x")})) AS longest FROM w),
    s AS (SELECT doc_id, coalesce({STRICT} = truth, FALSE) AS c, doc_id % 4 <> 0 AS p, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS n, doc_id % 4 IN (0, 1) AS f, CASE WHEN doc_id % 4 IN (1, 3) THEN exp((ln(1.0 / 6) + 2 * ln(1.0 / 8)) / 3) ELSE 1.0 END AS b,
        CASE WHEN total > 0 THEN greatest((total - outside - coalesce(longest, 0)) / total, 0.0) ELSE 0.0 END AS e, doc_id % 40 + 1 AS step FROM p)
    SELECT doc_id, {", ".join(f"round(CAST({MATH_SQL[k]} AS DOUBLE), 6) + 0.0 AS {k}" for k in COMPUTED)} FROM s""")
def rewards_of_computed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with diversity and efficiency, both taken from the text."""
    a, n = V.answers(spark, sf_dir), tags.parallel_count(F.col("tagged"))
    c = F.coalesce(extract.final_answer(F.col("response")) == F.col("truth"), F.lit(False))
    rows = a.select("doc_id", c.alias("c"), n.alias("n"), (tags.n_format_errors("tagged") == 0).alias("f"), tags.mean_self_bleu("tagged").alias("b"), tags.efficiency(F.col("tagged")).alias("e"), (F.col("doc_id") % 40 + 1).alias("step"))
    found = rewards.math_rewards(*(F.col(x) for x in ("c", "n", "f", "b", "e", "step")))
    return rows.select("doc_id", *[r6(found[k]).alias(k) for k in COMPUTED])


def _draw(seed: int, n: int) -> str:
    return f"((doc_id * 2654435761 + {seed * 40503}) % 4294967296) % {n}"


@register(f"SELECT doc_id, concat(repeat('0', CAST(l AS INT)), repeat('1', CAST(v AS INT)), repeat('0', CAST(20 - l - v AS INT))) AS mask FROM (SELECT doc_id, {_draw(1, 6)} AS l, {_draw(2, 14)} + 2 AS v FROM documents)")
def random_attention_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of twenty places: up to five of left padding, two to fifteen valid."""
    left, valid = P.random_lengths(F.col("doc_id"), 20, 0.75, 0.25, 0.1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.attention_mask(left, valid, 20).cast("array<string>"), "").alias("mask"))


@register("""SELECT source, index, ability, md5(content) AS content, truth FROM (
    SELECT 'Maxwell-Jia/AIME_2024' AS source, item_id AS index, 'English' AS ability, text AS content, CAST(item_id * 3 AS VARCHAR) AS truth FROM benchmark
    UNION ALL SELECT 'opencompass/cnmo2024_zh', item_id, 'Math', text, concat('n', item_id) FROM benchmark
    UNION ALL SELECT 'livecodebench/code_generation_lite', item_id, 'Code', concat('You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.', chr(10), chr(10), 'Question: ', text, chr(10), chr(10),
        CASE WHEN item_id % 2 = 0 THEN concat('You will use the following starter code to write the solution to the problem and enclose your code within delimiters.', chr(10), '```python', chr(10), 'def f():', chr(10), '```')
        ELSE concat('Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.```python', chr(10), '# YOUR CODE HERE', chr(10), '```') END),
        concat('{"inputs":["', item_id, '","2"],"outputs":["a","b"],"fn_name":', CASE WHEN item_id % 2 = 0 THEN '"f"' ELSE 'null' END, '}') FROM benchmark)""")
def benchmark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three benchmarks through the one table of builders."""
    b, id_ = table(spark, sf_dir, "benchmark").withColumn("index", F.col("item_id")), F.col("item_id").cast("string")
    even = F.col("item_id") % 2 == 0
    code = b.select(
        "index", F.col("text").alias("question_content"), F.when(even, "def f():").otherwise("").alias("starter_code"), F.concat(F.lit('[{"input": "'), id_, F.lit('", "output": "a"}]')).alias("public_test_cases"),
        F.lit('[{"input": "2", "output": "b"}]').alias("private_test_cases"), F.when(even, '{"func_name": "f"}').otherwise("{}").alias("metadata"),
    )
    parts = [
        P.benchmark_records("aime2024", b.select("index", F.col("text").alias("Problem"), (F.col("item_id") * 3).alias("Answer"))),
        P.benchmark_records("cnmo2024", b.select("index", F.col("text").alias("question"), F.concat(F.lit("n"), id_).alias("answer")), "opencompass/cnmo2024_zh"),
        P.benchmark_records("livecodebench", code),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select(F.col("data_source").alias("source"), F.col("extra_info.index").alias("index"), "ability", F.md5(F.col("prompt")[0]["content"]).alias("content"), F.col("reward_model.ground_truth").alias("truth"))


@register("SELECT item_id AS index, letter_at, starts FROM (SELECT item_id, TRUE AS letter_at, TRUE AS starts FROM benchmark)")
def multiple_choice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the multiple-choice benchmark: the gold answer stands at the letter that is the truth."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("index"), F.col("text").alias("Question"), F.lit("gold").alias("Correct Answer"), *[F.lit(f"wrong{i}").alias(f"Incorrect Answer {i}") for i in (1, 2, 3)])
    rows = P.benchmark_records("gpqa_diamond", b).select(F.col("extra_info.index").alias("index"), F.col("prompt")[0]["content"].alias("c"), F.col("reward_model.ground_truth").alias("letter"))
    return rows.select("index", F.contains("c", F.concat("letter", F.lit(") gold"))).alias("letter_at"), F.startswith("c", F.lit("Answer the following multiple choice question.")).alias("starts"))


TOOL_ROLES = "(SELECT conv_id, turn, text, CASE WHEN turn % 4 IN (2, 3) THEN 'tool' ELSE role END AS role FROM conversations)"


@register(rf"""WITH m AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'tool' THEN 0 ELSE 1 END AS new FROM {TOOL_ROLES})
    SELECT conv_id, CAST(sum(new) AS INT) AS groups, CAST(sum(new + len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) ELSE 0 END) AS BIGINT) AS loss_tokens FROM m GROUP BY conv_id""")
def chat_packing_with_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive tool messages are one, with one role mark and no loss."""
    role = F.when(F.col("turn") % 4 >= 2, "tool").otherwise(F.col("role"))
    seen = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content"))))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(P.grouped_tools(F.transform(seen, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("m"))
    ids, mask = P.packed_chat(F.col("m"))
    return g.select("conv_id", F.size("m").alias("groups"), F.size(ids).cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("loss_tokens"))


@register("SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0.0::DOUBLE WHEN doc_id % 2 = 1 THEN 0.1::DOUBLE WHEN doc_id % 13 > 10 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS score FROM documents")
def search_answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged answers against golds: none, wrong, right, and right among more than ten tags."""
    answer = F.when(F.col("doc_id") % 2 == 0, "The Right One!").otherwise("another")
    text = F.concat(F.lit("Look: "), F.repeat(F.concat(F.lit("<answer> "), answer, F.lit(" </answer>")), (F.col("doc_id") % 13).cast("int")))
    golds = F.array(F.lit("right one"), F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", extract.search_score(text, golds, form=0.1).alias("score"))


@register("SELECT device, peak, round(6.0 * 7e9 * (SELECT sum(n_chars) FROM documents) / peak, 6) + 0.0 AS seconds FROM (SELECT unnest(['NVIDIA H800', 'NVIDIA A100-SXM', 'NVIDIA L40', 'NVIDIA H20', 'unknown']) AS device, unnest([989e12, 312e12, 181.05e12, 148e12, NULL])::DOUBLE AS peak)")
def device_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that a step of a dense model would take at a device's peak."""
    total = table(spark, sf_dir, "documents").agg(E.flops(F.col("n_chars"), 7e9, 0, 0, 0).alias("f"))
    names = F.explode(F.array(*[F.lit(d) for d in ("NVIDIA H800", "NVIDIA A100-SXM", "NVIDIA L40", "NVIDIA H20", "unknown")]))
    return total.select("f", names.alias("device")).select("device", E.device_flops(F.col("device")).alias("peak"), r6(F.col("f") / E.device_flops(F.col("device"))).alias("seconds"))


@register("""WITH p AS (SELECT a, s, n, array_to_string(list_transform(range(1, n + 1), lambda k: (a + s + k * s) % 20), ',') AS truth FROM range(20) r(a), range(4) q(s), range(1, 5) t(n))
    SELECT a, s, CAST(n AS INT) AS n, truth, round(CASE WHEN a % 2 = 0 THEN length(truth) ELSE 1 END / (length(truth) + 1.0), 6) + 0.0 AS reward FROM p""")
def digit_completion_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rewards of a right completion, and of one that goes wrong after its first character."""
    rows = spark.range(20).withColumnRenamed("id", "a").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4))))
    prompt = F.concat(F.col("a").cast("string"), F.lit(","), ((F.col("a") + F.col("s")) % 20).cast("string"), F.lit(":20,"), F.col("n").cast("string"))
    rows = rows.withColumn("truth", P.digit_completion(prompt))
    given = F.when(F.col("a") % 2 == 0, F.col("truth")).otherwise(F.concat(F.substring("truth", 1, 1), F.lit("x"), "truth"))
    return rows.select("a", "s", "n", "truth", r6(F.aggregate(P.dense_rewards(given, F.col("truth")), F.lit(0.0), lambda x, y: x + y)).alias("reward"))


CHAT = ("You are a helpful assistant.", "What is {0} plus {1}?", "It is {2}.", "And twice that?", "It is {3}.")


@register("""SELECT i AS id, k AS turn, CASE k WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' WHEN 3 THEN 'user' ELSE 'assistant' END AS role,
    CASE k WHEN 0 THEN 'You are a helpful assistant.' WHEN 1 THEN concat('What is ', i, ' plus ', i % 7, '?') WHEN 2 THEN concat('It is ', i + i % 7, '.') WHEN 3 THEN 'And twice that?' ELSE concat('It is ', 2 * (i + i % 7), '.') END AS content FROM range(100) r(i), (SELECT unnest([0, 1, 2, 3, 4])::INT AS k)""")
def synthetic_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up conversations of five messages."""
    i = F.col("id")
    values = [i, i % 7, i + i % 7, 2 * (i + i % 7)]

    def said(form: str) -> Column:
        return P.filled(form, **{str(k): v.cast("string") for k, v in enumerate(values)})

    messages = F.array(*[P.message(r, said(c)) for r, c in zip(("system", "user", "assistant", "user", "assistant"), CHAT, strict=True)])
    return spark.range(100).select("id", F.posexplode(messages).alias("turn", "m")).select("id", "turn", "m.role", "m.content")


@register(r"SELECT conv_id, turn, w AS word, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS w FROM conversations) GROUP BY ALL")
def tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered tool that makes many rows of one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return X.TOOLS["word_count"](rows, "text").select("conv_id", "turn", "word", "n")


@register("SELECT CAST(user_id % 16 AS BIGINT) AS rank, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1")
def function_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function applied to the batches of each rank's partition, and what it gives collected by rank."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("rank"), "value")
    part = X.apply_parts(rows, 16, ["rank"], lambda b: b.groupby("rank", as_index=False).agg(n=("value", "size"), total=("value", "sum")), "rank long, n long, total double")
    return part.groupBy("rank").agg(F.sum("n").alias("n"), (F.round(F.sum("total"), 4) + 0.0).alias("total"))


@register("""SELECT uid, CAST(idx - 1 AS INT) AS path, CAST(uid % 9 + coalesce(sum(CAST(len AS BIGINT)) OVER (PARTITION BY uid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(uid % 9 + sum(CAST(len AS BIGINT)) OVER (PARTITION BY uid ORDER BY idx) AS BIGINT) AS stop,
    CAST(uid % 9 AS BIGINT) AS position, CAST(uid % 9 + max(CAST(len AS BIGINT)) OVER (PARTITION BY uid) AS BIGINT) AS next_position FROM rollouts""")
def merged_path_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's samples as the paths of one block: spans in the merged sequence and positions."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("len").cast("long").alias("n")))), lambda x: x["n"])
    rows = V.rollouts(spark, sf_dir).groupBy("uid").agg(sizes.alias("sizes"))
    return rows.select("uid", F.explode(T.merged_paths(F.col("uid") % 9, F.col("sizes"))).alias("x")).select("uid", "x.path", "x.start", F.col("x.end").alias("stop"), "x.position", "x.next_position")


@register(r"""SELECT id, md5(concat('The following is a math problem and an AI solution:', chr(10), chr(10), '[Math Problem]', chr(10), chr(10), question, chr(10), chr(10), '[AI Solution]', chr(10), chr(10), answer, chr(10), chr(10),
    'Your task is to review and critique the solution step by step, and output whether the AI solution is correct.', chr(10), chr(10), 'Please put your final answer (i.e., ''True'' or ''False'') in \boxed{}.')) AS content,
    CASE WHEN id % 5 = 0 THEN 0.5::DOUBLE WHEN id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM prompts""")
def judged_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judging model is asked, and the scores of its replies; rows of the test split keep the rule's."""
    reply = F.concat(F.lit("I checked it. \\boxed{"), F.when(F.col("id") % 3 == 0, "True").otherwise("False"), F.lit("}"))
    rows = V.prompts(spark, sf_dir).select("id", P.judge_messages(F.col("question"), F.col("answer")).alias("m"), reply.alias("reply"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    return rows.select("id", F.md5(F.col("m")[0]["content"]).alias("content"), grade.judged(grade.boxed_answer("reply"), F.lit(0.5), F.col("split")).alias("score"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def verified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside verifier over boxed truths; here the one that compares boxes by value."""
    k = F.col("doc_id") % 4
    response = F.concat(F.lit("so "), F.when(k == 0, "nothing").when(k == 1, "\\boxed{x+1}").when(k == 2, "\\boxed{-1}").otherwise(F.concat(F.lit("\\boxed{"), F.col("n_chars").cast("string"), F.lit(".0}"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", response.alias("response"), F.col("n_chars").cast("string").alias("truth"))
    return X.verified_rows(rows, boxes_equal, "response", "truth").select("doc_id", "score")


def boxes_equal(response: str, truth: str) -> float:
    given, wanted = grade.last_boxed(response), grade.last_boxed(truth)
    return float(given is not None and competition.math_equal(given, wanted) is True)


@register("""WITH a AS (SELECT doc_id, n_chars, CASE WHEN contains(response, concat('Final Answer: ', truth)) THEN 1.0 ELSE 0.0 END AS s FROM answers)
    SELECT 'naive' AS strategy, doc_id, s::DOUBLE AS score FROM a UNION ALL SELECT 'batch', doc_id, s FROM a UNION ALL SELECT 'dapo', doc_id, round(s + least(-(n_chars - 9000) / 1000 * 0.5, 0.0), 6) + 0.0 FROM a
    UNION ALL SELECT 'prime', doc_id, CASE WHEN doc_id % 5 = 1 AND n_chars > 0 THEN 0.0 WHEN doc_id % 3 <> 1 OR 1 <= 1e-4 * (n_chars + 1) THEN 1.0 ELSE 0.0 END FROM a""")
def scoring_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four strategies of the registry over the same responses."""
    rows = V.answers(spark, sf_dir).select("doc_id", "response", "truth", "n_chars")
    found = {
        "naive": X.STRATEGIES["naive"](rows, "response", "truth", states_truth), "batch": X.STRATEGIES["batch"](rows, "response", "truth", lambda a, b: [states_truth(x, y) for x, y in zip(a, b, strict=True)]),
        "dapo": X.STRATEGIES["dapo"](rows, "response", "truth", states_truth, "n_chars", 10_000, 1000, 0.5), "prime": X.STRATEGIES["prime"](rows, "response", "truth"),
    }
    out = None
    for name, frame in found.items():
        one = frame.select(F.lit(name).alias("strategy"), "doc_id", r6("score").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def states_truth(response: str, truth: str) -> float:
    return float(f"Final Answer: {truth}" in response)


#: A dense model with grouped keys, a mixture of experts, and a mixture with latent attention.
MODELS = {
    "dense": E.Architecture(3584, 28, 152064, 28, 4, 128, 18944), "mixture": E.Architecture(2048, 48, 151936, 32, 4, 128, 6144, 128, 8, 0, 768),
    "latent": E.Architecture(7168, 61, 129280, 128, 128, 192, 18432, 256, 8, 1, 2048, 3, (1536, 512, 64, 128)),
}


@register("""WITH w AS (SELECT 'dense' AS model, 28::BIGINT * (3 * 3584 * 18944 + 3584 * 128 * (2 * 28 + 2 * 4)) + 2 * 152064 * 3584::BIGINT AS n, 28 * 128 * 28 AS a
    UNION ALL SELECT 'mixture', 48::BIGINT * (3 * 2048 * 768 * 8 + 2048 * 128 + 2048 * 128 * (2 * 32 + 2 * 4)) + 2 * 151936 * 2048::BIGINT, 32 * 128 * 48
    UNION ALL SELECT 'latent', 58::BIGINT * (3 * 7168 * 2048 * 9 + 7168 * 256) + 9::BIGINT * 7168 * 18432 + 61::BIGINT * (7168::BIGINT * 1536 + 128 * 192 * 1536 + 7168 * (512 + 64) + 128 * (192 - 64 + 128) * 512 + 128 * 128 * 7168) + 2 * 129280 * 7168::BIGINT, 128 * 192 * 61)
    SELECT model, n AS weights, round((6.0::DOUBLE * n * s1 + 12.0::DOUBLE * a * s2) / 1e15, 3) + 0.0 AS petaflops FROM w, (SELECT sum(n_chars) AS s1, sum(n_chars * n_chars) AS s2 FROM documents)""")
def flops_by_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that a token meets, and the operations of a training step over all texts."""
    rows = table(spark, sf_dir, "documents").agg(*[m.flops(F.col("n_chars")).alias(n) for n, m in MODELS.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m.weights()).cast("long").alias("weights"), F.col(n).alias("f")) for n, m in MODELS.items()])).alias("x")
    return rows.select(each).select("x.model", "x.weights", (F.round(F.col("x.f") / 1e15, 3) + 0.0).alias("petaflops"))


@register("SELECT p_partkey, CAST(k AS INT) AS place, concat(p_name, '. ', p_type, ' ', CASE k WHEN 0 THEN p_brand WHEN 1 THEN concat(p_brand, '. b') ELSE 'c d' END) AS choice FROM part, range(3) r(k)")
def map_ending_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ending after its context, both cleaned of titles, brackets and double spaces."""
    context = F.concat(F.lit(" "), "p_name", F.lit(" [title]"), "p_type")
    endings = F.array(F.col("p_brand"), F.concat("p_brand", F.lit(" [title]b")), F.lit("c[step]  d"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(P.ending_choices(context, endings)).alias("place", "choice"))
    return rows.select("p_partkey", "place", "choice")
