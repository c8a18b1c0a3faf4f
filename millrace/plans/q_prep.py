"""Queries on sources and preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import r6, register, table
from millrace.functions import extract as X
from millrace.functions import grade
from millrace.operators import prep as P
from millrace.operators import tokens as T
from millrace.plans import views as V
from millrace.sources import io

HASH = "replace(regexp_extract_all(answer, '#### (-?[0-9.,]+)', 1)[1], ',', '')"


@register("SELECT 0 AS file_no, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM customer")
def scan_parquet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/customer.parquet"
    return io.read_parquet(spark, [path, path]).groupBy("file_no").agg(F.count("*").alias("n"))


@register("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, k < floor(n * 0.75) AS head FROM o WHERE k < floor(n * 0.75) OR k >= floor(n * 0.75)")
def scan_split_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return io.split_slice(o, 0, 0.75, ["o_orderkey"]).withColumn("head", F.lit(True)).unionByName(io.split_slice(o, 0.75, 1, ["o_orderkey"]).withColumn("head", F.lit(False)))


@register("SELECT event_type, CAST(props::JSON ->> '$.k' AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def scan_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@register(r"SELECT conv_id, turn, md5(regexp_replace(text, '[0-9]+', '*', 'g')) AS masked, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS row_no FROM conversations")
def dump_rows_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace("text", "[0-9]+", "*")).alias("masked"), (F.row_number().over(w) - 1).alias("row_no"))


@register("SELECT doc_id, instr(text, 'the') > 0 AS hit FROM documents WHERE contains(text, 'tion')")
def dump_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("tion"))).select("doc_id", (F.instr("text", "the") > 0).alias("hit"))


@register("SELECT 'time/gen' AS name, round(sum(value), 6) + 0.0 AS value FROM events UNION ALL SELECT 'time/all/max', round(max(value), 6) + 0.0 FROM events UNION ALL SELECT 'n', count(*) + 0.0::DOUBLE FROM events")
def flatten_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").agg(F.struct(F.sum("value").alias("gen"), F.struct(F.max("value").alias("max")).alias("all")).alias("time"), F.count("*").alias("n"))
    return io.flattened(e).select("name", r6("value").alias("value"))


@register("SELECT i AS id, concat('How many ', chr(CAST(97 + i % 26 AS INT)), ' are in ', repeat(concat(chr(CAST(97 + i % 26 AS INT)), 'z'), CAST(i % 5 AS INT)), '?') AS question, CASE WHEN i % 26 = 25 THEN 2 * (i % 5) ELSE i % 5 END AS answer FROM range(200) r(i)")
def synthetic_char_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    letter = F.char((97 + i % 26).cast("int"))
    text = F.repeat(F.concat(letter, F.lit("z")), (i % 5).cast("int"))
    return spark.range(200).select("id", F.concat(F.lit("How many "), letter, F.lit(" are in "), text, F.lit("?")).alias("question"), (F.length(text) - F.length(F.replace(text, letter, F.lit("")))).cast("long").alias("answer"))


@register("SELECT i AS id, concat('(', i, ' + 2) * 3 @ (', i % 7, ' - 4) / 2') AS expression, CAST((9 * (i + 2) - 2 * (i % 7 - 4)) / 2.0 AS DOUBLE) AS value FROM range(200) r(i)")
def synthetic_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions with a made-up operator, and their exact values from a recursive-descent reader."""

    @F.pandas_udf("double")
    def value(s):  # noqa: ANN001, ANN202
        return s.map(lambda e: None if (v := grade.evaluate(e)) is None else float(v)).astype(float)

    i = F.col("id").cast("string")
    text = F.concat(F.lit("("), i, F.lit(" + 2) * 3 @ ("), (F.col("id") % 7).cast("string"), F.lit(" - 4) / 2"))
    return spark.range(200).select("id", text.alias("expression")).select("id", "expression", value("expression").alias("value"))


@register("SELECT a, s AS step, array_to_string(list_transform(range(0, 4), lambda k: (a + k * s) % 100), ',') AS shown, array_to_string(list_transform(range(4, 8), lambda k: (a + k * s) % 100), ',') AS truth FROM range(1, 20) r(a), range(1, 6) q(s)")
def digit_completion_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 20).withColumnRenamed("id", "a").withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    run = lambda lo, hi: F.array_join(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: ((F.col("a") + k * F.col("step")) % 100).cast("string")), ",")
    return rows.select("a", "step", run(0, 3).alias("shown"), run(4, 7).alias("truth"))


@register("SELECT doc_id, length(text) AS n, ascii(text[1]) AS first_id FROM documents")
def character_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chars).cast("long").alias("n"), F.ascii(F.element_at(chars, 1)).alias("first_id"))


@register(f"SELECT id, data_source, concat(question, ' ', 'Let''s think step by step and output the final answer after \"####\".') AS content, 'user' AS role, 'rule' AS style, {HASH} AS ground_truth, 'train' AS split, id AS index FROM prompts")
def map_word_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.prompts(spark, sf_dir)
    made = rows.select("id", *P.record(F.col("data_source"), F.array(P.message("user", F.concat(F.col("question"), F.lit(" "), F.lit(P.STEPS)))), F.lit("math"), X.hash_answer(F.col("answer")), P.extra("train", F.col("id"), F.col("answer"), F.col("question"))))
    return made.select("id", "data_source", F.col("prompt")[0]["content"].alias("content"), F.col("prompt")[0]["role"].alias("role"), "reward_model.style", "reward_model.ground_truth", "extra_info.split", "extra_info.index")


FORM = "Think in parallel.\nProblem: {Problem}\nEnd with Final Answer."


@register(f"SELECT id, replace('Think in parallel.\nProblem: {{Problem}}\nEnd with Final Answer.', '{{Problem}}', question) AS content, {HASH} AS ground_truth FROM prompts WHERE regexp_matches(answer, '#### -?[0-9.,]+') AND len(regexp_extract_all(replace('Think in parallel.\nProblem: {{Problem}}\nEnd with Final Answer.', '{{Problem}}', question), '\\S+')) <= 20")
def map_templated_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an answer whose templated prompt is short enough, templated."""
    content = io.filled(F.lit(FORM), F.col("question"))
    return V.prompts(spark, sf_dir).where(F.col("answer").rlike(r"#### -?[0-9.,]+") & (F.size(P.tokens_of(content)) <= 20)).select("id", content.alias("content"), X.hash_answer(F.col("answer")).alias("ground_truth"))


@register("SELECT id, trim(CASE WHEN len(string_split(t, chr(10) || chr(10))) >= 3 THEN string_split(t, chr(10) || chr(10))[2] ELSE t END) AS problem, 'accuracy_reward' AS reward_method FROM (SELECT id, concat(CASE WHEN id % 2 = 0 THEN 'Solve.' || chr(10) || chr(10) ELSE '' END, question, CASE WHEN id % 3 <> 0 THEN chr(10) || chr(10) || 'Remember.' ELSE '' END) AS t FROM prompts)")
def map_middle_of_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("id") % 2 == 0, "Solve.\n\n").otherwise(""), F.col("question"), F.when(F.col("id") % 3 != 0, "\n\nRemember.").otherwise(""))
    return V.prompts(spark, sf_dir).select("id", P.middle_part(text).alias("problem"), F.lit("accuracy_reward").alias("reward_method"))


@register(r"SELECT doc_id, CAST(n_chars AS VARCHAR) AS ground_truth FROM documents")
def map_boxed_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(r" so \boxed{0}, no, \boxed{"), F.col("n_chars").cast("string"), F.lit("}."))
    return table(spark, sf_dir, "documents").select("doc_id", grade.boxed_answer(text).alias("ground_truth"))


@register(r"SELECT p_partkey, replace(regexp_replace(replace(trim(concat(' ', p_name, ' [title]', p_type, ' [x]  end')), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS ctx, concat(upper(p_type[1]), lower(p_type[2:])) AS cap FROM part WHERE length(p_brand) > 0")
def map_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "p_name", F.lit(" [title]"), "p_type", F.lit(" [x]  end"))
    return table(spark, sf_dir, "part").where(F.length("p_brand") > 0).select("p_partkey", P.cleaned_ending(text).alias("ctx"), P.capitalized(F.col("p_type")).alias("cap"))


@register("SELECT id, question AS prompt, CAST(k AS INT) AS place, CASE k WHEN 0 THEN answer ELSE 'I do not know.' END AS response FROM prompts, range(2) r(k)")
def preferences_to_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.prompts(spark, sf_dir).select("id", F.col("question").alias("prompt"), F.col("answer").alias("chosen"), F.lit("I do not know.").alias("rejected"))
    return rows.select("id", "prompt", F.posexplode(F.array("chosen", "rejected")).alias("place", "response"))


@register("WITH o AS (SELECT id, question AS prompt, answer AS chosen, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM prompts) SELECT id, prompt, chosen, 'No.' AS rejected FROM o WHERE k >= floor(n * 0.75)")
def preferences_for_reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.prompts(spark, sf_dir).select("id", F.col("question").alias("prompt"), F.col("answer").alias("chosen"), F.lit("No.").alias("rejected"))
    return io.split_slice(rows, 0.75, 1, ["id"])


@register("SELECT id, 'model' AS style, 'alignment' AS ability, question AS content FROM prompts")
def preferences_for_rl(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = V.prompts(spark, sf_dir).select("id", *P.record(F.col("data_source"), F.array(P.message("user", F.col("question"))), F.lit("alignment"), F.col("answer"), P.extra("train", F.col("id"), F.col("answer"), F.col("question")), "model"))
    return made.select("id", "reward_model.style", "ability", F.col("prompt")[0]["content"].alias("content"))


@register("SELECT page_id, concat('<image> ', url) AS content, md5(html) AS image FROM pages")
def map_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "pages").select("page_id", F.array(P.message("user", F.concat(F.lit("<image> "), "url"))).alias("prompt"), F.array("html").alias("images"))
    return made.select("page_id", F.col("prompt")[0]["content"].alias("content"), F.md5(F.col("images")[0]).alias("image"))


@register(f"SELECT id, TRUE AS need_tools, {HASH} AS create_truth, 'tool_agent' AS agent_name, 'word_problem' AS interaction, question AS query FROM prompts")
def map_tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = X.hash_answer(F.col("answer"))
    kwargs = F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias("score_tool")).alias("tools_kwargs")
    rows = V.prompts(spark, sf_dir).select("id", F.struct(F.lit(True).alias("need_tools_kwargs"), kwargs, F.struct(F.lit("word_problem").alias("name"), F.col("question").alias("query"), truth.alias("ground_truth")).alias("interaction_kwargs")).alias("extra_info"), F.lit("tool_agent").alias("agent_name"))
    return rows.select("id", F.col("extra_info.need_tools_kwargs").alias("need_tools"), F.col("extra_info.tools_kwargs.score_tool.create_kwargs.ground_truth").alias("create_truth"), "agent_name", F.col("extra_info.interaction_kwargs.name").alias("interaction"), F.col("extra_info.interaction_kwargs.query").alias("query"))


@register("SELECT item_id, concat('searchR1_', CASE WHEN item_id % 2 = 0 THEN 'nq' ELSE 'hotpot' END) AS data_source, coalesce(CASE WHEN item_id % 3 = 0 THEN NULL ELSE text END, CAST(item_id AS VARCHAR)) AS truth, text AS question, 2 AS turns FROM benchmark")
def map_search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text asks; the truth is the reward model's where it has one, else the answer column's."""
    truth = F.coalesce(F.when(F.col("item_id") % 3 != 0, F.col("text")), F.col("item_id").cast("string"))
    chat = F.array(P.message("system", F.lit("Search first.")), P.message("user", F.col("text")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("searchR1_"), F.when(F.col("item_id") % 2 == 0, "nq").otherwise("hotpot")).alias("data_source"), truth.alias("truth"), chat.alias("chat"))
    return rows.select("item_id", "data_source", "truth", F.element_at("chat", -1)["content"].alias("question"), F.size("chat").alias("turns"))


@register("SELECT page_id, k AS place, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'text' ELSE 'video' END AS kind, CASE k WHEN 0 THEN url WHEN 1 THEN '<image>' WHEN 2 THEN ' and ' ELSE '<video>' END AS part FROM pages, (SELECT unnest([0, 1, 2, 3])::INT AS k)")
def media_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(P.segments(F.concat("url", F.lit("<image> and <video>")))).alias("place", "s"))
    return rows.select("page_id", "place", "s.kind", "s.part")


@register("SELECT id, 'ABCD'[CAST(('0x' || md5(concat(id, ':gold'))[1:4])::INT % 4 + 1 AS INT)] AS letter, TRUE AS at_letter FROM prompts")
def shuffled_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter of the gold choice, and whether the gold choice stands there."""
    choices, letter = P.shuffled_choices(F.lit("right"), [F.lit("x"), F.lit("y"), F.lit("z")], F.col("id"))
    rows = V.prompts(spark, sf_dir).select("id", choices.alias("c"), letter.alias("letter"))
    return rows.select("id", "letter", (F.element_at("c", F.ascii("letter") - 64) == "right").alias("at_letter"))


@register("SELECT doc_id, CAST(k AS INT) AS place, CASE k WHEN 0 THEN 'assistant' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'tool' ELSE 'assistant' END AS role, CASE k WHEN 0 THEN lang WHEN 1 THEN 'print(1)' WHEN 2 THEN '1' ELSE source END AS content FROM documents, range(4) r(k)")
def transcript_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("lang", F.lit(" <code>print(1)</code><interpreter>1</interpreter> <answer>"), "source", F.lit("</answer>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.transcript(text)).alias("place", "m"))
    return rows.select("doc_id", "place", "m.role", "m.content")


@register("SELECT id, lower(data_source) AS data_source, concat(question, ' Answer in a box.') AS content, 'tool_agent' AS agent_name FROM prompts")
def map_with_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prompts(spark, sf_dir).select("id", F.lower("data_source").alias("data_source"), F.concat(F.col("question"), F.lit(" Answer in a box.")).alias("content"), F.lit("tool_agent").alias("agent_name"))


@register("SELECT id, question AS inner_question, answer AS inner_answer FROM prompts")
def key_path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cells of one element are opened, and fields reached by their path."""
    nested = V.prompts(spark, sf_dir).select("id", F.array(F.struct(F.col("question").alias("question"), F.struct(F.col("answer").alias("text")).alias("answer"))).alias("cell"))
    opened = nested.select("id", F.when(F.size("cell") == 1, F.col("cell")[0]).alias("cell"))
    return opened.select("id", F.col("cell.question").alias("inner_question"), F.col("cell.answer.text").alias("inner_answer"))


@register("SELECT id, len(regexp_extract_all(question, '\\S+')) AS tokens FROM prompts WHERE len(regexp_extract_all(question, '\\S+')) <= 8")
def overlong_prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(P.tokens_of(F.col("question"))).cast("long")
    return V.prompts(spark, sf_dir).where(n <= 8).select("id", n.alias("tokens"))


@register("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-08-00' AND strftime(o_orderdate, '%Y-%m-%d') < '1997-02-00'")
def date_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates are compared as ISO strings: the bounds need not be dates."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where((day >= "1996-08-00") & (day < "1997-02-00")).select("o_orderkey")


CHAT = "c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    seen = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(seen, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))


@register("SELECT conv_id, max(CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'unknown role' WHEN role = 'system' AND k > 1 THEN 'system after the first turn' END) AS error FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def chat_role_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", P.role_errors(F.col("m")).alias("error"))


@register(r"""SELECT conv_id, CAST(sum(1 + len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) ELSE 0 END) AS BIGINT) AS loss_tokens FROM conversations GROUP BY conv_id""")
def chat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, mask = P.packed_chat(F.col("m"))
    return chats(spark, sf_dir).select("conv_id", F.size(ids).cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("loss_tokens"))


@register(r"""WITH w AS (SELECT id, len(regexp_extract_all(question, '\S+')) AS p, len(regexp_extract_all(answer, '\S+')) + 1 AS r FROM prompts)
    SELECT id, CAST(least(p + r, 12) AS BIGINT) AS n, CAST(greatest(least(p + r, 12) - 1 - greatest(p - 1, 0), 0) AS BIGINT) AS loss FROM w""")
def sft_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, mask = P.sft_row(F.col("question"), F.col("answer"), 12)
    return V.prompts(spark, sf_dir).select("id", F.size(ids).cast("long").alias("n"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("loss"))


@register(r"""WITH w AS (SELECT id, len(regexp_extract_all(concat(question, ' ', answer), '\S+')) AS c, len(regexp_extract_all(concat(question, ' No.'), '\S+')) AS r FROM prompts) SELECT id, CAST(least(c, 10) AS BIGINT) AS chosen, CAST(least(r, 10) AS BIGINT) AS rejected, 10 AS width FROM w""")
def reward_pair_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = (P.tokens_of(F.concat(F.col("question"), F.lit(" "), x)) for x in (F.col("answer"), F.lit("No.")))
    padded = [T.pad_or_cut(x, 10, F.lit("<pad>"), False, "right") for x in (c, r)]
    kept = [F.size(F.filter(x, lambda t: t != "<pad>")).cast("long") for x in padded]
    return V.prompts(spark, sf_dir).select("id", kept[0].alias("chosen"), kept[1].alias("rejected"), F.size(padded[0]).alias("width"))


@register("SELECT conv_id, turn, role, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations)")
def adjacent_role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    return table(spark, sf_dir, "conversations").withColumn("new", new).select("conv_id", "turn", "role", F.sum("new").over(w).alias("run"))


@register(r"""WITH t AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS n FROM conversations), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS calls FROM t)
    SELECT conv_id, CAST(sum(greatest(least(n, 60 - (upto - n)), 0)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN greatest(least(n, 60 - (upto - n)), 0) ELSE 0 END) AS BIGINT) AS own_tokens, count(*) + 1 AS num_turns FROM c WHERE upto - n < 60 AND calls <= 3 GROUP BY conv_id""")
def rollout_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns up to the first stop: 60 tokens or three assistant turns; the last turn is cut; mask 1 on the assistant's tokens."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(P.tokens_of(F.col("text"))).alias("n"))
    c = t.withColumns({"upto": F.sum("n").over(w), "calls": F.sum((F.col("role") == "assistant").cast("int")).over(w)})
    kept = F.greatest(F.least(F.col("n"), 60 - (F.col("upto") - F.col("n"))), F.lit(0))
    return c.where("upto - n < 60 AND calls <= 3").groupBy("conv_id").agg(F.sum(kept).alias("tokens"), F.sum(F.when(F.col("role") == "assistant", kept).otherwise(0)).alias("own_tokens"), (F.count("*") + 1).alias("num_turns"))
