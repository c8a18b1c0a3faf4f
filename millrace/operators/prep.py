"""Preprocessing maps from raw question tables to training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 'Let\'s think step by step and output the final answer after "####".'


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def record(source: Column, messages: Column, ability: Column, truth: Column, extra: Column, style: str = "rule") -> list[Column]:
    """The five fields of a prompt record."""
    return [source.alias("data_source"), messages.alias("prompt"), ability.alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info")]


def extra(split: str, index: Column, answer: Column, question: Column, method: str | None = None) -> Column:
    return F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), answer.alias("answer"), question.alias("question"), F.lit(method).cast("string").alias("reward_method"))


def middle_part(text: Column) -> Column:
    """The text between the first and the second blank line, if there are two; else all of it; trimmed."""
    parts = F.split(text, "\n\n")
    return F.trim(F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(text))


def cleaned_ending(text: Column) -> Column:
    out = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def ending_choices(context: Column, endings: Column) -> Column:
    """The choices of an unfinished text: its cleaned context with each cleaned ending."""
    return F.transform(endings, lambda e: F.concat(cleaned_ending(context), F.lit(" "), cleaned_ending(e)))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def preferences_as_rows(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """(prompt, response, place): both answers of each pair, the chosen one first."""
    both = F.posexplode(F.array(F.col(chosen), F.col(rejected))).alias("place", "response")
    return df.select(prompt, both)


def segments(text: Column, markers: tuple[str, ...] = ("<image>", "<video>")) -> Column:
    """Typed parts of a text: each marker a part of its kind, the text between parts of kind text, none empty."""
    either = "|".join(markers)
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)({either}|(?:(?!{either}).)+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p.isin(*markers), F.regexp_replace(p, "[<>]", "")).otherwise("text").alias("kind"), p.alias("part")))


def shuffled_choices(gold: Column, wrong: list[Column], key: Column) -> tuple[Column, Column]:
    """(choices, letter): wrong answers ordered by a hash, the gold one put at a slot that a hash decides."""
    h = lambda i: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(i))))
    order = F.transform(F.array_sort(F.array(*[F.struct(h(i).alias("h"), w.alias("w")) for i, w in enumerate(wrong)])), lambda x: x["w"])
    slot = F.pmod(F.conv(F.substring(h("gold"), 1, 4), 16, 10).cast("int"), F.lit(len(wrong) + 1))
    return F.concat(F.slice(order, 1, slot), F.array(gold), F.slice(order, slot + 1, F.lit(len(wrong)))), F.substring(F.lit("ABCDEFGH"), slot + 1, F.lit(1))


def transcript(text: Column) -> Column:
    """Messages of a tagged transcript: text is the assistant's, `<code>` its tool call, `<interpreter>` the tool's answer."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(<code>.*?</code>|<interpreter>.*?</interpreter>|(?:(?!<code>|<interpreter>).)+)"), F.lit(1))
    kind = lambda p: F.when(p.startswith("<code>"), "tool_call").when(p.startswith("<interpreter>"), "tool").otherwise("assistant")
    made = F.transform(parts, lambda p: F.struct(kind(p).alias("role"), F.trim(F.regexp_replace(p, "</?(code|interpreter|answer)>", "")).alias("content")))
    return F.filter(made, lambda m: m["content"] != "")


def role_errors(messages: Column) -> Column:
    """What is wrong with a conversation's roles, or null: an unknown role, or a system turn after the first."""
    roles = F.transform(messages, lambda m: m["role"])
    unknown = F.exists(roles, lambda r: ~r.isin("system", "user", "assistant", "tool"))
    late = F.exists(F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), lambda r: r == "system")
    return F.when(unknown, "unknown role").when(late, "system after the first turn")


def tokens_of(text: Column) -> Column:
    """White-space tokens: the offline stand-in for a tokenizer's."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def sft_row(prompt: Column, response: Column, most: int) -> tuple[Column, Column]:
    """(tokens, loss_mask) of prompt, response and end: no loss on the prompt but for its last token, nor on the last token."""
    p, r = tokens_of(prompt), F.concat(tokens_of(response), F.array(F.lit("</s>")))
    ids = F.slice(F.concat(p, r), 1, most)
    n = F.size(ids)
    mask = F.transform(ids, lambda _, i: F.when((i < F.size(p) - 1) | (i == n - 1), 0).otherwise(1))
    return ids, mask


def packed_chat(messages: Column) -> tuple[Column, Column]:
    """(tokens, loss_mask) of a conversation: each message's role mark and words, with loss on the assistant's words alone."""
    own = F.transform(messages, lambda m: F.concat(F.array(F.concat(F.lit("<"), m["role"], F.lit(">"))), tokens_of(m["content"])))
    mask = F.transform(messages, lambda m: F.concat(F.array(F.lit(0)), F.transform(tokens_of(m["content"]), lambda _: (m["role"] == "assistant").cast("int"))))
    return F.flatten(own), F.flatten(mask)


def grouped_tools(messages: Column) -> Column:
    """The messages with each run of tool messages as one, its contents joined by line breaks."""
    kind = "array<struct<role:string,content:string>>"

    def add(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.lit("tool").alias("role"), F.concat_ws("\n", last["content"], m["content"]).alias("content"))
        both = (m["role"] == "tool") & (last["role"] == "tool")
        return F.when(both, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(F.struct(m["role"].alias("role"), m["content"].alias("content")))))

    return F.aggregate(messages, F.array().cast(kind), lambda done, m: F.coalesce(add(done, m), done))


def attention_mask(left: Column, valid: Column, width: int) -> Column:
    """`width` numbers: `left` zeros of padding, `valid` ones, and zeros to the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when((i >= left) & (i < left + valid), 1).otherwise(0))


def random_lengths(key: Column, width: int, most_valid: float, most_left: float, least_valid: float = 0.0) -> tuple[Column, Column]:
    """(left padding, valid tokens) of a row, drawn by a hash of its key within shares of the width."""
    high, low, pad = int(width * most_valid), max(1, int(width * least_valid)), int(width * most_left)
    if not 0 < high or high + pad > width or low > high:
        raise ValueError("the shares do not fit the width")
    draw = lambda seed, n: F.pmod(F.pmod(key * F.lit(2654435761) + F.lit(seed * 40503), F.lit(4294967296)), F.lit(n))
    return draw(1, pad + 1), draw(2, high - low + 1) + low


#: Prompts of the multiple-choice and the code benchmarks.
CHOICE_PROMPT = (
    "Answer the following multiple choice question. The last line of your response should be of the following "
    "format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before "
    "answering.\n\n{Question}\n\nA) {A}\nB) {B}\nC) {C}\nD) {D}"
)
CODE_PROMPT = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.\n\nQuestion: {Question}\n\n"
WITH_STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n{Starter}\n```"
WITHOUT_STARTER = (
    "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test "
    "on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python "
    "program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."
    "```python\n# YOUR CODE HERE\n```"
)


def filled(form: str, **values: Column) -> Column:
    """The form with each {name} replaced by its value."""
    out = F.lit(form)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def aime_pair(rows: DataFrame) -> tuple[Column, Column]:
    return F.col("Problem"), F.col("Answer").cast("string")


def cnmo_pair(rows: DataFrame) -> tuple[Column, Column]:
    return F.col("question"), F.col("answer")


def gpqa_pair(rows: DataFrame) -> tuple[Column, Column]:
    choices, letter = shuffled_choices(F.col("Correct Answer"), [F.col(f"Incorrect Answer {i}") for i in (1, 2, 3)], F.col("index"))
    return filled(CHOICE_PROMPT, Question=F.col("Question"), **{c: F.element_at(choices, i + 1) for i, c in enumerate("ABCD")}), letter


def code_pair(rows: DataFrame) -> tuple[Column, Column]:
    """The prompt by whether there is starter code, and the public and private tests as one JSON; a pickled test list is not read."""
    case = "array<struct<input:string,output:string>>"
    tests = F.concat(F.from_json("public_test_cases", case), F.coalesce(F.from_json("private_test_cases", case), F.array().cast(case)))
    starter = F.coalesce(F.col("starter_code"), F.lit(""))
    prompt = F.concat(filled(CODE_PROMPT, Question=F.col("question_content")), F.when(starter != "", filled(WITH_STARTER, Starter=starter)).otherwise(WITHOUT_STARTER))
    truth = F.struct(F.transform(tests, lambda t: t["input"]).alias("inputs"), F.transform(tests, lambda t: t["output"]).alias("outputs"), F.get_json_object("metadata", "$.func_name").alias("fn_name"))
    return prompt, F.to_json(truth, {"ignoreNullFields": "false"})


#: Benchmarks by name: their source, ability, and the question and answer of a row. Rows bring an `index`.
BENCHMARKS = {
    "aime2024": ("Maxwell-Jia/AIME_2024", "English", aime_pair),
    "gpqa_diamond": ("Idavidrein/gpqa", "Math", gpqa_pair),
    "cnmo2024": ("opencompass/cnmo2024_en", "Math", cnmo_pair),
    "livecodebench": ("livecodebench/code_generation_lite", "Code", code_pair),
}


def benchmark_records(name: str, rows: DataFrame, source: str | None = None) -> DataFrame:
    """Prompt records of a benchmark's rows."""
    if name not in BENCHMARKS:
        raise ValueError(f"no benchmark {name}; there are {', '.join(sorted(BENCHMARKS))}")
    own, ability, pair = BENCHMARKS[name]
    question, answer = pair(rows)
    more = F.struct(F.lit("test").alias("split"), F.col("index").cast("long").alias("index"))
    return rows.select(*record(F.lit(source or own), F.array(message("user", question)), F.lit(ability), answer, more))


def digit_completion(prompt: Column) -> Column:
    """The continuation that a prompt `a,b:limit,n` asks for: n numbers at the distance of a and b, modulo the limit."""
    part = lambda i: F.split(prompt, "[,:]")[i].cast("int")
    a, b, limit, n = (part(i) for i in range(4))
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.pmod(b + k * F.pmod(b - a, limit), limit).cast("string"))
    return F.when(n > 0, F.array_join(numbers, ",")).otherwise("")


def dense_rewards(response: Column, truth: Column, whole: float = 1.0) -> Column:
    """A reward for each character: an equal share (the end counts as one more) up to the first that differs from the truth."""
    n = F.length(truth)
    places = F.filter(F.sequence(F.lit(0), F.length(response)), lambda i: i < F.length(response))
    right = lambda i: (i < n) & (F.substr(response, F.lit(1), i + 1) == F.substr(truth, F.lit(1), i + 1))
    return F.transform(places, lambda i: F.when(right(i), whole / (n + 1)).otherwise(0.0))


#: What a judging model is asked.
JUDGE_PROMPT = (
    "The following is a math problem and an AI solution:\n\n[Math Problem]\n\n{problem}\n\n[AI Solution]\n\n{solution}\n\n"
    "Your task is to review and critique the solution step by step, and output whether the AI solution is correct.\n\n"
    "Please put your final answer (i.e., 'True' or 'False') in \\boxed{}."
)


def judge_messages(problem: Column, solution: Column) -> Column:
    """The messages that a judging model gets; sending them is the caller's."""
    return F.array(message("user", filled(JUDGE_PROMPT, problem=problem, solution=solution)))
