"""Queries on competition answers: spans, normal forms, equality by value and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register, table
from millrace.functions import competition as K
from millrace.functions import rewards


def picked(*values: Column | str) -> Column:
    """One of the values by doc_id."""
    out = F.when(F.col("doc_id") % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col("doc_id") % len(values) == i, v)
    return out


def sql_picked(*values: str) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"




def n() -> Column:
    return F.col("n_chars").cast("string")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


RAW_SQL = sql_picked(
    "concat(n, ' meters')", "concat('$', n)", "concat('\\text{', n, ' feet}')", "concat(n, '\\%')", "concat(n, ' 1/2')", "concat(n, ' or ', m)",
    "concat(n, '^\\circ')", "concat('- ', n)", "concat(n, ',\\! ', '000')", "concat('{', n, '.0}')", "concat('(', n, ', ', m, ')')", "concat(m, ' million')",
)
UNIT_SQL = "(?:" + "|".join(K.UNITS) + ")(?:es)?s? *(?:\\^[0-9]+)?"


@register(f"""WITH a AS (SELECT doc_id, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars % 10 AS VARCHAR) AS m FROM documents), r AS (SELECT doc_id, {RAW_SQL} AS x FROM a),
    b AS (SELECT doc_id, replace(replace(replace(regexp_replace(regexp_replace(x, '^\\\\text\\{{(.+)\\}}$', '\\1'), '\\\\?[$%]', '', 'g'), ' or ', ' , '), ' and ', ' , '), 'million', '*10^6') AS x FROM r),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{UNIT_SQL}', '', 'g'), '\\^ *\\\\circ', '', 'g'), '^\\{{(.*)\\}}$', '\\1'), ',\\\\! *', '', 'g') AS x FROM b),
    d AS (SELECT doc_id, lower(regexp_replace(regexp_replace(CASE WHEN contains(x, ',') THEN x WHEN TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN CAST(CAST(TRY_CAST(x AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE x END, '- *', '-', 'g'), '([0-9]) +([0-9])', '\\1+\\2', 'g')) AS x FROM c)
    SELECT doc_id, CASE WHEN TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN CAST(CAST(TRY_CAST(x AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE x END AS answer FROM d""")
def competition_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.col("n_chars") % 10).cast("string")
    raw = picked(
        text(n(), " meters"), text("$", n()), text("\\text{", n(), " feet}"), text(n(), "\\%"), text(n(), " 1/2"), text(n(), " or ", m),
        text(n(), "^\\circ"), text("- ", n()), text(n(), ",\\! ", "000"), text("{", n(), ".0}"), text("(", n(), ", ", m, ")"), text(m, " million"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", K.competition_answer(raw).alias("answer"))


FACTORS = ("1.0", "100.0", "0.01", "1.5", "1.00005", "1.0002", "-1.0")


@register(f"SELECT doc_id, abs(n_chars - f * n_chars) <= 1e-4 * greatest(n_chars, abs(f * n_chars)) OR abs(n_chars / 100.0 - f * n_chars) <= 1e-4 * greatest(n_chars / 100.0, abs(f * n_chars)) OR abs(n_chars * 100.0 - f * n_chars) <= 1e-4 * greatest(n_chars * 100.0, abs(f * n_chars)) AS equal FROM (SELECT doc_id, n_chars, CAST({sql_picked(*FACTORS)} AS DOUBLE) AS f FROM documents)")
def math_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within a ten-thousandth of the truth, a hundredth or a hundred times it."""
    given = F.col("n_chars").cast("double") * picked(*[F.lit(float(f)) for f in FACTORS])
    return table(spark, sf_dir, "documents").select("doc_id", K.equal_by_value(given.cast("string"), n()).alias("equal"))


@register("SELECT doc_id, CAST(n_chars % 7 AS INT) AS a, CAST(n_chars % 5 AS INT) AS b, n_chars % 7 = doc_id % 3 AS same_polynomial, n_chars % 7 = doc_id % 3 AS same_interval, n_chars % 7 = n_chars % 5 AS same_matrix FROM documents")
def symbolic_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded against factored polynomials, intervals by element, and matrices written in two ways."""
    a, b, c = ((F.col(x) % k).cast("string") for x, k in (("n_chars", 7), ("n_chars", 5), ("doc_id", 3)))
    expanded = F.concat(F.lit("x^2 + "), (2 * (F.col("n_chars") % 7)).cast("string"), F.lit("x + "), F.pow(F.col("n_chars") % 7, 2).cast("int").cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", a.cast("int").alias("a"), b.cast("int").alias("b"), K.equal_by_value(expanded, F.concat(F.lit("(x+"), c, F.lit(")^2"))).alias("same_polynomial"),
        K.equal_by_value(F.concat(F.lit("Interval.Ropen("), a, F.lit(", 50)")), F.concat(F.lit("["), c, F.lit(", 50)"))).alias("same_interval"),
        K.equal_by_value(F.concat(F.lit("[["), a, F.lit(", 1], [2, 3]]")), F.concat(F.lit(r"\begin{pmatrix}"), b, F.lit(r" & 1 \\ 2 & 3\end{pmatrix}"))).alias("same_matrix"),
    )
    return rows


@register("SELECT doc_id, doc_id % 4 <> 3 AS correct, doc_id % 4 <> 3 AS formed, CASE doc_id % 4 WHEN 2 THEN concat(n_chars, '.0') WHEN 3 THEN CAST(n_chars * 3 AS VARCHAR) ELSE CAST(n_chars AS VARCHAR) END AS span FROM documents")
def prime_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a sentence, in a box, as a decimal, and a wrong one."""
    more = (F.col("n_chars") * 3).cast("string")
    response = picked(text("We count. The answer is ", n()), text("We get \\boxed{", n(), "} at last"), text("Answer: ", n(), ".0"), text("Then it is ", more))
    found = K.scored(response, n())
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.correct", "s.formed", "s.span")


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0.0::DOUBLE ELSE CASE WHEN doc_id % 3 = 0 OR n_chars % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score, CASE WHEN doc_id % 3 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS format_score, doc_id % 3 = 0 OR (doc_id % 3 = 1 AND n_chars % 2 = 0) AS acc FROM documents")
def superset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most lenient grader on boxed answers: as written, as a fraction of the truth's double, and without a box."""
    half = F.floor(F.col("n_chars") / 2).cast("string")
    response = picked(text("so \\boxed{", n(), "}"), text("so \\boxed{2 \\cdot ", half, "}"), text("so ", n()))
    found = K.superset_scored(response, F.when(F.col("doc_id") % 3 == 1, text("2*", half, " + ", (F.col("n_chars") % 2).cast("string"))).otherwise(n()))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.*")


@register("SELECT doc_id, doc_id % 3 <> 2 AS stated, CASE doc_id % 3 WHEN 2 THEN 'nothing here' ELSE CAST(n_chars AS VARCHAR) END AS span FROM documents")
def stated_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a response states: after the verb at the end, before the words that follow an answer, or nothing."""
    response = picked(text("First we look; so the count must be ", n()), text("We see that x = ", n(), " is the answer."), F.lit("nothing here"))
    found = K.stated_answer(response)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.stated", "s.span")


@register("SELECT s AS source, CASE WHEN contains(s, 'GSM8k') THEN 'word' WHEN s = 'lighteval/MATH' THEN 'math' WHEN s = 'hiyouga/geometry3k' THEN 'geometry' WHEN s LIKE 'numina_%' THEN 'prime' END AS family, count(*) AS n FROM (SELECT ['openai/GSM8k', 'lighteval/MATH', 'hiyouga/geometry3k', 'numina_x'][CAST(doc_id % 4 + 1 AS INT)] AS s FROM documents) GROUP BY ALL")
def reward_dispatch_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of each source; a source that no family knows would end the query."""
    source = picked(*[F.lit(s) for s in ("openai/GSM8k", "lighteval/MATH", "hiyouga/geometry3k", "numina_x")])
    rows = table(spark, sf_dir, "documents").select(source.alias("source"))
    return rows.select("source", rewards.family_or_error(F.col("source")).alias("family")).groupBy("source", "family").agg(F.count("*").alias("n"))
