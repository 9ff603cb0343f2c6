"""Queries over answers and transcripts. Tagged texts are built in the query, and in its SQL, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import math_answers as ma
from quern.functions import text as tx
from quern.plans.registry import query
from quern.plans.relational import r6, t

P = "translate(lower({}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"


def norm(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({P.format(x)}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def pairs(spark, d):
    b = t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return b.withColumn("gold", tx.first_words(F.col("text"), 3))


C = "WITH c AS (SELECT conv_id, turn, role, text, array_to_string(string_split(text, ' ')[1:3], ' ') AS gold FROM conversations) "


@query(C + f"SELECT conv_id, turn, {norm('text')} AS n FROM c")
def normalize(spark, d):
    return pairs(spark, d).select("conv_id", "turn", tx.normalize(F.col("text")).alias("n"))


@query(C + f"SELECT conv_id, turn, ({norm('gold')} = {norm('text')}) AS em, contains({norm('text')}, {norm('gold')}) AS sub, contains(' ' || {norm('text')} || ' ', ' ' || {norm('gold')} || ' ') AS span FROM c")
def em_subem_span(spark, d):
    g, golds = F.col("text"), F.array("gold")
    return pairs(spark, d).select("conv_id", "turn", tx.exact_match(g, golds).alias("em"), tx.substring_match(g, golds).alias("sub"), tx.span_match(g, golds).alias("span"))


@query("SELECT doc_id, string_agg('Doc ' || i || ' (Title: ' || lang || ')' || chr(10) || source, chr(10) ORDER BY i) AS context FROM (SELECT doc_id, lang, source, unnest([1, 2]) AS i FROM documents) GROUP BY 1")
def render_context(spark, d):
    one = F.struct(F.col("lang").alias("title"), F.col("source").alias("text"))
    return t(spark, d, "documents").select("doc_id", tx.render_documents(F.array(one, one)).alias("context"))


@query(C + "SELECT conv_id, turn, CASE WHEN trim(gold) LIKE '%?' THEN trim(gold) ELSE trim(gold) || '?' END AS question FROM c")
def question_canon(spark, d):
    return pairs(spark, d).select("conv_id", "turn", tx.question(F.concat(F.lit("  "), "gold")).alias("question"))


#: A text, the outcome read from it with deaths first, and with negations of death before these.
OUTCOMES = (
    ("The patient will die", 1, 1), ("LIKELY to survive", 0, 0), ("unlikely to die", 1, 0), ("unlikely to survive", 1, 1), ("unclear", -1, -1), ("Yes.", 1, 1), ("the answer is 0", 0, 0), ("will die <search_complete>yes</search_complete> No", 0, 0),
    ("he will not die", 0, 0), ("a poor prognosis", 1, 1), ("yes" + "\n." * 10 + "good prognosis", 0, 0), (f"will die. {tx.LOOP_START}: no", 0, 0), ("yesterday, 10 of 11", -1, -1), ("not expected to die", 1, 0),
)


#: A text, its label, its confidence, and the stated confidence of its label.
RISKS = (
    ("High risk. CONFIDENCE: Medium", 1, 0.9, 0.6), ("it is low. confidence: medium", 0, 0.5, 0.4), ("no idea", 0, 0.5, 0.5), (" low ", 0, 0.1, 0.5), ("it is likely to die; CONFIDENCE: high", 1, 0.5, 0.9), ("", 0, 0.0, 0.5),
    ("highly unlikely, low risk", 1, 0.9, 0.5), ("a low-risk case. Confidence: low", 0, 0.1, 0.7), ("good prognosis", 0, 0.5, 0.5), ("PREDICTION: HIGH-RISK", 1, 0.9, 0.5),
)


@query("""WITH x AS (SELECT doc_id, exp(-(doc_id % 7)::DOUBLE / 10) AS h, exp((doc_id % 7)::DOUBLE / 2) AS ppl FROM labels)
SELECT doc_id, round(CASE doc_id % 5 WHEN 0 THEN h / (h + exp(-1.0)) WHEN 1 THEN h / (h + exp(-1.0)) WHEN 2 THEN 0.0 WHEN 3 THEN h / (h + exp(-2.0)) ELSE 1 - CASE WHEN ppl < 2 THEN 0.9 WHEN ppl < 5 THEN 0.7 WHEN ppl < 10 THEN 0.5 ELSE 0.3 END END, 6) AS confidence FROM x""")
def logprob_confidence(spark, d):
    m = (F.col("doc_id") % 7).cast("double")
    other = lambda token, lp: F.struct(F.lit(token).alias("token"), (F.lit(lp) if isinstance(lp, float) else lp).alias("logprob"))
    none = F.array().cast("array<struct<token:string,logprob:double>>")
    said = lambda token, lp, *top: F.struct(F.lit(token).alias("token"), (F.lit(lp) if isinstance(lp, float) else lp).alias("logprob"), (F.array(*top) if top else none).alias("top"))
    both = (other(" HIGH", -m / 10), other("low", -1.0))
    cases = F.array(
        F.array(said("High", -m / 10, *both), said("x", -9.0)), F.array(said("word", -m / 2, *both)),
        F.array(said("HIGH", -3.0), said(" a", -1.0), said(" b", -1.0), said(" Final", -1.0), said(" Answer:", -1.0), said(" LOW", -m / 10)),
        F.array(said("It", -1.0, other("Died", -m / 10), other("Surviv", -2.0), other("x", -0.1))), F.array(said("stable", -m / 2)),
    )
    content = F.element_at(cases, (F.col("doc_id") % 5 + 1).cast("int"))
    response = F.array_join(F.transform(content, lambda x: x["token"]), "")
    return r6(t(spark, d, "labels").select("doc_id", tx.logprob_confidence(content, response).alias("confidence")), "confidence")


@query("SELECT doc_id, CASE WHEN s >= 0.9 THEN 3 WHEN s >= 0.7 THEN 2 WHEN s >= 0.5 THEN 1 ELSE 0 END AS score FROM (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS s FROM labels)")
def perplexity_bucket(spark, d):
    return t(spark, d, "labels").select("doc_id", tx.perplexity_score(F.col("doc_id") % 11 / 10).alias("score"))


@query(C + "SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:5], ' ') AS short FROM c")
def truncate_words(spark, d):
    return pairs(spark, d).select("conv_id", "turn", tx.first_words(F.col("text"), 5).alias("short"))


@query(C + "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE left(split_part(text, chr(10), 1), 200) END AS title, CASE WHEN turn % 2 = 0 THEN gold ELSE text END AS body FROM c")
def title_split(spark, d):
    content = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), "role", F.lit('"\n'), "gold")).otherwise(F.col("text"))
    return pairs(spark, d).withColumn("x", tx.title_and_text(content)).select("conv_id", "turn", F.col("x.title").alias("title"), F.col("x.text").alias("body"))


@query("SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS prompt, p_type AS answer FROM part")
def multiple_choice(spark, d):
    options = F.create_map(F.lit("B"), "p_type", F.lit("A"), "p_brand")
    return t(spark, d, "part").select("p_partkey", tx.choices(options).alias("prompt"), options["B"].alias("answer"))


@query("SELECT event_id, CASE WHEN value > 60 AND value < 30 THEN 'a' WHEN value > 60 THEN 'fast rate' WHEN value < 30 THEN 'slow rate' ELSE '' END AS phrases FROM events")
def feature_phrases(spark, d):
    text = F.concat(F.lit("rate "), F.col("value").cast("decimal(20,6)").cast("string"), F.lit(" at hour 1"))
    found = tx.feature_phrases(text, [(r"rate ([\d.]+)", ">", 60.0, "fast rate"), (r"rate ([\d.]+)", "<", 30.0, "slow rate")])
    return t(spark, d, "events").select("event_id", F.array_join(found, " ").alias("phrases"))


@query("SELECT doc_id, doc_id % 2 = 0 AS equal, doc_id % 3 = 0 AS right_sum FROM documents")
def math_checks(spark, d):
    a = F.when(F.col("doc_id") % 4 == 0, r"so \boxed{\dfrac{1}{2}}").when(F.col("doc_id") % 4 == 2, r"$\boxed 1/2$ it is").otherwise(r"\fbox{3}")
    e = F.when(F.col("doc_id") % 3 == 0, "(1+2)*4").otherwise("1+2+4")
    return t(spark, d, "documents").select("doc_id", ma.math_equal(a, F.lit("1/2")).alias("equal"), ma.countdown_equal(e, F.array(F.lit(1), F.lit(2), F.lit(4)), F.lit(12.0)).alias("right_sum"))


@query("SELECT d.doc_id, (CASE WHEN d.source IS NULL THEN 0 ELSE q.quality - coalesce(z.s, 0) + q.quality END)::INTEGER AS reward FROM labels q JOIN documents d USING (doc_id) LEFT JOIN (SELECT doc_id, min(toxic) AS s FROM labels WHERE doc_id % 3 = 0 GROUP BY 1) z ON z.doc_id = d.doc_id")
def utility_reward(spark, d):
    cache = t(spark, d, "labels").filter("doc_id % 3 = 0").groupBy("doc_id").agg(F.min("toxic").alias("zero_shot"))
    told = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").join(cache, "doc_id", "left")
    reward = tx.utility_reward(F.col("quality"), F.col("zero_shot"))
    return told.select("doc_id", F.when(F.col("source").isNull(), 0).otherwise(reward).cast("int").alias("reward"))


@query("SELECT doc_id, (CASE WHEN lang = 'en' THEN n_chars WHEN lang = 'de' THEN -1 ELSE 0 END)::BIGINT AS score FROM documents")
def score_by_source(spark, d):
    score = tx.score_by_source(F.col("lang"), {"en": F.col("n_chars"), "de": F.lit(-1)}, F.lit(0))
    return t(spark, d, "documents").select("doc_id", score.cast("long").alias("score"))


@query("SELECT conv_id, turn FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 40")
def prompt_length_filter(spark, d):
    from quern.functions import prompts as pr

    return t(spark, d, "conversations").filter(pr.fits(pr.chat(F.col("text")), 40)).select("conv_id", "turn")
