"""A search agent as rounds of DataFrames: generate, parse, retrieve, append, until done or out of turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx


def trajectory_stats(turns: DataFrame, trajectory: str, valid: Column, search: Column, finish: Column) -> DataFrame:
    """Mean turns, valid actions, searches and share of finished trajectories."""
    each = turns.groupBy(trajectory).agg(F.count("*").alias("t"), F.count_if(valid).alias("v"), F.count_if(search).alias("s"), F.max(finish.cast("int")).alias("f"))
    return each.agg(F.avg("t").alias("turns"), F.avg("v").alias("valid"), F.avg("s").alias("searches"), F.avg("f").alias("finished"))


def triples(df: DataFrame, history: str) -> DataFrame:
    """The columns of df and a row for each step (from 1): query, result, important."""
    h = F.col(history)
    steps = F.arrays_zip(tx.tag_bodies(h, "query").alias("query"), tx.tag_bodies(h, "information").alias("result"), tx.tag_bodies(h, "important_info").alias("important"))
    return df.select("*", F.posexplode(steps).alias("k", "x")).select(*df.columns, (F.col("k") + 1).alias("step"), "x.*")


def search_loop(questions: DataFrame, generate: Callable[[DataFrame], DataFrame], retrieve: Callable[[DataFrame], DataFrame], turns: int, keep: Callable[[DataFrame], DataFrame], action: Callable[[Column], Column] = tx.action, query: Callable[[Column], Column] = tx.query_of) -> DataFrame:
    """id, history, searches, done after at most `turns` rounds of search and one without.

    questions: id, question. generate: adds `response` to rows with a `history`. retrieve: rows of (id, information) for rows of
    (id, query). keep: cuts the lineage after each round (a checkpoint or a written table). action, query: read a response. Rows that
    are done are not given to generate again."""
    state = questions.select("id", F.concat(F.lit("<question>"), "question", F.lit("</question>")).alias("history"), F.lit(0).alias("searches"), F.lit(False).alias("done"))
    for turn in range(turns + 1):
        said = keep(generate(state.filter(~F.col("done"))).withColumn("action", action(F.col("response"))))
        grown = said.withColumn("history", F.concat("history", "response"))
        asking = grown.filter(F.col("action") == "search") if turn < turns else grown.limit(0)
        found = retrieve(asking.select("id", query(F.col("response")).alias("query")))
        more = grown.join(found.select("id", "information"), "id", "left")
        block = F.concat(F.lit("<information>"), "information", F.lit("</information>"))
        after = more.select("id", F.concat("history", F.coalesce(block, F.lit(""))).alias("history"), (F.col("searches") + F.col("information").isNotNull().cast("int")).alias("searches"), (F.col("action") != "search").alias("done"))
        state = keep(state.filter("done").unionByName(after))
    return state


def search_tag_action(text: Column) -> Column:
    """search, done or none of a response with <search> and <answer> tags, whichever comes first."""
    kind = F.regexp_extract(text, r"(?s)<(search|answer)>.*?</\1>", 1)
    return F.when(kind == "search", "search").when(kind == "answer", "done").otherwise("none")


def search_tag_query(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?s)<search>(.*?)</search>", 1))


def interleaved(questions: DataFrame, generate: Callable[[DataFrame], DataFrame], retrieve: Callable[[DataFrame], DataFrame], steps: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, question, chain (array of thoughts), context, done: the question is looked up first, then each thought that does not say
    search_complete is looked up itself, and what is found is added to the context, for `steps` thoughts at most."""
    first = retrieve(questions.select("id", F.col("question").alias("query")))
    state = questions.join(first.select("id", F.col("information").alias("context")), "id", "left")
    state = keep(state.select("id", "question", F.array().cast("array<string>").alias("chain"), F.coalesce("context", F.lit("")).alias("context"), F.lit(False).alias("done")))
    for _ in range(steps):
        said = keep(generate(state.filter(~F.col("done"))).withColumn("response", F.trim("response")))
        told = said.withColumn("chain", F.array_append("chain", F.col("response"))).withColumn("done", F.contains(F.lower("response"), F.lit("<search_complete>yes</search_complete>")))
        thought = F.trim(F.regexp_replace("response", r"(?is)<search_complete>.*?</search_complete>", ""))
        found = retrieve(told.filter(~F.col("done")).select("id", thought.alias("query"))).select("id", "information")
        context = F.concat("context", F.coalesce(F.concat(F.lit("\n"), "information"), F.lit("")))
        after = told.join(found, "id", "left").select("id", "question", "chain", context.alias("context"), "done")
        state = keep(state.filter("done").unionByName(after))
    return state


# Marks around queries and results in a chain of reasoning.
QUERY_MARKS = ("<|begin_search_query|>", "<|end_search_query|>")
RESULT_MARKS = ("<|begin_search_result|>", "<|end_search_result|>")


def analysed(questions: DataFrame, generate: Callable[[DataFrame], DataFrame], retrieve: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame], turns: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, history, searches, done: a response that holds a marked query is looked up, what is found is read by `analyse` (adds
    `analysis` to id, history, query, information), and the analysis goes into the history between marks; a response without one ends."""
    asked = r"(?s)" + r"(.*?)".join(m.replace("|", r"\|") for m in QUERY_MARKS)
    state = questions.select("id", F.concat(F.lit("Question: "), "question").alias("history"), F.lit(0).alias("searches"), F.lit(False).alias("done"))
    for _ in range(turns):
        said = keep(generate(state.filter(~F.col("done"))))
        grown = said.withColumn("history", F.concat("history", F.lit("\n"), "response")).withColumn("query", F.trim(F.regexp_extract("response", asked, 1)))
        asking = grown.filter("query <> ''")
        found = asking.select("id", "history", "query").join(retrieve(asking.select("id", "query")).select("id", "information"), "id")
        read = analyse(found).select("id", F.concat(F.lit(f"\n{RESULT_MARKS[0]}\n"), "analysis", F.lit(f"\n{RESULT_MARKS[1]}\n")).alias("block"))
        after = grown.join(read, "id", "left").select("id", F.concat("history", F.coalesce("block", F.lit(""))).alias("history"), (F.col("searches") + F.col("block").isNotNull().cast("int")).alias("searches"), (F.col("query") == "").alias("done"))
        state = keep(state.filter("done").unionByName(after))
    return state
