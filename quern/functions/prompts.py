"""Prompts, documents and queries rendered from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chat(content: Column, system: str | None = None) -> Column:
    """Array of (role, content)."""
    told = [F.struct(F.lit("user").alias("role"), content.alias("content"))]
    return F.array(*([F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []), *told)


def encoder_text(text: Column, model: str, query: bool) -> Column:
    """What an encoder of a family expects before a text: e5 'query: ' or 'passage: '; bge an instruction before queries."""
    if model == "e5":
        return F.concat(F.lit("query: " if query else "passage: "), text)
    if model == "bge" and query:
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), text)
    return text


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean over the positions of mask 1 of an array of equally long vectors."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def pooled(vectors: Column, mask: Column, how: str = "mean", pooler: Column | None = None) -> Column:
    """One vector of a text's token vectors: the mean of the valid ones, the first token's (cls), or what the model's pooler gave."""
    if how == "mean":
        return mean_pool(vectors, mask)
    if how == "cls":
        return F.get(vectors, F.lit(0))
    if how == "pooler" and pooler is not None:
        return pooler
    raise ValueError(f"pooling {how!r} is none of mean, cls, pooler (of a model that has one)")


#: Which pooling a family of encoders was trained with.
POOLING = {"e5": "mean", "bge": "cls", "contriever": "mean", "jina": "mean"}


def truncated(ids: Column, most: int, how: str = "error") -> Column:
    """Ids cut to `most`: left keeps the last ones, right the first ones, middle both ends; error refuses a longer row."""
    size = F.size(ids)
    if how == "left":
        return F.slice(ids, F.greatest(size - most, F.lit(0)) + 1, F.lit(most))
    if how == "right":
        return F.slice(ids, 1, most)
    if how == "middle":
        first = most // 2
        return F.when(size <= most, ids).otherwise(F.concat(F.slice(ids, 1, first), F.slice(ids, F.greatest(size - (most - first), F.lit(0)) + 1, F.lit(most - first))))
    if how == "error":
        return F.when(size <= most, ids).otherwise(F.raise_error(F.concat(F.lit("row of "), size.cast("string"), F.lit(f" ids, {most} at most"))).cast("array<bigint>"))
    raise ValueError(f"truncation {how!r} is none of left, right, middle, error")


def passages(docs: Column) -> Column:
    """'Doc i(Title: t) text' lines of an array of contents: the first line is the title, the others are the text."""

    def one(content: Column, i: Column) -> Column:
        line = F.split_part(content, F.lit("\n"), F.lit(1))
        rest = F.substring(content, F.length(line) + 2, F.length(content))
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), line, F.lit(") "), rest, F.lit("\n"))

    return F.array_join(F.transform(docs, one), "")


def record(fields: dict[str, Column]) -> Column:
    """'Name: value' lines; fields without a value are left out."""
    return F.concat_ws("\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()])


def rewritten(parts: list[Column], limit: int = 500) -> Column:
    """Phrases that are there, joined by spaces, of `limit` characters at most."""
    return F.left(F.concat_ws(" ", *parts), F.lit(limit))


def last_body(text: Column, tag: str, placeholders: list[str]) -> Column:
    """Trimmed body of the last tag that is no placeholder of the prompt."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda b: F.trim(b))
    real = F.filter(bodies, lambda b: ~b.isin("", *placeholders))
    return F.when(F.size(real) > 0, F.element_at(real, -1))


def auto_closed(text: Column, tag: str) -> Column:
    """Body of the first tag; one that was cut off counts to the end."""
    closed = F.when(F.contains(text, F.lit(f"</{tag}>")), text).otherwise(F.concat(text, F.lit(f"</{tag}>")))
    return F.trim(F.regexp_extract(closed, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def without_options(question: Column) -> Column:
    """A question without the options that follow it."""
    return F.trim(F.regexp_replace(question, r"(?s)\s*(?:Options?:|\bA[.)] ).*$", ""))


def titled(text: Column) -> Column:
    """'(Title: t) body' as '"t"' and the body on the next line."""
    return F.regexp_replace(text, r"(?s)\A\(Title: (.*?)\) ?", '"$1"\n')


def kl_reward(score: Column, kl: Column, coefficient: float, last: Column) -> Column:
    """Token reward: the score on the last valid token, less the penalty on each."""
    return F.when(last, score).otherwise(0.0) - coefficient * kl


def fits(prompt: Column, most: int) -> Column:
    """Whether a chat prompt (array of (role, content)) has `most` words at most."""
    return F.aggregate(prompt, F.lit(0), lambda n, m: n + F.size(F.filter(F.split(m["content"], r"\s+"), lambda w: w != ""))) <= most
