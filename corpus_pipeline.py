"""A corpus pipeline: quality rules, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.best_fit import best_fit
from quern.llm.common import WORD, table, written
from quern.llm.jaccard_join import one_of_each
from quern.llm.quality_rules import quality_rules
from quern.llm.source_mix import Mix, source_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the compression bands keep.

    Null, empty and short texts have too few words and go; a very long text is judged whole. Repeated rows are judged
    alike and each by itself; there are no ties. An empty table gives an empty one; columns beside those of documents go."""
    judged = quality_rules(_documents(docs), prefix="__q_")
    return judged.filter("__q_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, null ids last.

    Documents of one id and other texts are documents of their own. Ties and repeated rows: see one_of_each. Null and
    empty texts are near to nothing and stay; a very long text is compared whole. An empty table gives an empty one."""
    return one_of_each(_documents(docs)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; those of sources that weigh more than they hold come again.

    A null source is a source; texts, null, empty or very long, are passed on as they are. Repeated rows each get a
    place; ties in the order of a source are rows alike in all columns. An empty table gives an empty one."""
    mixed = source_mix(_documents(docs))
    return mixed.orderBy("slot", "place").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: (pack_group, bin) is a window, slot the place in the mix.

    A group packs a stretch of the mix, so its windows hold the sources by their weights: documents are scheduled once more, each
    once, by the rows that their sources have here, and texts are left behind before that. Null and empty texts are their end
    token alone; very long texts are cut into pieces, all of which are packed. Repeated rows never share a window; ties in length
    go by the rows' keys. An empty table gives an empty one."""
    text = F.coalesce("text", F.lit(""))
    told = docs.select("doc_id", "source", (F.regexp_count(text, F.lit(WORD)) + 1).alias("__size"), F.xxhash64(text).alias("__cluster"))
    placed = written(source_mix(told, params=Mix(power=1.0, once=True)))
    slots = (placed.agg(F.max("slot")).first()[0] or 0) + 1
    rows = placed.select("doc_id", "source", "slot", "__size", "__cluster", (F.col("slot") / slots).alias("__along"), F.lit(None).cast("string").alias("text"))
    return best_fit(rows, cluster=F.col("__cluster"), tokens=F.col("__size"), along=F.col("__along")).drop("__size", "__cluster", "__along")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Shingle sets, compression and the search for bins can't be put in SQL; tests/llm hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
