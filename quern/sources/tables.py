"""Readers and writers. Schemas are given, never inferred; sinks rely on Spark's atomic commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ranks import number_order, with_place

SCHEMAS = {
    "chartevents": "subject_id long, hadm_id long, stay_id long, charttime timestamp_ntz, itemid long, value string, valuenum double, valueuom string, warning int",
    "labevents": "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, value string, valuenum double, valueuom string, flag string",
    "outputevents": "subject_id long, hadm_id long, stay_id long, itemid long, charttime timestamp_ntz, value double, valueuom string",
    "icustays": "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, intime timestamp_ntz, outtime timestamp_ntz, los double",
    "patients": "subject_id long, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod date",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, race string, admission_type string, insurance string, language string, marital_status string, hospital_expire_flag int",
    "diagnoses_icd": "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
    "corpus": "id string, title string, text string, contents string",
    "matrix": "patient_id string, indicator string, hour int, value double",
}


def read_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """CSV, also gzipped (one task a file: split it with repartition()). Malformed fields become null, malformed rows stay."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def scan_keys(spark: SparkSession, path: str | list[str], schema: str, keys: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a large CSV whose key is among the given ones; of it only the key and the given columns are parsed."""
    told = read_csv(spark, path, schema)
    return told.select(key, *(columns or [c for c in told.columns if c != key])).join(keys.select(key).distinct(), key, "left_semi")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array, or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    told = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return told.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_parquets(spark: SparkSession, *paths: str) -> DataFrame:
    """Several files as one table; columns that some lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_entities(spark: SparkSession, pattern: str, schema: str, entity: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """One folder an entity: files of a glob, with the entity and the file's number from its path."""
    path = F.col("_metadata.file_path")
    told = spark.read.schema(schema).option("header", True).csv(pattern)
    return told.select("*", F.regexp_extract(path, entity, 1).alias("entity"), F.regexp_extract(path, r"(\d+)\D*$", 1).try_cast("int").alias("number"))


def first_split(splits: dict[str, DataFrame | None]) -> DataFrame:
    """The first split that there is, in the order given (test, then dev, then train)."""
    return next(df for df in splits.values() if df is not None)


def web_results(df: DataFrame, payload: str, k: int) -> DataFrame:
    """rank, title, text of a search answer in JSON: its answer box, then organic and related results, k of each."""
    item = "array<struct<title:string,snippet:string,question:string>>"
    kind = f"struct<answer_box:struct<title:string,answer:string,snippet:string>,organic_results:{item},related_questions:{item}>"
    x = F.from_json(F.col(payload), kind)
    some = lambda items, title: F.transform(F.slice(F.coalesce(items, F.array().cast(item)), 1, k), lambda r: F.struct(F.coalesce(r[title], F.lit("")).alias("title"), F.coalesce(r["snippet"], F.lit("")).alias("text")))
    box = x["answer_box"]
    boxed = F.when(box.isNull(), F.array().cast("array<struct<title:string,text:string>>")).otherwise(F.array(F.struct(F.coalesce(box["title"], F.lit("")).alias("title"), F.coalesce(box["answer"], box["snippet"], F.lit("")).alias("text"))))
    own = [c for c in df.columns if c != payload]
    every = F.concat(boxed, some(x["organic_results"], "title"), some(x["related_questions"], "question"))
    return df.select(*own, F.posexplode(every).alias("k", "r")).select(*own, (F.col("k") + 1).alias("rank"), "r.title", "r.text")


def chunk_ids(df: DataFrame, chunk: str, order: str) -> DataFrame:
    """id '<chunk>_<n>', n from 0 in the order (a number) of the chunk; no task holds a chunk."""
    placed = with_place(df, [chunk], number_order(df, order), "__n")
    return placed.withColumn("id", F.concat_ws("_", F.col(chunk), F.col("__n").cast("string"))).drop("__n")


def write_per_source(df: DataFrame, path: str, source: str = "data_source", format: str = "json") -> None:  # noqa: A002
    """A folder a source, all or nothing."""
    df.write.partitionBy(source).mode("overwrite").format(format).save(path)


def write_texts(df: DataFrame, path: str, entity: str, text: str) -> None:
    """One text a row under a folder of its entity."""
    df.select(entity, F.col(text).alias("value")).write.partitionBy(entity).mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_array(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Files that are each one JSON array, of up to `rows` rows: however large a partition is, no array is larger."""
    told = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
    # numbers of a partition count up from its own multiple of 2^33
    part = told.withColumn("n", F.monotonically_increasing_id()).withColumn("p", F.floor(F.col("n") / F.lit(1 << 33))).withColumn("q", F.floor(F.pmod("n", F.lit(1 << 33)) / rows))
    arrays = part.groupBy("p", "q").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "r"))), lambda x: x["r"]), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics of a step as a JSON line, nested names joined by /."""
    metrics.select(*flat(metrics)).write.mode("append").json(path)


def flat(df: DataFrame) -> list[Column]:
    """Columns of nested structs as name/inner."""
    from pyspark.sql.types import StructType

    def walk(kind: StructType, at: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = [*at, f.name]
            out += walk(f.dataType, here) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias("/".join(here))]
        return out

    return walk(df.schema, [])
