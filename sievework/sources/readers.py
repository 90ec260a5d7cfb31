"""Readers and writers of the record files that runs leave: tolerant JSON lines, documents, CSV, reports."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.yaml_text import parse_yaml, yaml_to_json
from sievework.sources.files import exists


def safe_json_lines(lines: DataFrame, column: str, schema: str, *keys: str) -> DataFrame:
    """Records of a column of JSON lines, with the keys of their rows; blank and malformed lines, such as a last one cut short, are skipped."""
    good = lines.where((F.trim(column) != "") & F.try_parse_json(F.col(column)).isNotNull())
    return good.select(*keys, F.from_json(column, schema).alias("_r")).select(*keys, "_r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return safe_json_lines(spark.read.text(path), "value", schema)


def texts_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """path, value: whole texts of all files of a name below a folder; none where there is no folder."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("ignoreMissingFiles", "true")
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, value string")
    return found.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per JSON file, with its path; unreadable ones have nulls in all columns of the schema."""
    texts = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("_r"))
    return texts.select("path", "_r.*")


def typed_scalar(v: Column) -> Column:
    """struct<kind, b, i, d, s> of a scalar's text: null (also ~ and empty), bool, int, float or str."""
    t = F.lower(F.trim(v))
    none, flag = t.isin("", "null", "~"), t.isin("true", "false")
    whole, real = F.rlike(v, F.lit("^[+-]?[0-9]+$")), v.try_cast("double").isNotNull()
    kind = F.when(none | v.isNull(), "null").when(flag, "bool").when(whole, "int").when(real, "float").otherwise("str")
    is_ = lambda k: kind == k
    return F.struct(kind.alias("kind"), F.when(is_("bool"), t == "true").alias("b"), F.when(is_("int"), v.try_cast("long")).alias("i"), F.when(is_("float"), v.try_cast("double")).alias("d"), F.when(is_("str"), v).alias("s"))


def read_yaml(path: str | Path) -> object:
    """A small configuration document."""
    return parse_yaml(Path(path).read_text())


def read_yaml_documents(spark: SparkSession, glob: str) -> DataFrame:
    """path, json: one row per YAML file, as JSON; null where it can't be read."""

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        return texts.map(yaml_to_json)

    texts = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", as_json("value").alias("json"))


def write_cells(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder of JSON per key, replaced as a whole by Spark's committer."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replay_key(system: Column, user: Column) -> Column:
    """SHA-256 of the JSON array of both texts, with a blank after the comma."""
    one = lambda c: F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")
    return F.sha2(F.concat(F.lit("["), one(system), F.lit(", "), one(user), F.lit("]")), 256)


def json_text(value: object) -> str:
    return json.dumps(value, sort_keys=True)
