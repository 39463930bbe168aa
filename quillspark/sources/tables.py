"""Readers: tables by folder, whole texts, JSON arrays and lines, CSV, binary files, first source that has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Path, size and content of all files below a folder with a suffix (case matters)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)


def texts(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """doc_id (file name without suffix), path and whole text of every text file."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of a JSONL file; blank lines and lines that are no object are skipped."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("{"))
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def numbers(df: DataFrame, column: str) -> DataFrame:
    """The values of a text column that are numbers."""
    return df.selectExpr(f"try_cast(`{column}` AS DOUBLE) AS value").where("value is not null")


def first_with_rows(*labelled: tuple[str, DataFrame]) -> DataFrame:
    """The first frame that has rows, with its label as column source_label; the last if none has."""
    for label, df in labelled:
        if not df.isEmpty():
            break
    return df.withColumn("source_label", F.lit(label))

