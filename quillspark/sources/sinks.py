"""Writers: split-partitioned lines, ledgers that never overwrite, single-file reports, image-dataset rows, reviewed assets."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import strip


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the warehouse, removed when the application ends."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch/{name}-{uuid.uuid4().hex[:12]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def split_lines(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in one folder for each split."""
    rows.repartition(split).write.partitionBy(split).json(path)


def append_ledger(rows: DataFrame, path: str, partition: str = "experiment_id") -> None:
    """A ledger in a new folder; an existing one is refused."""
    rows.write.mode("errorifexists").partitionBy(partition).parquet(path)


def write_report(spark: SparkSession, path: str, value: object) -> None:
    """One JSON file, whole or not at all: written beside its place, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex[:8]}")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
        out.hsync()
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't rename to {path}")


def relative(path: Column, prefixes: tuple[str, ...]) -> Column:
    """path without the first prefix that it starts with."""
    out = path
    for p in reversed(prefixes):
        out = F.when(path.startswith(p), F.substring(path, F.lit(len(p) + 1), F.length(path))).otherwise(out)
    return out


def image_dataset(rows: DataFrame, prefixes: tuple[str, ...], placeholder: str = "images/_placeholder.png") -> DataFrame:
    """Rows of an image dataset: file_name is the first image below images/, or a placeholder; fields of visuals go; the
    split dev is called validation."""
    names = F.transform(F.coalesce("visuals", "context_payload.visuals", F.array().cast("array<string>")), lambda v: F.concat(F.lit("images/"), relative(v, prefixes)))
    out = rows.withColumns({"file_name": F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(placeholder)), "context_payload": F.col("context_payload").dropFields("visuals"), "split": F.when(F.col("split") == "dev", "validation").otherwise(F.col("split"))})
    return out.drop("visuals", "image_file_name", "image_file_names")


def kept_assets(reviews: DataFrame, files: DataFrame, path: str = "filename") -> DataFrame:
    """Assets that were kept in review and whose file is there."""
    return reviews.where(strip("review_decision") == "KEEP").join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def layout(base: str, legacy: str) -> str:
    """The data folder with more of a pipeline's artifacts; the first one on a tie."""

    def score(folder: str) -> int:
        inside = lambda *x: os.path.join(folder, *x)
        some = lambda where, ends: os.path.isdir(where) and any(n.lower().endswith(ends) for n in os.listdir(where))
        points = ((os.path.isdir(inside("raw")), 1), (some(inside("raw"), ".pdf"), 1), (os.path.isdir(inside("interim")), 1), (os.path.exists(inside("interim", "multimodal_contexts.json")), 4), (some(inside("interim", "contexts"), ".json"), 3))
        points += ((some(inside("interim", "qa_chunks"), ".json"), 2), (os.path.exists(inside("processed", "dataset.jsonl")), 4))
        return sum(n for there, n in points if there)

    return legacy if score(legacy) > score(base) else base
