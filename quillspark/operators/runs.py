"""Run inputs and ledgers: frozen manifests, plan order, batches, samples, joins of verdicts, items and reviews."""

from __future__ import annotations

import hashlib
import platform
import random
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillspark.functions.text import strip
from quillspark.functions.unicode import composed
from quillspark.operators.items import with_rank

# Conditions of a package, the evidence each shows, and labels of failed calls.
SHOWN = {"T": ("text",), "TL_struct": ("document_structure", "text"), "TLV": ("document_structure", "images", "text")}
FAILED = ("HTTP_ERR", "PARSE_ERR")


def manifest_faults(packages: DataFrame, expected: int | None = None) -> DataFrame:
    """(chunk_id, fault) of the packages of a frozen manifest that break it: condition, keys of the evidence, text, structure,
    images, doubles, chunks without all conditions, and texts or structures that differ between conditions; and a row
    without a chunk if the number is wrong. packages: chunk_id, condition, keys, text, structure (JSON), declared, images."""
    c = F.col
    keys = F.array_sort("keys")
    wrong = F.lit(False)
    for condition, shown in SHOWN.items():
        wrong = wrong | ((c("condition") == condition) & (keys != F.array(*[F.lit(x) for x in shown])))
    order = F.when(F.size("declared") > 0, F.sequence(F.lit(1), F.size("declared"))).otherwise(F.array().cast("array<int>"))
    fault = (
        F.when(c("chunk_id").isNull() | ~F.coalesce(c("condition").isin(*SHOWN), F.lit(False)), "invalid_package").when(strip(F.coalesce("text", F.lit(""))) == "", "invalid_text").when(c("text").contains("![](") | c("text").contains("_page_"), "unclean_text")
        .when(wrong, F.concat(F.lit("invalid_"), "condition", F.lit("_evidence"))).when((c("condition") != "T") & F.coalesce(c("declared") != order, F.lit(True)), "invalid_structure")
        .when((c("condition") == "TLV") & (F.coalesce(c("images"), F.lit(0)) == 0), "missing_tlv_images").when((c("condition") == "TLV") & (F.size("declared") != c("images")), "invalid_declared_image_order")
    )
    own = packages.select("chunk_id", fault.alias("fault")).where("fault is not null").distinct()
    doubles = packages.groupBy("chunk_id", "condition").count().where("count > 1").select("chunk_id", F.lit("duplicate_chunk_condition").alias("fault")).distinct()
    by = packages.groupBy("chunk_id").agg(F.count_distinct("condition").alias("n"), F.count_distinct("text").alias("texts"), F.count_distinct("structure").alias("structures"))
    whole = by.select("chunk_id", F.when(c("n") != len(SHOWN), "incomplete_chunk_x_condition").when(c("texts") > 1, "unpaired_text").when(c("structures") > 1, "unpaired_structure").alias("fault")).where("fault is not null")
    out = own.unionByName(doubles).unionByName(whole)
    if expected is not None:
        out = out.unionByName(packages.agg(F.count("*").alias("n")).where(c("n") != expected).select(F.lit(None).cast(packages.schema["chunk_id"].dataType).alias("chunk_id"), F.lit("unexpected_manifest").alias("fault")))
    return out


def evidence_index(packages: DataFrame) -> DataFrame:
    """One row for each chunk and condition with its evidence and a digest; doubles raise."""
    n = F.count("*").over(Window.partitionBy("chunk_id", "condition"))
    ok = F.when(n == 1, F.col("condition")).otherwise(F.raise_error(F.lit("invalid_manifest_package")))
    return packages.withColumn("condition", ok).withColumn("evidence_sha256", F.sha2(F.concat_ws("|", "chunk_id", "condition", "text"), 256))


def image_fault(content: Column, size: Column, digest: Column) -> Column:
    """Whether an image's bytes are those of its manifest."""
    return F.when(content.isNull() | (F.octet_length(content) != size) | (F.sha2(content, 256) != digest), "BLOCKED_INPUT_INTEGRITY:image")


# --- order and samples -------------------------------------------------------------------------


def plan_order(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(place, run_order): a seeded order of a plan's rows, which are few; both count from 0 and 1."""
    places = list(range(n))
    random.Random(seed).shuffle(places)
    return spark.createDataFrame([(p, k) for k, p in enumerate(places, 1)], "place bigint, run_order int")


@F.pandas_udf(ArrayType(IntegerType()))
def stable_order(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
    """A permutation of 0 .. n - 1 from a digest of each seed text."""

    def one(seed: str, n: int) -> list[int]:
        order = list(range(n))
        random.Random(int(hashlib.sha256(seed.encode()).hexdigest()[:16], 16)).shuffle(order)
        return order

    return pd.Series([one(s, int(n)) for s, n in zip(seeds, sizes, strict=True)])


def batches_by_length(rows: DataFrame, key: str, length: Column, size: int) -> DataFrame:
    """rows with batch and place: sorted by length, then key (a whole number below 2**32), in batches of so many."""
    ranked = with_rank(rows.withColumn("_by", length.cast("bigint") * (1 << 32) + F.col(key)), "_by", "_rank")
    return ranked.withColumns({"batch": F.floor(F.col("_rank") / size), "place": F.col("_rank") % size}).drop("_by", "_rank")


def dealt(rows: DataFrame, position: str, workers: int) -> DataFrame:
    return rows.withColumn("worker", F.col(position) % workers)


def length_balanced(items: DataFrame, options: str, gold: str, key: str) -> DataFrame:
    """As many items for each rank of the right option's length (ties: the mean place down), the first by key digest."""
    sizes = F.transform(options, F.length)
    own = F.element_at(sizes, (F.col(gold) + 1).cast("int"))
    rank = F.size(F.filter(sizes, lambda s: s < own))
    ranked = items.withColumn("length_rank", rank)
    least = ranked.groupBy("length_rank").agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    w = Window.partitionBy("length_rank").orderBy(F.sha2(F.col(key).cast("string"), 256))
    return ranked.withColumn("_k", F.row_number().over(w)).join(F.broadcast(least), F.lit(True)).where("_k <= _least").drop("_k", "_least")


# --- joins -------------------------------------------------------------------------------------


def pruned(contexts: DataFrame, stems: DataFrame, doc: str = "doc_id", stem: str = "stem") -> tuple[DataFrame, DataFrame]:
    """The contexts whose document is among the stems, and the others; names are compared composed and stripped."""
    own, known = composed(strip(F.col(doc))), stems.select(composed(strip(F.col(stem))).alias("_stem")).distinct()
    rows = contexts.withColumn("_name", own)
    return tuple(rows.join(known, F.col("_name") == F.col("_stem"), how).drop("_name") for how in ("left_semi", "left_anti"))  # type: ignore[return-value]


def reviewed(shortlist: DataFrame, spot_check: DataFrame, path: str = "filename") -> DataFrame:
    """The shortlist with a decision: its own label's where that settles it, else the spot check's, else REVIEW."""
    checked = spot_check.select(F.col("asset_path").alias(path), F.col("decision").alias("_d"), F.col("reason").alias("_r"))
    label = F.col("shortlist_label")
    keep, drop = label == "keep_pdf_for_render", label.startswith("drop")
    joined = shortlist.join(checked, path, "left")
    decision = F.when(keep, "KEEP").when(drop, "DROP").otherwise(F.coalesce("_d", F.lit("REVIEW")))
    reason = F.when(keep, "official_pdf_for_render_and_text_extraction").when(drop, F.col("shortlist_reason")).otherwise(F.coalesce("_r", "shortlist_reason"))
    return joined.withColumns({"review_decision": decision, "review_reason": reason}).drop("_d", "_r")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def accepted_items(verdicts: DataFrame, items: DataFrame, verdict: str = "VISUAL_DEPENDENT") -> DataFrame:
    """The items with that verdict; a fingerprint that occurs twice among the items, or has no item, raises."""
    n = F.count("*").over(Window.partitionBy("fingerprint"))
    unique = items.withColumn("_n", n).withColumn("fingerprint", F.when(F.col("_n") == 1, F.col("fingerprint")).otherwise(F.raise_error(F.lit("BLOCKED_PAIRING:duplicate_item_fingerprint")))).drop("_n")
    wanted = verdicts.where(F.col("verdict") == verdict).select("fingerprint").distinct()
    joined = wanted.join(unique.withColumn("_there", F.lit(True)), "fingerprint", "left")
    found = F.when(F.col("_there"), F.col("fingerprint")).otherwise(F.raise_error(F.lit("BLOCKED_PAIRING:verdict_without_item")))
    return joined.withColumn("fingerprint", found).drop("_there")


def with_packages(rows: DataFrame, packages: DataFrame, on: list[str]) -> DataFrame:
    """rows with their package; those without one are rejected, not lost."""
    joined = rows.join(packages.withColumn("_there", F.lit(True)), on, "left")
    return joined.withColumn("status", F.when(F.col("_there"), F.col("status")).otherwise("REJECTED")).withColumn("reason", F.when(F.col("_there"), F.col("reason")).otherwise("package_missing")).drop("_there")


def retries(ledger: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, staged, missing): the ledger without failed rows, the images to ask again, and the failed rows without an image."""
    failed = ledger.where(F.col("label").isin(*FAILED)).withColumn("name", F.substring_index("file", "/", -1))
    there = files.withColumn("name", F.substring_index("path", "/", -1)).groupBy("name").agg(F.min("path").alias("path"))
    return ledger.where(~F.col("label").isin(*FAILED)), there.join(failed, "name", "left_semi"), failed.join(there, "name", "left_anti").select("file")


def rejected(evaluated: DataFrame, passed: DataFrame, key: str) -> DataFrame:
    """Rows of the one that aren't, as whole rows, in the other; equal rows of both go however often they occur."""
    whole = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    seen = passed.select(F.col(key).alias("_key"), whole(passed).alias("_row")).distinct()
    return evaluated.withColumn("_own", whole(evaluated)).join(seen, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_row")), "left_anti").drop("_own")


def pipeline_state(counts: DataFrame, strict: bool = False) -> DataFrame:
    """One row: issues, warnings and the exit code of a pipeline's state. counts: artifact, n (null: missing)."""
    n = lambda a: F.max(F.when(F.col("artifact") == a, F.col("n")))
    t = counts.agg(*[n(a).alias(a) for a in ("contexts", "raw_pairs", "pair_chunks", "filtered", "dataset")])
    raw, parts = F.coalesce("raw_pairs", F.lit(0)), F.coalesce("pair_chunks", F.lit(0))
    issues = F.array_compact(F.array(F.when(F.col("contexts").isNull(), "contexts_missing").when(F.col("contexts") == 0, "contexts_empty"), F.when((raw == 0) & (parts == 0), "no_pairs")))
    warnings = F.array_compact(F.array(F.when(F.col("raw_pairs").isNull(), "raw_pairs_missing"), F.when((raw == 0) & (parts > 0), "raw_pairs_empty"), F.when(F.col("filtered").isNull(), "filtered_missing"), F.when(F.col("dataset").isNull(), "dataset_missing")))
    code = F.when(F.size(issues) > 0, 2).when(F.lit(strict) & (F.size(warnings) > 0), 1).otherwise(0)
    return t.select(F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"), code.alias("exit_code"))


def envelope(stage: str, model: dict, decoding: dict, prompt: dict, extra: dict | None = None) -> dict:
    """What is common to all records of a run."""
    host = {"python": platform.python_version(), "platform": platform.platform()}
    made = {"run_id": uuid.uuid4().hex, "stage": stage, "generated_at": datetime.now(timezone.utc).isoformat(), "generator": {"host": host}, "model": dict(model), "decoding": dict(decoding), "prompt": dict(prompt)}
    return made | ({"extra": extra} if extra else {})
