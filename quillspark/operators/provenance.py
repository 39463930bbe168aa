"""Provenance: content and context digests of records, stamps and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that the content digest covers.
CONTENT = ("question_content", "candidate_answers", "ground_truth", "legal_rationale")


def text_digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(c, F.lit("")), 256))


def canonical_json(columns: tuple[str, ...]) -> Column:
    """JSON of the columns: names sorted, nulls kept, no blanks, characters as they are."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_digest(columns: tuple[str, ...] = CONTENT) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(columns), 256))


def stamp(records: DataFrame, run_id: str, context: str = "context_text", columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """records with a stamp; rows that have one keep it."""
    made = F.struct(F.lit(run_id).alias("run_id"), text_digest(F.col(context)).alias("context_sha256"), content_digest(columns).alias("content_sha256"))
    return records.withColumn("_provenance", F.coalesce(F.col("_provenance"), made) if "_provenance" in records.columns else made)


def reasons(verified: DataFrame) -> DataFrame:
    """verify()'s rows with why a record fails: no stamp, changed content, changed context."""
    why = F.array(
        F.when(~F.col("has_provenance"), "no_provenance"), F.when(F.col("has_provenance") & ~F.coalesce("content_ok", F.lit(False)), "content_hash_mismatch"), F.when(~F.coalesce("context_ok", F.lit(True)), "context_hash_mismatch")
    )
    return verified.withColumn("reasons", F.array_compact(why))


def verify(records: DataFrame, context: str = "context_text", columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """records with has_provenance, content_ok and context_ok, which is null where nothing was stored."""
    p = F.col("_provenance")
    return records.withColumns(
        {"has_provenance": p.isNotNull(), "content_ok": p["content_sha256"] == content_digest(columns), "context_ok": p["context_sha256"] == text_digest(F.col(context))}
    )
