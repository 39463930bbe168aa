"""Prompts as column expressions, with the list of fields that each one shows, and parsing of short model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import strip, truncate_context
from quillspark.operators.contracts import parsed, without_fence
from quillspark.operators.steps import TEXT_MOTIFS, VISUAL_MOTIFS

# Length limits of contexts in prompts, and the dimensions that a blinded judge marks from 1 to 5.
GENERATION_CHARS, JUDGE_CHARS = 2000, 1500
DIMENSIONS = ("faithfulness", "answerability", "distractor_quality", "depth")
BLOOM = ("Remember", "Understand", "Apply")


def options_block(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def mcq_prompt(question: Column, options: Column, context: Column | None = None, most: int = 0) -> Column:
    """A question with its options and, where given, its context cut to `most` characters (0: whole)."""
    ask = F.concat(F.lit("### Question:\n"), question, F.lit("\n\n### Options:\n"), options_block(options), F.lit("\n\n### Answer with one letter (A, B, C or D):"))
    return ask if context is None else F.concat(F.lit("### Context:\n"), truncate_context(context, most), F.lit("\n\n"), ask)


def generation_prompts(chunks: DataFrame, visuals: bool = True, syllogism: bool = True) -> DataFrame:
    """One prompt for each chunk and level of Bloom's taxonomy."""
    level = F.explode(F.array(*[F.lit(b) for b in BLOOM])).alias("bloom_level")
    shown = F.when(F.size("visual_descriptions") > 0, F.concat(F.lit("\nVISUALS:\n"), F.array_join("visual_descriptions", "\n"))).otherwise("") if visuals else F.lit("")
    clause = "\nState the major premise, the minor premise and the conclusion." if syllogism else ""
    text = F.concat(F.lit("LEVEL: "), F.col("bloom_level"), F.lit("\nCONTEXT:\n"), F.left("text", F.lit(GENERATION_CHARS)), shown, F.lit(clause + "\nWrite question blocks as XML."))
    return chunks.select("*", level).withColumn("prompt", text)


def judge_prompt(context: Column, visuals: Column, question: Column, options: Column, truth: Column) -> Column:
    return F.concat(F.lit("CONTEXT:\n"), F.left(context, F.lit(JUDGE_CHARS)), F.lit("\nVISUALS:\n"), F.coalesce(F.array_join(visuals, " | "), F.lit("")), F.lit("\nQUESTION:\n"), question, F.lit("\n"), options_block(options), F.lit("\nANSWER:\n"), truth)


def evidence_prompt(evidence: Column, method: Column) -> Column:
    """struct(prompt, fields): the evidence as its condition shows it, and the fields that were shown."""
    structure, images = evidence["document_structure"], evidence["images"]
    text = F.concat(F.lit("METHOD: "), method, F.lit("\nEVIDENCE TEXT:\n"), evidence["text"], F.when(structure.isNotNull(), F.concat(F.lit("\nSTRUCTURE:\n"), F.to_json(structure))).otherwise(""), F.when(F.size(images) > 0, "\nIMAGES: attached in declared order").otherwise(""))
    fields = F.array_compact(F.array(
        F.lit("evidence.text"), *[F.when(structure.isNotNull(), f"evidence.document_structure.{f}") for f in ("section_title", "header_level", "declared_image_order")], F.when(F.size(images) > 0, "evidence.images[pixels_attached]"),
    ))
    return F.struct(text.alias("prompt"), fields.alias("fields"))


def motif_catalog(spark: SparkSession) -> DataFrame:
    """(condition, motif): the motifs that a planner may use under each condition; without a condition, all."""
    every = [(None, m) for m in (*TEXT_MOTIFS, *VISUAL_MOTIFS)]
    return spark.createDataFrame([*((c, m) for c in ("T", "TL_struct") for m in TEXT_MOTIFS), *(("TLV", m) for m in VISUAL_MOTIFS), *every], "condition string, motif string")


def judge_marks(rows: DataFrame, raw: str) -> DataFrame:
    """rows with reason, four whole marks from 1 to 5 (true counts as 1), gold_supported and note; or why there are none."""
    c = F.col
    out = rows.withColumn("_bare", strip(without_fence(c(raw))))
    out = out.withColumn("_value", F.coalesce(F.try_parse_json("_bare"), F.try_parse_json(escaped(c("_bare"))["text"])))
    kind = lambda d: F.schema_of_variant(F.try_variant_get(c("_value"), f"$.{d}", "variant"))
    mark = lambda d: F.when(kind(d) == "BIGINT", F.try_variant_get(c("_value"), f"$.{d}", "bigint")).when((kind(d) == "BOOLEAN") & F.try_variant_get(c("_value"), f"$.{d}", "boolean"), 1)
    out = out.withColumns({f"_{d}": mark(d) for d in DIMENSIONS})
    bad = F.coalesce(*[F.when(~F.coalesce(c(f"_{d}").between(1, 5), F.lit(False)), f"bad_score:{d}") for d in DIMENSIONS])
    out = out.withColumn("reason", F.when(c("_value").isNull(), "invalid_json").when(~F.schema_of_variant(c("_value")).startswith("OBJECT"), "json_not_object").otherwise(bad))
    ok = c("reason").isNull()
    out = out.withColumns({d: F.when(ok, c(f"_{d}")) for d in DIMENSIONS})
    gold, note = F.coalesce(F.try_variant_get(c("_value"), "$.gold_supported", "boolean"), F.lit(False)), F.coalesce(F.try_variant_get(c("_value"), "$.note", "string"), F.lit(""))
    return out.withColumns({"gold_supported": F.when(ok, gold), "note": F.when(ok, F.left(note, F.lit(200)))}).drop("_bare", "_value", *[f"_{d}" for d in DIMENSIONS])


def answer_index(raw: Column, n_choices: int) -> Column:
    """struct(index, reason) of {"answer_index": whole number in range}; true is no number."""
    value = parsed(raw)["value"]
    kind = F.schema_of_variant(F.try_variant_get(value, "$.answer_index", "variant"))
    number = F.when(kind == "BIGINT", F.try_variant_get(value, "$.answer_index", "bigint"))
    reason = F.when(value.isNull(), "unparseable").when(~F.schema_of_variant(value).startswith("OBJECT"), "json_not_object").when(number.isNull(), "answer_index_not_int").when(~number.between(0, n_choices - 1), "answer_index_out_of_range")
    return F.struct(F.when(reason.isNull(), number).alias("index"), reason.alias("reason"))


def escaped(text: Column) -> Column:
    """struct(text, repaired): backslashes that start no JSON escape doubled, and how many were."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    stray = lambda p: p.startswith("\\") & (F.length(p) == 2) & ~F.substring(p, 2, 1).isin(*'"\\/bfnrtu')
    whole = F.array_join(F.transform(pieces, lambda p: F.when(stray(p), F.concat(F.lit("\\"), p)).otherwise(p)), "")
    return F.struct(whole.alias("text"), F.size(F.filter(pieces, stray)).alias("repaired"))
