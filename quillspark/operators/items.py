"""Operators over question items: evaluation-ready set, rebalancing, language filters, triage, filters, release schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import mcq as M
from quillspark.functions.fuzzy import resolved
from quillspark.functions.text import strip

# Limits of the item checks and the scaffold pattern of the evaluation-ready filter.
MIN_QUESTION, MIN_RATIONALE, MIN_CONTEXT = 12, 40, 80
SCAFFOLD = r"(?i)\b(full correct answer text|correct answer is|because|therefore|In this case)\b"


def drop_reason(options: Column, method: Column) -> Column:
    """First reason why an item is not evaluation-ready, null if it is."""
    cleaned = F.transform(options, M.clean_option)
    return (
        F.when(F.size(options) != 4, "not_4_options").when(method == "unresolved", "unresolved")
        .when(F.exists(cleaned, lambda x: x == ""), "empty_cleaned_option")
        .when(F.size(F.array_distinct(F.transform(cleaned, F.lower))) < 4, "duplicate_cleaned_options")
    )


def kept(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows that fulfil a condition on columns that are dear to make. The optimiser can't move it below them, which would
    make them twice and the plan many times as large."""
    return rows.withColumn("_kept", F.rand()).where(condition & (F.col("_kept") >= 0)).drop("_kept")


def eval_ready(items: DataFrame, id_col: str) -> DataFrame:
    """Items with four distinct options and a resolved answer, whose place goes round over A-D in id order.
    The rank is a prefix sum over ranges of ids, so no task orders all items."""
    rows = kept(resolved(items).withColumn("reason", drop_reason(F.col("candidate_answers"), F.col("method"))), F.col("reason").isNull())
    ranked = with_rank(rows, id_col, "kept_rank", items)
    place = F.col("kept_rank") % 4
    # rotate so that the answer stands in its place
    made = ranked.withColumns({"_options": F.transform("candidate_answers", M.clean_option), "_turn": F.pmod(F.col("gold_index") - place, F.lit(4)).cast("int"), "_place": place})
    made = made.withColumn("_rotated", F.concat(F.slice("_options", F.col("_turn") + 1, F.lit(4)), F.slice("_options", F.lit(1), F.col("_turn"))))
    answer = F.element_at("_rotated", (F.col("_place") + 1).cast("int"))
    return made.select(id_col, F.col("_rotated").alias("options"), answer.alias("ground_truth"), F.col("_place").alias("gold_index"), F.char(F.col("_place") + 65).alias("gold_letter"), F.col("gold_index").alias("source_gold_index"))


def with_rank(rows: DataFrame, key: str, name: str, source: DataFrame | None = None, buckets: int = 200) -> DataFrame:
    """rows with their rank (from 0) by a key that is unique and a number: ranks within ranges of keys, plus the rows of
    the ranges before. The ranges hold like numbers of the source's keys, however those are spread; null keys come first."""
    cuts = (rows if source is None else source).select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.001)
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    bucketed = rows.withColumn("_bucket", F.coalesce(F.when(F.col(key).isNotNull(), bucket), F.lit(-1)))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1 + F.col("_before")
    return bucketed.join(F.broadcast(before), "_bucket").withColumn(name, rank.cast("bigint")).drop("_bucket", "_before")


def release_language_reasons(question: Column, options: Column, truth: Column, rationale: Column) -> Column:
    merged = F.concat_ws(" ", *[M.sanitize(c) for c in (question, truth, rationale)], F.array_join(F.transform(options, M.sanitize), " "))
    return M.artifacts(merged)


def release_filter(items: DataFrame, position: str, examples: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, counts, examples) of the release language filter: fields are sanitised, rows with reasons go; counts are by
    reason and split, `changed` counts rows that sanitising changed; examples are the first that went."""
    texts = ["question", "ground_truth", "legal_rationale"]
    clean = items.withColumns({f"_{c}": M.sanitize(c) for c in texts} | {"_options": F.transform("candidate_answers", M.sanitize)})
    changed = F.lit(False)
    for c in texts:
        changed = changed | ~F.col(f"_{c}").eqNullSafe(F.col(c))
    clean = clean.withColumn("_changed", changed | ~F.col("_options").eqNullSafe(F.col("candidate_answers")))
    clean = clean.withColumn("reasons", M.artifacts(F.concat_ws(" ", *[f"_{c}" for c in texts], F.array_join("_options", " "))))
    good = clean.where(F.size("reasons") == 0).select(*[F.col(f"_{c}").alias(c) if c in texts else F.col("_options").alias(c) if c == "candidate_answers" else F.col(c) for c in items.columns])
    marks = F.concat(F.when(F.size("reasons") == 0, F.array(F.lit("kept"))).otherwise(F.concat(F.array(F.lit("removed")), "reasons")), F.when(F.col("_changed"), F.array(F.lit("changed"))).otherwise(F.array().cast("array<string>")))
    counts = clean.select("split", F.explode(marks).alias("mark")).groupBy("split", "mark").agg(F.count("*").alias("n"))
    gone = clean.where(F.size("reasons") > 0).orderBy(position).limit(examples).select(position, "reasons")
    return good, counts, gone


def stamped(items: DataFrame, flags: Column) -> DataFrame:
    """items with _quality: flags and what to do."""
    return items.withColumn("_flags", flags).withColumn("_quality", F.struct(F.col("_flags").alias("flags"), triage(F.col("_flags")).alias("triage"))).drop("_flags")


def eval_ready_language_reasons(*texts: Column) -> Column:
    """The other rule set: any ideograph, or scaffold wording; nothing is sanitised."""
    merged = F.concat_ws(" ", *texts)
    return F.array_compact(F.array(F.when(merged.rlike(M.CJK), F.lit("cjk_chars")), F.when(merged.rlike(SCAFFOLD), F.lit("english_scaffold"))))


def quality_flags(question: Column, options: Column, truth: Column, rationale: Column, context: Column, multimodal: Column, visuals: Column, scores: Column | None = None, method: Column | None = None) -> Column:
    """Flag codes with severities, in fixed order. method: how the answer was resolved, where the fuzzy stage has run."""
    flag = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity")))
    size = lambda c: F.length(strip(F.coalesce(c, F.lit(""))))
    method = M.resolve(options, truth)["method"] if method is None else method
    canon = F.filter(F.transform(options, M.canonical), lambda x: x != "")
    reasons = release_language_reasons(question, options, truth, rationale)
    hard = F.array_contains(reasons, "cjk_chars") | F.array_contains(reasons, "prompt_leak")
    low = F.lower(F.coalesce(rationale, F.lit("")))
    flags = [
        flag(method.isin("unresolved", "no_candidates", "candidates_not_list"), "gt_unresolved", "error"),
        flag(method == "fuzzy_payload", "gt_fuzzy_only", "warn"),
        flag(F.size(options) != 4, "candidate_count", F.when(F.size(options) < 2, "error").otherwise("warn")),
        flag(F.size(F.array_distinct(canon)) < F.size(canon), "duplicate_candidates", "error"),
        flag(F.exists(options, lambda o: M.choice_label(o).isNull()), "candidate_unlabeled", "warn"),
        flag(F.size(reasons) > 0, "language_artifact", F.when(hard, "error").otherwise("warn")),
        flag(size(question) < MIN_QUESTION, "question_too_short", "warn"),
        flag(size(rationale) < MIN_RATIONALE, "rationale_too_short", "warn"),
        flag(size(context) < MIN_CONTEXT, "context_too_short", "warn"),
        flag(~(low.contains(M.SYLLOGISM[0]) | low.contains(M.SYLLOGISM[1])), "missing_syllogism", "warn"),
        flag(multimodal & (F.coalesce(F.size(visuals), F.lit(0)) <= 0), "multimodal_no_visual", "warn"),
    ]
    if scores is not None:
        flags += [flag(scores["groundedness"] == 0, "judge_ungrounded", "error"), flag(scores["legal_fluency"] == 0, "judge_illogical", "warn")]
    return F.array_compact(F.array(*flags))


def triage(flags: Column) -> Column:
    return F.when(F.exists(flags, lambda f: f["severity"] == "error"), "regenerate").when(F.exists(flags, lambda f: f["severity"] == "warn"), "review").otherwise("keep")


def passes_judge(scores: Column, multimodal: Column, threshold: float = 1.0) -> Column:
    """Unscored items fail; alignment counts for multimodal items only."""
    own = (scores["groundedness"] >= threshold) & (scores["legal_fluency"] >= threshold) & (scores["overall"] >= threshold)
    return scores.isNotNull() & own & (~multimodal | (scores["multimodal_alignment"] >= threshold))


def error_category(scores: Column) -> Column:
    """Why a rejected item failed, by precedence."""
    return F.when(scores["groundedness"] < 1, "Legal Hallucination").when(scores["multimodal_alignment"] < 1, "Visual Misalignment").when(scores["legal_fluency"] < 1, "Logical Fallacy").otherwise("Other")
