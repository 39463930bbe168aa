"""Release operators: ids, split join, seeded option order, evaluable records, release schema, reports, demotion of visuals, sheets."""

from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import fuzzy
from quillspark.functions import mcq as M
from quillspark.functions.text import normalize, strip
from quillspark.operators.items import drop_reason, kept, with_rank

# Fields that a record needs, domain tags that say nothing, cue words of the visual audit.
REQUIRED = ("qa_id", "question_content", "candidate_answers", "ground_truth", "legal_rationale")
PLACEHOLDERS = ("", "civil_law", "unknown", "Unknown")
PERMUTATIONS = list(permutations(range(4)))
CHUNK = 1 << 20


def qa_parts(qa_id: Column) -> tuple[Column, Column]:
    """Document and chunk of a question id; the id itself where it names no chunk."""
    doc = F.regexp_extract(qa_id, r"(?s)^(.*?)_chunk_", 1)
    chunk = F.regexp_extract(qa_id, r"(?s)^(.*?_chunk_[^_]*)", 1)
    has = qa_id.contains("_chunk_")
    return F.when(has, doc).otherwise(qa_id), F.when(has, chunk).otherwise(qa_id)


def with_split(rows: DataFrame, manifest: DataFrame, position: str, chunk: str = "chunk_id") -> DataFrame:
    """rows with the split of the last manifest row of their chunk, else their own, else unknown."""
    last = manifest.where(strip(F.col(chunk)) != "").groupBy(chunk).agg(F.max_by("split", position).alias("_split"), F.max_by("doc_id", position).alias("_doc"))
    some = lambda c: F.when(strip(c) != "", strip(c))
    joined = rows.join(last, chunk, "left")
    return joined.withColumns({"split": F.coalesce(some(F.col("_split")), some(F.col("split")), F.lit("unknown")), "doc_id": F.coalesce(some(F.col("_doc")), F.col("doc_id"))}).drop("_split", "_doc")


def seeded_orders(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(chunk, orders): the order of four options of items 0 .. n-1 as one byte each, by a random stream that doesn't
    depend on the data. Made in sequence, a megabyte a row."""
    rng, number = random.Random(seed), {p: i for i, p in enumerate(PERMUTATIONS)}
    rows = []
    for chunk in range(-(-n // CHUNK)):
        made = bytearray()
        for _ in range(min(CHUNK, n - chunk * CHUNK)):
            order = [0, 1, 2, 3]
            rng.shuffle(order)
            made.append(number[tuple(order)])
        rows.append((chunk, bytes(made)))
    return spark.createDataFrame(rows, "chunk bigint, orders binary")


def rebalanced(items: DataFrame, position: str, seed: int) -> DataFrame:
    """Evaluation-ready items in a seeded option order, with the answer moved to places that go round over A-D."""
    rows = kept(fuzzy.resolved(items).withColumn("reason", drop_reason(F.col("candidate_answers"), F.col("method"))), F.col("reason").isNull())
    ranked = with_rank(rows, position, "kept_rank", items)
    orders = seeded_orders(items.sparkSession, ranked.count(), seed)
    byte = F.hex(F.substring(F.col("orders"), (F.col("kept_rank") % CHUNK + 1).cast("int"), F.lit(1)))
    table = F.array(*[F.array(*[F.lit(x) for x in p]) for p in PERMUTATIONS])
    joined = ranked.join(orders, F.floor(F.col("kept_rank") / CHUNK) == F.col("chunk")).withColumn("order", F.element_at(table, F.conv(byte, 16, 10).cast("int") + 1))
    place = F.col("_place")
    joined = joined.withColumns({"_place": (F.col("kept_rank") % 4).cast("int"), "_gold": F.col("gold_index").cast("int"), "_cleaned": F.transform("candidate_answers", M.clean_option)})
    joined = joined.withColumn("_at", F.array_position("order", F.col("_gold")).cast("int") - 1)
    swapped = F.transform("order", lambda x, i: F.when(i == place, F.col("_gold")).when(i == F.col("_at"), F.element_at("order", place + 1)).otherwise(x))
    options = F.transform(swapped, lambda i: F.element_at("_cleaned", i + 1))
    made = joined.withColumn("_options", options)
    others = [c for c in items.columns if c not in ("candidate_answers", "ground_truth")]
    return made.select(*others, F.col("_options").alias("candidate_answers"), F.element_at("_options", place + 1).alias("ground_truth"), place.cast("bigint").alias("gold_index"), F.col("method").alias("source_match_method"), F.col("gold_index").alias("source_gold_index"))


def evaluable(records: DataFrame) -> DataFrame:
    """records with _gold_index and skip_reason: an index from 0 to 3 over four options is trusted, else the answer is resolved."""
    trusted = F.coalesce((F.size("candidate_answers") == 4) & F.col("gold_index").between(0, 3), F.lit(False))
    rows = fuzzy.resolved(records.withColumn("_trusted", F.when(trusted, F.col("gold_index"))).drop("gold_index"))
    reason = F.when(F.col("_trusted").isNotNull(), None).when(F.coalesce(F.size("candidate_answers"), F.lit(0)) != 4, "not_4_options").when(F.col("gold_index").isNull(), F.col("method"))
    return rows.withColumn("skip_reason", reason).withColumn("_gold_index", F.when(reason.isNull(), F.coalesce("_trusted", "gold_index"))).drop("_trusted")


def infer_domain(tag: Column, qa_id: Column, names: Column, default: str = "Other") -> Column:
    """The tag unless it says nothing, else the name of the question id's leading number."""
    number = F.regexp_extract(qa_id, r"^(\d+)", 1)
    tagged = strip(F.coalesce(tag, F.lit("")))
    return F.when(~tagged.isin(*PLACEHOLDERS), tagged).otherwise(F.coalesce(F.try_element_at(names, number), F.lit(default)))


def to_release(rows: DataFrame) -> DataFrame:
    """The release schema: nested context, nulls as empty values, rows without an id or with a wrong list dropped."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    payload = F.struct(F.coalesce("context_text", F.lit("")).alias("text"), F.coalesce("context_visuals", F.array().cast("array<string>")).alias("visuals"))
    return rows.where("candidate_answers is not null").select(text("qa_id"), text("domain_tag"), text("bloom_level"), payload.alias("context_payload"), text("question_content"), F.coalesce("is_multimodal", F.lit(False)).alias("is_multimodal"), "candidate_answers", text("ground_truth"), text("legal_rationale"))


def integrity(records: DataFrame) -> DataFrame:
    """(section, key, n): six issue counters, sizes of the option lists, resolution methods and answer positions. One
    pass over signatures and ids each."""
    r = fuzzy.resolved(records)
    lists = F.col("candidate_answers")
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    rows = r.select(
        F.coalesce("qa_id", F.lit("")).alias("id"), normalize(F.coalesce("question_content", F.lit(""))).alias("q"), normalize(F.coalesce("ground_truth", F.lit(""))).alias("t"),
        missing.alias("missing"), (strip(F.coalesce("question_content", F.lit(""))) == "").alias("empty"), F.coalesce(F.size(lists), F.lit(-1)).alias("k"), "method", "gold_index",
    )
    flag = lambda name, when: F.when(when, F.struct(F.lit("issue").alias("section"), F.lit(name).alias("key")))
    entry = lambda section, key, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(section).alias("section"), key.alias("key")))
    marks = F.array_compact(
        F.array(
            flag("missing_required_fields", F.col("missing")), flag("empty_question", F.col("empty")), flag("invalid_candidate_answers", F.col("k") < 2), flag("non_four_way_candidate_answers", (F.col("k") >= 0) & (F.col("k") != 4)),
            entry("candidates", F.col("k").cast("string"), F.col("k") >= 0), entry("method", F.col("method")), entry("position", F.char(F.col("gold_index") + 65), F.col("gold_index").between(0, 3) & (F.col("k") == 4)),
        )
    )
    counted = rows.select(F.explode(marks).alias("m")).groupBy("m.section", "m.key").agg(F.count("*").alias("n"))
    repeats = lambda name, *by: rows.groupBy(*by).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("issue").alias("section"), F.lit(name).alias("key"), "n").where("n > 0")
    return counted.unionByName(repeats("duplicate_qa_id", "id")).unionByName(repeats("duplicate_question_ground_truth", "q", "t"))


def intrinsic(records: DataFrame) -> DataFrame:
    """Counts and rates of a set of records: valid, duplicate, distinct questions, multimodal. Empty sets give zeros."""
    whole = strip(F.coalesce("question_content", F.lit(""))) != ""
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    rows = records.select(normalize(F.coalesce("question_content", F.lit(""))).alias("q"), normalize(F.coalesce("ground_truth", F.lit(""))).alias("t"), whole.alias("v"), F.coalesce("is_multimodal", F.lit(False)).alias("m"))
    by_pair = rows.groupBy("q", "t").agg(F.count("*").alias("n"), F.count_if("v").alias("v"), F.count_if("m").alias("m"))
    by_q = by_pair.groupBy("q").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("m").alias("m"), F.sum(F.col("n") - 1).alias("d"))
    t = by_q.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("v").alias("v"), F.sum("m").alias("m"), F.sum("d").alias("d"), F.count("*").alias("k"))
    rate = lambda c: F.round(F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0), 6)
    return t.select(F.col("n").alias("n_records"), rate("v").alias("parse_valid_rate"), rate("d").alias("duplicate_rate"), rate("k").alias("diversity_ratio"), rate("m").alias("multimodal_ratio"))


def dataset_stats(records: DataFrame, n_raw: int | Column, n_filtered: int | Column) -> DataFrame:
    """One row: funnel, ratios, mean lengths over non-empty texts, mean option count, source documents."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)), 1)
    text = F.coalesce(F.when(F.col("context_text") != "", F.col("context_text")), F.col("context_payload.text"), F.lit(""))
    doc = F.coalesce(F.when(strip("doc_id") != "", strip("doc_id")), F.when(F.col("qa_id").contains("_chunk_"), F.regexp_extract("qa_id", r"(?s)^(.*?)_chunk_", 1)))
    flagged = F.coalesce("is_multimodal", F.lit(False)) | F.coalesce(F.size("context_payload.visuals") > 0, F.lit(False))
    rows = records.select(doc.alias("d"), flagged.alias("m"), F.length("question_content").alias("q"), F.length(text).alias("c"), F.size("candidate_answers").alias("a"))
    whole = rows.agg(F.count("*").alias("n_final"), F.count_if("m").alias("n_multimodal"), mean(F.col("q")).alias("avg_question"), mean(F.col("c")).alias("avg_context"), F.round(F.coalesce(F.avg("a"), F.lit(0.0)), 1).alias("avg_candidates"))
    docs = rows.where("d is not null").groupBy("d").count().agg(F.count("*").alias("n_documents"))
    number = lambda x: x if isinstance(x, Column) else F.lit(x).cast("bigint")
    out = whole.withColumn("j", F.lit(1)).join(docs.withColumn("j", F.lit(1)), "j").drop("j")
    raw, kept = number(n_raw), number(n_filtered)
    return out.withColumns({"n_raw": raw, "n_filtered": kept, "n_rejected": raw - kept, "pass_rate": F.round(F.when(raw > 0, kept / raw).otherwise(0.0), 4), "multimodal_ratio": F.round(F.col("n_multimodal") / F.greatest(F.col("n_final"), F.lit(1)), 4)})


# --- audit of visuals --------------------------------------------------------------------------


def visual_audit(contexts: DataFrame, rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Decision for each chunk that multimodal rows use: signals for and against its visuals, and the first rule that
    drops them. patterns: cue, structure, page_zero, artifact, decorative, malformed."""
    asked = rows.where("is_multimodal").groupBy("chunk_id").agg(F.array_join(F.collect_list(F.coalesce("question_content", F.lit(""))), " ").alias("questions"), F.count("*").alias("n_rows"))
    both = asked.join(contexts.select("chunk_id", "text", "summaries", "visuals"), "chunk_id", "left")
    text, summary = F.coalesce("text", F.lit("")), F.coalesce(F.array_join("summaries", " | ", ""), F.lit(""))
    has = lambda c, p: c.rlike(patterns[p])
    asks = F.col("questions")
    cue, asked_cue, structure = has(text, "cue"), has(asks, "cue"), has(summary, "structure")
    zero = has(F.coalesce(F.array_join("visuals", " ", ""), F.lit("")), "page_zero")
    artifact, plain, broken = has(summary, "artifact") | has(asks, "artifact") | has(text, "artifact"), has(summary, "decorative"), has(summary, "malformed")
    decision = (
        F.when(artifact, "drop_cover_logo_or_front_matter").when(zero & ~cue, "drop_page_zero_non_structural_image").when(plain & ~asked_cue, "drop_decorative_or_generic_visual")
        .when(~structure & ~cue, "drop_no_structural_visual_evidence").when(broken & ~asked_cue, "drop_malformed_summary_without_question_grounding").otherwise("retain_structural_visual")
    )
    return both.select("chunk_id", "n_rows", zero.alias("page_zero"), asked_cue.alias("question_cue"), decision.alias("decision"), decision.startswith("retain").alias("keep"))


def demoted(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """rows whose chunk was dropped become text-only: five fields are reset."""
    gone = audit.where("not keep").select("chunk_id", F.lit(True).alias("_gone"))
    joined = rows.join(gone, "chunk_id", "left")
    hit = F.coalesce("_gone", F.lit(False)) & F.col("is_multimodal")
    empty = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "visuals": F.when(hit, empty).otherwise(F.col("visuals")), "image_file_name": F.when(~hit, F.col("image_file_name")), "image_file_names": F.when(hit, empty).otherwise(F.col("image_file_names")),
            "context_payload": F.when(hit, F.col("context_payload").withField("visuals", empty)).otherwise(F.col("context_payload")), "is_multimodal": F.col("is_multimodal") & ~hit,
        }
    ).drop("_gone")


def visual_report(audit: DataFrame) -> DataFrame:
    """Contexts, rows and signals before and after, in one pass."""
    n = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    all_, keep = F.lit(True), F.col("keep")
    return audit.agg(
        *[F.count_if(w).alias(f"contexts_{k}") for k, w in (("before", all_), ("after", keep))], *[n("n_rows", w).alias(f"rows_{k}") for k, w in (("before", all_), ("after", keep))],
        *[F.count_if(w & F.col("page_zero")).alias(f"page_zero_{k}") for k, w in (("before", all_), ("after", keep))], *[n("n_rows", w & F.col("question_cue")).alias(f"cue_rows_{k}") for k, w in (("before", all_), ("after", keep))],
    )


# --- sheets ------------------------------------------------------------------------------------


def stratified(records: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n records: n div k of each of k strata in hash order, topped up from the rest in hash order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    k = records.select(*strata).distinct().groupBy().agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.count("*"), F.lit(1)))).alias("_per"))
    rows = records.withColumn("_h", digest).withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))).where(F.col("_k") <= n)
    first = rows.join(F.broadcast(k), F.lit(True)).withColumn("_late", F.col("_k") > F.col("_per"))
    return first.orderBy("_late", "_h", key).limit(n).drop("_h", "_k", "_per", "_late")


def annotator_sheet(sample: DataFrame, key: str) -> DataFrame:
    """Rows of an annotation sheet: numbered by key, options joined, excerpt of 600 characters, blank marks."""
    number = F.row_number().over(Window.orderBy(key)) - 1
    blank = [F.lit("").alias(f"ann_{x}") for x in ("legal_correctness", "groundedness", "question_quality", "distractor_quality", "visual_alignment", "comments")]
    text = F.coalesce(F.when(F.col("context_text") != "", F.col("context_text")), F.lit(""))
    return sample.select(F.format_string("item_%04d", number).alias("item_id"), "qa_id", "bloom_level", F.col("is_multimodal").cast("int").alias("is_multimodal"), "question_content", F.array_join("candidate_answers", " || ").alias("candidate_answers"), "ground_truth", F.left(text, F.lit(600)).alias("context_excerpt"), *blank)


def paired_marks(first: DataFrame, second: DataFrame, key: str, fields: list[str], position: str) -> DataFrame:
    """(field, a, b, n): counts of pairs of marks that two annotators gave one item; each side's last row counts, and a
    pair only if both are given."""
    last = lambda df, x: df.groupBy(key).agg(*[F.max_by(F.coalesce(f, F.lit("")), position).alias(f"{f}_{x}") for f in fields])
    both = last(first, "a").join(last(second, "b"), key)
    marks = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), strip(f"{f}_a").alias("a"), strip(f"{f}_b").alias("b")) for f in fields]))
    return both.select(marks.alias("m")).select("m.*").where("a <> '' and b <> ''").groupBy("field", "a", "b").agg(F.count("*").alias("n"))


def kappa_by(cells: DataFrame, group: str) -> DataFrame:
    """Items, agreement and Cohen's kappa for each group of counted pairs; 1 with fewer than two marks or certain chance."""
    sides = cells.select(group, F.explode(F.array(F.struct(F.col("a").alias("mark"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")), F.struct(F.col("b").alias("mark"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))).alias("s"))
    per = sides.groupBy(group, "s.mark").agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    chance = per.groupBy(group).agg(F.sum(F.col("na") * F.col("nb")).alias("m"), F.count("*").alias("labels"))
    seen = cells.groupBy(group).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    pe, po = F.col("m") / (F.col("items") * F.col("items")), F.col("same") / F.col("items")
    return seen.join(chance, group).select(group, "items", F.round(po, 6).alias("agreement"), F.round(F.when((F.col("labels") < 2) | (pe >= 1), 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))
