"""Queries of the release path: fuzzy resolution, seeded order, splits, evaluable records, reports, visual audit, sheets."""

from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fuzzy
from quillspark.operators import items as I
from quillspark.operators import release as R
from quillspark.plans.items import ITEMS_SQL, items
from quillspark.plans.registry import query
from quillspark.sources.tables import table

SEED = 20260806
# near misses: an option repeated five times, and the answer without its last letter
NEAR_SQL = f"""{ITEMS_SQL}, near AS (SELECT item_id, question, gold, names, answer, CASE WHEN item_id % 6 = 5 THEN list_transform(range(4), lambda i: chr(CAST(65 + i AS INTEGER)) || '. ' || repeat(names[i + 1] || ' ', 5)) ELSE candidate_answers END AS candidate_answers,
  CASE WHEN item_id % 6 = 5 THEN left(repeat(answer || ' ', 5), length(answer) * 5 + 3) ELSE ground_truth END AS ground_truth, CASE WHEN item_id % 6 = 5 THEN 'fuzzy_payload' ELSE CASE item_id % 5 WHEN 0 THEN 'exact_full' WHEN 1 THEN 'payload_match' WHEN 2 THEN 'label_only' WHEN 3 THEN 'payload_match' ELSE 'unresolved' END END AS method FROM p JOIN items USING (item_id, question, candidate_answers, gold))"""
NEAR_SQL = NEAR_SQL.replace("FROM p JOIN items USING (item_id, question, candidate_answers, gold)", "FROM (SELECT i.*, p.names, p.answer FROM items i JOIN p USING (item_id))")


def near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    miss = F.col("item_id") % 6 == 5
    name = lambda o: F.regexp_replace(o, r"^[A-D]\. ", "")
    options = F.transform("candidate_answers", lambda o: F.concat(F.left(o, F.lit(3)), F.repeat(F.concat(name(o), F.lit(" ")), F.lit(5))))
    answer = name(F.element_at("candidate_answers", (F.col("gold") + 1).cast("int")))
    cut = F.left(F.repeat(F.concat(answer, F.lit(" ")), F.lit(5)), F.length(answer) * 5 + 3)
    return rows.withColumns({"candidate_answers": F.when(miss, options).otherwise(F.col("candidate_answers")), "ground_truth": F.when(miss, cut).otherwise(F.col("ground_truth"))})


@query("gt_resolve_fuzzy", f"WITH {NEAR_SQL} SELECT item_id, method, CASE WHEN method <> 'unresolved' THEN gold END AS gold_index FROM near")
def gt_resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.resolved(near_items(spark, sf_dir)).select("item_id", "method", "gold_index")


def _orders(n: int) -> str:
    """The seeded orders of the first n kept items as letters: a plain loop, for the SQL."""
    rng, number, out = random.Random(SEED), {p: i for i, p in enumerate(permutations(range(4)))}, []
    for _ in range(n):
        order = [0, 1, 2, 3]
        rng.shuffle(order)
        out.append(chr(65 + number[tuple(order)]))
    return "".join(out)


ORDER_LIST = "[" + ", ".join(f"'{''.join(map(str, p))}'" for p in permutations(range(4))) + "]"
CLEANED = "list_transform(candidate_answers, lambda x: trim(regexp_replace(regexp_replace(x, '^[A-D][.] ', ''), '\\s+', ' ', 'g')))"


@query(
    "eval_ready_seeded",
    f"""WITH {NEAR_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS r, {CLEANED} AS cleaned FROM near WHERE method <> 'unresolved'), perm AS (SELECT '{_orders(2000)}' AS letters),
    c AS (SELECT k.*, r % 4 AS place, ({ORDER_LIST})[ascii(substr(letters, CAST(r + 1 AS BIGINT), 1)) - 64] AS ord FROM k, perm),
    s AS (SELECT *, strpos(ord, CAST(gold AS VARCHAR)) - 1 AS cur FROM c),
    t AS (SELECT *, list_transform(range(4), lambda i: cleaned[CAST(CASE WHEN i = place THEN gold WHEN i = cur THEN CAST(substr(ord, CAST(place + 1 AS BIGINT), 1) AS BIGINT) ELSE CAST(substr(ord, i + 1, 1) AS BIGINT) END AS BIGINT) + 1]) AS options FROM s)
    SELECT item_id, array_to_string(options, '|') AS options, options[place + 1] AS ground_truth, place AS gold_index, method AS source_match_method FROM t""",
)
def eval_ready_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL holds the seeded orders of 2,000 items, those of the smaller tables."""
    out = R.rebalanced(near_items(spark, sf_dir).select("item_id", "candidate_answers", "ground_truth"), "item_id", SEED)
    return out.select("item_id", F.array_join("candidate_answers", "|").alias("options"), "ground_truth", "gold_index", "source_match_method")


RECORDS_SQL = f"""{NEAR_SQL}, rec AS (SELECT item_id, CASE WHEN item_id % 41 = 0 THEN 'd1_chunk_1_0' WHEN item_id % 43 = 0 THEN 'plain' || item_id ELSE 'd' || (item_id % 37) || '_chunk_' || (item_id % 11) || '_' || item_id END AS qa_id,
  CASE WHEN item_id % 31 = 0 THEN '  ' ELSE question END AS question_content, CASE WHEN item_id % 29 = 0 THEN candidate_answers[1:3] ELSE candidate_answers END AS candidate_answers, ground_truth, method, gold,
  CASE WHEN item_id % 23 <> 0 THEN 'because ' || names[1] END AS legal_rationale, CASE item_id % 3 WHEN 0 THEN 'Remember' WHEN 1 THEN 'Understand' ELSE 'Apply' END AS bloom_level, item_id % 2 = 0 AS is_multimodal, CASE WHEN item_id % 5 = 0 THEN '' ELSE question || ' context' END AS context_text,
  CASE WHEN item_id % 4 = 0 THEN 'train' WHEN item_id % 4 = 1 THEN '' ELSE 'dev' END AS split FROM near)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records with planted faults: repeated and chunkless ids, blank questions, three options, no rationale."""
    i = F.col("item_id")
    rows = near_items(spark, sf_dir)
    part = lambda k: F.format_string("%d", i % k)
    qa_id = F.when(i % 41 == 0, "d1_chunk_1_0").when(i % 43 == 0, F.concat(F.lit("plain"), i.cast("string"))).otherwise(F.concat(F.lit("d"), part(37), F.lit("_chunk_"), part(11), F.lit("_"), i.cast("string")))
    return rows.select(
        "item_id", qa_id.alias("qa_id"), F.when(i % 31 == 0, "  ").otherwise(F.col("question")).alias("question_content"), F.when(i % 29 == 0, F.slice("candidate_answers", 1, 3)).otherwise(F.col("candidate_answers")).alias("candidate_answers"), "ground_truth", "gold",
        F.when(i % 23 != 0, "because").alias("legal_rationale"), F.when(i % 3 == 0, "Remember").when(i % 3 == 1, "Understand").otherwise("Apply").alias("bloom_level"), (i % 2 == 0).alias("is_multimodal"),
        F.when(i % 5 == 0, "").otherwise(F.concat("question", F.lit(" context"))).alias("context_text"), F.when(i % 4 == 0, "train").when(i % 4 == 1, "").otherwise("dev").alias("split"),
    )


CHUNK_SQL = "CASE WHEN contains(qa_id, '_chunk_') THEN regexp_extract(qa_id, '^(.*?_chunk_[^_]*)', 1) ELSE qa_id END"
DOC_SQL = "CASE WHEN contains(qa_id, '_chunk_') THEN regexp_extract(qa_id, '^(.*?)_chunk_', 1) ELSE qa_id END"


@query(
    "split_join",
    f"""WITH {RECORDS_SQL}, m AS (SELECT 'd' || (o_custkey % 37) || '_chunk_' || (o_orderkey % 9) AS chunk_id, CASE o_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN ' dev ' WHEN 2 THEN '' ELSE 'test' END AS split, o_orderkey AS pos FROM orders),
    l AS (SELECT chunk_id, arg_max(split, pos) AS split FROM m GROUP BY chunk_id)
    SELECT item_id, {CHUNK_SQL} AS chunk_id, {DOC_SQL} AS doc_id, coalesce(nullif(trim(l.split), ''), nullif(rec.split, ''), 'unknown') AS split FROM rec LEFT JOIN l ON l.chunk_id = {CHUNK_SQL}""",
)
def split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, chunk = R.qa_parts(F.col("qa_id"))
    rows = records(spark, sf_dir).select("item_id", doc.alias("doc_id"), chunk.alias("chunk_id"), "split")
    k = F.col("o_orderkey") % 4
    made = F.concat(F.lit("d"), (F.col("o_custkey") % 37).cast("string"), F.lit("_chunk_"), (F.col("o_orderkey") % 9).cast("string"))
    manifest = table(spark, sf_dir, "orders").select(made.alias("chunk_id"), F.when(k == 0, "train").when(k == 1, " dev ").when(k == 2, "").otherwise("test").alias("split"), F.lit("").alias("doc_id"), F.col("o_orderkey").alias("pos"))
    return R.with_split(rows, manifest, "pos").select("item_id", "chunk_id", "doc_id", "split")


EVAL_SQL = f"""{RECORDS_SQL}, t AS (SELECT *, CASE WHEN item_id % 7 = 0 THEN 2 WHEN item_id % 7 = 1 THEN 9 END AS gi, len(candidate_answers) AS n, {{}} AS m FROM rec),
  e AS (SELECT item_id, CASE WHEN n = 4 AND gi BETWEEN 0 AND 3 THEN gi WHEN n <> 4 THEN NULL WHEN method <> 'unresolved' THEN gold END AS idx, CASE WHEN n = 4 AND gi BETWEEN 0 AND 3 THEN NULL WHEN n <> 4 THEN 'not_4_options' WHEN method = 'unresolved' THEN 'unresolved' END AS skip_reason FROM t)""".replace("{}", "method")


@query("evaluable_records", f"WITH {EVAL_SQL} SELECT item_id, CAST(idx AS BIGINT) AS gold_index, skip_reason FROM e")
def evaluable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    rows = records(spark, sf_dir).withColumn("gold_index", F.when(i % 7 == 0, 2).when(i % 7 == 1, 9).cast("bigint"))
    return R.evaluable(rows).select("item_id", F.col("_gold_index").alias("gold_index"), "skip_reason")


@query("skip_reasons", f"WITH {EVAL_SQL} SELECT coalesce(skip_reason, 'evaluable') AS reason, count(*) AS n FROM e GROUP BY 1")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluable_records(spark, sf_dir).groupBy(F.coalesce("skip_reason", F.lit("evaluable")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "release_schema",
    f"""WITH {RECORDS_SQL} SELECT qa_id, domain, bloom_level, text, n_visuals, question_content, is_multimodal, options, ground_truth, legal_rationale FROM (SELECT qa_id, CASE WHEN regexp_matches(qa_id, '^[0-9]') THEN 'Law ' || regexp_extract(qa_id, '^([0-9]+)', 1) ELSE 'Other' END AS domain, bloom_level, context_text AS text,
    CAST(CASE WHEN is_multimodal THEN 1 ELSE 0 END AS INTEGER) AS n_visuals, question_content, is_multimodal, array_to_string(candidate_answers, '|') AS options, ground_truth, CASE WHEN legal_rationale IS NULL THEN '' ELSE 'because' END AS legal_rationale FROM rec)""",
)
def release_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for k in range(1, 43) for x in (str(k), f"Law {k}")])
    rows = records(spark, sf_dir).withColumn("domain_tag", R.infer_domain(F.lit("unknown"), F.col("qa_id"), names)).withColumn("context_visuals", F.when(F.col("is_multimodal"), F.array(F.lit("img.png"))))
    out = R.to_release(rows)
    return out.select("qa_id", F.col("domain_tag").alias("domain"), "bloom_level", "context_payload.text", F.size("context_payload.visuals").alias("n_visuals"), "question_content", "is_multimodal", F.array_join("candidate_answers", "|").alias("options"), "ground_truth", "legal_rationale")


NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(
    "integrity_report",
    f"""WITH {RECORDS_SQL}, x AS (SELECT *, len(candidate_answers) AS k, {NORM.format('question_content')} AS q, {NORM.format('ground_truth')} AS t FROM rec),
    y AS (SELECT *, CASE WHEN method = 'unresolved' THEN NULL WHEN gold < k OR method = 'label_only' THEN gold END AS gi FROM x),
    z AS (SELECT *, CASE WHEN gi IS NOT NULL AND gi < k THEN method ELSE 'unresolved' END AS m2 FROM y)
    SELECT section, key, count(*) AS n FROM (
      SELECT 'issue' AS section, 'missing_required_fields' AS key FROM z WHERE legal_rationale IS NULL UNION ALL SELECT 'issue', 'empty_question' FROM z WHERE trim(question_content) = '' UNION ALL SELECT 'issue', 'non_four_way_candidate_answers' FROM z WHERE k <> 4
      UNION ALL SELECT 'candidates', CAST(k AS VARCHAR) FROM z UNION ALL SELECT 'method', m2 FROM z UNION ALL SELECT 'position', chr(CAST(65 + gi AS INTEGER)) FROM z WHERE k = 4 AND m2 <> 'unresolved') GROUP BY ALL
    UNION ALL SELECT 'issue', 'duplicate_qa_id', count(*) - count(DISTINCT qa_id) FROM z HAVING count(*) > count(DISTINCT qa_id) UNION ALL SELECT 'issue', 'duplicate_question_ground_truth', count(*) - (SELECT count(*) FROM (SELECT DISTINCT q, t FROM z)) FROM z""",
)
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.integrity(records(spark, sf_dir))


@query(
    "intrinsic_metrics",
    f"""WITH {RECORDS_SQL}, x AS (SELECT {NORM.format('question_content')} AS q, {NORM.format('ground_truth')} AS t, legal_rationale IS NOT NULL AND trim(question_content) <> '' AS v, is_multimodal AS m FROM rec), n AS (SELECT count(*) AS n FROM x)
    SELECT n AS n_records, round((SELECT count(*) FROM x WHERE v) / n::DOUBLE, 6) AS parse_valid_rate, round((n - (SELECT count(*) FROM (SELECT DISTINCT q, t FROM x))) / n::DOUBLE, 6) AS duplicate_rate, round((SELECT count(DISTINCT q) FROM x) / n::DOUBLE, 6) AS diversity_ratio, round((SELECT count(*) FROM x WHERE m) / n::DOUBLE, 6) AS multimodal_ratio FROM n""",
)
def intrinsic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.intrinsic(records(spark, sf_dir))


@query(
    "dataset_stats",
    f"""WITH {RECORDS_SQL}, x AS (SELECT *, CASE WHEN context_text = '' THEN 'payload text' ELSE context_text END AS c, is_multimodal OR item_id % 9 = 0 AS mm FROM rec WHERE item_id % 10 <> 0)
    SELECT (SELECT count(*) FROM rec) AS n_raw, (SELECT count(*) FROM rec WHERE item_id % 10 <> 0) AS n_filtered, count(*) AS n_final, (SELECT count(*) FROM rec WHERE item_id % 10 = 0) AS n_rejected, round(count(*) / (SELECT count(*) FROM rec)::DOUBLE, 4) AS pass_rate, count(DISTINCT CASE WHEN contains(qa_id, '_chunk_') THEN {DOC_SQL} END) AS n_documents,
    CAST(count(CASE WHEN mm THEN 1 END) AS BIGINT) AS n_multimodal, round(count(CASE WHEN mm THEN 1 END) / count(*)::DOUBLE, 4) AS multimodal_ratio, round(avg(length(question_content)), 1) AS avg_question, round(avg(length(c)), 1) AS avg_context, round(avg(len(candidate_answers)), 1) AS avg_candidates FROM x""",
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = records(spark, sf_dir)
    final = raw.where("item_id % 10 <> 0")
    visuals = F.when(F.col("item_id") % 9 == 0, F.array(F.lit("x.png"))).otherwise(F.array().cast("array<string>"))
    final = final.withColumn("context_payload", F.struct(F.lit("payload text").alias("text"), visuals.alias("visuals"))).withColumn("doc_id", F.lit(""))
    return R.dataset_stats(final, raw.count(), final.count())


@query(
    "eval_ready_report",
    f"""WITH {RECORDS_SQL}, r AS (SELECT *, CASE WHEN len(candidate_answers) <> 4 THEN 'not_4_options' WHEN method = 'unresolved' THEN 'unresolved' END AS reason FROM rec), k AS (SELECT * FROM r WHERE reason IS NULL),
    d AS (SELECT {DOC_SQL} AS doc, count(*) AS n, min(item_id) AS first FROM k GROUP BY 1 ORDER BY n DESC, first LIMIT 10)
    SELECT 'drop_reasons' AS section, reason AS key, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'position_before', chr(CAST(65 + gold AS INTEGER)), count(*) FROM k GROUP BY ALL UNION ALL SELECT 'split', CASE WHEN split = '' THEN 'unknown' ELSE split END, count(*) FROM k GROUP BY ALL
    UNION ALL SELECT 'bloom', bloom_level, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'bloom_multimodal', bloom_level, count(*) FROM k WHERE is_multimodal GROUP BY ALL UNION ALL SELECT 'top_domains', doc, n FROM d""",
)
def eval_ready_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by section; the ten largest groups, ties by first appearance."""
    rows = fuzzy.resolved(records(spark, sf_dir)).withColumn("reason", I.drop_reason(F.col("candidate_answers"), F.col("method")))
    doc, _ = R.qa_parts(F.col("qa_id"))
    kept = F.col("reason").isNull()
    entry = lambda section, key, when: F.when(when, F.struct(F.lit(section).alias("section"), key.alias("key")))
    marks = F.array_compact(F.array(
        entry("drop_reasons", F.col("reason"), ~kept), entry("position_before", F.char(F.col("gold_index") + 65), kept), entry("split", F.when(F.col("split") == "", "unknown").otherwise(F.col("split")), kept),
        entry("bloom", F.col("bloom_level"), kept), entry("bloom_multimodal", F.col("bloom_level"), kept & F.col("is_multimodal")), entry("top_domains", doc, kept),
    ))
    counts = rows.select("item_id", F.explode(marks).alias("m")).groupBy("m.section", "m.key").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    top = counts.where("section = 'top_domains'").orderBy(F.desc("n"), "first").limit(10)
    return counts.where("section <> 'top_domains'").unionByName(top).select("section", "key", "n")


# --- quality codes -----------------------------------------------------------------------------


@query(
    "quality_codes",
    f"""WITH {RECORDS_SQL}, x AS (SELECT *, len(candidate_answers) AS k, CASE WHEN method <> 'unresolved' AND gold < len(candidate_answers) THEN method ELSE 'unresolved' END AS m FROM rec)
    SELECT item_id, array_to_string(list_filter([CASE WHEN m = 'unresolved' THEN 'gt_unresolved' END, CASE WHEN m = 'fuzzy_payload' THEN 'gt_fuzzy_only' END, CASE WHEN k <> 4 THEN 'candidate_count' END, CASE WHEN trim(question_content) = '' THEN 'question_too_short' END, 'rationale_too_short', CASE WHEN length(context_text) < 80 THEN 'context_too_short' END,
      'missing_syllogism', CASE WHEN is_multimodal THEN 'multimodal_no_visual' END], lambda v: v IS NOT NULL), ',') AS codes, CASE WHEN m = 'unresolved' THEN 'regenerate' ELSE 'review' END AS triage FROM x""",
)
def quality_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags over records whose answers are resolved with the fuzzy stage."""
    rows = fuzzy.resolved(records(spark, sf_dir))
    flags = I.quality_flags(F.col("question_content"), F.col("candidate_answers"), F.col("ground_truth"), F.when(F.col("legal_rationale").isNotNull(), "so"), F.col("context_text"), F.col("is_multimodal"), F.array().cast("array<string>"), method=F.col("method"))
    return rows.withColumn("flags", flags).select("item_id", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("codes"), I.triage(F.col("flags")).alias("triage"))


# --- visuals, sheets, annotators ---------------------------------------------------------------

PATTERNS = {"cue": r"(?i)\b(figure|diagram)\b", "structure": r"(?i)\b(flow|arrow)\b", "page_zero": r"_page_0_", "artifact": r"(?i)\b(logo|cover)\b", "decorative": r"(?i)\bdecorative\b", "malformed": r"^\s*\{"}
VISUAL_SQL = f"""{RECORDS_SQL}, a AS (SELECT CAST(item_id % 50 AS VARCHAR) AS chunk_id, string_agg(question_content || CASE WHEN item_id % 50 % 4 = 1 THEN ' figure' ELSE '' END, ' ') AS qs, count(*) AS n_rows FROM rec WHERE is_multimodal OR item_id % 50 % 2 = 1 GROUP BY 1),
  c AS (SELECT CAST(i AS VARCHAR) AS chunk_id, CASE WHEN i % 3 = 0 THEN 'see the Diagram' ELSE 'plain' END AS text, CASE i % 7 WHEN 0 THEN 'a flow' WHEN 1 THEN 'the logo' WHEN 2 THEN 'decorative arrow' WHEN 3 THEN '{{ arrow' ELSE 'none' END AS s, i % 5 = 0 AS zero FROM range(48) t(i)),
  v AS (SELECT a.chunk_id, n_rows, contains(qs, 'figure') AS qc, coalesce(contains(text, 'Diagram'), FALSE) AS cue, coalesce(s LIKE '%flow%' OR s LIKE '%arrow%', FALSE) AS st, coalesce(zero, FALSE) AS zero, coalesce(s LIKE '%logo%', FALSE) AS art, coalesce(s LIKE '%decorative%', FALSE) AS deco, coalesce(s LIKE '{{%', FALSE) AS mal FROM a LEFT JOIN c USING (chunk_id)),
  w AS (SELECT *, CASE WHEN art THEN 'drop_cover_logo_or_front_matter' WHEN zero AND NOT cue THEN 'drop_page_zero_non_structural_image' WHEN deco AND NOT qc THEN 'drop_decorative_or_generic_visual' WHEN NOT st AND NOT cue THEN 'drop_no_structural_visual_evidence' WHEN mal AND NOT qc THEN 'drop_malformed_summary_without_question_grounding' ELSE 'retain_structural_visual' END AS decision FROM v)"""


def visual_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("item_id") % 50
    rows = records(spark, sf_dir).withColumn("chunk_id", k.cast("string")).withColumn("is_multimodal", F.col("is_multimodal") | (k % 2 == 1)).withColumn("question_content", F.when(k % 4 == 1, F.concat("question_content", F.lit(" figure"))).otherwise(F.col("question_content")))
    i = F.col("id")
    summary = F.when(i % 7 == 0, "a flow").when(i % 7 == 1, "the logo").when(i % 7 == 2, "decorative arrow").when(i % 7 == 3, "{ arrow").otherwise("none")
    visuals = F.array(F.when(i % 5 == 0, "x/_page_0_Picture.png").otherwise("x/_page_3_Picture.png"))
    return spark.range(48).select(i.cast("string").alias("chunk_id"), F.when(i % 3 == 0, "see the Diagram").otherwise("plain").alias("text"), F.array(summary).alias("summaries"), visuals.alias("visuals")), rows


@query("visual_audit", f"WITH {VISUAL_SQL} SELECT chunk_id, n_rows, decision FROM w")
def visual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, rows = visual_rows(spark, sf_dir)
    return R.visual_audit(contexts, rows, PATTERNS).select("chunk_id", "n_rows", "decision")


@query("visual_demotion", f"WITH {VISUAL_SQL}, m AS (SELECT item_id, CAST(item_id % 50 AS VARCHAR) AS chunk_id, is_multimodal OR item_id % 50 % 2 = 1 AS mm FROM rec) SELECT item_id, mm AND coalesce(decision LIKE 'retain%', TRUE) AS is_multimodal, CAST(CASE WHEN mm AND decision LIKE 'drop%' THEN 0 ELSE 1 END AS INTEGER) AS n_visuals, CASE WHEN NOT (mm AND decision LIKE 'drop%') THEN 'f.png' END AS image_file_name FROM m LEFT JOIN w USING (chunk_id)")
def visual_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, rows = visual_rows(spark, sf_dir)
    one = F.array(F.lit("f.png"))
    rows = rows.withColumns({"visuals": one, "image_file_name": F.lit("f.png"), "image_file_names": one, "context_payload": F.struct(F.lit("t").alias("text"), one.alias("visuals"))})
    out = R.demoted(rows, R.visual_audit(contexts, rows, PATTERNS))
    return out.select("item_id", "is_multimodal", F.size("context_payload.visuals").alias("n_visuals"), "image_file_name")


@query(
    "visual_report",
    f"WITH {VISUAL_SQL}, k AS (SELECT *, decision LIKE 'retain%' AS keep FROM w) SELECT CAST(count(*) AS BIGINT) AS contexts_before, CAST(count(CASE WHEN keep THEN 1 END) AS BIGINT) AS contexts_after, CAST(sum(n_rows) AS BIGINT) AS rows_before, CAST(coalesce(sum(CASE WHEN keep THEN n_rows END), 0) AS BIGINT) AS rows_after, CAST(count(CASE WHEN zero THEN 1 END) AS BIGINT) AS page_zero_before, CAST(count(CASE WHEN keep AND zero THEN 1 END) AS BIGINT) AS page_zero_after, CAST(coalesce(sum(CASE WHEN qc THEN n_rows END), 0) AS BIGINT) AS cue_rows_before, CAST(coalesce(sum(CASE WHEN keep AND qc THEN n_rows END), 0) AS BIGINT) AS cue_rows_after FROM k",
)
def visual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, rows = visual_rows(spark, sf_dir)
    return R.visual_report(R.visual_audit(contexts, rows, PATTERNS))


@query(
    "annotator_sheet",
    f"""WITH {RECORDS_SQL}, h AS (SELECT *, sha256('7|' || item_id) AS h FROM rec), k AS (SELECT *, row_number() OVER (PARTITION BY bloom_level, is_multimodal ORDER BY h, item_id) AS k FROM h), n AS (SELECT greatest(1, 50 // count(DISTINCT bloom_level || is_multimodal)) AS per FROM rec),
    s AS (SELECT k.* FROM k, n ORDER BY k > per, h, item_id LIMIT 50)
    SELECT 'item_' || lpad(CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR), 4, '0') AS item_id, qa_id, bloom_level, CAST(is_multimodal AS INTEGER) AS is_multimodal, array_to_string(candidate_answers, ' || ') AS candidate_answers, left(context_text, 600) AS context_excerpt, '' AS ann_comments FROM s""",
)
def annotator_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = R.stratified(records(spark, sf_dir), ["bloom_level", "is_multimodal"], "item_id", 50, 7)
    return R.annotator_sheet(sample, "item_id").select("item_id", "qa_id", "bloom_level", "is_multimodal", "candidate_answers", "context_excerpt", "ann_comments")


def marks_of(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Marks of one annotator, keyed by customer; blanks and repeated rows are planted."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    mark = lambda m, shift: F.when((k + side) % 13 == 0, " ").otherwise(((F.col("o_custkey") + F.when(k % 5 == 0, side * shift).otherwise(0)) % m + 1).cast("string"))
    return o.where(k % 3 != side).select(F.col("o_custkey").alias("qa_id"), k.alias("pos"), mark(5, 1).alias("quality"), mark(3, 2).alias("grounded"))


MARKS_SQL = "m{s} AS (SELECT o_custkey AS qa_id, arg_max(CASE WHEN (o_orderkey + {s}) % 13 = 0 THEN ' ' ELSE CAST((o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN {s} ELSE 0 END) % 5 + 1 AS VARCHAR) END, o_orderkey) AS quality, arg_max(CASE WHEN (o_orderkey + {s}) % 13 = 0 THEN ' ' ELSE CAST((o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN {s} * 2 ELSE 0 END) % 3 + 1 AS VARCHAR) END, o_orderkey) AS grounded FROM orders WHERE o_orderkey % 3 <> {s} GROUP BY 1)"


@query(
    "annotator_agreement",
    f"""WITH {MARKS_SQL.format(s=1)}, {MARKS_SQL.format(s=2)}, j AS (SELECT field, trim(a) AS a, trim(b) AS b FROM (SELECT 'quality' AS field, m1.quality AS a, m2.quality AS b FROM m1 JOIN m2 USING (qa_id) UNION ALL SELECT 'grounded', m1.grounded, m2.grounded FROM m1 JOIN m2 USING (qa_id)) WHERE trim(a) <> '' AND trim(b) <> ''),
    n AS (SELECT field, count(*)::DOUBLE AS n, count(CASE WHEN a = b THEN 1 END) AS same FROM j GROUP BY field), e AS (SELECT x.field, sum(x.c * y.c)::DOUBLE AS m FROM (SELECT field, a AS k, count(*) AS c FROM j GROUP BY ALL) x JOIN (SELECT field, b AS k, count(*) AS c FROM j GROUP BY ALL) y USING (field, k) GROUP BY x.field)
    SELECT field, CAST(n AS BIGINT) AS items, round(same / n, 6) AS agreement, round((same / n - m / (n * n)) / (1 - m / (n * n)), 6) AS kappa FROM n JOIN e USING (field)""",
)
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.paired_marks(marks_of(spark, sf_dir, 1), marks_of(spark, sf_dir, 2), "qa_id", ["quality", "grounded"], "pos")
    return R.kappa_by(cells, "field")
