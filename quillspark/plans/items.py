"""Queries over question items. Items are derived from customers: the question asks for a nation's region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import mcq as M
from quillspark.operators import items as I
from quillspark.plans.documents import squeeze_sql, strip_sql
from quillspark.plans.registry import query
from quillspark.sources.tables import table

ITEMS_SQL = """
o AS (SELECT c_custkey AS item_id, n_name, n_regionkey, list(r_name ORDER BY (r_regionkey + c_custkey) % 5) AS names, max(CASE WHEN r_regionkey = n_regionkey THEN r_name END) AS answer
  FROM customer JOIN nation ON c_nationkey = n_nationkey, region WHERE r_regionkey <> (n_regionkey + 1 + c_custkey % 4) % 5 GROUP BY ALL),
p AS (SELECT *, list_position(names, answer) - 1 AS gold, list_transform(range(4), lambda i: chr(CAST(65 + i AS INTEGER)) || '. ' || names[i + 1]) AS candidate_answers FROM o),
items AS (SELECT item_id, 'In which region does ' || n_name || ' lie?' AS question, candidate_answers, CASE item_id % 5 WHEN 0 THEN candidate_answers[gold + 1] WHEN 1 THEN '  ' || lower(answer) || ' ' WHEN 2 THEN chr(CAST(65 + gold AS INTEGER)) || '.'
  WHEN 3 THEN '<ground_truth>' || chr(CAST(65 + gold AS INTEGER)) || ') ' || answer || ' (full correct answer text)</ground_truth>' ELSE 'NOWHERE' END AS ground_truth, gold FROM p)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item a customer. The five regions are a fixed dimension and become a literal."""
    regions = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    out = (F.col("n_regionkey") + 1 + F.col("c_custkey") % 4) % 5
    pool = F.array(*[F.struct(F.pmod(F.lit(k) + F.col("c_custkey"), F.lit(5)).alias("o"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(regions)])
    names = F.transform(F.filter(F.array_sort(pool), lambda x: x["k"] != out), lambda x: x["n"])
    answer = F.element_at(F.array(*[F.lit(n) for n in regions]), F.col("n_regionkey") + 1)
    rows = rows.select(F.col("c_custkey").alias("item_id"), F.col("n_name"), names.alias("names"), answer.alias("answer"))
    options = F.transform("names", lambda n, i: F.concat(F.char(i + 65), F.lit(". "), n))
    rows = rows.withColumn("candidate_answers", options).withColumn("gold", F.array_position("names", F.col("answer")) - 1)
    kind, letter = F.col("item_id") % 5, F.char(F.col("gold") + 65)
    truth = (
        F.when(kind == 0, F.element_at("candidate_answers", (F.col("gold") + 1).cast("int"))).when(kind == 1, F.concat(F.lit("  "), F.lower("answer"), F.lit(" "))).when(kind == 2, F.concat(letter, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("<ground_truth>"), letter, F.lit(") "), "answer", F.lit(" (full correct answer text)</ground_truth>"))).otherwise("NOWHERE")
    )
    return rows.select("item_id", F.concat(F.lit("In which region does "), "n_name", F.lit(" lie?")).alias("question"), "candidate_answers", truth.alias("ground_truth"), "gold")


METHOD_SQL = "CASE item_id % 5 WHEN 0 THEN 'exact_full' WHEN 1 THEN 'payload_match' WHEN 2 THEN 'label_only' WHEN 3 THEN 'payload_match' ELSE 'unresolved' END"


@query("mcq_build", f"WITH {ITEMS_SQL} SELECT item_id, question, array_to_string(candidate_answers, ' | ') AS options, ground_truth, gold FROM items")
def mcq_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", "question", F.array_join("candidate_answers", " | ").alias("options"), "ground_truth", "gold")


# the SQL states the method that each way of writing the answer must lead to
@query("gt_resolve_methods", f"WITH {ITEMS_SQL} SELECT item_id, {METHOD_SQL} AS method, CASE WHEN item_id % 5 < 4 THEN gold END AS gold_index FROM items")
def gt_resolve_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolved(items(spark, sf_dir)).select("item_id", "method", "gold_index")


@query("gt_method_histogram", f"WITH {ITEMS_SQL} SELECT {METHOD_SQL} AS method, count(*) AS n FROM items GROUP BY 1")
def gt_method_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolved(items(spark, sf_dir)).groupBy("method").agg(F.count("*").alias("n"))


READY_SQL = f"""WITH {ITEMS_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS kept_rank FROM items WHERE item_id % 5 < 4),
c AS (SELECT *, kept_rank % 4 AS place, list_transform(candidate_answers, lambda x: regexp_replace(x, '^[A-D][.] ', '')) AS cleaned FROM k),
t AS (SELECT *, ((gold - place) % 4 + 4) % 4 AS turn FROM c),
ready AS (SELECT item_id, list_transform(range(4), lambda i: cleaned[CAST((i + turn) % 4 AS BIGINT) + 1]) AS options, place, gold FROM t)"""


@query("eval_ready_rebalance", READY_SQL + " SELECT item_id, array_to_string(options, '|') AS options, options[place + 1] AS ground_truth, place AS gold_index, chr(CAST(65 + place AS INTEGER)) AS gold_letter, gold AS source_gold_index FROM ready")
def eval_ready_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.eval_ready(items(spark, sf_dir), "item_id").withColumn("options", F.array_join("options", "|"))


@query("gold_position_hist", READY_SQL + " SELECT position, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after FROM (SELECT gold AS position, 1 AS before, 0 AS after FROM ready UNION ALL SELECT place, 0, 1 FROM ready) GROUP BY position")
def gold_position_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = I.eval_ready(items(spark, sf_dir), "item_id")
    both = ready.select(F.explode(F.array(F.struct(F.col("source_gold_index").alias("position"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("gold_index").alias("position"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return both.groupBy("x.position").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


@query(
    "integrity_counts",
    f"""WITH {ITEMS_SQL} SELECT count(*) AS n, CAST(count(CASE WHEN len(candidate_answers) <> 4 THEN 1 END) AS BIGINT) AS bad_candidate_count, CAST(count(CASE WHEN item_id % 5 = 4 THEN 1 END) AS BIGINT) AS unresolved,
    CAST(count(CASE WHEN trim(question) = '' THEN 1 END) AS BIGINT) AS empty_question, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lower(question), {squeeze_sql('lower(ground_truth)')} FROM items)) AS BIGINT) AS duplicates FROM items""",
)
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global aggregate over one row a signature: duplicates without a distinct over all items."""
    rows = I.resolved(items(spark, sf_dir)).select(F.lower("question").alias("q"), M.normalize("ground_truth").alias("t"), F.size("candidate_answers").alias("k"), "method", "question")
    per = rows.groupBy("q", "t").agg(F.count("*").alias("n"), F.count_if(F.col("k") != 4).alias("bad"), F.count_if(F.col("method") == "unresolved").alias("un"), F.count_if(F.trim("question") == "").alias("empty"))
    return per.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad_candidate_count"), F.sum("un").alias("unresolved"), F.sum("empty").alias("empty_question"), F.sum(F.col("n") - 1).alias("duplicates"))


NOTES = ["", " Therefore it is so.", " 根据提供的背景信息", " only the XML tags", " because (correct answer text) "]


def _noted(c: str) -> F.Column:
    k = F.col("doc_id") % 7
    return F.concat(F.col(c), *[F.when(k == i, n).otherwise("") for i, n in enumerate(NOTES)])


NOTED_SQL = "text || CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NOTES)) + " ELSE '' END"
SANITIZE_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\\s*\\((?:full correct answer text|correct answer text)\\)\\s*', '', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
SANITIZED = strip_sql("array_to_string(list_transform(string_split(" + SANITIZE_SQL.format(x="t") + ", chr(10)), lambda x: " + strip_sql("x") + "), chr(10))")


@query(
    "language_artifacts",
    f"""WITH n AS (SELECT doc_id, {NOTED_SQL} AS t FROM documents), s AS (SELECT doc_id, {SANITIZED} AS s FROM n)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'cjk_chars' END, CASE WHEN regexp_matches(s, '(?i)\\b(correct answer is|because|therefore|in this case)\\b') THEN 'english_meta' END,
    CASE WHEN regexp_matches(s, '(?i)(<qa_pair>|Bloom''s Taxonomy|only the xml tags|XML格式|根据提供的背景信息)') THEN 'prompt_leak' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""",
)
def language_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.artifacts(_noted("text")), ",").alias("reasons"))


@query(
    "eval_ready_language",
    f"""WITH n AS (SELECT doc_id, {NOTED_SQL} AS t FROM documents)
    SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'cjk_chars' END,
    CASE WHEN regexp_matches(t, '(?i)\\b(full correct answer text|correct answer is|because|therefore|in this case)\\b') THEN 'english_scaffold' END], lambda x: x IS NOT NULL)) AS reason FROM n) GROUP BY reason""",
)
def eval_ready_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = table(spark, sf_dir, "documents").select(F.explode(I.eval_ready_language_reasons(_noted("text"))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


@query("sanitize_text", f"WITH n AS (SELECT conv_id, turn, '  a (correct answer text) ' || chr(13) || chr(10) || text || chr(9) || ' x' AS t FROM conversations) SELECT conv_id, turn, sha256({SANITIZED}) AS text_sha256 FROM n")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("  a (correct answer text) \r\n"), "text", F.lit("\t x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(M.sanitize(t), 256).alias("text_sha256"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge output rendered from labels, and parsed back."""
    labels = table(spark, sf_dir, "labels")
    xml = F.concat(
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("<groundedness> "), F.col("quality").cast("string"), F.lit("</groundedness>"))),
        F.lit("<multimodal_alignment>"), (1 - F.col("toxic")).cast("string"), F.lit(".0</multimodal_alignment><Legal_Fluency>"), F.when(F.col("doc_id") % 5 == 0, "0").otherwise("1"),
        F.lit("</legal_fluency><taxonomy_level> "), F.when(F.col("doc_id") % 3 == 0, "APPLY").when(F.col("doc_id") % 3 == 1, "remember").otherwise("create"), F.lit(" </taxonomy_level>"),
    )
    return labels.select("doc_id", M.parse_scores(xml).alias("s"), (F.col("doc_id") % 2 == 0).alias("is_multimodal"))


SCORED_SQL = """s AS (SELECT doc_id, doc_id % 2 = 0 AS mm, CASE WHEN doc_id % 11 <> 0 THEN CAST(quality AS DOUBLE) END AS g, CASE WHEN doc_id % 11 <> 0 THEN CAST(1 - toxic AS DOUBLE) END AS m,
  CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END END::DOUBLE AS f, CASE WHEN doc_id % 11 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN 'Apply' WHEN 1 THEN 'Remember' ELSE 'Create' END END AS level FROM labels)"""


@query("eval_xml_parse", f"WITH {SCORED_SQL} SELECT doc_id, g AS groundedness, m AS multimodal_alignment, f AS legal_fluency, level AS taxonomy_level, CASE WHEN g IS NOT NULL THEN CASE WHEN g = 1 AND f = 1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS overall FROM s")
def eval_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "s.groundedness", "s.multimodal_alignment", "s.legal_fluency", "s.taxonomy_level", "s.overall")


PASS_SQL = "(g IS NOT NULL AND g >= 1 AND f >= 1 AND (NOT mm OR m >= 1))"


@query("judge_filter", f"WITH {SCORED_SQL} SELECT count(*) AS n, CAST(count(CASE WHEN {PASS_SQL} THEN 1 END) AS BIGINT) AS n_passed, round(count(CASE WHEN {PASS_SQL} THEN 1 END) / count(*)::DOUBLE, 6) AS pass_rate FROM s")
def judge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.count_if(I.passes_judge(F.col("s"), F.col("is_multimodal")))
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), passed.alias("n_passed"), F.round(passed / F.count("*"), 6).alias("pass_rate"))


@query("error_taxonomy", f"WITH {SCORED_SQL} SELECT CASE WHEN g < 1 THEN 'Legal Hallucination' WHEN m < 1 THEN 'Visual Misalignment' WHEN f < 1 THEN 'Logical Fallacy' ELSE 'Other' END AS category, count(*) AS n FROM s WHERE NOT {PASS_SQL} GROUP BY 1")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = scored(spark, sf_dir).where(~I.passes_judge(F.col("s"), F.col("is_multimodal")))
    return rejected.groupBy(I.error_category(F.col("s")).alias("category")).agg(F.count("*").alias("n"))


@query("taxonomy_counts", f"WITH {SCORED_SQL} SELECT CASE WHEN level IN ('Remember', 'Apply') THEN level ELSE 'Understand' END AS bloom, count(*) AS n, round(avg(g), 6) AS groundedness, round(avg(f), 6) AS fluency, round(avg(m), 6) AS alignment FROM s WHERE g IS NOT NULL GROUP BY 1")
def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("s.taxonomy_level").isin("Remember", "Apply"), F.col("s.taxonomy_level")).otherwise("Understand")
    means = [F.round(F.avg(f"s.{c}"), 6).alias(n) for c, n in (("groundedness", "groundedness"), ("legal_fluency", "fluency"), ("multimodal_alignment", "alignment"))]
    return scored(spark, sf_dir).where("s is not null").groupBy(level.alias("bloom")).agg(F.count("*").alias("n"), *means)


@query(
    "quality_triage",
    f"""WITH {ITEMS_SQL}, r AS (SELECT i.*, text FROM items i JOIN documents d ON d.doc_id = i.item_id),
    f AS (SELECT item_id, list_filter([CASE WHEN item_id % 5 = 4 THEN 'gt_unresolved' END, CASE WHEN item_id % 13 = 0 THEN 'candidate_count' END, CASE WHEN item_id % 6 = 0 THEN 'rationale_too_short' END,
      CASE WHEN length({strip_sql('text')}) < 80 THEN 'context_too_short' END, CASE WHEN item_id % 3 <> 0 OR item_id % 6 = 0 THEN 'missing_syllogism' END, CASE WHEN item_id % 4 = 0 THEN 'multimodal_no_visual' END], lambda x: x IS NOT NULL) AS codes FROM r)
    SELECT item_id, array_to_string(codes, ',') AS codes, CASE WHEN list_contains(codes, 'gt_unresolved') THEN 'regenerate' WHEN len(codes) > 0 THEN 'review' ELSE 'keep' END AS triage FROM f""",
)
def quality_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    k = F.col("item_id")
    options = F.when(k % 13 == 0, F.concat("candidate_answers", F.array(F.lit("D. NONE OF THESE")))).otherwise(F.col("candidate_answers"))
    rationale = F.when(k % 6 == 0, "short").when(k % 3 == 0, "Tiền đề: every nation lies in one region. Kết luận: so does this one.").otherwise("Every nation lies in one region, and so does this one, as all know.")
    rows = items(spark, sf_dir).join(docs, "item_id").withColumn("options", options).withColumn("rationale", rationale)
    flags = I.quality_flags(F.col("question"), F.col("options"), F.col("ground_truth"), F.col("rationale"), F.col("text"), k % 4 == 0, F.array().cast("array<string>"))
    return rows.withColumn("flags", flags).select("item_id", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("codes"), I.triage(F.col("flags")).alias("triage"))


@query(
    "qa_xml_parse",
    f"""WITH {ITEMS_SQL}, g AS (SELECT item_id % 50 AS batch, item_id, question, candidate_answers, ground_truth FROM items WHERE item_id % 7 <> 3)
    SELECT item_id, question, CAST(4 AS BIGINT) AS n_options, candidate_answers[2] AS second_option FROM g""",
)
def qa_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items rendered as question blocks, every seventh with a leaked prompt, and parsed back."""
    leak = F.when(F.col("item_id") % 7 == 3, " Bloom's Taxonomy").otherwise("")
    block = F.concat(F.lit("<qa_pair><question>"), "question", leak, F.lit("</question>\n<candidate_answers>\n"), F.array_join("candidate_answers", "\n"), F.lit("\n</candidate_answers><ground_truth>x</ground_truth><legal_rationale>y</legal_rationale></qa_pair> <qa_pair>incomplete</qa_pair>"))
    rows = items(spark, sf_dir).select("item_id", F.explode(M.parse_qa_pairs(block)).alias("p"))
    return rows.select("item_id", "p.question", F.size("p.candidate_answers").cast("bigint").alias("n_options"), F.element_at("p.candidate_answers", 2).alias("second_option"))


@query(
    "answer_letters",
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' b) because' WHEN 1 THEN 'I think the correct answer is C' WHEN 2 THEN 'because' WHEN 3 THEN repeat('x', 60) ELSE o_orderpriority END AS out FROM orders),
    t AS (SELECT o_orderkey, upper(trim(out)) AS t FROM o)
    SELECT o_orderkey, CASE WHEN regexp_extract(t, '^[ ]*([A-D])[\\s:.)]', 1) <> '' THEN regexp_extract(t, '^[ ]*([A-D])[\\s:.)]', 1) WHEN regexp_extract(t, 'CORRECT ANSWER IS[ ]*([A-D])', 1) <> '' THEN regexp_extract(t, 'CORRECT ANSWER IS[ ]*([A-D])', 1)
    WHEN length(t) < 50 AND regexp_matches(t, '[A-D]') THEN regexp_extract(t, '([A-D])', 1) ELSE 'N/A' END AS letter FROM t""",
)
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    out = F.when(k == 0, " b) because").when(k == 1, "I think the correct answer is C").when(k == 2, "because").when(k == 3, "x" * 60).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.answer_letter(out).alias("letter"))
