"""Queries of run inputs and ledgers: prompts, marks, manifests, plans, samples, provider runs, reviews and sinks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import ledger as L
from quillspark.operators import media as M
from quillspark.operators import prompts as P
from quillspark.operators import providers
from quillspark.operators import runs as R
from quillspark.plans.items import ITEMS_SQL, items
from quillspark.plans.registry import query
from quillspark.plans.reports import TRIALS_SQL, predictions, trials
from quillspark.sources import sinks, tables
from quillspark.sources.tables import table


@query("mcq_prompts", f"""WITH {ITEMS_SQL} SELECT item_id, sha256('### Context:' || chr(10) || question || ' context' || chr(10) || chr(10) || '### Question:' || chr(10) || question || chr(10) || chr(10) || '### Options:' || chr(10) || array_to_string(list_transform(range(4), lambda i: chr(CAST(65 + i AS INTEGER)) || '. ' || candidate_answers[i + 1]), chr(10)) || chr(10) || chr(10) || '### Answer with one letter (A, B, C or D):') AS prompt FROM items""")
def mcq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = P.mcq_prompt(F.col("question"), F.col("candidate_answers"), F.concat("question", F.lit("  context")), 2000)
    return items(spark, sf_dir).select("item_id", F.sha2(prompt, 256).alias("prompt"))


@query("generation_prompts", """SELECT doc_id, bloom_level, sha256('LEVEL: ' || bloom_level || chr(10) || 'CONTEXT:' || chr(10) || left(text, 2000) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'VISUALS:' || chr(10) || 'a map' || chr(10) || source ELSE '' END || chr(10) || 'State the major premise, the minor premise and the conclusion.' || chr(10) || 'Write question blocks as XML.') AS prompt
    FROM documents, (VALUES ('Remember'), ('Understand'), ('Apply')) b(bloom_level)""")
def generation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a map"), F.col("source"))).otherwise(F.array().cast("array<string>"))
    out = P.generation_prompts(table(spark, sf_dir, "documents").select("doc_id", "text", seen.alias("visual_descriptions")))
    return out.select("doc_id", "bloom_level", F.sha2("prompt", 256).alias("prompt"))


@query("judge_prompts", f"""WITH {ITEMS_SQL} SELECT item_id, sha256('CONTEXT:' || chr(10) || left(repeat(question, 60), 1500) || chr(10) || 'VISUALS:' || chr(10) || 'v1 | v2' || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || array_to_string(list_transform(range(4), lambda i: chr(CAST(65 + i AS INTEGER)) || '. ' || candidate_answers[i + 1]), chr(10)) || chr(10) || 'ANSWER:' || chr(10) || ground_truth) AS prompt FROM items""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = P.judge_prompt(F.repeat("question", F.lit(60)), F.array(F.lit("v1"), F.lit("v2")), F.col("question"), F.col("candidate_answers"), F.col("ground_truth"))
    return items(spark, sf_dir).select("item_id", F.sha2(prompt, 256).alias("prompt"))


@query("prompt_fields", "SELECT doc_id AS chunk_id, condition, 'evidence.text' || CASE WHEN condition <> 'T' THEN ',evidence.document_structure.section_title,evidence.document_structure.header_level,evidence.document_structure.declared_image_order' ELSE '' END || CASE WHEN condition = 'TLV' THEN ',evidence.images[pixels_attached]' ELSE '' END AS fields, condition <> 'T' AS shows_structure FROM documents, (VALUES ('T'), ('TL_struct'), ('TLV')) c(condition)")
def prompt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.col("source").alias("section_title"), F.lit(1).alias("header_level"), F.array(F.lit("a.png")).alias("images"))
    p = M.packages(chunks).withColumn("p", P.evidence_prompt(F.col("evidence"), F.lit("direct")))
    return p.select("chunk_id", "condition", F.array_join("p.fields", ",").alias("fields"), F.col("p.prompt").contains("STRUCTURE:").alias("shows_structure"))


@query("motif_catalog", "SELECT condition, count(*) AS n FROM (SELECT 'T' AS condition FROM range(5) UNION ALL SELECT 'TL_struct' FROM range(5) UNION ALL SELECT 'TLV' FROM range(2) UNION ALL SELECT NULL FROM range(7)) GROUP BY condition")
def motif_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.motif_catalog(spark).groupBy("condition").agg(F.count("*").alias("n"))


@query("judge_marks", """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'bad_score:depth' WHEN 2 THEN 'bad_score:faithfulness' WHEN 3 THEN 'json_not_object' WHEN 4 THEN 'invalid_json' END AS reason, CASE WHEN doc_id % 7 IN (0, 5, 6) THEN CASE WHEN doc_id % 7 = 5 THEN 1 ELSE quality + 3 END END::BIGINT AS faithfulness,
    CASE WHEN doc_id % 7 IN (0, 5, 6) THEN toxic = 0 END AS gold_supported, CASE WHEN doc_id % 7 IN (0, 5) THEN 'n' WHEN doc_id % 7 = 6 THEN 'a\\*b' END AS note FROM labels""")
def judge_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in fences, with stray backslashes, out of range, or no JSON at all."""
    k = F.col("doc_id") % 7
    first = F.when(k == 2, "7").when(k == 5, "true").otherwise((F.col("quality") + 3).cast("string"))
    body = F.concat(F.lit('{"faithfulness":'), first, F.lit(',"answerability":4,"distractor_quality":2,"depth":'), F.when(k == 1, '"3"').otherwise("3"), F.lit(',"gold_supported":'), F.when(F.col("toxic") == 0, "true").otherwise("false"), F.lit(',"note":"'), F.when(k == 6, "a\\*b").otherwise("n"), F.lit('"}'))
    raw = F.when(k == 3, F.lit("[1]")).when(k == 4, F.lit("no json {")).when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return P.judge_marks(table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw")), "raw").select("doc_id", "reason", "faithfulness", "gold_supported", "note")


@query("answer_indexes", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN doc_id % 4 END AS index, CASE doc_id % 6 WHEN 1 THEN 'answer_index_not_int' WHEN 2 THEN 'answer_index_not_int' WHEN 3 THEN 'answer_index_out_of_range' WHEN 4 THEN 'unparseable' WHEN 5 THEN 'json_not_object' END AS reason FROM documents")
def answer_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, F.concat(F.lit('{"answer_index": '), (F.col("doc_id") % 4).cast("string"), F.lit("}"))).when(k == 1, '{"answer_index": true}').when(k == 2, '{"answer_index": "1"}').when(k == 3, '{"answer_index": 4}').when(k == 4, "{").otherwise("[0]")
    return table(spark, sf_dir, "documents").select("doc_id", P.answer_index(raw, 4).alias("a")).select("doc_id", "a.index", "a.reason")


@query("escape_repair", "SELECT doc_id, 'a\\n b\\\\* c\\u0041 \\\\_' || source AS text, 2 AS repaired FROM documents")
def escape_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.escaped(F.concat(F.lit("a\\n b\\* c\\u0041 \\_"), "source"))
    return table(spark, sf_dir, "documents").select("doc_id", e["text"].alias("text"), e["repaired"].alias("repaired"))


# --- manifests, plans and samples --------------------------------------------------------------


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three packages a document, some with a planted fault by id."""
    i, c = F.col("doc_id") % 10, F.col("condition")
    condition = F.explode(F.array(*[F.lit(x) for x in ("T", "TL_struct", "TLV")])).alias("condition")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", condition)
    keys = F.when(c == "T", F.array(F.lit("text"))).when(c == "TL_struct", F.array(F.lit("text"), F.lit("document_structure"))).otherwise(F.array(F.lit("text"), F.lit("document_structure"), F.lit("images")))
    text = F.when(i == 1, " ").when(i == 2, "see ![](x)").when((i == 3) & (c == "TLV"), "other").otherwise(F.concat(F.lit("text "), "source"))
    declared = F.when(c != "T", F.when(i == 4, F.array(F.lit(2), F.lit(1))).when(i == 5, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
    out = rows.select(
        F.col("doc_id").alias("chunk_id"), "condition", F.when((i == 6) & (c == "T"), F.array(F.lit("text"), F.lit("images"))).otherwise(keys).alias("keys"), text.alias("text"),
        F.when(c != "T", F.concat("source", F.when((i == 7) & (c == "TLV"), "!").otherwise(""))).alias("structure"), declared.alias("declared"), F.when(c == "TLV", F.when(i == 8, 0).otherwise(2)).alias("images"),
    )
    return out.where("not (chunk_id % 10 = 9 and condition = 'TL_struct')")


@query("manifest_faults", """SELECT doc_id AS chunk_id, CASE doc_id % 10 WHEN 1 THEN 'invalid_text' WHEN 2 THEN 'unclean_text' WHEN 3 THEN 'unpaired_text' WHEN 4 THEN 'invalid_structure' WHEN 5 THEN 'invalid_declared_image_order' WHEN 6 THEN 'invalid_T_evidence' WHEN 7 THEN 'unpaired_structure' WHEN 8 THEN 'missing_tlv_images' ELSE 'incomplete_chunk_x_condition' END AS fault FROM documents WHERE doc_id % 10 > 0
    UNION ALL SELECT NULL, 'unexpected_manifest'""")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manifest_faults(manifest(spark, sf_dir), expected=24)


@query("evidence_index", "SELECT doc_id AS chunk_id, condition, sha256(doc_id || '|' || condition || '|' || 'text ' || source) AS evidence_sha256 FROM documents, (VALUES ('T'), ('TL_struct'), ('TLV')) c(condition) WHERE doc_id % 10 = 0")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence_index(manifest(spark, sf_dir).where("chunk_id % 10 = 0")).select("chunk_id", "condition", "evidence_sha256")


@query("image_integrity", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'BLOCKED_INPUT_INTEGRITY:image' END AS fault FROM documents")
def image_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, content = F.col("doc_id") % 3, F.encode("source", "UTF-8")
    fault = R.image_fault(content, F.octet_length(content) + F.when(k == 1, 1).otherwise(0), F.when(k == 2, "0").otherwise(F.sha2(content, 256)))
    return table(spark, sf_dir, "documents").select("doc_id", fault.alias("fault"))


def _places(n: int, seed: int) -> list[int]:
    places = list(range(n))
    random.Random(seed).shuffle(places)
    return places


@query("plan_order", f"SELECT place, run_order FROM (SELECT unnest({_places(72, 20260824)})::BIGINT AS place, unnest(range(1, 73))::INTEGER AS run_order)")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plan_order(spark, 72, 20260824)


@query("judge_order")
def judge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded option orders of items; SQL has no such random stream."""
    seed = F.concat_ws("|", F.col("item_id").cast("string"), F.lit("direct"), F.lit("T"), F.lit("7"))
    return items(spark, sf_dir).select("item_id", R.stable_order(seed, F.size("candidate_answers")).alias("order"))


@query("length_batches", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) % 16 AS place, doc_id % 3 AS worker FROM documents")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.batches_by_length(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 16)
    return R.dealt(rows, "doc_id", 3).select("doc_id", "batch", "place", "worker")


@query("length_balanced", f"""WITH {ITEMS_SQL}, r AS (SELECT item_id, len(list_filter(candidate_answers, lambda o: length(o) < length(candidate_answers[gold + 1]))) AS r FROM items), k AS (SELECT item_id, r, row_number() OVER (PARTITION BY r ORDER BY sha256(CAST(item_id AS VARCHAR))) AS k, min(c) OVER () AS least FROM (SELECT *, count(*) OVER (PARTITION BY r) AS c FROM r))
    SELECT item_id, CAST(r AS INTEGER) AS length_rank FROM k WHERE k <= least""")
def length_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.length_balanced(items(spark, sf_dir), "candidate_answers", "gold", "item_id").select("item_id", "length_rank")


@query("head_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 in order: the feature itself."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(25)


# --- providers ---------------------------------------------------------------------------------


def echo(texts: list[str]) -> list:
    """A stand-in for a model: refuses some prompts, breaks on some, and answers with JSON of the prompt's length."""
    out: list = []
    for t in texts:
        out.append(providers.CallError("http_400", 400) if "qq" in t else "cut {" if t.endswith("x") else '{"answer_index": %d}' % (len(t) % 5))
    return out


@query("provider_run", """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'qq' WHEN 1 THEN 'ends x' ELSE repeat('a', CAST(doc_id % 7 + 1 AS BIGINT)) END AS prompt FROM documents WHERE doc_id % 9 > 0), r AS (SELECT *, CASE WHEN contains(prompt, 'qq') THEN 'ERROR' WHEN prompt LIKE '%x' OR length(prompt) % 5 = 4 THEN 'REJECTED' ELSE 'PARSED' END AS status FROM p)
    SELECT doc_id, status, CASE WHEN status = 'ERROR' THEN 'http_400' WHEN prompt LIKE '%x' THEN 'unparseable' WHEN status = 'REJECTED' THEN 'answer_index_out_of_range' END AS reason, 0 AS retry_count FROM r UNION ALL SELECT doc_id, 'REJECTED', 'unparseable', 0 FROM documents WHERE doc_id % 9 = 0""")
def provider_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger by a stand-in provider; null prompts are not called."""
    k, i = F.col("doc_id") % 4, F.col("doc_id")
    prompt = F.when(i % 9 > 0, F.when(k == 0, "qq").when(k == 1, "ends x").otherwise(F.repeat(F.lit("a"), (i % 7 + 1).cast("int"))))
    plan = table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))
    done = providers.executed(plan, "prompt", echo, lambda raw: P.answer_index(F.coalesce(raw, F.lit("")), 4)["reason"], pause=0.0)
    return done.select("doc_id", "status", "reason", F.col("retry_count").cast("int").alias("retry_count"))


@query("provider_two_stages", """WITH p AS (SELECT doc_id, doc_id % 7 + 1 AS n FROM documents), r AS (SELECT *, n % 5 AS a FROM p) SELECT doc_id, CASE WHEN a = 4 THEN 'REJECTED' ELSE 'PARSED' END AS status, CASE WHEN a = 4 THEN 'stage1:answer_index_out_of_range' END AS reason FROM r""")
def provider_two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "documents").select("doc_id", F.repeat(F.lit("a"), (F.col("doc_id") % 7 + 1).cast("int")).alias("prompt"))
    fault = lambda raw: P.answer_index(F.coalesce(raw, F.lit("")), 4)["reason"]
    return providers.two_stages(plan, "prompt", echo, fault, lambda raw: F.lit("aaa"), fault, pause=0.0).select("doc_id", "status", "reason")


@query("dry_run", "SELECT method, count(*) * 3 AS n_rows, CAST(count(*) * 3 * CASE WHEN method = 'ecm' THEN 2 ELSE 1 END AS BIGINT) AS n_calls FROM documents, (VALUES ('direct'), ('answer_first'), ('ecm')) m(method) GROUP BY method")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.dry_run(L.plan(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "exp-1"))


@query("endpoint_guard", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'BLOCKED_ROLE_ENDPOINT:got=http://other/' || source END AS fault FROM documents")
def endpoint_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(F.col("doc_id") % 2 == 1, "http://other/").otherwise("https://models.example/"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", providers.endpoint_fault(url, "https://models.example/").alias("fault"))


# --- joins and reports -------------------------------------------------------------------------


@query("orphans", "SELECT source, count(*) AS n, source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0) AS kept FROM documents GROUP BY source")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source")
    stems = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit(" "), "source").alias("stem"))
    kept, gone = R.pruned(docs, stems, "source")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))).groupBy("source", "kept").agg(F.count("*").alias("n")).select("source", "n", "kept")


@query("reviewed_assets", """WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'keep_pdf_for_render' WHEN 1 THEN 'drop_small' ELSE 'review' END AS label FROM documents), r AS (SELECT doc_id, CASE WHEN label LIKE 'keep%' THEN 'KEEP' WHEN label LIKE 'drop%' THEN 'DROP' WHEN doc_id % 6 = 2 THEN 'KEEP' ELSE 'REVIEW' END AS review_decision, CASE WHEN label LIKE 'keep%' THEN 'official_pdf_for_render_and_text_extraction' WHEN label LIKE 'drop%' OR doc_id % 6 <> 2 THEN 'short' ELSE 'seen' END AS review_reason FROM s)
    SELECT *, review_decision = 'KEEP' AND doc_id % 5 > 0 AS exported FROM r""")
def reviewed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    name = F.concat(F.lit("f"), i.cast("string"))
    label = F.when(i % 4 == 0, "keep_pdf_for_render").when(i % 4 == 1, "drop_small").otherwise("review")
    out = R.reviewed(docs.select("doc_id", name.alias("filename"), label.alias("shortlist_label"), F.lit("short").alias("shortlist_reason")), docs.where("doc_id % 6 = 2").select(name.alias("asset_path"), F.lit("KEEP").alias("decision"), F.lit("seen").alias("reason")))
    files = docs.where("doc_id % 5 > 0").select(name.alias("path"))
    there = sinks.kept_assets(out, files).select("filename", F.lit(True).alias("exported"))
    return out.join(there, "filename", "left").select("doc_id", "review_decision", "review_reason", F.coalesce("exported", F.lit(False)).alias("exported"))


@query("accepted_items", "SELECT doc_id, toxic FROM labels WHERE quality = 1 AND toxic = 0")
def accepted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    print_ = R.fingerprint(F.col("doc_id").cast("string"), F.lit("choices"))
    verdicts = labels.select(print_.alias("fingerprint"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "VISUAL_DEPENDENT").otherwise("TEXT_SUFFICIENT").alias("verdict"))
    return R.accepted_items(verdicts, labels.select(print_.alias("fingerprint"), "doc_id", "toxic")).select("doc_id", "toxic")


@query("judged_packages", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'REJECTED' ELSE 'PARSED' END AS status, CASE WHEN l.doc_id IS NULL THEN 'package_missing' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def judged_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("PARSED").alias("status"), F.lit(None).cast("string").alias("reason"))
    return R.with_packages(rows, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"]).select("doc_id", "status", "reason")


@query("retry_sets", "WITH l AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'HTTP_ERR' WHEN 1 THEN 'PARSE_ERR' ELSE event_type END AS label, 'p' || event_id || '.png' AS name FROM events) SELECT (SELECT count(*) FROM l WHERE label NOT LIKE '%ERR') AS kept, (SELECT count(*) FROM l WHERE label LIKE '%ERR' AND event_id % 3 > 0) AS staged, (SELECT count(*) FROM l WHERE label LIKE '%ERR' AND event_id % 3 = 0) AS missing")
def retry_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, events = F.col("event_id"), table(spark, sf_dir, "events")
    name = F.concat(F.lit("p"), i.cast("string"), F.lit(".png"))
    ledger = events.select(F.concat(F.lit("old/"), name).alias("file"), F.when(i % 10 == 0, "HTTP_ERR").when(i % 10 == 1, "PARSE_ERR").otherwise(F.col("event_type")).alias("label"))
    kept, staged, missing = R.retries(ledger, events.where("event_id % 3 > 0").select(F.concat(F.lit("new/"), name).alias("path")))
    one = lambda df, c: df.agg(F.count("*").alias(c))
    return one(kept, "kept").join(one(staged, "staged"), F.lit(True)).join(one(missing, "missing"), F.lit(True))


@query("rejected_rows", "SELECT doc_id, quality, toxic FROM labels WHERE NOT (doc_id % 3 = 0 AND toxic = 0)")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    passed = labels.where("doc_id % 3 = 0").withColumn("toxic", F.lit(0))  # rows that were changed on the way count as rejected
    return R.rejected(labels, passed, "doc_id")


@query("label_counts", "SELECT event_type AS label, user_id % 5 AS book, count(*) AS n FROM events GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by book, the part of a file name before two underscores."""
    name = F.concat((F.col("user_id") % 5).cast("string"), F.lit("__p"), F.col("event_id").cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.substring_index(name, "__", 1).cast("bigint").alias("book"))
    return rows.groupBy("label", "book").agg(F.count("*").alias("n"))


@query("action_report", "SELECT action, severity, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'DISCARD' WHEN event_id % 6 >= 4 AND event_id % 2 = 0 THEN 'KEEP_AS_IS' WHEN event_id % 6 <= 2 THEN 'REVIEW' ELSE 'given' END AS action, CASE WHEN event_id % 5 = 0 THEN 'high' WHEN event_id % 6 >= 4 AND event_id % 2 = 0 THEN 'none' WHEN event_id % 6 <= 2 THEN 'medium' ELSE 'low' END AS severity FROM events) GROUP BY ALL")
def action_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = M.gap_triage(F.when(i % 2 == 0, "table").otherwise("figure"), F.when(i % 5 == 0, "a Rasterized page").otherwise("r"), (i % 6).cast("int"), F.lit("given"))
    return table(spark, sf_dir, "events").select(t["action"].alias("action"), t["severity"].alias("severity")).groupBy("action", "severity").agg(F.count("*").alias("n"))


@query("high_severity", "SELECT event_id FROM events WHERE event_id % 5 = 0 ORDER BY event_id LIMIT 30")
def high_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty of high severity: a report with a limit."""
    i = F.col("event_id")
    t = M.gap_triage(F.lit("figure"), F.when(i % 5 == 0, "text-page").otherwise("r"), F.lit(3), F.lit("given"))
    return table(spark, sf_dir, "events").where(t["severity"] == "high").select("event_id").orderBy("event_id").limit(30)


@query("pipeline_state", "SELECT 'raw_pairs_empty,filtered_missing' AS warnings, '' AS issues, 1 AS exit_code")
def pipeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = lambda name, df: df.agg(F.lit(name).alias("artifact"), F.count("*").alias("n"))
    counts = n("contexts", docs).unionByName(n("raw_pairs", docs.where("false"))).unionByName(n("pair_chunks", docs)).unionByName(n("dataset", docs))
    return R.pipeline_state(counts, strict=True)


@query("vd_accuracy", f"WITH {TRIALS_SQL}, a AS (SELECT item, with_image, avg(CASE WHEN is_correct THEN 1.0 WHEN NOT is_correct THEN 0.0 END) AS acc FROM t SEMI JOIN d USING (item) GROUP BY ALL) SELECT (SELECT count(*) FROM d) AS n_tested, round((SELECT avg(acc) FROM a WHERE with_image), 4) AS mean_with, round((SELECT avg(acc) FROM a WHERE NOT with_image), 4) AS mean_without, 0.25::DOUBLE AS chance")
def vd_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of the items in each arm, and chance."""
    rows = trials(spark, sf_dir)
    tested = L.verdicts(rows).select("item")
    arms = rows.join(tested, "item", "left_semi").groupBy("item", "with_image").agg(F.avg(F.col("is_correct").cast("int")).alias("acc"))
    mean = lambda when: F.round(F.avg(F.when(when, F.col("acc"))), 4)
    return arms.agg(F.count_distinct("item").alias("n_tested"), mean(F.col("with_image")).alias("mean_with"), mean(~F.col("with_image")).alias("mean_without"), F.lit(0.25).alias("chance"))


@query("bench_status", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ctx' ELSE 'noctx' END AS mode, round(count(CASE WHEN o_orderkey % 29 <> 0 THEN 1 END) / count(*)::DOUBLE, 6) AS answered_rate, round(count(CASE WHEN o_orderkey % 29 = 0 THEN 1 END) / count(*)::DOUBLE, 6) AS empty_rate, CASE WHEN count(CASE WHEN o_orderkey % 29 = 0 THEN 1 END) / count(*)::DOUBLE < 0.1 THEN 'valid' ELSE 'invalid' END AS status FROM orders GROUP BY 1")
def bench_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run may be interpreted: fewer than a tenth of its outputs empty."""
    empty = F.count_if("empty_raw_output") / F.count("*")
    answered = F.count_if(F.col("pred_letter").isin("A", "B", "C", "D")) / F.count("*")
    return predictions(spark, sf_dir).groupBy("mode").agg(F.round(answered, 6).alias("answered_rate"), F.round(empty, 6).alias("empty_rate"), F.when(empty < 0.1, "valid").otherwise("invalid").alias("status"))


# --- sinks and sources -------------------------------------------------------------------------


@query("split_files", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines by split, and read back."""
    path = sinks.scratch(spark, "splits")
    sinks.split_lines(table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("train").alias("split")), path)
    return spark.read.schema("doc_id bigint, n_chars bigint, split string").json(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("image_dataset", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'images/a/' || doc_id || '.png' ELSE 'images/_placeholder.png' END AS file_name, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, source AS text FROM documents")
def image_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    visuals = F.when(i % 2 == 0, F.array(F.concat(F.when(i % 4 == 0, "/content/data/").otherwise("data/"), F.lit("a/"), i.cast("string"), F.lit(".png"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 == 0, "dev").otherwise("train").alias("split"), visuals.alias("visuals"), F.struct(F.col("source").alias("text"), F.array(F.lit("x")).cast("array<string>").alias("visuals")).alias("context_payload"))
    rows = rows.withColumn("context_payload", F.col("context_payload").withField("visuals", F.array().cast("array<string>")))
    return sinks.image_dataset(rows, ("/content/data/", "data/")).select("doc_id", "file_name", "split", "context_payload.text")


@query("file_sources", "SELECT 'lines' AS source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents UNION ALL SELECT 'csv', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'numbers', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id % 4 = 0")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank lines and lists among them, CSV, and the numbers of a text column, written and read back."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id"), sinks.scratch(spark, "files")
    docs.select(F.to_json(F.struct("doc_id")).alias("value")).unionByName(spark.range(3).select(F.element_at(F.array(F.lit(""), F.lit("[1]"), F.lit("  ")), (F.col("id") + 1).cast("int")).alias("value"))).write.text(f"{path}/lines")
    docs.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("no "), F.col("doc_id").cast("string"))).alias("value"), "doc_id").write.option("header", True).csv(f"{path}/csv")
    lines, rows = tables.json_lines(spark, f"{path}/lines", "doc_id bigint"), tables.csv(spark, f"{path}/csv")
    total = lambda name, df, c: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum(F.col(c).cast("bigint")).alias("total"))
    return total("lines", lines, "doc_id").unionByName(total("csv", rows, "doc_id")).unionByName(total("numbers", tables.numbers(rows, "value"), "value"))


@query("text_sources", "SELECT 'd' || doc_id AS doc_id, sha256(replace(text, chr(13), '')) AS text_sha256 FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL")
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text files, found by folder and suffix; the files are written for every 20th document."""
    path = sinks.scratch(spark, "texts")
    some = table(spark, sf_dir, "documents").where("doc_id % 20 = 0 and text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.regexp_replace("text", "\r", "").alias("text"))
    some.write.partitionBy("name").text(path)
    found = tables.texts(spark, path, ".txt")
    return found.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("doc_id"), F.sha2(F.substring("text", F.lit(1), F.length("text") - 1), 256).alias("text_sha256"))
