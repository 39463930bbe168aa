"""Queries of resumed work, pairing, coverage ends, release filters, stamps and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import assets as A
from quillspark.operators import items as I
from quillspark.operators import ledger as L
from quillspark.operators import media as M
from quillspark.operators import provenance as P
from quillspark.plans.items import ITEMS_SQL, items
from quillspark.plans.registry import query
from quillspark.plans.release import RECORDS_SQL, records
from quillspark.plans.reports import SPLIT_SQL, split_of
from quillspark.sources.tables import table


@query("resumed_work", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'made' ELSE 'kept' END AS origin, CASE WHEN l.doc_id IS NULL THEN -1 ELSE quality END AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.doc_id % 2 = 0")
def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of even ids are there, one of them for a document that isn't asked for; the others are made."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    done = table(spark, sf_dir, "labels").where("doc_id % 2 = 0").select("doc_id", F.lit("kept").alias("origin"), F.col("quality").cast("int").alias("quality"))
    done = done.unionByName(spark.range(1).select(F.lit(-5).cast("bigint").alias("doc_id"), F.lit("kept").alias("origin"), F.lit(0).alias("quality")))
    return L.resumed(docs, done, "doc_id", lambda rows: rows.select("doc_id", F.lit("made").alias("origin"), F.lit(-1).alias("quality")))


@query("pairing_faults", "WITH t AS (SELECT user_id AS item, event_id % 2 = 0 AS arm, CASE WHEN user_id % 9 = 0 THEN TRUE ELSE event_id % 2 = 0 END AS attached FROM events WHERE NOT (user_id % 7 = 0 AND event_id % 2 = 1)), g AS (SELECT item, count(DISTINCT arm) AS arms, bool_and(arm = attached) AS sound FROM t GROUP BY item) SELECT item, CASE WHEN arms < 2 THEN 'missing_arm' ELSE 'image_not_as_arm_says' END AS fault FROM g WHERE arms < 2 OR NOT sound")
def pairing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, item = F.col("event_id") % 2 == 0, F.col("user_id")
    trials = table(spark, sf_dir, "events").where(~((item % 7 == 0) & ~even)).select(item.alias("item"), even.alias("arm"), F.when(item % 9 == 0, True).otherwise(even).alias("attached"))
    return L.pairing_faults(trials, "item", "arm", "attached")


@query("last_reports", "SELECT o_orderpriority AS model, o_orderstatus AS split, arg_max(o_totalprice, o_orderkey) AS accuracy FROM orders GROUP BY ALL")
def last_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("accuracy"))
    return L.last_reports(rows, ["model", "split"], "position")


@query("coverage_ends", "WITH c AS (SELECT source, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY coverage, source) AS lo, row_number() OVER (ORDER BY coverage DESC, source) AS hi FROM c) SELECT source, coverage, 'lowest' AS \"end\" FROM r WHERE lo <= 15 UNION ALL SELECT source, coverage, 'highest' FROM r WHERE hi <= 15")
def coverage_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen lowest and highest: a report with a limit."""
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("done"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left")
    return L.extremes(rows.groupBy("source").agg(F.round(F.count("done") / F.count("*"), 6).alias("coverage")), "coverage", "source")


@query("split_bloom", f"WITH {RECORDS_SQL} SELECT CASE WHEN split = '' THEN 'unknown' ELSE split END AS split, CAST(count(CASE WHEN bloom_level = 'Remember' THEN 1 END) AS BIGINT) AS remember, CAST(count(CASE WHEN bloom_level = 'Understand' THEN 1 END) AS BIGINT) AS understand, CAST(count(CASE WHEN bloom_level = 'Apply' THEN 1 END) AS BIGINT) AS apply, round(avg(CASE WHEN is_multimodal THEN 1.0 ELSE 0 END), 6) AS multimodal_ratio FROM rec GROUP BY 1")
def split_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stacked figure of splits by level shows."""
    level = lambda b: F.count_if(F.col("bloom_level") == b)
    rows = records(spark, sf_dir).withColumn("split", F.when(F.col("split") == "", "unknown").otherwise(F.col("split")))
    return rows.groupBy("split").agg(level("Remember").alias("remember"), level("Understand").alias("understand"), level("Apply").alias("apply"), F.round(F.avg(F.col("is_multimodal").cast("int")), 6).alias("multimodal_ratio"))


@query("release_filter", f"""WITH {ITEMS_SQL}, r AS (SELECT item_id, {SPLIT_SQL.replace('doc_id', 'item_id')} AS split, CASE item_id % 5 WHEN 1 THEN 'cjk_chars' WHEN 2 THEN 'english_meta' END AS reason, item_id % 5 = 3 OR item_id % 5 = 1 AND FALSE OR ground_truth <> trim(ground_truth) OR contains(ground_truth, '(full correct') AS changed FROM items)
    SELECT split, mark, count(*) AS n FROM (SELECT split, CASE WHEN reason IS NULL THEN 'kept' ELSE 'removed' END AS mark FROM r UNION ALL SELECT split, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT split, 'changed' FROM r WHERE changed) GROUP BY ALL""")
def release_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id") % 5
    rows = items(spark, sf_dir).withColumns({"split": split_of("item_id"), "legal_rationale": F.when(k == 1, "根据 text").when(k == 2, "It is so because of it").when(k == 3, "two  blanks").otherwise("fine")})
    return I.release_filter(rows, "item_id")[1]


@query("release_filter_examples", f"WITH {ITEMS_SQL} SELECT item_id, CASE item_id % 5 WHEN 1 THEN 'cjk_chars' ELSE 'english_meta' END AS reasons FROM items WHERE item_id % 5 IN (1, 2) ORDER BY item_id LIMIT 25")
def release_filter_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 that went: a report with a limit."""
    k = F.col("item_id") % 5
    rows = items(spark, sf_dir).withColumns({"split": F.lit("s"), "legal_rationale": F.when(k == 1, "根据 text").when(k == 2, "It is so because of it").otherwise("fine")})
    return I.release_filter(rows, "item_id")[2].select("item_id", F.array_join("reasons", ",").alias("reasons"))


@query("provenance_reasons", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'no_provenance' WHEN 2 THEN 'content_hash_mismatch' WHEN 3 THEN 'context_hash_mismatch' ELSE '' END AS reasons FROM documents")
def provenance_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped records, of which some lose their stamp or are changed."""
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question_content"), F.array("lang").alias("candidate_answers"), F.col("lang").alias("ground_truth"), F.lit("r").alias("legal_rationale"), F.col("text").alias("context_text"))
    made = P.stamp(rows, "run-1")
    made = made.withColumns({"ground_truth": F.when(k == 2, "changed").otherwise(F.col("ground_truth")), "context_text": F.when(k == 3, "changed").otherwise(F.col("context_text")), "_provenance": F.when(k != 1, F.col("_provenance"))})
    return P.reasons(P.verify(made)).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("asset_kinds", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'image' ELSE 'page' END AS kind, page_id % 5 = 1 AND page_id % 2 = 0 AS is_pdf FROM pages")
def asset_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by ending or type, and downloads that are PDFs of 50,000 bytes or more."""
    i = F.col("page_id")
    url = F.concat(F.lit("http://a.example/x"), F.when(i % 5 == 0, ".PDF?v=1").when(i % 5 == 2, ".jpeg#top").otherwise(""))
    given = F.when(i % 5 == 1, "application/pdf").when(i % 5 == 3, "image/png")
    content = F.encode(F.repeat(F.lit("a"), F.when(i % 2 == 0, 50_000).otherwise(100)), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", A.kind(url, given).alias("kind"), F.coalesce(M.is_pdf(content, given), F.lit(False)).alias("is_pdf"))


@query("file_names", "SELECT page_id, 'a_b.pdf_' || substr(sha256('http://x.example/p/a%20b.pdf?q=' || page_id), 1, 10) AS file_slug, 'luat-' || page_id || '-abc' AS query_slug FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    url = F.concat(F.lit("http://x.example/p/a%20b.pdf?q="), i)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(T.file_slug(url), "^a_20b", "a_b").alias("file_slug"), T.query_slug(F.concat(F.lit(" Luat  "), i, F.lit(" / ABC!"))).alias("query_slug"))


@query("quality_stamps", f"WITH {RECORDS_SQL}, x AS (SELECT CASE WHEN method <> 'unresolved' AND gold < len(candidate_answers) THEN 'review' ELSE 'regenerate' END AS triage FROM rec) SELECT triage, count(*) AS n FROM x GROUP BY 1")
def quality_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.resolved(records(spark, sf_dir))
    flags = I.quality_flags(F.col("question_content"), F.col("candidate_answers"), F.col("ground_truth"), F.lit("so"), F.col("context_text"), F.col("is_multimodal"), F.array().cast("array<string>"), method=F.col("method"))
    return I.stamped(rows, flags).groupBy("_quality.triage").agg(F.count("*").alias("n"))
