"""Queries over splits, ledgers, benchmark scores, ablation trials and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import squeeze
from quillspark.operators import ledger as L
from quillspark.plans.documents import squeeze_sql
from quillspark.plans.registry import query
from quillspark.sources.tables import table

SPLIT_SQL = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END"


def split_of(c: str) -> F.Column:
    return F.when(F.col(c) % 10 < 8, "train").when(F.col(c) % 10 == 8, "dev").otherwise("test")


@query("split_summary", f"SELECT {SPLIT_SQL} AS split, count(*) AS n_contexts, CAST(count(DISTINCT source) AS BIGINT) AS n_docs, CAST(count(CASE WHEN toxic = 1 THEN 1 END) AS BIGINT) AS n_flagged, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS context_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    per = rows.groupBy(split_of("doc_id").alias("split"), "source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("f"))
    out = per.groupBy("split").agg(F.sum("n").alias("n_contexts"), F.count("*").alias("n_docs"), F.sum("f").alias("n_flagged"))
    total = table(spark, sf_dir, "documents").count()
    return out.withColumn("context_ratio", F.round(F.col("n_contexts") / F.lit(total), 6))


@query("split_leakage", f"SELECT source, CAST(count(DISTINCT {SPLIT_SQL}) AS BIGINT) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT {SPLIT_SQL}) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("source", split_of("doc_id").alias("split")).count()
    return per.groupBy("source").agg(F.count("*").alias("n_splits")).where("n_splits > 1")


@query("doc_split_manifest")
def doc_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak-free split by source; greedy over the sources' sizes, which are few, on the driver."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.lit(False).alias("is_multimodal"))
    return L.document_splits(rows, "doc", "is_multimodal", seed=42)


@query(
    "gates_a_d",
    f"""SELECT (SELECT count(*) FROM documents) AS n_expected, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS n_covered, (SELECT CAST(count(CASE WHEN length({squeeze_sql('text')}) >= 100 THEN 1 END) AS BIGINT) FROM documents) AS n_valid,
    (SELECT CAST(count(*) - count(DISTINCT sha256(text)) AS BIGINT) FROM documents) AS n_duplicates, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS n_unknown""",
)
def gates_a_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(1))
    both = docs.select("doc_id", F.length(squeeze("text")).alias("n"), F.sha2("text", 256).alias("k")).withColumn("d", F.lit(1)).join(labels, "doc_id", "full")
    flags = both.groupBy("k", F.col("d").isNull().alias("unknown")).agg(F.count("d").alias("n"), F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("c"), F.count_if(F.col("n") >= 100).alias("v"), F.count_if(F.col("d").isNull()).alias("u"))
    return flags.agg(F.sum("n").alias("n_expected"), F.sum("c").alias("n_covered"), F.sum("v").alias("n_valid"), F.sum(F.when(~F.col("unknown"), F.col("n") - 1).otherwise(0)).alias("n_duplicates"), F.sum("u").alias("n_unknown"))


@query("coverage_audit", "SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_done, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("done"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("done").alias("n_done"), F.round(F.count("done") / F.count("*"), 6).alias("coverage"))


@query("missing_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("resume_antijoin", "SELECT source, count(*) AS n_todo FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = L.unfinished(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")
    return todo.groupBy("source").agg(F.count("*").alias("n_todo"))


@query(
    "plan_matrix",
    """SELECT doc_id, condition, method, substr(sha256('exp-1|' || sha256(CAST(doc_id AS VARCHAR) || '|' || condition || '|' || method)), 1, 24) AS run_id
    FROM documents, (VALUES ('T'), ('TL_struct'), ('TLV')) c(condition), (VALUES ('direct'), ('answer_first'), ('ecm')) m(method)""",
)
def plan_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under each condition and method: an explode of two literals, no join."""
    return L.plan(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "exp-1")


EVENT_STATUS = "CASE event_type WHEN 'view' THEN 'PARSED' WHEN 'click' THEN 'REJECTED' WHEN 'signup' THEN 'ABSTAINED' WHEN 'purchase' THEN 'PARSED' ELSE 'ERROR' END"
REASON_SQL = "CASE WHEN event_type IN ('click', 'error') THEN event_type || ':code' || CAST(event_id % 3 AS VARCHAR) || ':detail' || CAST(event_id % 7 AS VARCHAR) END"


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t.isin("view", "purchase"), "PARSED").when(t == "click", "REJECTED").when(t == "signup", "ABSTAINED").otherwise("ERROR")
    reason = F.when(t.isin("click", "error"), F.concat(t, F.lit(":code"), (F.col("event_id") % 3).cast("string"), F.lit(":detail"), (F.col("event_id") % 7).cast("string")))
    method = F.when(F.col("user_id") % 2 == 0, "ecm").otherwise("direct")
    return table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), reason.alias("reason"), method.alias("method"), "ts")


@query("ledger_status", f"SELECT {EVENT_STATUS} AS status, count(*) AS n, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS api_calls FROM events GROUP BY 1")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_summary(event_ledger(spark, sf_dir))


@query("reason_families", f"WITH r AS (SELECT {REASON_SQL} AS reason FROM events) SELECT string_split(reason, ':')[1] || ':' || string_split(reason, ':')[2] AS family, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def reason_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reason_families(event_ledger(spark, sf_dir))


TRIALS_SQL = """t AS (SELECT user_id AS item, event_id % 2 = 0 AS with_image, CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('view', 'purchase') END AS is_correct FROM events),
g AS (SELECT item, with_image, count(is_correct) AS votes, count(CASE WHEN is_correct THEN 1 END) AS yes, count(*) AS n FROM t GROUP BY 1, 2),
v AS (SELECT item, max(CASE WHEN with_image THEN CASE WHEN yes * 2 > votes THEN 1 WHEN (votes - yes) * 2 > votes THEN 0 END END) AS cw, max(CASE WHEN NOT with_image THEN CASE WHEN yes * 2 > votes THEN 1 WHEN (votes - yes) * 2 > votes THEN 0 END END) AS co, count(*) AS arms FROM g GROUP BY item),
d AS (SELECT item, CASE WHEN cw IS NULL OR co IS NULL THEN 'indeterminate' WHEN cw = 0 THEN 'unanswerable' WHEN co = 1 THEN 'text_sufficient' ELSE 'visually_dependent' END AS verdict FROM v WHERE arms = 2)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    correct = F.when(F.col("event_type") != "error", F.col("event_type").isin("view", "purchase"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), (F.col("event_id") % 2 == 0).alias("with_image"), correct.alias("is_correct"))


@query("vd_verdicts", f"WITH {TRIALS_SQL} SELECT item, verdict FROM d")
def vd_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.verdicts(trials(spark, sf_dir))


@query("vd_rate", f"WITH {TRIALS_SQL} SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 4) AS rate FROM d GROUP BY verdict")
def vd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.verdicts(trials(spark, sf_dir))
    n = v.count()
    return v.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(n), 4).alias("rate"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions derived from orders: gold by customer, answer by order, empty outputs for some."""
    o = table(spark, sf_dir, "orders")
    empty = F.col("o_orderkey") % 29 == 0
    return o.select(
        F.col("o_orderkey").alias("qa_id"), F.col("o_orderpriority").alias("bloom"), (F.col("o_custkey") % 3 == 0).alias("is_multimodal"), F.char(F.col("o_custkey") % 4 + 65).alias("gt_letter"),
        F.when(empty, "N/A").otherwise(F.char(F.col("o_orderkey") % 4 + 65)).alias("pred_letter"), empty.alias("empty_raw_output"), F.when(F.col("o_orderkey") % 2 == 0, "ctx").otherwise("noctx").alias("mode"),
    )


PRED_SQL = "p AS (SELECT o_orderkey AS qa_id, o_orderpriority AS bloom, o_custkey % 3 = 0 AS is_multimodal, o_orderkey % 29 = 0 AS e, o_orderkey % 29 <> 0 AND o_custkey % 4 = o_orderkey % 4 AS ok, CASE WHEN o_orderkey % 2 = 0 THEN 'ctx' ELSE 'noctx' END AS mode FROM orders)"


@query("bench_score", f"WITH {PRED_SQL} SELECT bloom, is_multimodal, count(*) AS n, CAST(count(CASE WHEN ok THEN 1 END) AS BIGINT) AS n_correct, CAST(count(CASE WHEN e THEN 1 END) AS BIGINT) AS n_empty, round(count(CASE WHEN ok THEN 1 END) / count(*)::DOUBLE, 6) AS accuracy FROM p GROUP BY GROUPING SETS ((), (bloom), (is_multimodal))")
def bench_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.benchmark_scores(predictions(spark, sf_dir))


@query("bench_pivot", f"WITH {PRED_SQL} SELECT bloom, round(avg(CASE WHEN mode = 'ctx' THEN CAST(ok AS INTEGER) END), 6) AS ctx, round(avg(CASE WHEN mode = 'noctx' THEN CAST(ok AS INTEGER) END), 6) AS noctx, round(avg(CASE WHEN mode = 'ctx' THEN CAST(ok AS INTEGER) END) - avg(CASE WHEN mode = 'noctx' THEN CAST(ok AS INTEGER) END), 6) AS delta FROM p GROUP BY bloom")
def bench_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("pred_letter") == F.col("gt_letter")).cast("int")
    wide = predictions(spark, sf_dir).groupBy("bloom").pivot("mode", ["ctx", "noctx"]).agg(F.avg(ok))
    return wide.select("bloom", F.round("ctx", 6).alias("ctx"), F.round("noctx", 6).alias("noctx"), F.round(F.col("ctx") - F.col("noctx"), 6).alias("delta"))


@query("stratified_sample", """WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels) SELECT doc_id, quality, toxic FROM r WHERE k <= 10""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of each stratum in hash order (portable mode of the sampling operator)."""
    return L.stratified(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], "doc_id", 10, 42)
