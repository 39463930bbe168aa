"""Queries over crawled assets and page triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import assets as A
from quillspark.operators import documents as D
from quillspark.operators.release import PLACEHOLDERS
from quillspark.plans.registry import query
from quillspark.sources.tables import table


def any_sql(x: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in tokens) + ")"


URL_SQL = "u AS (SELECT page_id, lower(url) || CASE page_id % 9 WHEN 0 THEN '/thong-tu.pdf' WHEN 1 THEN '/a.pdf?x' WHEN 2 THEN '/logo.png' WHEN 3 THEN '/luat-1.jpg' WHEN 4 THEN '/anhdaidien/1.jpg' ELSE '' END AS url, CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'text/html' END AS kind FROM pages)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 9
    more = F.when(k == 0, "/thong-tu.pdf").when(k == 1, "/a.pdf?x").when(k == 2, "/logo.png").when(k == 3, "/luat-1.jpg").when(k == 4, "/anhdaidien/1.jpg").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lower("url"), more).alias("url"), F.when(F.col("page_id") % 2 == 0, "image/png").otherwise("text/html").alias("kind"))


@query(
    "asset_triage",
    f"""WITH {URL_SQL} SELECT page_id, CASE WHEN ends_with(string_split(url, '?')[1], '.pdf') THEN CASE WHEN {any_sql('url', A.KEEP_TOKENS)} THEN 'keep_pdf' ELSE 'needs_review_pdf' END
    WHEN {any_sql('url', A.DROP_TOKENS)} THEN 'drop_static' WHEN {any_sql('url', A.KEEP_TOKENS)} THEN 'keep_image_candidate' WHEN contains(url, '/anhdaidien/') OR contains(url, 'publishingimages/tintuc') OR contains(kind, 'image') THEN 'needs_vision' ELSE 'drop_unknown' END AS label FROM u""",
)
def asset_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).select("page_id", A.triage(F.col("url"), F.lit(""), F.col("kind")).alias("label"))


@query(
    "asset_shortlist",
    f"""WITH {URL_SQL}, s AS (SELECT *, CAST(page_id % 900 AS DOUBLE) AS w, CAST(page_id % 500 AS DOUBLE) AS h FROM u)
    SELECT page_id, CASE WHEN ends_with(url, '.pdf') THEN 'keep_pdf_for_render' WHEN {any_sql('url', A.BAD_TOKENS)} THEN 'drop_static' WHEN w < 350 OR h < 250 THEN 'drop_too_small' WHEN w / greatest(h, 1) > 5 OR h / greatest(w, 1) > 5 THEN 'drop_banner_shape'
    WHEN {any_sql('url', A.GOOD_TOKENS)} THEN 'candidate_image_for_vision' WHEN contains(kind, 'image') THEN 'candidate_image_for_vision' ELSE 'drop_low_signal' END AS decision FROM s""",
)
def asset_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets(spark, sf_dir).withColumn("w", (F.col("page_id") % 900).cast("double")).withColumn("h", (F.col("page_id") % 500).cast("double"))
    label = F.when(F.col("kind").contains("image"), "needs_vision").otherwise("")
    return rows.select("page_id", A.shortlist(F.col("url"), label, F.col("w"), F.col("h")).alias("decision"))


@query("host_predicates", "WITH l AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) SELECT page_id, host, host = 'example.com' OR ends_with(host, '.example.com') AS same_host, contains(lower(url), 'utm_source') AS has_keyword FROM l")
def host_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), A.same_host(host, "example.com").alias("same_host"), F.lower("url").contains("utm_source").alias("has_keyword"))


@query("crawl_frontier", """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']([^"'']+)["'']', 1)) AS link FROM pages) SELECT link FROM l WHERE link NOT IN (SELECT DISTINCT '/' || lang FROM documents)""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next frontier: links found, without those seen."""
    found = D.links(table(spark, sf_dir, "pages"), "page_id", "html").select("link").distinct()
    seen = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "lang").alias("link")).distinct()
    return found.join(seen, "link", "left_anti")


@query("escaped_links", """SELECT page_id, 'https://a.example/' || page_id || '/x.pdf' AS link FROM pages UNION ALL SELECT page_id, '/' || page_id FROM pages""")
def escaped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes, and URLs in scripts whose slashes are escaped."""
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a href="/'), i, F.lit('">x</a><script>{"u":"https:\\/\\/a.example\\/'), i, F.lit('\\/x.pdf"}</script>'))
    return D.links(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html", escaped=True)


# a site of suppliers: page k links to 2k + 1 and 2k + 2, and to another host
@query("crawl_site", """WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT 0::BIGINT AS k, 0 AS depth UNION ALL SELECT child, depth + 1 FROM (SELECT c.k * 2 + o AS child, depth FROM c, n, (VALUES (1), (2)) t(o) WHERE c.k < n.n) WHERE depth < 3) SELECT 'https://www.site.example/p' || k AS url, depth FROM c""")
def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth first from one page over pages of the same host, three steps deep; the fetcher is a table."""
    k = F.col("s_suppkey") - 1
    page = lambda n: F.concat(F.lit('<a href="https://www.site.example/p'), n.cast("string"), F.lit('">'))
    site = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://www.site.example/p"), k.cast("string")).alias("url"), F.concat(page(k * 2 + 1), page(k * 2 + 2), F.lit('<a href="https://other.example/x">'), page(F.lit(0))).alias("html"))
    start = spark.range(1).select(F.lit("https://www.site.example/p0").alias("url"))
    return A.crawl(start, lambda urls: urls.join(site, "url"), "site.example", 3)


PAGE_SQL = "s AS (SELECT event_id, event_id % 7 AS rects, event_id % 5 AS lines, event_id % 9 AS curves, event_id % 2 AS big_imgs, event_id % 600 AS txt_len, user_id FROM events)"


@query("page_candidates", f"WITH {PAGE_SQL} SELECT event_id, CASE WHEN rects >= 3 AND lines >= 3 THEN 'rects_lines' WHEN curves >= 6 THEN 'curves' WHEN rects >= 5 THEN 'rects' WHEN big_imgs >= 1 AND txt_len < 300 THEN 'big_image' END AS reason FROM s")
def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_signals(spark, sf_dir).select("event_id", A.page_reason().alias("reason"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (e % 7).alias("rects"), (e % 5).alias("lines"), (e % 9).alias("curves"), (e % 2).alias("big_imgs"), (e % 600).alias("txt_len"), "user_id")


@query("scan_vs_text", f"WITH {PAGE_SQL} SELECT user_id % 100 AS book, count(*) AS pages, round(median(txt_len), 6) AS median_len, median(txt_len) < 80 AS is_scan FROM s GROUP BY 1")
def scan_vs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_signals(spark, sf_dir).groupBy((F.col("user_id") % 100).alias("book"))
    return rows.agg(F.count("*").alias("pages"), F.round(F.median("txt_len"), 6).alias("median_len"), (F.median("txt_len") < 80).alias("is_scan"))


@query(
    "image_audit_triage",
    """WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'noise' WHEN 1 THEN 'diagram' WHEN 2 THEN 'table' ELSE 'duplicate' END AS c, event_id % 6 AS relevance, event_id % 5 AS confidence, event_id % 11 AS page FROM events)
    SELECT event_id, CASE WHEN c IN ('noise', 'duplicate') THEN 'irrelevant_or_noise' WHEN page = 0 AND c = 'diagram' THEN 'front_matter' WHEN relevance >= 3 AND confidence >= 3 THEN 'qa_candidate' WHEN relevance <= 2 THEN 'low_legal_relevance' ELSE 'borderline' END AS issue FROM a""",
)
def image_audit_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "noise").when(e % 4 == 1, "diagram").when(e % 4 == 2, "table").otherwise("duplicate")
    return table(spark, sf_dir, "events").select("event_id", A.audit_issue(kind, e % 6, e % 5, e % 11, F.lit("")).alias("issue"))


@query(
    "visual_anchor_check",
    """WITH b AS (SELECT vec_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[3]::DOUBLE AS x1, embedding[4]::DOUBLE AS y1 FROM embeddings)
    SELECT vec_id, CASE WHEN least(x0, y0, x1, y1) < 0 OR greatest(x0, y0, x1, y1) > 1 THEN 'bbox_not_normalised' WHEN x1 <= x0 OR y1 <= y0 THEN 'bbox_degenerate' WHEN (x1 - x0) * (y1 - y0) >= 0.8 THEN 'bbox_covers_whole_page' WHEN (x1 - x0) * (y1 - y0) < 0.0004 THEN 'bbox_too_small' END AS problem FROM b""",
)
def visual_anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", A.box_problem(*box).alias("problem"))


DOMAIN_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in A.DOMAINS.items()) + "}"


@query("domain_tags", f"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Own tag' WHEN 1 THEN 'civil_law' WHEN 2 THEN '' ELSE 'unknown' END AS tag, CASE WHEN page_id % 5 > 0 THEN CAST(page_id % 60 AS VARCHAR) || '_book' ELSE 'book' END AS doc_id, CAST(page_id % 59 AS VARCHAR) || '_q' AS qa_id FROM pages), n AS (SELECT *, regexp_extract(doc_id, '^[0-9]+') AS d, regexp_extract(qa_id, '^[0-9]+') AS q, {DOMAIN_SQL} AS m FROM r)
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN tag WHEN d <> '' THEN coalesce(m[d], 'Other') ELSE coalesce(m[q], 'Other') END AS tag, coalesce(m[q], 'Other') AS by_question, CASE WHEN d <> '' THEN coalesce(m[d], 'Other') ELSE coalesce(m[q], 'Other') END AS by_document, page_id % 3 = 0 OR page_id % 7 = 0 AS is_multimodal FROM n""")
def domain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag that says something, else the document's subject, else the question's; and the variants that skip the tag."""
    i = F.col("page_id")
    ids = table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 == 0, "Own tag").when(i % 4 == 1, "civil_law").when(i % 4 == 2, "").otherwise("unknown").alias("tag"), F.when(i % 5 > 0, F.concat((i % 60).cast("string"), F.lit("_book"))).otherwise("book").alias("doc_id"), F.concat((i % 59).cast("string"), F.lit("_q")).alias("qa_id"))
    by_doc = A.domain(F.col("doc_id"), F.col("qa_id"))
    tag = F.when(~F.col("tag").isin(*PLACEHOLDERS), F.col("tag")).otherwise(by_doc)
    visuals = F.when(i % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return ids.select("page_id", tag.alias("tag"), A.subject(F.col("qa_id"), "Other").alias("by_question"), by_doc.alias("by_document"), A.multimodal(F.when(i % 3 == 0, True), visuals).alias("is_multimodal"))
