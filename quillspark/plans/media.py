"""Queries over images, tables and pages of documents; Markdown and files are derived from documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import media as M
from quillspark.plans.registry import query
from quillspark.sources.tables import table

# chunks refer to one or two images; a third of the references lead nowhere
REFS_SQL = "c AS (SELECT page_id AS chunk_id, page_id % 20 AS doc_id, CASE WHEN page_id % 7 = 0 THEN 'no image' ELSE 'text ![a](img/p' || (page_id % 9) || '.png) more ![](x/q' || (page_id % 5) || '.jpg \"t\") end' END AS text FROM pages), f AS (SELECT d AS doc_id, 'root/d' || d || '/p' || k || '.png' AS path FROM range(20) a(d), range(0, 9, 2) b(k) UNION ALL SELECT d, 'root/d' || d || '/q' || k || '.jpg' FROM range(0, 20, 3) a(d), range(5) b(k))"


def refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("page_id")
    text = F.when(i % 7 == 0, "no image").otherwise(F.concat(F.lit("text ![a](img/p"), (i % 9).cast("string"), F.lit(".png) more ![](x/q"), (i % 5).cast("string"), F.lit('.jpg "t") end')))
    chunks = table(spark, sf_dir, "pages").select(i.alias("chunk_id"), (i % 20).alias("doc_id"), text.alias("text"))
    d = spark.range(20).withColumnRenamed("id", "doc_id")
    path = lambda kind, ext: F.concat(F.lit("root/d"), F.col("doc_id").cast("string"), F.lit(f"/{kind}"), F.col("k").cast("string"), F.lit(ext))
    p = d.select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(0, 9, 2)])).alias("k")).select("doc_id", path("p", ".png").alias("path"))
    q = d.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("k")).select("doc_id", path("q", ".jpg").alias("path"))
    return chunks, p.unionByName(q)


@query(
    "chunk_images",
    f"""WITH {REFS_SQL}, r AS (SELECT chunk_id, doc_id, unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1)) AS ref, unnest(range(len(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1)))) AS pos FROM c),
    j AS (SELECT r.chunk_id, r.doc_id, pos, f.path FROM r LEFT JOIN f ON f.doc_id = r.doc_id AND regexp_extract(f.path, '[^/]+$') = regexp_extract(r.ref, '[^/]+$')), g AS (SELECT chunk_id, doc_id, string_agg(path, ',' ORDER BY pos) AS hits FROM j GROUP BY ALL)
    SELECT chunk_id, coalesce(hits, (SELECT string_agg(path, ',' ORDER BY path) FROM f WHERE f.doc_id = g.doc_id)) AS images FROM g""",
)
def chunk_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chunk_images(*refs(spark, sf_dir)).select("chunk_id", F.array_join("images", ",").alias("images"))


@query(
    "resolved_paths",
    f"""WITH {REFS_SQL}, d AS (SELECT chunk_id, CASE chunk_id % 3 WHEN 0 THEN 'root/d' || doc_id || '/p' || (chunk_id % 9) || '.png' WHEN 1 THEN 'old/d' || doc_id || '/p' || (chunk_id % 9) || '.png' ELSE 'else/where/q' || (chunk_id % 6) || '.jpg' END AS declared FROM c),
    j AS (SELECT d.chunk_id, d.declared, f.path, CASE WHEN f.path = d.declared THEN 0 WHEN string_split(f.path, '/')[-2] = string_split(d.declared, '/')[-2] THEN 1 ELSE 2 END AS rank FROM d LEFT JOIN f ON string_split(f.path, '/')[-1] = string_split(d.declared, '/')[-1]),
    b AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rank, path) AS r FROM j) SELECT chunk_id, declared, path, CASE WHEN path IS NULL THEN 'unresolved' WHEN rank = 0 THEN 'exact_path' WHEN rank = 1 THEN 'basename+parent' ELSE 'basename_only' END AS how FROM b WHERE r = 1""",
)
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, files = refs(spark, sf_dir)
    k, text = F.col("chunk_id") % 3, lambda c: c.cast("string")
    name = F.concat(F.lit("/p"), text(F.col("chunk_id") % 9), F.lit(".png"))
    declared = F.when(k == 0, F.concat(F.lit("root/d"), text(F.col("doc_id")), name)).when(k == 1, F.concat(F.lit("old/d"), text(F.col("doc_id")), name)).otherwise(F.concat(F.lit("else/where/q"), text(F.col("chunk_id") % 6), F.lit(".jpg")))
    return M.resolved_paths(chunks.select("chunk_id", declared.alias("declared")), files, "chunk_id")


@query("image_index", f"WITH {REFS_SQL} SELECT regexp_extract(path, '[^/]+$') AS name, string_agg(path, ',' ORDER BY path) AS paths FROM f GROUP BY 1")
def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.image_index(refs(spark, sf_dir)[1]).select("name", F.array_join("paths", ",").alias("paths"))


@query(
    "visual_fusion",
    """WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'says ' || role WHEN 1 THEN 'fenced ' || role ELSE left('plain ' || text, 200) END AS summary FROM conversations)
    SELECT c AS chunk_id, coalesce(string_agg(sha256(summary), ',' ORDER BY turn), '') AS summaries FROM (SELECT DISTINCT conv_id AS c FROM conversations UNION SELECT 10000000) k LEFT JOIN r ON r.conv_id = k.c GROUP BY c""",
)
def visual_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output, some fenced and some no JSON, parsed and put back in order; a chunk without images stays."""
    rows, k = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    raw = F.when(k == 0, F.concat(F.lit('{"summary": "says '), "role", F.lit('"}'))).when(k == 1, F.concat(F.lit('here:\n```json\n{"summary": "fenced '), "role", F.lit('"}\n```'))).otherwise(F.concat(F.lit("plain "), "text"))
    found = rows.select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("pos"), M.described(raw)["summary"].alias("summary"))
    chunks = rows.select(F.col("conv_id").alias("chunk_id")).unionByName(spark.range(1).select(F.lit(10_000_000).cast("bigint").alias("chunk_id"))).distinct()
    return M.fused(chunks, found).select("chunk_id", F.array_join(F.transform("visual_descriptions", lambda s: F.sha2(s, 256)), ",").alias("summaries"))


@query("clean_evidence", "SELECT doc_id, sha256('first line' || chr(10) || chr(10) || source || chr(10) || chr(10) || 'kept ![x](y) inline') AS text_sha256 FROM documents")
def clean_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\n![a](b.png)\nfirst line\n{12}-----\n\n\n_page_3_Picture_1.jpeg\n\n"), "source", F.lit("\n\n \n\t\nkept ![x](y) inline\n  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(M.clean_evidence(text), 256).alias("text_sha256"))


@query("condition_packages", "SELECT doc_id AS chunk_id, condition, condition <> 'T' AS has_structure, condition = 'TLV' AS has_images, CASE WHEN condition <> 'T' THEN source END AS section_title FROM documents, (VALUES ('T'), ('TL_struct'), ('TLV')) c(condition)")
def condition_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.col("source").alias("section_title"), F.lit(1).alias("header_level"), F.array(F.lit("a.png")).alias("images"))
    p = M.packages(chunks)
    return p.select("chunk_id", "condition", F.col("evidence.document_structure").isNotNull().alias("has_structure"), F.col("evidence.images").isNotNull().alias("has_images"), "evidence.document_structure.section_title")


@query(
    "table_block_classes",
    """WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT doc_id, CASE WHEN k = 1 THEN 4 ELSE 3 END AS start, 2 AS n_lines, CASE k WHEN 0 THEN 'qa_candidate' WHEN 1 THEN 'toc_or_front_matter' WHEN 2 THEN 'borderline_review' WHEN 3 THEN 'ocr_artifact' END AS kind, CAST(doc_id % 50 AS INTEGER) AS page,
    CASE k WHEN 0 THEN 'KEEP_AS_IS' WHEN 2 THEN 'REVIEW' ELSE 'DISCARD' END AS action FROM d WHERE k < 4""",
)
def table_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table a text: with key words, after front matter, with one key word, with scan faults; single lines and tables that
    end the text give none."""
    k = F.col("doc_id") % 6
    mark = F.concat(F.lit("intro\n--- Page "), (F.col("doc_id") % 50).cast("string"), F.lit(" ---\n"))
    rows = F.when(k == 0, "| Điều 1 | hợp đồng |\n| a | b |").when(k == 1, "| luật | thuế |\n| a | b |").when(k == 2, "| thuế |\n| a |").when(k == 3, "| ..... |\n| □□□ |").when(k == 4, "| one line |").otherwise("| a |\n| b |")
    text = F.concat(F.when(k == 1, F.lit("Mục lục\n")).otherwise(""), mark, F.lit("before\n"), rows, F.when(k == 5, "").otherwise("\nafter"))
    return M.table_blocks(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


SCREEN_SQL = """c AS (SELECT doc_id AS chunk_id, source, doc_id % 11 AS k FROM documents)"""


@query(
    "screening",
    """WITH RECURSIVE c AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n, doc_id % 11 AS k, doc_id // 2 % 40 AS t, doc_id % 60 AS g FROM documents),
    s AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS texts, []::BIGINT[] AS owners, []::BIGINT[] AS imgs, NULL::BIGINT AS id, '' AS reason
      UNION ALL SELECT c.n, CASE WHEN r = '' THEN list_append(texts, t) ELSE texts END, CASE WHEN r = '' THEN list_append(owners, c.id) ELSE owners END, CASE WHEN r = '' THEN list_append(imgs, g) ELSE imgs END, c.id, r
      FROM (SELECT c.*, s.texts, s.owners, s.imgs, CASE WHEN k = 1 THEN 'text_too_short:10<200' WHEN k = 2 THEN 'no_declared_image' WHEN k = 3 THEN 'image_unresolved' WHEN list_contains(texts, t) THEN 'duplicate_text_of:' || owners[list_position(texts, t)] WHEN k IN (4, 5, 6) OR list_contains(imgs, g) THEN 'no_usable_image_after_screening' ELSE '' END AS r FROM s JOIN c ON c.n = s.n + 1) c)
    SELECT id AS chunk_id, CASE WHEN reason = '' THEN 'ACCEPT' ELSE 'REJECT' END AS decision, reason AS reasons FROM s WHERE n > 0""",
)
def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL takes the chunks one after the other."""
    i, k = F.col("doc_id"), F.col("doc_id") % 11
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(i.alias("chunk_id"), F.when(k == 1, "abcdefghij").otherwise(F.concat(F.repeat(F.lit("text "), F.lit(50)), (F.floor(i / 2) % 40).cast("string"))).alias("text"))
    images = docs.where(k != 2).select(
        i.alias("chunk_id"), F.lit(0).alias("pos"), F.when(k == 6, "_page_0_x.png").otherwise("x.png").alias("name"), F.when(k == 5, 100).otherwise(5000).alias("bytes"), F.when(k == 4, 10).otherwise(300).alias("width"),
        F.lit(300).alias("height"), F.when(k != 3, (i % 60).cast("string")).alias("sha256"),
    )
    return M.screened(chunks, images).select("chunk_id", "decision", F.array_join("reasons", ",").alias("reasons"))


@query(
    "gap_triage",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'rasterized_text_page' WHEN event_id % 6 >= 4 AND event_id % 2 = 0 THEN 'structured_table_candidate' WHEN event_id % 6 <= 2 THEN 'low_confidence_gap' ELSE 'gap_candidate' END AS issue,
    CASE WHEN event_id % 5 = 0 THEN 'DISCARD' WHEN event_id % 6 >= 4 AND event_id % 2 = 0 THEN 'KEEP_AS_IS' WHEN event_id % 6 <= 2 THEN 'REVIEW' ELSE 'given' END AS action FROM events""",
)
def gap_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = M.gap_triage(F.when(i % 2 == 0, "table").otherwise("figure"), F.when(i % 5 == 0, "a Rasterized page").otherwise("r"), (i % 6).cast("int"), F.lit("given"))
    return table(spark, sf_dir, "events").select("event_id", t["issue"].alias("issue"), t["action"].alias("action"))


@query("png_sizes", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 4000 AS INTEGER) END AS width, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 77 AS INTEGER) END AS height FROM documents")
def png_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG files, and of files that are none."""
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.when(F.col("doc_id") % 3 > 0, F.lit("89504E470D0A1A0A0000000D49484452")).otherwise(F.lit("FFD8FFE0000000000000000D49484452"))
    content = F.unhex(F.concat(head, number(F.col("doc_id") % 4000), number(F.col("doc_id") % 77)))
    return table(spark, sf_dir, "documents").select("doc_id", M.png_size(content).alias("s")).select("doc_id", "s.width", "s.height")


@query(
    "scan_books",
    """WITH p AS (SELECT source AS book, doc_id AS page, length(text) % 160 AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n) - 1 AS r, row_number() OVER (PARTITION BY book ORDER BY page) - 1 AS q, count(*) OVER (PARTITION BY book) AS c FROM p)
    SELECT book, median(n) < 80 AS scan_cost, max(CASE WHEN r = c // 2 THEN n END) < 50 AS scan_rank, avg(CASE WHEN q % greatest(1, c // 12) = 0 AND q // greatest(1, c // 12) < 12 THEN n END) < 60 AS scan_sample FROM r GROUP BY book""",
)
def scan_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), (F.length("text") % 160).alias("n"))
    return M.scan_books(pages, "book", "n")


@query("diagram_pages", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 >= 3 AND l_partkey % 100 >= 4 AND l_quantity / 100 > 0.01 AND l_quantity / 100 < 0.22 THEN 2 * (l_suppkey % 7) + l_partkey % 100 + 2 END AS score, CASE WHEN l_suppkey % 7 >= 3 AND l_partkey % 100 >= 3 THEN 'rects_and_lines' WHEN l_linenumber >= 6 THEN 'curves' WHEN l_suppkey % 7 >= 5 THEN 'rects' WHEN l_linenumber = 1 AND l_quantity < 30 THEN 'image_page' END AS why FROM lineitem")
def diagram_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, lines, q = F.col("l_suppkey") % 7, F.col("l_partkey") % 100, F.col("l_quantity")
    score = M.diagram_score(boxes, lines, F.lit(1), F.lit(1), q / 100)
    why = M.page_candidate(boxes, lines, F.col("l_linenumber"), F.col("l_linenumber") == 1, q * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), why.alias("why"))


@query("role_check", "SELECT * FROM (VALUES ('apart', FALSE, FALSE, FALSE), ('same', TRUE, TRUE, TRUE), ('family', FALSE, FALSE, TRUE)) t(name, same_model, in_subjects, same_family)")
def role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"apart": ("a/x", "b/y", "c/z"), "same": ("a/x", "a/x", "a/x"), "family": ("a/x", "A/y", "b/z")}
    out = None
    for name, (g, j, s) in sets.items():
        roles = spark.range(3).select(F.element_at(F.array(F.lit("generator"), F.lit("judge"), F.lit("subject")), (F.col("id") + 1).cast("int")).alias("role"), F.element_at(F.array(F.lit(g), F.lit(j), F.lit(s)), (F.col("id") + 1).cast("int")).alias("model"))
        one = M.role_faults(roles).select(F.lit(name).alias("name"), "same_model", "in_subjects", "same_family")
        out = one if out is None else out.unionByName(one)
    return out
