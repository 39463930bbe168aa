"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.plans.registry import query
from quillspark.sources.tables import table

WS = r"[\s\x1c-\x1f\x{0085}\x{00a0}\x{2028}\x{2029}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def words_sql(x: str) -> str:
    s = squeeze_sql(x)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END"


MARKDOWN_SQL = strip_sql(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,"
    r" '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<head\b.*?</head>|<!--.*?-->', '', 'g'),"
    r" '(?i)<h1[^>]*>', chr(10) || '# ', 'g'), '(?i)<p><b>', chr(10) || '## ', 'g'),"
    r" '(?i)<(?:p|li|br|div|article)\b[^>]*>|</(?:h1|p|li|div|article)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]*\n\s*', chr(10), 'g')"
)
BOUNDARY_SQL = r"(?mi)^#{1,6}\s+.*|^(?:Điều|Khoản)\s+\d+(?:[.:])?\s*|^Chương\s+[IVXLCDM]+(?:[.:])?\s*|^Mục\s+\d+(?:[.:])?\s*"
CHUNKS_SQL = rf"""
WITH md AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, {MARKDOWN_SQL} AS t FROM pages),
p AS (SELECT doc_id, string_split(regexp_replace(t, '{BOUNDARY_SQL}', chr(1) || '\0', 'g'), chr(1)) AS pieces FROM md),
r AS (SELECT doc_id, len(pieces) AS n, unnest(range(len(pieces))) AS pos, unnest(pieces) AS piece FROM p),
b AS (SELECT doc_id, n, pos, piece, {strip_sql('piece')} AS body, regexp_extract(piece, '^(#{{1,6}})\s', 1) AS hashes FROM r),
c AS (SELECT doc_id, n, pos, piece, body, CASE WHEN pos = 0 THEN 0 WHEN hashes <> '' THEN length(hashes) ELSE 2 END AS header_level,
  CASE WHEN n = 1 THEN 'Full Document' WHEN pos = 0 THEN 'Preamble' WHEN hashes <> '' THEN {strip_sql("regexp_extract(piece, '^#{1,6}[ ]+([^' || chr(10) || ']*)', 1)")}
  ELSE left(string_split(piece, chr(10))[1], 50) END AS section_title FROM b),
k AS (SELECT * FROM c WHERE n = 1 OR (length(body) >= 100 AND header_level <= 3))
SELECT doc_id, doc_id || '_chunk_' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS VARCHAR) AS chunk_id, section_title,
  CAST(header_level AS BIGINT) AS header_level,
  CASE WHEN n > 1 AND pos > 0 AND length(body) > 3000 THEN left(body, 3000) || chr(10) || chr(10) || '[... truncated ...]' ELSE body END AS text FROM k"""


@query("pages_to_chunks", CHUNKS_SQL)
def pages_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", D.html_to_markdown("html").alias("md"))
    return D.chunks(pages, "page_id", "md")


NOISE_SQL = r"^\s*\d+\s*$|^\s*trang\s+\d+|^\s*[-_=]{3,}\s*$|^\s*\.\.\.\.+\s*$"
LINES_SQL = f"list_filter(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: NOT regexp_matches({strip_sql('x')}, '{NOISE_SQL}'))"
CLEAN_SQL = rf"""
WITH l AS (SELECT doc_id, {LINES_SQL} AS lines FROM documents),
c AS (SELECT doc_id, lines, {strip_sql("array_to_string(lines, chr(10))")} AS t FROM l),
m AS (SELECT doc_id, len(list_filter(lines, lambda x: regexp_matches(x, '\.\.+\s*\d+|\d+\s*$'))) AS toc, {words_sql('t')} AS words, t,
  1 - length(regexp_replace(t, '[^\p{{L}}\p{{N}}\s]', '', 'g')) / nullif(length(t), 0)::DOUBLE AS special, len(regexp_extract_all(t || ' ', '[.?!]\s')) AS ends FROM c)
SELECT doc_id, CASE WHEN toc > 5 THEN 'toc' WHEN words < 15 THEN 'short' WHEN t <> '' AND special > 0.5 THEN 'noisy' WHEN ends < 1 THEN 'no_sentence' END AS reason FROM m"""


@query("chunk_clean_reasons", CLEAN_SQL)
def chunk_clean_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.clean_reason("text").alias("reason"))


@query("noise_line_strip", f"SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) AS BIGINT) AS n_lines, CAST(len({LINES_SQL}) AS BIGINT) AS n_kept, sha256(array_to_string({LINES_SQL}, chr(10))) AS kept_sha256 FROM documents")
def noise_line_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.without_noise("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", r"\r\n|\r|\n")).cast("bigint").alias("n_lines"), F.size(lines).cast("bigint").alias("n_kept"), F.sha2(F.array_join(lines, "\n"), 256).alias("kept_sha256"))


@query(
    "doc_stats_by_source",
    """SELECT source, count(*) AS n_docs, CAST(count(CASE WHEN toxic = 1 THEN 1 END) AS BIGINT) AS n_flagged, round(avg(length(text)), 6) AS avg_chars,
    round(count(CASE WHEN toxic = 1 THEN 1 END) / count(*)::DOUBLE, 6) AS flagged_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def doc_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    flagged = F.count_if(F.col("toxic") == 1)
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"), F.round(flagged / F.count("*"), 6).alias("flagged_ratio"))


@query("text_dedup_exact", f"SELECT sha256({squeeze_sql('text')}) AS text_sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def text_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "qa_dup_signature",
    f"""WITH s AS (SELECT doc_id, {squeeze_sql("lower(string_split(text, chr(10))[1])")} AS first_line, {squeeze_sql("lower(list_last(string_split(text, chr(10))))")} AS last_line FROM documents)
    SELECT count(*) AS n_rows, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT first_line, last_line FROM s)) AS BIGINT) AS n_duplicates FROM s""",
)
def qa_dup_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select(T.squeeze(F.lower(lines[0])).alias("a"), T.squeeze(F.lower(F.element_at(lines, -1))).alias("b"))
    sizes = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"))


@query(
    "dup_first_wins",
    """SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents""",
)
def dup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    # first id of a digest instead of a window over it: one digest may hold any share of the rows
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "k").select("doc_id", (F.col("doc_id") != F.col("first_id")).alias("is_duplicate"))


@query(
    "truncate_context",
    f"""WITH s AS (SELECT doc_id, {squeeze_sql('text')} AS s FROM documents)
    SELECT doc_id, sha256(CASE WHEN length(s) <= 600 THEN s ELSE rtrim(left(s, 420)) || chr(10) || '...' || chr(10) || ltrim(right(s, 175)) END) AS cut_sha256 FROM s""",
)
def truncate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.truncate_context("text", 600), 256).alias("cut_sha256"))


@query(
    "excerpt_budget",
    f"""WITH s AS (SELECT doc_id, {squeeze_sql('text')} AS s, {words_sql('text')} AS n FROM documents),
    b AS (SELECT doc_id, s, CAST(greatest(1, least(40, floor(n * 0.35 / 2))) AS BIGINT) AS budget FROM s)
    SELECT doc_id, budget, array_to_string(list_slice(string_split(s, ' '), 1, budget), ' ') AS excerpt FROM b""",
)
def excerpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = T.excerpt_budget("text", 2)
    return table(spark, sf_dir, "documents").select("doc_id", budget.alias("budget"), T.excerpt("text", budget.cast("int")).alias("excerpt"))


SENT_SQL = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: {strip_sql('x')}), lambda x: length(x) >= 25)"


@query("sentence_split", f"SELECT doc_id, CAST(len({SENT_SQL}) AS BIGINT) AS n_sentences, sha256(array_to_string({SENT_SQL}, chr(1))) AS sentences_sha256 FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.sha2(F.array_join(s, "\u0001"), 256).alias("sentences_sha256"))


@query(
    "idf_table",
    f"""WITH s AS (SELECT item_id, unnest({SENT_SQL}) AS sentence, unnest(range(len({SENT_SQL}))) AS pos FROM benchmark),
    w AS (SELECT DISTINCT item_id, pos, unnest(regexp_extract_all(lower(sentence), '[a-zA-Z\\x{{00C0}}-\\x{{1EF9}}0-9]+')) AS word FROM s)
    SELECT word, count(*) AS df, round(ln(((SELECT count(*) FROM s) + 1) / (count(*) + 1)::DOUBLE), 6) AS idf FROM w GROUP BY word""",
)
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.idf_table(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("link_extract", """SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']([^"'']+)["'']', 1)) AS link FROM pages""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "table_blocks",
    """WITH d AS (SELECT doc_id, replace(text, ' | ', chr(10) || '| ') AS t FROM documents),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos, len(string_split(t, chr(10))) AS n FROM d),
    r AS (SELECT *, starts_with(ltrim(line), '|') AS is_row FROM l),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, is_row ORDER BY pos) AS island FROM r)
    SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_line, count(*) AS n_lines FROM i WHERE is_row GROUP BY doc_id, island HAVING count(*) >= 2 AND max(pos) < max(n) - 1""",
)
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" | "), F.lit("\n| ")).alias("text"))
    return D.table_blocks(docs, "doc_id", "text")


@query("topk_per_group", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of each source; row_number with a limit keeps 5 rows a task and group before the shuffle."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.withColumn("k", rank).where("k <= 5").drop("k")


@query(
    "cumulative_coverage",
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT source, n, CAST(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM c""",
)
def cumulative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running share of rows by source; the window orders one row a source."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "source")
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("source", "n", run.alias("running"), F.round(run / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(
    "shared_benchmark_runs",
    """WITH t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(text), '[\\s\\x1c-\\x1f]+', ' ', 'g')), ' ') AS w FROM documents),
    d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
    u AS (SELECT item_id, string_split_regex(trim(regexp_replace(lower(text), '[\\s\\x1c-\\x1f]+', ' ', 'g')), ' ') AS w FROM benchmark),
    b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM u))
    SELECT doc_id, item_id, count(*) AS shared_runs FROM d JOIN b USING (gram) GROUP BY doc_id, item_id""",
)
def shared_benchmark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight words that a document shares with a benchmark item. Documents' runs are digested, and joined with
    the benchmark's: a broadcast while those are few (the planner's size check), a shuffle of digests beyond it."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        w = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\s\x1c-\x1f]+", " ")), " ")
        runs = F.when(F.size("w") >= 8, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.md5(F.array_join(F.slice(F.col("w"), i, F.lit(8)), " ")))))
        return df.select(key, w.alias("w")).select(key, F.explode(runs).alias("gram"))

    asked = grams(table(spark, sf_dir, "benchmark"), "item_id").persist()
    few = asked.count() <= 200_000
    side = F.broadcast(asked) if few else asked
    return grams(table(spark, sf_dir, "documents"), "doc_id").join(side, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared_runs"))
