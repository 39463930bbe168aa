"""Document operators: Markdown chunks, cleaning, line noise, truncation tables, exact duplicates, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import col, sentences, squeeze, strip, word_count

# Splitting and noise patterns and limits of the document format.
HEADER = r"^#{1,6}\s+.*"
LEGAL = (r"^(?:Điều|Khoản)\s+\d+(?:[.:])?\s*", r"^Chương\s+[IVXLCDM]+(?:[.:])?\s*", r"^Mục\s+\d+(?:[.:])?\s*")
BOUNDARY = "(?dmiuU)" + "|".join(f"(?:{p})" for p in (HEADER, *LEGAL))
NOISE = (r"^\s*\d+\s*$", r"^\s*trang\s+\d+", r"^\s*[-_=]{3,}\s*$", r"^\s*\.\.\.\.+\s*$")
TOC = r"\.\.+\s*\d+|\d+\s*$"
MIN_CHARS, MAX_CHARS, DEEPEST = 100, 3000, 3
MIN_WORDS, MAX_SPECIAL, MAX_TOC = 15, 0.5, 5
MARK = "\u0001"
IMAGE_MARK = r"!\[[^\]]*\]\([^)]+\)"


def html_to_markdown(c: Column | str) -> Column:
    """Headings as # lines, blocks as lines, other markup gone."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style|nav|footer|head)\b.*?</\1>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<h1[^>]*>", "\n# ")
    t = F.regexp_replace(t, r"(?i)<p><b>", "\n## ")
    t = F.regexp_replace(t, r"(?i)<(?:p|li|br|div|article)\b[^>]*>|</(?:h1|p|li|div|article)>", "\n")
    return strip(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), r"[ \t]*\n\s*", "\n"))


def chunks(docs: DataFrame, id_col: str, text_col: str, keep_deep: bool = False) -> DataFrame:
    """Chunks of every text: doc_id, chunk_id, section_title, header_level, text. Boundaries are headers and legal
    sections; short chunks stay only if they hold an image; a window numbers the chunks of a document, which is one row's content and so bounded by it."""
    text = col(text_col)
    pieces = F.split(F.regexp_replace(text, BOUNDARY, MARK + "$0"), MARK)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("_all"), F.posexplode(pieces).alias("pos", "piece"), F.size(pieces).alias("n"))
    body = strip("piece")
    hashes = F.regexp_extract("piece", r"^(#{1,6})\s", 1)
    level = F.when(F.col("pos") == 0, 0).when(hashes != "", F.length(hashes)).otherwise(2)
    title = F.when(F.col("n") == 1, "Full Document").when(F.col("pos") == 0, "Preamble").when(hashes != "", strip(F.regexp_extract("piece", r"^#{1,6}\s+([^\n]*)", 1))).otherwise(F.left(F.substring_index("piece", "\n", 1), F.lit(50)))
    rows = rows.select("doc_id", "pos", "n", body.alias("body"), level.alias("header_level"), title.alias("section_title"))
    whole = F.col("n") == 1
    has_image = F.col("body").rlike(IMAGE_MARK)
    kept = rows.where(whole | (((F.length("body") >= MIN_CHARS) | has_image) & (F.lit(keep_deep) | (F.col("header_level") <= DEEPEST))))
    cut = F.when(~whole & (F.col("pos") > 0) & (F.length("body") > MAX_CHARS), F.concat(F.left("body", F.lit(MAX_CHARS)), F.lit("\n\n[... truncated ...]"))).otherwise(F.col("body"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return kept.select("doc_id", F.concat("doc_id", F.lit("_chunk_"), number.cast("string")).alias("chunk_id"), "section_title", F.col("header_level").cast("bigint").alias("header_level"), cut.alias("text"))


def without_noise(c: Column | str) -> Column:
    """Lines that are no page numbers, rules or dot leaders."""
    return F.filter(F.split(col(c), r"\r\n|\r|\n"), lambda line: ~strip(line).rlike("|".join(NOISE)))


def clean_reason(c: Column | str, multimodal: Column | None = None) -> Column:
    """Why a chunk is dropped: toc, short, noisy, no_sentence; null if it stays. Lines and text are bound once."""
    own = F.lit(True) if multimodal is None else ~multimodal
    bound = F.transform(F.array(without_noise(c)), lambda lines: F.struct(lines.alias("lines"), strip(F.array_join(lines, "\n")).alias("text")))

    def reason(x: Column) -> Column:
        lines, text = x["lines"], x["text"]
        toc = F.size(F.filter(lines, lambda line: line.rlike(TOC)))
        special = 1 - F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", "")) / F.length(text)
        return (
            F.when(toc > MAX_TOC, "toc").when(own & (word_count(text) < MIN_WORDS), "short").when(own & (text != "") & (special > MAX_SPECIAL), "noisy")
            .when(own & ~F.concat(text, F.lit(" ")).rlike(r"[.?!]\s"), "no_sentence")
        )

    return F.element_at(F.transform(bound, reason), 1)


def clean(chunk_rows: DataFrame, text_col: str = "text", multimodal: str | None = None, enabled: bool = True) -> DataFrame:
    """Chunks that stay, their noise lines removed."""
    if not enabled:
        return chunk_rows
    reason = clean_reason(text_col, F.col(multimodal) if multimodal else None)
    return chunk_rows.where(reason.isNull()).withColumn(text_col, strip(F.array_join(without_noise(text_col), "\n")))


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups of texts that are equal but for white space: digest, least id, copies."""
    return docs.groupBy(F.sha2(squeeze(text_col), 256).alias("text_sha256")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


def idf_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, df, idf over sentences; idf = ln((N + 1) / (df + 1))."""
    parts = items.select(id_col, F.posexplode(sentences(text_col)).alias("pos", "sentence"))
    n = parts.agg(F.count("*").alias("n"))
    words = parts.select(id_col, "pos", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"([a-zA-ZÀ-ỹ0-9]+)"), F.lit(1)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("word", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)), 6).alias("idf"))


def links(pages: DataFrame, id_col: str, html_col: str, escaped: bool = False) -> DataFrame:
    """One row per page and target of href or src; escaped adds absolute URLs whose slashes are escaped, as in scripts."""
    found = F.regexp_extract_all(col(html_col), F.lit(r"""(?i)(?:href|src)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    if escaped:
        more = F.regexp_extract_all(col(html_col), F.lit(r"""https?:\\/\\/[^"'\s<>]+"""), F.lit(0))
        found = F.array_distinct(F.concat(found, F.transform(more, lambda u: F.replace(u, F.lit("\\/"), F.lit("/")))))
    return pages.select(id_col, F.explode(found).alias("link"))


def table_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of two or more lines that start with a pipe: first line, lines, rows. A run that ends the text is not emitted.
    The lines of one document are ordered by a window over that document alone."""
    lines = docs.select(id_col, F.posexplode(F.split(col(text_col), "\n")).alias("pos", "line"), F.size(F.split(col(text_col), "\n")).alias("n"))
    lines = lines.withColumn("is_row", F.ltrim("line").startswith("|"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(id_col, "is_row").orderBy("pos"))
    runs = lines.withColumn("island", island).where("is_row").groupBy(id_col, "island").agg(F.min("pos").alias("first_line"), F.count("*").alias("n_lines"), F.max("pos").alias("last"), F.max("n").alias("n"))
    return runs.where("n_lines >= 2 and last < n - 1").select(id_col, F.col("first_line").cast("bigint").alias("first_line"), "n_lines")
