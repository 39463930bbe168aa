"""Images and tables of documents: references and their resolution, descriptions, evidence cleaning, screening, tables, page markers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspark.functions.text import squeeze, strip

# Patterns of the Markdown that the digitiser writes, of front matter and scan faults, and legal key words.
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
IMAGE_LINE = r"(?m)^\s*!\[[^\]]*\]\([^)]*\)\s*$"
PAGE_LINE = r"(?m)^\s*\{\d+\}\s*-{3,}\s*$"
FILE_LINE = r"(?imU)^\s*(?:[_\w .,-]+)?_page_\d+(?:_[\w.-]+)?\.(?:jpe?g|png|webp|gif)\s*$"
PAGE_MARK = r"(?i)---\s*page\s*(\d+)\s*---"
FRONT = (r"^\s*mục\s*lục", r"^\s*table\s+of\s+contents", r"^\s*danh\s+mục", r"^\s*lời\s+(nói\s+)?đầu", r"^\s*chương\s+trình", r"^\s*tài\s+liệu\s+tham\s+khảo", r"^\s*bibliography", r"^\s*index\b",
         r"^\s*nhà\s+xuất\s+bản", r"^\s*isbn\b", r"bìa\s+sách", r"tên\s+giáo\s+trình", r"xuất\s+bản\s+lần\s+thứ", r"^\s*in\s+lần\s+thứ")
SCAN_FAULTS = (r"[^\x{00}-\x{7F}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]{5,}", r"[□▪■]{3,}", r"\.{5,}", r"\s{10,}", r"([A-Z0-9]{1,3}\s*){8,}")
LEGAL = ("điều", "khoản", "điểm", "nghị định", "thông tư", "luật", "quyết định", "bộ luật", "tội phạm", "hợp đồng", "thừa kế", "đất đai", "thuế", "hôn nhân", "tố tụng", "hình sự", "dân sự", "hành chính", "kinh tế")
MIN_TEXT, MIN_PIXELS, MIN_BYTES, COVER = 200, 64, 2048, r"(?i)_page_0_"
#: Rows, one an image of an open chunk, that one task settles.
AT_ONCE = 200_000
MIN_RECTS, MIN_CURVES, MANY_RECTS, SHORT_TEXT = 3, 6, 5, 300


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise("")


def image_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, paths): all files of a name, in order."""
    return files.groupBy(basename(F.col(path)).alias("name")).agg(F.sort_array(F.collect_list(path)).alias("paths"))


def chunk_images(chunks: DataFrame, files: DataFrame, key: str = "chunk_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, images): the images of a chunk's references in order, by file name within its document; all of the document's
    images if there are references and none is found."""
    refs = chunks.select(key, doc, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(IMAGE), F.lit(1))).alias("pos", "ref"))
    own = files.select(F.col(doc), basename(F.col("path")).alias("name"), F.col("path")).groupBy(doc, "name").agg(F.min("path").alias("path"))
    found = refs.withColumn("name", basename(F.col("ref"))).join(own, [doc, "name"], "left")
    by = found.groupBy(key, doc).agg(F.sort_array(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("pos", "path")))).alias("hits"))
    whole = files.groupBy(doc).agg(F.sort_array(F.collect_list("path")).alias("every"))
    return by.join(whole, doc, "left").select(key, F.when(F.size("hits") > 0, F.transform("hits", lambda h: h["path"])).otherwise(F.coalesce("every", F.array().cast("array<string>"))).alias("images"))


def resolved_paths(refs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """refs (key, declared) with path and how: the very path, else one with the same folder and file name, else one with the
    same file name; the first by name."""
    names = files.select("path", basename(F.col("path")).alias("name"), parent(F.col("path")).alias("folder"))
    pairs = refs.withColumn("name", basename(F.col("declared"))).join(names, "name", "left")
    rank = F.when(F.col("path") == F.col("declared"), 0).when(F.col("folder") == parent(F.col("declared")), 1).when(F.col("path").isNotNull(), 2)
    best = pairs.groupBy(key, "declared").agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("path").alias("path")))).alias("b"))
    how = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.rank") == 0, "exact_path").when(F.col("b.rank") == 1, "basename+parent").otherwise("basename_only")
    return best.select(key, "declared", F.col("b.path").alias("path"), how.alias("how"))


def described(raw: Column) -> Column:
    """struct(summary, parsed): the summary of a model's JSON, fenced or bare; the first 200 characters where there is none."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    value = F.try_parse_json(strip(F.when(fenced != "", fenced).otherwise(raw)))
    summary = F.try_variant_get(value, "$.summary", "string")
    return F.struct(F.coalesce(summary, F.left(raw, F.lit(200))).alias("summary"), value.isNotNull().alias("parsed"))


def fused(chunks: DataFrame, descriptions: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with visual_descriptions: those of its images in their order; chunks without stay, with an empty list."""
    lists = descriptions.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "summary"))), lambda d: d["summary"]).alias("visual_descriptions"))
    return chunks.join(lists, key, "left").withColumn("visual_descriptions", F.coalesce("visual_descriptions", F.array().cast("array<string>")))


def clean_evidence(text: Column) -> Column:
    """Text without image lines, page separators and image file names, and without runs of empty lines."""
    for pattern in (IMAGE_LINE, PAGE_LINE, FILE_LINE):
        text = F.regexp_replace(text, pattern, "")
    return strip(F.regexp_replace(text, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"))


CONDITIONS = ("T", "TL_struct", "TLV")


def packages(chunks: DataFrame) -> DataFrame:
    """Every chunk under each condition, with the evidence that the condition shows."""
    condition = F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition")
    rows = chunks.select("chunk_id", "doc_id", "text", "section_title", "header_level", "images", condition)
    order = F.transform("images", lambda _, i: i + 1)
    structure = F.when(F.col("condition") != "T", F.struct("section_title", "header_level", order.alias("declared_image_order")))
    return rows.select("chunk_id", "doc_id", "condition", F.struct(F.col("text"), structure.alias("document_structure"), F.when(F.col("condition") == "TLV", F.col("images")).alias("images")).alias("evidence"))


def _held(df: DataFrame) -> DataFrame:
    """df, computed once: in the checkpoint folder where one is set, else kept by the executors."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The accepted ones among open chunks that come in id order, each with its text and images."""
    texts: set[str] = set()
    taken: set[str] = set()
    for batch in batches:
        accepted = []
        for i, (text, images) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if text not in texts and not taken.issuperset(images):
                texts.add(text)
                taken.update(images)
                accepted.append(i)
        yield batch.take(pa.array(accepted, pa.int64())).select([0, 1])


def screened(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """chunk_id, decision and reasons of multimodal chunks taken in id order: what a chunk and its images fail by
    themselves, then texts and images that chunks accepted before already have. images: chunk_id, pos, name, bytes, width,
    height, sha256; a null sha256 is unresolved. Who is a duplicate depends on who was accepted, so open chunks are settled
    in rounds: those that are the first open one for their text and for an image are accepted, and then those go whose text
    or whose last image a chunk before them has. One task settles the rest in id order once it has AT_ONCE rows or fewer.
    Which of the two a rejected chunk lacks is told at the end. An id that is repeated counts once, by its least text."""
    c = F.col
    bad = c("sha256").isNull() | c("width").isNull() | (F.least("width", "height") < MIN_PIXELS) | (c("bytes") < MIN_BYTES) | c("name").rlike(COVER)
    rows = images.select("chunk_id", c("sha256").isNull().alias("lost"), F.when(~F.coalesce(bad, F.lit(True)), c("sha256")).alias("good"))
    per = rows.groupBy("chunk_id").agg(F.count_if("lost").alias("lost"))
    reasons = F.array_compact(F.array(
        F.when(c("chars") < MIN_TEXT, F.concat(F.lit("text_too_short:"), c("chars").cast("string"), F.lit(f"<{MIN_TEXT}"))), F.when(c("lost").isNull(), "no_declared_image"), F.when(c("lost") > 0, "image_unresolved"),
    ))
    all_ = chunks.select("chunk_id", F.sha2(squeeze("text"), 256).alias("text"), F.length("text").alias("chars")).join(per, "chunk_id", "left").withColumn("reasons", reasons)
    fit = _held(all_.where(F.size("reasons") == 0).groupBy("chunk_id").agg(F.min("text").alias("text")))
    left = _held(fit.join(rows.where("good is not null").select("chunk_id", c("good").alias("image")).distinct(), "chunk_id"))
    accepted = None
    while True:
        few = left.count() <= AT_ONCE
        if few:
            queue = left.groupBy("chunk_id").agg(F.first("text").alias("text"), F.collect_list("image").alias("images"))
            new = queue.repartition(1).sortWithinPartitions("chunk_id").mapInArrow(_settled, fit.schema)
        else:
            first = left.groupBy("text").agg(F.min("chunk_id").alias("chunk_id"))
            new = first.join(left.groupBy("image").agg(F.min("chunk_id").alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "text")
        new = _held(new)
        accepted = new if accepted is None else accepted.unionByName(new)
        if few:
            break
        taken = left.join(new.select("chunk_id"), "chunk_id", "left_semi").groupBy("image").agg(F.min("chunk_id").alias("by"))
        left = _held(left.join(new.select("text"), "text", "left_anti").join(taken, "image", "left").where("by is null or by > chunk_id").select("chunk_id", "text", "image"))
    judged = fit.join(accepted.select("text", c("chunk_id").alias("owner")), "text", "left")
    why = F.when(c("owner") == c("chunk_id"), F.array().cast("array<string>")).when(c("owner") < c("chunk_id"), F.array(F.concat(F.lit("duplicate_text_of:"), c("owner").cast("string")))).otherwise(F.array(F.lit("no_usable_image_after_screening")))
    done = all_.where(F.size("reasons") > 0).select("chunk_id", "reasons").unionByName(judged.select("chunk_id", why.alias("reasons")))
    return done.select("chunk_id", F.when(F.size("reasons") == 0, "ACCEPT").otherwise("REJECT").alias("decision"), "reasons")


# --- tables ------------------------------------------------------------------------------------


def table_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of two or more lines that start with a bar and end before the text does: first line (from 0), number of lines,
    class, nearest page mark before, and what to do."""
    lines = docs.select(key, F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n").alias("lines"))
    rows = lines.select(key, F.size("lines").alias("total"), F.posexplode("lines").alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    bar = F.col("line").rlike(r"^\s*\|")
    rows = rows.withColumns({"bar": bar, "page": F.last(F.when(F.col("line").rlike(PAGE_MARK), F.regexp_extract("line", PAGE_MARK, 1).cast("int")), True).over(w), "context": F.array_join(F.collect_list("line").over(w.rowsBetween(-10, -1)), "\n")})
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(key, "bar").orderBy("i"))).where("bar")
    first = lambda c: F.min_by(c, "i").alias(c)
    block = rows.groupBy(key, "island").agg(F.min("i").alias("start"), F.max("i").alias("last"), F.first("total").alias("total"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n").alias("block"), first("context"), first("page"))
    low = F.lower("block")
    hits = lambda c, patterns: sum((F.when(c.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
    front = hits(F.col("context"), [f"(?iu){p}" for p in FRONT]) > 0
    words = sum((F.when(low.contains(k), 1).otherwise(0) for k in LEGAL), F.lit(0))
    kind = F.when(front, "toc_or_front_matter").when(hits(F.col("block"), SCAN_FAULTS) >= 2, "ocr_artifact").when(words >= 2, "qa_candidate").when(words == 1, "borderline_review").otherwise("ocr_artifact")
    action = F.when(F.col("kind") == "qa_candidate", "KEEP_AS_IS").when(F.col("kind") == "borderline_review", "REVIEW").otherwise("DISCARD")
    return block.where("n_lines >= 2 and last < total - 1").withColumn("kind", kind).select(key, "start", "n_lines", "kind", F.coalesce("page", F.lit(-1)).alias("page"), action.alias("action"))


def gap_triage(visual_type: Column, reason: Column, confidence: Column, action: Column) -> Column:
    """struct(issue, severity, action) of a candidate that extraction may have missed."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    sure = F.coalesce(confidence, F.lit(3))
    issue = F.when(low.contains("rasterized") | low.contains("text-page"), "rasterized_text_page").when((sure >= 4) & (visual_type == "table"), "structured_table_candidate").when(sure <= 2, "low_confidence_gap").otherwise("gap_candidate")
    by = lambda **k: F.coalesce(*[F.when(issue == name, v) for name, v in k.items()])
    return F.struct(
        issue.alias("issue"), by(rasterized_text_page="high", structured_table_candidate="none", low_confidence_gap="medium", gap_candidate="low").alias("severity"),
        by(rasterized_text_page="DISCARD", structured_table_candidate="KEEP_AS_IS", low_confidence_gap="REVIEW", gap_candidate=F.coalesce(action, F.lit("KEEP_AS_IS"))).alias("action"),
    )


# --- binary ------------------------------------------------------------------------------------


def png_size(content: Column) -> Column:
    """struct(width, height) of a PNG's header, null for other files."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from a JPEG's frame header within the first 64 KiB; null for other files."""

    def one(raw: bytes | None) -> tuple[int | None, int | None]:
        raw, at = (raw or b"")[: 1 << 16], 2
        while raw[:2] == b"\xff\xd8" and at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
            at += 2 + size
        return None, None

    return pd.DataFrame([one(x) for x in content], columns=["width", "height"]).astype("Int32")


def is_pdf(content: Column, content_type: Column, least: int = 50_000) -> Column:
    """Whether a download is a PDF of some size."""
    return (F.octet_length(content) >= least) & ((F.hex(F.substring(content, 1, 4)) == "25504446") | F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False)))


def page_candidate(rects: Column, lines: Column, curves: Column, big_image: Column, text_length: Column) -> Column:
    """Why a page may hold a diagram, null if it doesn't."""
    return F.when((rects >= MIN_RECTS) & (lines >= MIN_RECTS), "rects_and_lines").when(curves >= MIN_CURVES, "curves").when(rects >= MANY_RECTS, "rects").when(big_image & (text_length < SHORT_TEXT), "image_page")


def diagram_score(boxes: Column, long_lines: Column, horizontal: Column, vertical: Column, ink: Column) -> Column:
    """Score of a page's drawing, null if it is no diagram."""
    return F.when((boxes >= 3) & (long_lines >= 4) & (ink > 0.01) & (ink < 0.22), 2 * boxes + long_lines + horizontal + vertical)


def scan_books(pages: DataFrame, book: str, length: str) -> DataFrame:
    """The three tests for scanned books: median text length below 80, upper median below 50, mean of twelve pages spread
    over the book below 60."""
    w = Window.partitionBy(book)
    ranked = pages.withColumns({"_r": F.row_number().over(w.orderBy(length)) - 1, "_p": F.row_number().over(w.orderBy("page")) - 1, "_n": F.count("*").over(w)})
    upper = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col(length)))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / 12))
    twelve = F.avg(F.when((F.col("_p") % step == 0) & (F.col("_p") / step < 12), F.col(length)))
    return ranked.groupBy(book).agg((F.median(length) < 80).alias("scan_cost"), (upper < 50).alias("scan_rank"), (twelve < 60).alias("scan_sample"))


def family(model: Column) -> Column:
    """What stands before the slash of a model's name."""
    return F.when(model.contains("/"), F.lower(F.substring_index(model, "/", 1))).otherwise("")


def role_faults(roles: DataFrame) -> DataFrame:
    """One row: whether generator and judge are the same model or in the evaluated set, and whether they share a family.
    roles: role, model."""
    one = lambda r: F.max(F.when(F.col("role") == r, F.col("model")))
    t = roles.agg(one("generator").alias("g"), one("judge").alias("j"), F.collect_set(F.when(F.col("role") == "subject", F.col("model"))).alias("s"))
    return t.select((F.col("g") == F.col("j")).alias("same_model"), (F.array_contains("s", F.col("g")) | F.array_contains("s", F.col("j"))).alias("in_subjects"), ((family(F.col("g")) != "") & (family(F.col("g")) == family(F.col("j")))).alias("same_family"))
