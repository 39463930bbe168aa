"""Operators over crawled assets, page signals and visual checks: decision ladders as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL tokens of the asset rules.
DROP_TOKENS = ("logo", "favicon", "spcommon", "background", "bg-", "bg_", "banner", "bn_", "rss", "icon", "login", "footer", "header", "weather", "football", "mask", "backgroun", "attach-icon", "gg.png", "ftscore", "camera-icon")
KEEP_TOKENS = ("nghi-quyet", "nghi_dinh", "nghi-dinh", "thong-tu", "cong-van", "du-thao", "luat", "phap-luat", "tro-giup-phap-ly", "tuyen-truyen", "pbgdpl", "huong-dan", "infographic", "info-graphic", "quy-trinh", "thu-tuc", "hoi-dap", "dap-an")
BAD_TOKENS = ("logo", "favicon", "spcommon", "bg-", "bg_", "background", "banner", "header", "footer", "rss", "icon", "login", "weather", "football", "mask", "feedback")
GOOD_TOKENS = ("nghi-quyet", "nghi-dinh", "thong-tu", "cong-van", "du-thao", "luat", "phap-luat", "tro-giup-phap-ly", "thu-tuc", "quy-trinh", "huong-dan", "infographic", "pbgdpl", "tuyen-truyen")
# Subject by the leading number of a document's name.
DOMAINS = {
    4: "History of Law", 10: "Legislative Drafting", 11: "Legal Theory", 12: "Legal Theory", 13: "Civil Law I", 14: "Civil Law II", 15: "Commercial Law I", 16: "Commercial Law II",
    17: "Constitutional Law VN", 18: "Constitutional Law VN", 19: "Comparative Constitutional", 20: "Comparative Law", 21: "Administrative Law", 22: "Admin. Procedure", 23: "Environmental Law",
    24: "Civil Procedure", 25: "Family Law", 26: "Criminal Law (General)", 27: "Criminal Law (Specific)", 28: "Criminal Procedure", 29: "Tax / Budget Law", 30: "Banking Law",
    31: "International Law", 32: "International Law", 33: "Private International Law", 34: "Intl. Commercial Law", 36: "Intl. Economic Law", 37: "Land Law", 38: "Labor Law", 39: "IP Law",
    40: "Forensic Psychology", 41: "Competition Law", 42: "Civil Registration", 43: "Legal Practice", 46: "Criminology", 47: "Criminal Qualification", 48: "Social Security Law",
    49: "Notarization Law", 50: "Inheritance Law", 51: "Real Estate Law", 52: "Land Dispute Law", 53: "Contract Skills",
}


def kind(url: Column, content_type: Column) -> Column:
    """What an asset is, by its URL's ending or its type: pdf, image or page."""
    bare = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    given = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(bare.endswith(".pdf") | given.contains("pdf"), "pdf").when(bare.rlike(r"\.(?:png|jpe?g|gif|webp)$") | given.startswith("image/"), "image").otherwise("page")


def any_of(c: Column, tokens: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | c.contains(t)
    return out


def triage(url: Column, name: Column, kind: Column) -> Column:
    """Label of an asset by its URL, file name and content type."""
    hay = F.concat_ws(" ", F.lower(url), F.lower(name))
    pdf = F.lower(kind).contains("pdf") | F.substring_index(F.lower(url), "?", 1).endswith(".pdf")
    return (
        F.when(pdf & any_of(hay, KEEP_TOKENS), "keep_pdf").when(pdf, "needs_review_pdf").when(any_of(hay, DROP_TOKENS), "drop_static").when(any_of(hay, KEEP_TOKENS), "keep_image_candidate")
        .when(hay.contains("/anhdaidien/") | hay.contains("publishingimages/tintuc") | F.lower(kind).contains("image"), "needs_vision").otherwise("drop_unknown")
    )


def shortlist(url: Column, label: Column, width: Column, height: Column) -> Column:
    """Decision on a triaged asset by size, shape and tokens."""
    u = F.lower(url)
    thin = (width / F.greatest(height, F.lit(1.0)) > 5) | (height / F.greatest(width, F.lit(1.0)) > 5)
    return (
        F.when((label == "needs_review_pdf") | u.endswith(".pdf"), "keep_pdf_for_render").when(any_of(u, BAD_TOKENS), "drop_static").when((width < 350) | (height < 250), "drop_too_small")
        .when(thin, "drop_banner_shape").when(any_of(u, GOOD_TOKENS) | (label == "needs_vision"), "candidate_image_for_vision").otherwise("drop_low_signal")
    )


def same_host(host: Column, own: str) -> Column:
    return (host == own) | host.endswith("." + own)


def page_reason() -> Column:
    """Why a page may hold a diagram, from its signals; null if it may not."""
    return F.when((F.col("rects") >= 3) & (F.col("lines") >= 3), "rects_lines").when(F.col("curves") >= 6, "curves").when(F.col("rects") >= 5, "rects").when((F.col("big_imgs") >= 1) & (F.col("txt_len") < 300), "big_image")


def audit_issue(kind: Column, relevance: Column, confidence: Column, page: Column, action: Column) -> Column:
    """Issue of an audited image."""
    return (
        F.when((F.upper(action) == "DISCARD") | kind.isin("noise", "duplicate"), "irrelevant_or_noise").when((page == 0) & kind.isin("noise", "diagram"), "front_matter")
        .when((relevance >= 3) & (confidence >= 3), "qa_candidate").when(relevance <= 2, "low_legal_relevance").otherwise("borderline")
    )


def box_problem(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """First fault of a normalised box, null if it is sound."""
    area = (x1 - x0) * (y1 - y0)
    return (
        F.when((F.least(x0, y0, x1, y1) < 0) | (F.greatest(x0, y0, x1, y1) > 1), "bbox_not_normalised").when((x1 <= x0) | (y1 <= y0), "bbox_degenerate")
        .when(area >= 0.8, "bbox_covers_whole_page").when(area < 0.0004, "bbox_too_small")
    )


def subject(c: Column, default: str) -> Column:
    """Subject of an id's leading number; the default for a number that has none or an id without."""
    table = F.create_map(*[F.lit(x) for k, v in DOMAINS.items() for x in (str(k), v)])
    return F.coalesce(F.try_element_at(table, F.regexp_extract(c, r"^\s*(\d+)", 1)), F.lit(default))


def multimodal(flag: Column, visuals: Column) -> Column:
    """A set flag, or visuals where it is not set."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.size(visuals) > 0, F.lit(False))


def domain(*ids: Column) -> Column:
    """Subject of the first id that starts with a number: Other if the number is unknown; unknown without any."""
    table = F.create_map(*[F.lit(x) for k, v in DOMAINS.items() for x in (str(k), v)])
    numbers = [F.regexp_extract(i, r"^\s*(\d+)", 1) for i in ids]
    return F.coalesce(*[F.when(n != "", F.coalesce(F.try_element_at(table, n), F.lit("Other"))) for n in numbers], F.lit("unknown"))


def crawl(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], host: str, steps: int, keywords: tuple[str, ...] = (), least: int = 0, most: int | None = None) -> DataFrame:
    """(url, depth) of the pages reached from start (url) over links within a host, so many steps deep. fetch gives url
    and html of those it can get; pages of fewer bytes than `least` are passed over, links need one of the keywords
    where there are any, and `most` ends the crawl after the step that reaches so many pages."""
    from quillspark.operators.documents import links

    seen = start.distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, steps + 1):
        pages = fetch(frontier.select("url")).where(F.octet_length("html") >= least)
        found = links(pages, "url", "html", escaped=True).select(F.col("link").alias("url")).distinct()
        found = found.where(same_host(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), host))
        if keywords:
            found = found.where(any_of(F.lower("url"), keywords))
        frontier = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(frontier)
        if most is not None and seen.count() >= most:
            break
    return seen
