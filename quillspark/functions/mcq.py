"""Column functions for multiple-choice items: labels, answer texts, resolution, letters, XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import capitalize, col, normalize, squeeze, strip

# Label, tag, note and artifact patterns of the item format.
LABEL = r"(?i)^([A-D])[\s.):\-]+"
GROUND_TRUTH = r"(?is)<ground_truth>(.*?)(?:</ground_truth>|$)"
TRAILING_NOTE = r"(?iu)\s*\((?:full correct answer text|đây là đáp án.*?|.*?correct answer text.*?)\)\s*$"
SCAFFOLD_NOTE = r"(?i)\s*\((?:full correct answer text|correct answer text)\)\s*"
CJK = r"[\x{4e00}-\x{9fff}]"
ENGLISH_META = r"(?i)\b(correct answer is|because|therefore|in this case)\b"
PROMPT_LEAK = r"(?iu)(<qa_pair>|Bloom's Taxonomy|only the xml tags|XML格式|根据提供的背景信息)"
SYLLOGISM = ("tiền đề", "kết luận")


def choice_label(c: Column | str) -> Column:
    """A-D before a separator, null if none."""
    found = F.regexp_extract(strip(c), LABEL, 1)
    return F.when(found != "", F.upper(found))


def strip_label(c: Column | str) -> Column:
    return strip(F.regexp_replace(strip(c), LABEL, ""))


def strip_notes(c: Column | str) -> Column:
    return strip(F.regexp_replace(strip(c), TRAILING_NOTE, ""))


def embedded_truth(c: Column | str) -> Column:
    """The body of the last ground-truth tag, or the text."""
    found = F.regexp_extract_all(strip(c), F.lit(GROUND_TRUTH), F.lit(1))
    return strip(F.replace(F.coalesce(F.try_element_at(found, F.lit(-1)), strip(c)), F.lit("</ground_truth>"), F.lit("")))


def canonical(c: Column | str) -> Column:
    return normalize(strip_notes(strip_label(embedded_truth(c))))


def truth_variants(c: Column | str) -> Column:
    """Readings of a ground truth, most literal first."""
    c = col(c)
    all_ = F.array(strip(c), embedded_truth(c), strip_notes(c), strip_notes(embedded_truth(c)), strip_label(c), strip_label(embedded_truth(c)), canonical(c))
    return F.array_distinct(F.filter(all_, lambda x: x != ""))


def clean_option(c: Column | str) -> Column:
    """Option text without label and note, spaces squeezed, letter case kept."""
    return squeeze(strip_notes(strip_label(c)))


def resolve(options: Column, truth: Column) -> Column:
    """struct(method, index from 0 or null): exact_full, payload_match, label_only, else unresolved; first variant and first option win."""
    full, payload = F.transform(options, normalize), F.transform(options, canonical)
    variants = truth_variants(truth)
    place = lambda pool, f: F.try_element_at(F.filter(F.transform(variants, lambda v: F.array_position(pool, f(v))), lambda i: i > 0), F.lit(1)) - 1
    label = F.array_position(F.transform(options, lambda o: F.coalesce(choice_label(o), F.lit(""))), choice_label(truth))
    exact, match = place(full, normalize), place(payload, canonical)
    only = F.when((label > 0) & (canonical(truth) == ""), label - 1)
    method = (
        F.when(options.isNull(), "candidates_not_list").when(F.size(options) == 0, "no_candidates")
        .when(exact.isNotNull(), "exact_full").when(match.isNotNull(), "payload_match").when(only.isNotNull(), "label_only").otherwise("unresolved")
    )
    return F.struct(method.alias("method"), F.coalesce(exact, match, only).cast("bigint").alias("index"))


def with_resolution(items: DataFrame, options: str, truth: str) -> DataFrame:
    """items with _method and _index as resolve() gives them, and _variants and _payload, canonical. Every step is a column
    that the next ones refer to, so nothing is evaluated twice and the plan stays small."""
    first = lambda pool, texts: F.try_element_at(F.filter(F.transform(texts, lambda v: F.array_position(pool, v)), lambda i: i > 0), F.lit(1)) - 1
    c, names = F.col, items.columns
    rows = items.withColumns({"_t": strip(truth), "_e": embedded_truth(truth), "_full": F.transform(options, normalize), "_payload": F.transform(options, canonical), "_letters": F.transform(options, lambda o: F.coalesce(choice_label(o), F.lit("")))})
    rows = rows.withColumns({"_tn": strip_notes("_t"), "_en": strip_notes("_e"), "_tl": strip_label("_t"), "_el": strip_label("_e")}).withColumn("_canon", normalize(strip_notes("_el")))
    rows = rows.withColumn("_v", F.array_distinct(F.filter(F.array("_t", "_e", "_tn", "_en", "_tl", "_el", "_canon"), lambda x: x != "")))
    rows = rows.withColumns({"_plain": F.transform("_v", normalize), "_variants": F.transform("_v", canonical), "_label": F.array_position("_letters", choice_label(truth))})
    rows = rows.withColumns({"_x": first(c("_full"), c("_plain")), "_m": first(c("_payload"), c("_variants")), "_o": F.when((c("_label") > 0) & (c("_canon") == ""), c("_label") - 1)})
    method = (
        F.when(c(options).isNull(), "candidates_not_list").when(F.size(options) == 0, "no_candidates")
        .when(c("_x").isNotNull(), "exact_full").when(c("_m").isNotNull(), "payload_match").when(c("_o").isNotNull(), "label_only").otherwise("unresolved")
    )
    return rows.select(*names, method.alias("_method"), F.coalesce("_x", "_m", "_o").cast("bigint").alias("_index"), "_variants", "_payload")


def letter(index: Column) -> Column:
    return F.char(index + 65)


def answer_letter(c: Column | str) -> Column:
    """The letter that a model's output chooses, N/A if none."""
    t = F.upper(strip(c))
    start, said = F.regexp_extract(t, r"^[ ]*([A-D])[\s:.)]", 1), F.regexp_extract(t, r"CORRECT ANSWER IS[ ]*([A-D])", 1)
    return F.when(start != "", start).when(said != "", said).when((F.length(t) < 50) & t.rlike("[A-D]"), F.regexp_extract(t, "([A-D])", 1)).otherwise("N/A")


def sanitize(c: Column | str) -> Column:
    """Text without scaffold notes: unix line ends, single blanks, at most one empty line, lines stripped."""
    t = F.regexp_replace(col(c), SCAFFOLD_NOTE, "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def artifacts(c: Column | str) -> Column:
    """Reasons why a sanitised text is no clean target-language text, in fixed order."""
    t = sanitize(c)
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in (("cjk_chars", CJK), ("english_meta", ENGLISH_META), ("prompt_leak", PROMPT_LEAK))]))


def tag_text(c: Column | str, tag: str) -> Column:
    """The body of the first such tag, null if there is none."""
    found = F.regexp_extract_all(col(c), F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.try_element_at(found, F.lit(1))


def parse_scores(c: Column | str) -> Column:
    """struct of a judge's scores; null if a numeric tag is missing. A tag with a 1 in it counts as 1."""
    one = lambda tag: F.when(tag_text(c, tag).contains("1"), 1.0).otherwise(0.0)
    g, m, f = (one(t) for t in ("groundedness", "multimodal_alignment", "legal_fluency"))
    level = F.coalesce(capitalize(strip(tag_text(c, "taxonomy_level"))), F.lit("Understand"))
    whole = tag_text(c, "groundedness").isNotNull() & tag_text(c, "multimodal_alignment").isNotNull() & tag_text(c, "legal_fluency").isNotNull()
    overall = F.when((g == 1) & (f == 1), 1.0).otherwise(0.0)
    return F.when(whole, F.struct(g.alias("groundedness"), m.alias("multimodal_alignment"), f.alias("legal_fluency"), level.alias("taxonomy_level"), F.coalesce(strip(tag_text(c, "justification")), F.lit("")).alias("justification"), overall.alias("overall")))


def parse_qa_pairs(c: Column | str) -> Column:
    """Array of structs, one for each complete question block; blocks with artifacts are dropped."""
    blocks = F.regexp_extract_all(col(c), F.lit(r"(?is)<qa_pair>(.*?)</qa_pair>"), F.lit(1))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(col(c)))

    def one(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(strip(tag_text(b, "candidate_answers")), "\n"), strip), lambda x: x != "")
        marked = F.filter(lines, lambda x: x.rlike(r"^[A-E][.)]"))
        options = F.transform(F.when(F.size(marked) >= 2, marked).otherwise(lines), sanitize)
        return F.struct(sanitize(tag_text(b, "question")).alias("question"), options.alias("candidate_answers"), sanitize(tag_text(b, "ground_truth")).alias("ground_truth"), sanitize(tag_text(b, "legal_rationale")).alias("legal_rationale"))

    rows = F.filter(F.transform(blocks, one), lambda r: r["question"].isNotNull() & r["candidate_answers"].isNotNull() & r["ground_truth"].isNotNull() & r["legal_rationale"].isNotNull())
    return F.filter(rows, lambda r: F.size(artifacts(F.concat_ws(" ", r["question"], r["ground_truth"], r["legal_rationale"], F.array_join(r["candidate_answers"], " ")))) == 0)
