"""Column functions over text: white space, labels, answers, sentences, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip and str.split see it.
WS = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(col(c), rf"(?U)^{WS}+|{WS}+$", "")


def squeeze(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), rf"(?U){WS}+", " "))


def normalize(c: Column | str) -> Column:
    """Lower case, squeezed."""
    return squeeze(F.lower(col(c)))


#: What full case folding makes of characters that lower-casing leaves or makes otherwise, by Unicode's own rule.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0xFB18)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and c.casefold() != c}


def casefold(c: Column | str) -> Column:
    """Full case folding: lower case, and ß as ss and the like where such characters occur."""
    low = F.lower(col(c))
    table = F.create_map(*[F.lit(x) for kv in _FOLDED.items() for x in kv])
    each = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(low.rlike("[" + "".join(_FOLDED) + "]"), each).otherwise(low)


def fold_normalize(c: Column | str) -> Column:
    """Case-folded, squeezed."""
    return squeeze(casefold(c))


def capitalize(c: Column | str) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.left(col(c), F.lit(1))), F.lower(F.substring(col(c), 2, 1 << 30)))


def word_count(c: Column | str) -> Column:
    s = squeeze(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " "))).cast("bigint")


def truncate_context(c: Column | str, most: int) -> Column:
    """Squeezed text of at most `most` characters: its start, or 70 % start and the end of what fits."""
    s = squeeze(c)
    if most <= 0:
        return s
    head = int(most * 0.7)
    tail = most - head - 5
    if most < 400 or tail <= 0:
        return F.when(F.length(s) <= most, s).otherwise(F.rtrim(F.left(s, F.lit(most))))
    cut = F.concat(F.rtrim(F.left(s, F.lit(head))), F.lit("\n...\n"), F.ltrim(F.right(s, F.lit(tail))))
    return F.when(F.length(s) <= most, s).otherwise(cut)


def sentences(c: Column | str, least: int = 25) -> Column:
    """Parts that end at . ; : ! ? before white space, or at a line end, with at least `least` characters."""
    parts = F.transform(F.split(col(c), r"(?<=[.;:!?])\s+|\n+"), strip)
    return F.filter(parts, lambda s: F.length(s) >= least)


def excerpt(c: Column | str, words: Column | int) -> Column:
    """The first so many words."""
    n = words if isinstance(words, Column) else F.lit(words)
    return F.array_join(F.slice(F.split(squeeze(c), " "), F.lit(1), n), " ")


def excerpt_budget(c: Column | str, anchors: int, share: float = 0.35, most: int = 40) -> Column:
    """Words that each of so many excerpts may take."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(word_count(c) * share / anchors))).cast("bigint")


def file_slug(c: Column | str, most: int = 80) -> Column:
    """A file name from a URL: its last part without query, other characters as one underscore, and a digest's start."""
    part = F.regexp_extract(col(c), r"([^/?#]*)/?(?:[?#].*)?$", 1)
    plain = F.regexp_replace(F.regexp_replace(part, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.concat_ws("_", F.when(plain != "", F.left(plain, F.lit(most))), F.left(F.sha2(col(c), 256), F.lit(10)))


def query_slug(c: Column | str, most: int = 60) -> Column:
    """A search query as a file name: ASCII letters and digits, others as one dash."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(most))


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(col(c)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(strip(s), r"(?U)[\s_-]+", "_")
