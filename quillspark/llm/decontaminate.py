"""Benchmark decontamination (op 9): pigeonhole edit matching.

Texts and items are compared as sequences of letters and digits, lower-cased, with every run of
other characters as one space. An item of m characters may be met with up to k = floor(m * RATE)
edits. It is cut into k + 1 pieces of nearly equal size; k edits leave at least one piece
untouched, so every match contains an exact piece at its place. An Aho-Corasick automaton
over all pieces finds them in one pass over a text; the windows around hits are merged and
verified with Myers' bit-parallel distance (the item's best match ends anywhere in the window).

The items are read in blocks of at most BLOCK_CHARS characters; each block is broadcast and makes
one pass over the documents, so the broadcast has a fixed bound however large the benchmark is.

Cases: null and empty texts meet nothing; items that are null or have no letter or digit are met by
nothing. Items shorter than 1 / RATE characters must occur exactly and as whole words, so that a short item isn't
met inside longer words. Equal items all report. An item met more than once in a text is reported once, with its least
distance (ties can't be told apart in the result). Repeated rows are reported each. Texts of any length are searched
whole: windows around hits that touch are verified as one. Empty tables give an empty result. Only the named columns
are read by matches; decontaminate keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import small_batches, tidy

RATE = 0.08
BLOCK_CHARS = 4_000_000
#: Characters of the grams that rule windows out before the distance is computed.
Q = 5
_OTHER = re.compile(r"[\W_]+", re.UNICODE)


def plain(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Offset and text of each of budget + 1 pieces."""
    n, k = len(item), budget + 1
    edges = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def grams(text: str) -> set[str]:
    return {text[i : i + Q] for i in range(len(text) - Q + 1)}


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of a pattern of m characters to a substring of text, and where the first such ends; None beyond `most`."""
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = full, 0, m, (most + 1, -1)
    get = masks.get
    for i, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, i + 1)
            if not score:
                break
    return best if best[0] <= most else None


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        # texts are searched with a space at either end; an item that must occur exactly brings its own
        self.items = [(i, p if (budget := int(len(p) * rate)) else f" {p} ", budget) for i, t in items if (p := plain(t))]
        self.masks: dict[int, dict[str, int]] = {}
        self.grams: dict[int, set[str]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, p, budget) in enumerate(self.items):
            for offset, piece in pieces(p, budget):
                where.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.automaton.add_word(piece, (len(piece), hits))
        if where:
            self.automaton.make_automaton()

    def mask(self, number: int) -> dict[str, int]:
        if number not in self.masks:
            made: dict[str, int] = {}
            for i, ch in enumerate(self.items[number][1]):
                made[ch] = made.get(ch, 0) | 1 << i
            self.masks[number] = made
        return self.masks[number]

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, least distance) of every item that the text holds within its budget."""
        p = f" {plain(text)} "
        if p == "  " or not self.items:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, hits) in self.automaton.iter(p):
            for number, offset in hits:
                starts.setdefault(number, []).append(end + 1 - size - offset)
        found = []
        for number, at in starts.items():
            item_id, item, budget = self.items[number]
            best = budget + 1
            lo = hi = None
            for s in sorted(set(at)):  # windows that overlap are verified as one
                a, b = max(0, s - budget), s + len(item) + budget
                if hi is not None and a <= hi:
                    hi = max(hi, b)
                    continue
                if hi is not None:
                    best = min(best, self._distance(number, p[lo:hi], best))
                lo, hi = a, b
            best = min(best, self._distance(number, p[lo:hi], best))
            if best <= budget:
                found.append((item_id, best))
        return sorted(found)

    def _distance(self, number: int, window: str, known: int) -> int:
        _, item, _ = self.items[number]
        if known > 0 and item in window:
            return 0
        if number not in self.grams:
            self.grams[number] = grams(item)
        if len(self.grams[number] - grams(window)) > Q * (known - 1):
            return known  # each edit takes at most Q grams of the item away
        hit = myers(self.mask(number), len(item), window, known - 1) if known > 0 else None
        return hit[0] if hit else known


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition after the other."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance. No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, distance int"
    out = None
    texts = docs.select(doc_id, text_col)
    item_type = to_arrow_type(items.schema[item_id].dataType)
    for block in item_blocks(items, item_id, text_col):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    rows += [(i, item, d) for item, d in matcher.matches(text)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.int32())],
                    [doc_id, item_id, "distance"],
                )

        found = texts.mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The documents, all columns, that hold no item. One pass for each block of items, no shuffle."""
    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)
    for block in item_blocks(items, item_id, text_col):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(x.as_py()) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs
