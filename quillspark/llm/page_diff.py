"""Main text of web pages (op 6): nearest-URL page differencing.

Every page becomes its lines of text, one a block, each with the zone its markup gives it. Pages
are ordered by (host, path, id); a page is paired with the neighbour in that order on the same host
whose path shares the longer prefix (ties: the one before). The lines of both are aligned by longest
common subsequence (bit-parallel, whole pages), and shared lines are deleted: they belong to the
site, not to the page. An exact check of the markup follows. A shared line of the page's main
container (article, main) comes back if it is the container's own text (its h1, bare paragraphs) or
stands in a kind of box that holds unshared text too: that is article text which happens to recur.
A kind of box is an element with a class, or a further container, inside the container or beside it,
told by its name and class and those around it; one that holds nothing but shared lines stays deleted. A line in
a zone that can't be article text (navigation, page header and footer, asides, adverts, notices,
forms, scripts, reader comments), or outside the main container of a page that has one, goes as well.

Hosts may hold any share of the pages: pages are dealt to ranges of the order, and each range also
gets the page before and after it, so every page meets its true neighbours and no host has to fit
in a task. The driver gets a bounded sample of keys and two keys a range.

Cases: null html has no text; null URLs count as host '' and path ''. Equal URLs are ordered by id;
a page that is alone on its host has no shared lines. A copy can't tell a site's lines from the page's own, so
a page is not paired with one: the other neighbour is taken, or none. With a main container, a copy is a page that shares
half of the container's text or more; without, one that is equal outside side zones. Repeated rows give repeated results. Empty
table: empty result. Only the named columns are read. No text is cut.
"""

from __future__ import annotations

import html as html_lib
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import dealt as dealt_by
from quillspark.llm.common import parts_for, small_batches

#: HTML's elements whose text is no text, those that start a new block, and those without an end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and attribute words of zones that hold no article text; roles likewise.
SIDE = {"nav", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "svg", "object", "fieldset", "label"}
SIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|notice|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|commentlist|replies|respond|disqus|footer|masthead|header|toolbar|pagination|pager|widget|alert|disclaimer)(?:$|[\s_-])", re.IGNORECASE)
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
MAIN_WORDS = re.compile(r"(?:^|\s)(?:article-body|article-content|post-body|post-content|entry-content|main-content|story-body|content-main)(?:$|\s)", re.IGNORECASE)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
#: Elements that make a kind of box by their class, inside a main container.
BOXES = set("address article center details div dl figure main ol p section table ul".split())
_CLASS = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Zones; any number above OUT is a kind of box inside the main container.
PLAIN, MAIN, OUT = 0, 1, 2


def in_main(zone: int) -> bool:
    return zone == MAIN or zone > OUT


def _zone(name: str, attributes: str, outer: int) -> int:
    """The zone inside an element that stands in zone `outer`."""
    if outer == OUT or name in SIDE or (name == "header" and not in_main(outer)):
        return OUT
    for m in _ATTR.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in SIDE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return OUT
        if key == "role" and value.lower() in ("main", "article"):
            return MAIN
        if key in ("class", "id"):
            if name not in ("article", "main", "body", "html") and SIDE_WORDS.search(value):
                return OUT
            if MAIN_WORDS.search(value):
                return MAIN
    return MAIN if name in ("article", "main") else outer


class Lines(list):
    """(text, zone) of every block that has text, in page order; outer[k - OUT - 1] is the zone around the kind of boxes k."""

    outer: tuple[int, ...] = ()


class _Kinds:
    """Numbers the kinds of boxes in a page's main container."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str, str], int] = {}
        self.made: list[tuple[int, str, str]] = []
        self.first: tuple[str, str] | None = None
        self.title = False

    def zone(self, name: str, attributes: str, outer: int, inner: int) -> int:
        """The zone inside an element within the main container, given the one that _zone tells."""
        if in_main(outer) and name not in BLOCKS:
            return outer
        if name == "h1" and in_main(outer) and not self.title:
            self.title = True
            return MAIN
        further = inner == MAIN and (outer != MAIN or name in ("article", "main"))
        found = _CLASS.search(attributes) if attributes and (further or name in BOXES) else None
        kind = re.sub(r"\d+", "0", " ".join(sorted((found[1] or found[2] or found[3] or "").split()))) if found else ""
        if not in_main(outer):  # a page's first container, and those like it, have no kind
            self.first = self.first or (name, kind)
            if self.first == (name, kind):
                return MAIN
        elif not kind and not further:
            return inner
        at = outer
        while at > OUT:  # elements whose end tags were left out nest in their like
            key = self.made[at - OUT - 1]
            if key[1:] == (name, kind):
                return at
            at = key[0]
        key = (outer, name, kind)
        if key not in self.numbers:
            self.made.append(key)
            self.numbers[key] = OUT + len(self.made)
        return self.numbers[key]


def page_lines(page: str | None) -> Lines:
    """The lines of a page."""
    lines = Lines()
    if not page:
        return lines
    stack: list[tuple[str, int]] = []
    kinds = _Kinds()
    parts: list[str] = []
    zone, at, size = PLAIN, 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, zone))

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                parts.append(token)
            continue
        name = name.lower()
        if m[1]:  # an end tag closes what is open inside its element; without one it means nothing
            if any(n == name for n, _ in stack):
                if name in BLOCKS:
                    close()
                while True:
                    n, before = stack.pop()
                    if n in BLOCKS:
                        close()
                    zone = before
                    if n == name:
                        break
            elif name in BLOCKS:
                close()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (size if not m[3].endswith("/") else at)
            continue
        if name in BLOCKS:
            close()
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                zone = stack.pop()[1]  # its end tag was left out
        if name not in VOID and not m[3].endswith("/"):
            inner = _zone(name, m[3], zone)
            if in_main(inner):
                inner = kinds.zone(name, m[3], zone, inner)
            if inner != zone:
                close()
            stack.append((name, zone))
            zone = inner
    close()
    if kinds.made:
        lines.outer = tuple(key[0] for key in kinds.made)
    return lines


def shared(a: list, b: list) -> set[int]:
    """Indexes of a that a longest common subsequence with b takes."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    y = [s for s in y if s in set(x)] if x else []
    if not x or not y:
        return out
    masks: dict = {}
    for i, s in enumerate(x):
        masks[s] = masks.get(s, 0) | 1 << i
    full = (1 << len(x)) - 1
    v, rows = full, [full]
    for s in y:
        m = masks[s]
        v = ((v + (v & m)) | (v & ~m)) & full
        rows.append(v)
    # length of the common subsequence of x[:i] and y[:j]: zeros among the low i bits of rows[j]
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    i, j = len(x), len(y)
    now = length(i, j)
    while now:
        if length(i - 1, j) == now:
            i -= 1
        elif length(i, j - 1) == now:
            j -= 1
        else:
            i, j, now = i - 1, j - 1, now - 1
            out.add(head + i)
    return out


def deleted(lines: Lines, other: Lines) -> set[int]:
    """Indexes of the lines that a page shares with another. Lines of a main container don't meet side zones' lines."""
    if any(in_main(z) for _, z in lines):
        return shared([(t, z == OUT) for t, z in lines], [(t, z == OUT) for t, z in other])
    return shared([t for t, _ in lines], [t for t, _ in other])


def tells_apart(lines: Lines, other: Lines) -> bool:
    """Whether a page differs enough from another for shared lines to be the site's."""
    if not any(in_main(z) for _, z in lines):
        return [t for t, z in other if z != OUT] != [t for t, z in lines if z != OUT]
    if not lines.outer:
        return True  # all of the container comes back anyway
    gone = deleted(lines, other)
    inside = [(len(t), i in gone) for i, (t, z) in enumerate(lines) if in_main(z)]
    return 2 * sum(n for n, met in inside if met) < sum(n for n, _ in inside)


def main_text(lines: Lines, other: Lines | None) -> str:
    """What is left of a page after its shared lines are deleted and the markup is checked."""
    gone = deleted(lines, other) if other else set()
    has_main = any(in_main(z) for _, z in lines)
    owning: set[int] = set()
    for z in {z for i, (_, z) in enumerate(lines) if i not in gone}:
        while z > OUT and z not in owning:
            owning.add(z)
            z = lines.outer[z - OUT - 1]
    kept = []
    for i, (text, zone) in enumerate(lines):
        if zone == MAIN or zone in owning or (zone == PLAIN and not has_main and i not in gone):
            kept.append(text)
    return " ".join(kept)


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, both lower-cased."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
    return (m[1].lower(), m[2].lower()) if m else ("", (url or "").lower())


def order_key(url: str | None, page_id: object) -> str:
    host, path = url_key(url)
    number = f"{page_id:020d}" if isinstance(page_id, int) and page_id >= 0 else str(page_id)
    return f"{host}\x01{path}\x01{number}"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ranges: int | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars. One shuffle, of the lines."""
    spark = pages.sparkSession
    small_batches(spark)
    ranges = ranges or parts_for(pages, 4)
    id_kind = pages.schema[id_col].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [order_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["key"])

    keyed = pages.select(id_col, url_col).mapInArrow(keys, "key string")
    sample = sorted(r["key"] for r in keyed.orderBy(F.xxhash64("key"), "key").limit(20 * ranges).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low: dict[int, str] = {}
            high: dict[int, str] = {}
            for key in batch.column(0).to_pylist():
                p = bisect_right(cuts, key)
                low[p], high[p] = min(low.get(p, key), key), max(high.get(p, key), key)
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.string()), pa.array([high[p] for p in low], pa.string())], ["part", "low", "high"])

    ends = {r["part"]: (r["low"], r["high"]) for r in keyed.mapInArrow(edges, "part int, low string, high string").groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    parts = sorted(ends)
    after, before = dict(zip(parts, parts[1:], strict=False)), dict(zip(parts[1:], parts, strict=False))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part_of, key_of, own, take, blobs = [], [], [], [], []
                rows = batch.slice(lo, 500)
                for i, (pid, url, page) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True)):
                    key = order_key(url, pid)
                    p = bisect_right(cuts, key)
                    blob = pickle.dumps(page_lines(page), 5)
                    to = [(p, True)]
                    if key == ends[p][1] and p in after:
                        to.append((after[p], False))
                    if key == ends[p][0] and p in before:
                        to.append((before[p], False))
                    for q, mine in to:
                        part_of.append(q)
                        key_of.append(key)
                        own.append(mine)
                        take.append(i)
                        blobs.append(blob)
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_of, pa.int32()), pa.array(key_of, pa.string()), pa.array(own, pa.bool_()), rows.column(0).take(at), rows.column(1).take(at), pa.array(blobs, pa.binary())],
                    ["part", "key", "own", id_col, url_col, "lines"],
                )

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_ids, out_urls, out_texts = [], [], []

        def emit(prev: tuple | None, row: tuple, following: tuple | None) -> None:
            part, key, own, pid, url, blob = row
            if not own:
                return
            host, path, _ = key.split("\x01", 2)
            beside = [(-len(commonprefix([path, h[1]])), near) for near in (prev, following) if near and near[0] == part and (h := near[1].split("\x01", 2))[0] == host]
            lines, other = pickle.loads(blob), None
            for _, near in sorted(beside, key=lambda x: x[0]):
                found = pickle.loads(near[5])
                if tells_apart(lines, found):
                    other = found
                    break
            out_ids.append(pid)
            out_urls.append(url)
            out_texts.append(main_text(lines, other))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(out_ids, id_type), pa.array(out_urls, pa.string()), pa.array(out_texts, pa.string()), pa.array([len(t) for t in out_texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )
            for x in (out_ids, out_urls, out_texts):
                x.clear()
            return made

        prev = row = None
        for batch in batches:
            for following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row:
                    emit(prev, row, following)
                prev, row = row, following
                if len(out_ids) >= 500:
                    yield flush()
        if row:
            emit(prev, row, None)
        if out_ids:
            yield flush()

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(id_kind, pa.string())
    lines = pages.select(id_col, url_col, html_col).mapInArrow(dealt, f"part int, key string, own boolean, `{id_col}` {id_kind}, `{url_col}` string, lines binary")
    ordered = dealt_by(lines, ranges).sortWithinPartitions("part", "key", F.desc("own"))
    return ordered.mapInArrow(differ, f"`{id_col}` {id_kind}, `{url_col}` string, text string, n_chars bigint")
