"""N-gram Jaccard join (op 2): T-occurrence search over inverted lists by DivideSkip.

A text's set holds the 64-bit hashes of its distinct five-word shingles (with fewer words: of the
whole sequence), so sizes and overlaps are those of the shingles but for hash collisions (chance
below 1e-9 a pair). Two texts link when 100 * overlap >= 80 * union, so a partner of a set of n holds
T = ceil(0.8 n) of its n lists at least. All lists have one order, frequent shingles last; a set's last
L = min(T - 1, floor(0.7 n)) lists are its long ones, and the others its short ones. Two sets that link
share T - L short lists at least, with T and L of the larger set, and T - L >= 0.1 n.

1. Texts with equal sets are one class; postings carry classes, so copies cost one entry.
2. Short postings are dealt by hash in packed arrays, and each part finds the lists that two classes share. A class
   with fewer than ceil(0.1 n) of them has no partner and drops out.
3. Lists of up to SMALL classes are heap-merged for each class, which counts the occurrences of every candidate.
   A crowded list (more classes than SMALL) is put aside like the long ones: a candidate stays if its count and the
   crowded lists that both sets have could reach T - L.
4. The long lists of what stays are probed: the whole sorted sets are searched by bisection.
5. Sets that link with no list of up to SMALL in common share ceil(0.1 n) crowded ones. Each crowded list has a
   centre, and its members are probed against it, so a large group of near copies gives a pair a member.
6. Links are contracted by label passing. Members of a list that are in the centre's component need nothing more. The
   others are indexed in cells of bounded size, and every member of the lists of that centre is a query of DivideSkip
   there: short lists heap-merged with skips, long ones probed by bisection. A pair whose members are joined
   already isn't probed, and a cell returns only links that join, so no pairs are written for all of a group.

So no link between different texts is lost, and components are exact.

Cases: null and blank texts have empty sets and are alone (component_id is their own id). Equal texts, and repeated
rows, share a class. A null id is never the least; where a component has no other, component_id is null. Ties between
centres go to the least class. Empty tables give an empty result. Only the id and text columns are read. Texts are
never cut; nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import dropped, shared_dir, small_batches, stored, tidy
from quillspark.llm.hashing import mixed, word_hashes

WIDTH = 5
#: Lists of at most so many classes are merged; longer ones are crowded.
SMALL = 6
#: Bits of the filter of candidate ids: a fixed 4 MB, whatever the number of documents.
FILTER_BITS = 1 << 25
#: One of so many texts is read to find frequent shingles: those of at least LEAST of them, and of 1 in 20,000.
SAMPLE, LEAST = 16, 4
FLUSH = 300_000
#: Postings of a part, and hashes of the index and of the queries of a cell.
PART, INDEX, ASKED = 1_000_000, 1 << 18, 1 << 16
_Q = 0xD6E8FEB86659FD93


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    with np.errstate(over="ignore"):
        word = word_hashes(text)
        if not len(word):
            return word
        k = min(width, len(word))
        out = np.full(len(word) - k + 1, k, np.uint64)
        for t in range(k):
            out = out * np.uint64(_Q) + word[t : t + len(out)]
        return np.unique(mixed(out))


def class_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 only for the empty set."""
    if not len(found):
        return 0
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def long_lists(n: int) -> int:
    """L: how many of the n lists of a set are put aside."""
    return min(-(-4 * n // 5) - 1, 7 * n // 10)


class Lists:
    """Inverted lists over the sets of a cell, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(hashes, kind="stable")
        self.keys, at = np.unique(hashes[order], return_index=True)
        self.edge = np.append(at, len(order)).tolist()
        self.owner: list[int] = owner[order].tolist()
        self.sizes = [len(x) for x in sets]

    def merged(self, lists: list[tuple[int, int]], need: int) -> Iterator[tuple[int, int]]:
        """(owner, count) of the owners in need lists or more: a heap of the lists' fronts; owners that fewer than need
        lists could hold are skipped by bisection."""
        own = self.owner
        heap = [(own[a], a, b) for a, b in lists]
        heapq.heapify(heap)
        while len(heap) >= need:
            top, front = heap[0][0], []
            while heap and heap[0][0] == top:
                front.append(heapq.heappop(heap))
            if len(front) >= need:
                yield top, len(front)
                target = top + 1
            else:
                while len(front) < need - 1:
                    front.append(heapq.heappop(heap))
                target = heap[0][0]
            for _, a, b in front:
                a = a + 1 if own[a] == top else a
                if a < b and own[a] < target:
                    a = bisect_left(own, target, a, b)
                if a < b:
                    heapq.heappush(heap, (own[a], a, b))

    def search(self, query: np.ndarray, wanted=lambda owner: True) -> Iterator[int]:
        """Owners that link with the query, but for those that wanted() refuses."""
        n = len(query)
        least = -(-4 * n // 5)
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query].tolist()
        if len(at) < least:
            return
        lists = sorted(((self.edge[k], self.edge[k + 1]) for k in at), key=lambda x: x[1] - x[0])
        aside = long_lists(n)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        for owner, count in self.merged(short, least - aside):
            m = self.sizes[owner]
            enough = max(least, -(-4 * (n + m) // 9))
            if not wanted(owner):
                continue
            for k, (a, b) in enumerate(long):
                if count >= enough or count + len(long) - k < enough:
                    break
                a = bisect_left(self.owner, owner, a, b)
                count += a < b and self.owner[a] == owner
            if count >= enough:
                yield owner


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection: the smaller set is probed into the larger one by bisection."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, class of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([class_of(x) for x in found], pa.int64())], ["doc_id", "n", "class"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {kind}, n bigint, class bigint")


def _postings(docs: DataFrame, text_col: str, parts: int, frequent: Broadcast | None) -> DataFrame:
    """Short postings, packed by part: hashes and classes as arrays, each class once a flush. Without the filter of
    frequent shingles: all postings."""

    def chosen(found: np.ndarray) -> np.ndarray:
        if frequent is None:
            return found
        later = _passes(frequent.value, (found % np.uint64(FILTER_BITS)).astype(np.int64))
        n = len(found) - long_lists(len(found))
        rare = found[~later]
        return rare[:n].copy() if len(rare) >= n else np.concatenate((rare, found[later][: n - len(rare)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            names = np.fromiter(held, np.int64, len(held))
            found = list(held.values())
            owner = np.repeat(names, [len(x) for x in found])
            hashes = np.concatenate(found)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-1))
            cuts = [*at.tolist(), len(order)]
            out = [(int(part[order[a]]), hashes[order[a:b]].tobytes(), owner[order[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "hashes", "classes"])

        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py())
                if len(found) and (name := class_of(found)) not in held:
                    held[name] = chosen(found)
                    size += len(held[name])
                    if size >= FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(tidy(run), "part int, hashes binary, classes binary").repartition(parts, "part")


def _lists(postings: DataFrame) -> DataFrame:
    """(list, class) of every list that two classes or more share. One part is merged at a time."""

    def merged(part: int, hashes: list[bytes], classes: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, c = np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(classes), np.int64)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c = h[fresh], c[fresh]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        number = np.cumsum(first) - 1
        shared = np.bincount(number)[number] > 1
        h, c = h[shared], c[shared]
        for lo in range(0, len(h), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + 50_000].view(np.int64)), pa.array(c[lo : lo + 50_000])], ["list", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        hashes: list[bytes] = []
        classes: list[bytes] = []
        for batch in batches:
            for part, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part != now and hashes:
                    yield from merged(now, hashes, classes)
                    hashes, classes = [], []
                now = part
                hashes.append(h)
                classes.append(c)
        if hashes:
            yield from merged(now, hashes, classes)

    return postings.sortWithinPartitions("part").mapInArrow(tidy(run), "list bigint, class bigint")


def _filter_of(bits: DataFrame) -> Broadcast:
    """A broadcast bit array of a fixed size from a column bit."""
    rows = bits.selectExpr("cast(bit div 32 as int) as at", "shiftleft(1L, cast(bit % 32 as int)) as bits").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(FILTER_BITS // 32, np.int64)
    packed = rows.toArrow()
    words[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    return bits.sparkSession.sparkContext.broadcast(words.astype(np.uint32))


def id_filter(ids: DataFrame) -> Broadcast:
    """A broadcast filter of the values of doc_id, which may let others pass."""
    return _filter_of(ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")))


def _frequent(docs: DataFrame, text_col: str, parts: int, sampled: int) -> Broadcast:
    """The filter of frequent shingles, which only settles the order of the lists."""
    least = max(LEAST, sampled // 20_000)
    some = docs.where(F.pmod(F.xxhash64(F.col(text_col)), F.lit(SAMPLE)) == 0)
    sizes = _lists(_postings(some, text_col, parts, None)).groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _filter_of(sizes.select(F.pmod(F.col("list"), F.lit(FILTER_BITS)).alias("bit")))


def _passes(words: np.ndarray, bit: pa.Array | np.ndarray) -> np.ndarray:
    bit = np.asarray(bit)
    return (words[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)


def _filtered_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, set) of the wanted classes (class, doc_id): a fixed-size filter of ids keeps the other texts out of the
    shuffle, and a join on the class drops what passed it by chance. Texts without an id always pass."""
    shipped = id_filter(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column(1))
            found = [shingles(x.as_py()) for x in batch.column(0).filter(pa.array((bits < 0) | _passes(shipped.value, bits.clip(0))))]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["class", "set"])

    bit = F.when(F.col(id_col).isNotNull(), F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))).otherwise(F.lit(-1))
    sets = docs.select(text_col, bit.alias("bit")).mapInArrow(tidy(run), "class bigint, set binary")
    return sets.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _counted(members: DataFrame) -> DataFrame:
    """a, b, na, nb, crowdeda, crowdedb, common of the pairs of classes a < b that share a list: for each class the lists it
    is in are heap-merged. One block of whole lists is merged at a time, so a pair's counts are sums over blocks."""

    def merged(lists: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
        tails: dict[tuple, list[list[tuple]]] = {}
        for rows in lists:
            for k in range(len(rows) - 1):
                tails.setdefault(rows[k], []).append(rows[k + 1 :])
        out = []
        for (a, na, ca), others in tails.items():
            for (b, nb, cb), run in groupby(heapq.merge(*others)):
                out.append((a, b, na, nb, ca, cb, sum(1 for _ in run)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, ["a", "b", "na", "nb", "crowdeda", "crowdedb", "common"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, size = None, [], 0
        for batch in batches:
            for name, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if name != now:
                    if size >= FLUSH // 4:
                        yield from merged(lists)
                        lists, size = [], 0
                    now = name
                    lists.append([])
                lists[-1].append(tuple(row))
                size += 1
        yield from merged(lists)

    dealt = members.select("list", "class", "n", "crowded").repartition("list").sortWithinPartitions("list", "class")
    pairs = dealt.mapInArrow(tidy(run), "a bigint, b bigint, na bigint, nb bigint, crowdeda bigint, crowdedb bigint, common bigint")
    return pairs.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("na", "nb", "crowdeda", "crowdedb")), F.sum("common").alias("common"))


def _probed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, na, nb of every pair: the whole sets are probed."""
    right = pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")
    both = right.join(sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, na, nb = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n.append(overlap(p, q))
                na.append(len(p))
                nb.append(len(q))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (n, na, nb))], ["a", "b", "common", "na", "nb"])

    return both.mapInArrow(tidy(run), "a bigint, b bigint, common bigint, na bigint, nb bigint")


LINKED = "100 * common >= 80 * (na + nb - common)"
#: T and L of the larger set of a pair.
_MOST = "greatest(na, nb)"
_T = f"greatest((4 * {_MOST} + 4) div 5, (4 * (na + nb) + 8) div 9)"
_L = f"least((4 * {_MOST} + 4) div 5 - 1, 7 * {_MOST} div 10)"
#: What a pair that links and shares a merged list fulfils.
POSSIBLE = f"least(na, nb) * 100 >= 80 * {_MOST} and common + least(crowdeda, crowdedb) >= {_T} - {_L}"


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges as a star forest with the least class as root: same components, fewer edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.setdefault(top, top)) != top:
                top = y
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        def flush() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(up) if root(x) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
            if len(up) >= FLUSH:
                yield flush()
        yield flush()

    return edges.select("u", "v").mapInArrow(tidy(run), "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(class, root) of every class that has an edge (u, v): label passing by large and small stars until it rests."""
    spark = edges.sparkSession
    now = stored(_forest(edges), "edges")
    while True:
        # large star: neighbours above u go to the least class near u; small star: those below, and u itself
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u != v").distinct(), "edges")
        # at rest all edges lead to a root that has none: no class is both a leaf and a root, and no leaf has two roots
        leaf = after.select("u").intersect(after.select(F.col("v").alias("u")))
        if leaf.isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            dropped(now)
            out = after.select(F.col("u").alias("class"), F.col("v").alias("root"))
            out.stored_at = after.stored_at
            return out
        dropped(now)
        now = after


def _links(probed: DataFrame) -> DataFrame:
    return probed.where(LINKED).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _found_in(cell: pa.Table) -> pa.Table:
    """Links that join components, found in a cell: its index is searched for every other row."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    rows = list(zip(*(cell.column(c).to_pylist() for c in ("indexed", "class", "root", "set")), strict=True))
    rows = [(i, c, r, np.frombuffer(x, np.uint64)) for i, c, r, x in rows]
    index, out = [x for x in rows if x[0]], []
    lists = Lists([x[3] for x in index]) if index else None
    for _, name, own, query in (x for x in rows if lists and not x[0]):
        for k in lists.search(query, lambda k, own=own: root(index[k][2]) != root(own)):
            up[root(index[k][2])] = root(own)
            out.append((name, index[k][1]))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _families(crowd: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (u, v) among members of crowded lists that aren't in their centre's component; None if all are."""
    family = crowd.select("centre", "class", "n").distinct().join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_centre = roots.select(F.col("class").alias("centre"), F.col("root").alias("top"))
    family = stored(family.join(of_centre, "centre", "left").withColumn("outer", F.col("root") != F.coalesce("top", "centre")), "family")
    cells = family.groupBy("centre").agg(F.sum(F.when(F.col("outer"), F.col("n"))).alias("size"), F.sum("n").alias("all")).where("size is not null")
    cells = cells.selectExpr("centre", f"(size + {INDEX - 1}) div {INDEX} as across", f"(all + {ASKED - 1}) div {ASKED} as down")
    if cells.isEmpty():
        dropped(family)
        return None
    rows = family.join(cells, "centre").join(sets, "class")
    indexed = rows.where("outer").selectExpr("centre", "true as indexed", "class", "root", "set", "pmod(xxhash64(class), across) as i", "explode(sequence(0L, down - 1)) as j")
    asked = rows.selectExpr("centre", "false as indexed", "class", "root", "set", "explode(sequence(0L, across - 1)) as i", "pmod(xxhash64(class), down) as j")
    links = stored(indexed.unionByName(asked).groupBy("centre", "i", "j").applyInArrow(_found_in, "u bigint, v bigint"), "links")
    dropped(family)
    return links


def _grouped(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class) of every document, and (class, doc_id, n, root) of every class that isn't empty."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    base = stored(_sets(docs, id_col, text_col), "sets")
    classes = base.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    total = classes.agg(F.count("*"), F.sum("n")).first()
    at_least = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(at_least, -(-(total[1] or 0) // PART))

    frequent = _frequent(docs, text_col, parts, total[0] // SAMPLE)
    lists = stored(_lists(_postings(docs, text_col, parts, frequent)), "lists")
    frequent.unpersist()
    live = lists.groupBy("class").agg(F.count("*").alias("shares")).join(classes, "class").where(F.col("shares") >= F.ceil(F.col("n") / 10))
    live = stored(live.select("class", "doc_id", "n"), "live")
    members = stored(lists.join(live.select("class", "n"), "class").select("list", "class", "n"), "members")
    sizes = members.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    sized = members.join(sizes, "list")
    of_class = sized.groupBy("class").agg(F.count("*").alias("shares"), F.count_if(F.col("size") > SMALL).alias("crowded"))
    sized = stored(sized.join(of_class, "class").where(F.col("shares") >= F.ceil(F.col("n") / 10)), "sized")

    close = stored(_counted(sized.where(F.col("size") <= SMALL)).where(POSSIBLE).select("a", "b"), "close")
    # a pair without a merged list shares ceil(0.1 n) crowded ones, so one of them is left when so many less one, the longest, are put aside
    place = F.row_number().over(Window.partitionBy("class").orderBy("size", "list"))
    crowd = sized.where((F.col("size") > SMALL) & (F.col("crowded") >= F.ceil(F.col("n") / 10))).withColumn("place", place)
    crowd = stored(crowd.where(F.col("place") <= F.col("crowded") - F.ceil(F.col("n") / 10) + 1).select("list", "class", "n", "shares"), "crowd")
    heads = crowd.groupBy("list").agg(F.count("*").alias("m"), F.max(F.struct(F.col("shares"), -F.col("class"))).alias("top"))
    heads = heads.where("m > 1").select("list", (-F.col("top.col2")).alias("centre"))
    around = stored(crowd.join(heads, "list").select("centre", "class", "n").distinct(), "around")
    star = around.where("centre != class").select(F.least("centre", "class").alias("a"), F.greatest("centre", "class").alias("b"))
    pairs = stored(close.unionByName(star).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(live.select("class", "doc_id"), "class")
    sets = stored(_filtered_sets(docs, wanted, id_col, text_col), "sets")
    near = stored(_links(_probed(pairs, sets)), "near")
    roots = components(near)
    more = _families(around, roots, sets)
    if more is not None:
        old, roots = roots, components(near.unionByName(more))
        dropped(old, more)
    dropped(lists, live, members, sized, close, crowd, around, pairs, sets, near)
    return base, classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    base, named = _grouped(docs, id_col, text_col, parts)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("class", "component_id")
    out = base.where("n > 0").join(of_class, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumnRenamed("doc_id", id_col)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, but one of each component: that of the least id, then class, then other columns. Only
    texts that a fixed-size filter of the doubtful ids lets pass are shuffled. A row without an id stays only if no row of
    its component has one. Blank texts are one component for each id. Columns whose
    names start with _ngram_ are this function's own."""
    base, named = _grouped(docs, id_col, text_col)
    of_row = base.where("doc_id is not null").groupBy("doc_id", "class").agg(F.count("*").alias("rows")).join(named.select("class", "root"), "class", "left")
    best = of_row.where("class != 0").groupBy("root").agg(F.min(F.struct("doc_id", "class")).alias("best"))
    of_row = of_row.join(best, "root", "left").withColumn("chosen", (F.col("class") == 0) | ((F.col("doc_id") == F.col("best.doc_id")) & (F.col("class") == F.col("best.class"))))
    doubtful = of_row.withColumn("of_id", F.count("*").over(Window.partitionBy("doc_id"))).where("not chosen or rows > 1 or of_id > 1")
    doubtful = stored(doubtful.select("doc_id", "class", "chosen"), "doubtful")
    # ids of which no row is chosen go at once; the rows of other doubtful ids are told apart by their class
    gone = doubtful.groupBy("doc_id").agg(F.max("chosen").alias("any")).where("not any").select(F.col("doc_id").alias("_ngram_gone"))
    others = doubtful.where("not chosen").select(F.col("doc_id").alias("_ngram_other"), F.col("class").alias("_ngram_other_class"))
    nameless = base.where("doc_id is null and n > 0").select("class").distinct().join(named.select("class", "root"), "class").join(best.select("root", F.lit(True).alias("has")), "root", "left")
    first = nameless.where("has is null").groupBy("root").agg(F.min("class").alias("class"))
    lost = stored(nameless.join(first, "class", "left_anti").select(F.col("class").alias("_ngram_lost")), "lost")
    shipped = id_filter(doubtful)
    bit = docs.withColumn("_ngram_bit", F.when(F.col(id_col).isNotNull(), F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))).otherwise(F.lit(-1)))
    at, text_at = len(docs.columns), docs.columns.index(text_col)

    def side(inside: bool):  # noqa: ANN202
        """The rows that the filter lets pass, with their class, or the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.asarray(batch.column(at))
                rows = batch.filter(pa.array(((bits < 0) | _passes(shipped.value, bits.clip(0))) == inside))
                if inside:
                    names = pa.array([class_of(shingles(x.as_py())) for x in rows.column(text_at)], pa.int64())
                    rows = pa.RecordBatch.from_arrays([*rows.columns, names], [*rows.schema.names, "_ngram_class"])
                yield rows

        schema = bit.withColumn("_ngram_class", F.lit(0).cast("bigint")).schema if inside else bit.schema
        return bit.mapInArrow(tidy(run), schema).drop("_ngram_bit")

    rest = side(True).join(gone, F.col(id_col) == F.col("_ngram_gone"), "left_anti")
    rest = rest.join(others, (F.col(id_col) == F.col("_ngram_other")) & (F.col("_ngram_class") == F.col("_ngram_other_class")), "left_anti")
    rest = rest.join(lost, F.col(id_col).isNull() & (F.col("_ngram_class") == F.col("_ngram_lost")), "left_anti")
    apart = F.col(id_col).isNull() & (F.col("_ngram_class") == 0)  # blank texts without an id are copies of nothing
    order = [F.col(c.name) for c in docs.schema if c.dataType.typeName() not in ("map", "variant")]
    one = rest.where(~apart).withColumn("_ngram_place", F.row_number().over(Window.partitionBy(id_col, "_ngram_class").orderBy(*order))).where("_ngram_place = 1")
    return side(False).unionByName(one.drop("_ngram_class", "_ngram_place")).unionByName(rest.where(apart).drop("_ngram_class"))
