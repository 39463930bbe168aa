"""Language-model scoring (op 4): an Elias-Fano n-gram trie of words, in memory-mapped levels.

Tokens are words, lower-cased in A-Z, and one end per text; the end is also the context of a text's
first token. Training texts give a trie of two levels, cut by ranges of the words' 64-bit hashes:

- Level 1: the sorted hashes as an Elias-Fano sequence; a word's number is its rank. Beside it exact
  counts, back-off weights quantised to 256 values, and pointers: the running number of successors,
  Elias-Fano as well.
- Level 2: for each word the numbers of its successors, ascending, each range raised above the one
  before so that the whole is monotone, as Elias-Fano; and log10 probabilities (absolute discounting,
  interpolated with the unigrams) quantised to 256 values of a code book. Words are taken in classes of
  like numbers of successors (a factor of 4 each), each with sequences of its own: so the density within
  a sequence is even, and frequent words don't fill single buckets.

A pair is found by successor search relative to its context: pointers give the range, the context's
place in its class the offset, and the high bits' zeros lead to the only bucket that can hold it. All
lookups are vectorised over a batch. Levels are files in the shared folder, written under temporary
names and renamed, and memory-mapped by scoring tasks (from other stores they are fetched to an
unlinked local file first), so a task's heap stays small whatever the corpus. Counting shuffles packed
arrays of distinct words and pairs; both grow with the input, and so does the number of parts they are dealt to.

Cases: null and blank texts have the end as their only token. Without training texts every
probability is 1. Two words with one 64-bit hash count as one (chance V**2 / 2**65). Null ids count
as training texts and not held out. Repeated rows count and are scored each. Empty table: empty
result. Only the id and text columns are read; texts are never cut.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import dealt, fold, parts_for, small_batches
from quillspark.llm.hashing import mixed, word_hashes
from quillspark.llm.token_shards import _file_system

DISCOUNT = 0.75
NO_GROUP = 255
FLUSH = 2_000_000
#: Every so many ones or zeros of a bit vector its place is noted.
SAMPLE = 32
END = np.uint64(0x0123456789ABCDEF)


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, then that of the end."""
    return np.append(word_hashes(text), END)


# --- Elias-Fano --------------------------------------------------------------------------------


def ef_encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a monotone sequence of integers below universe: low bits, high bits in unary, samples."""
    values = values.astype(np.uint64)
    n = len(values)
    width = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
    low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
    if n and width:
        for lo in range(0, n, 1 << 16):  # a multiple of 8, so parts end at whole bytes
            part = (values[lo : lo + (1 << 16)] & np.uint64((1 << width) - 1)).astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
            packed = np.packbits(bits.reshape(-1), bitorder="little")
            low[lo * width // 8 : lo * width // 8 + len(packed)] = packed
    high = (values >> np.uint64(width)).astype(np.int64)
    buckets = int(high[-1]) + 1 if n else 1
    flags = np.zeros(-(-(n + buckets) // 64) * 64 + 64, np.uint8)
    ones = high + np.arange(n)
    flags[ones] = 1
    zeros = np.flatnonzero(flags == 0)
    return {
        "shape": np.array([n, width, buckets], np.int64),
        "low": low,
        "high": np.packbits(flags, bitorder="little").view("<u8"),
        "ones": ones[::SAMPLE].astype(np.int64),
        "zeros": zeros[::SAMPLE].astype(np.int64),
    }


class EliasFano:
    """Vectorised access and successor search over the arrays of ef_encode."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.width, self.buckets = (int(x) for x in arrays[prefix + "shape"])
        self.low, self.high = arrays[prefix + "low"], arrays[prefix + "high"]
        self.samples = {1: arrays[prefix + "ones"], 0: arrays[prefix + "zeros"]}

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Places of the k-th ones or zeros (from 0)."""
        place = self.samples[bit][k // SAMPLE]
        left = (k % SAMPLE).astype(np.int64)
        at = place >> 6
        word = self.high[at]
        word = (word if bit else ~word) & (np.uint64(0xFFFFFFFFFFFFFFFF) << (place & 63).astype(np.uint64))
        have = np.bitwise_count(word).astype(np.int64)
        far = np.flatnonzero(left >= have)
        while len(far):
            left[far] -= have[far]
            at[far] += 1
            w = self.high[at[far]]
            word[far] = w if bit else ~w
            have[far] = np.bitwise_count(word[far])
            far = far[left[far] >= have[far]]
        out = at << 6
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= part
            left -= part * up
            word >>= np.uint64(step) * up.astype(np.uint64)
            out += step * up
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        byte = at >> 3
        out = np.zeros(len(i), np.uint64)
        for k in range((self.width + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def _run(self, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """How many ones follow one another from a place on: the size of a bucket."""
        at, shift = place >> 6, (place & 63).astype(np.uint64)
        word = self.high[at] >> shift
        split = np.flatnonzero(shift)
        word[split] |= self.high[at[split] + 1] << (np.uint64(64) - shift[split])
        zero = ~word
        out = np.bitwise_count((zero & (~zero + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        long = np.flatnonzero(out == 64)
        if len(long):
            out[long] = self._select(bucket[long], 0) - place[long]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def find(self, target: np.ndarray) -> np.ndarray:
        """Places of values, -1 where the first value that is not less differs."""
        target = np.asarray(target, np.uint64)
        out = np.full(len(target), -1, np.int64)
        if not self.n:
            return out
        bucket = (target >> np.uint64(self.width)).astype(np.int64)
        live = np.flatnonzero(bucket < self.buckets)
        bucket = bucket[live]
        start = np.zeros(len(live), np.int64)
        later = bucket > 0
        start[later] = self._select(bucket[later] - 1, 0) - (bucket[later] - 1)
        stop = start + self._run(start + bucket, bucket)
        want = target[live] & np.uint64((1 << self.width) - 1)
        lo, hi = start.copy(), stop.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # bisection in the bucket
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        hit = np.flatnonzero(lo < stop)
        hit = hit[self._low(lo[hit]) == want[hit]]
        out[live[hit]] = lo[hit]
        return out


def code_book(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 values at most, the means of equally full bins, and each value's code."""
    if not len(values):
        return np.zeros(1), np.zeros(0, np.uint8)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(edges, values, side="left").astype(np.uint8)
    total = np.bincount(code, weights=values, minlength=256)
    return total / np.maximum(np.bincount(code, minlength=256), 1), code


# --- level files -------------------------------------------------------------------------------


def write_level(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    system, base = _file_system(path)
    system.create_dir(base, recursive=True)
    head, at, body = {}, 0, []
    for key, x in arrays.items():
        raw = np.ascontiguousarray(x)
        head[key] = [raw.dtype.str, at, len(raw)]
        body.append(raw.tobytes() + b"\0" * (-raw.nbytes % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    context = TaskContext.get()
    temporary = f"{base}/.{name}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(temporary) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for x in body:
            f.write(x)
    system.move(temporary, f"{base}/{name}")


def open_level(path: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a level file, memory-mapped."""
    from pyarrow import fs

    system, base = _file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        with open(f"{base}/{name}", "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        import tempfile

        with tempfile.TemporaryFile() as f, system.open_input_stream(f"{base}/{name}") as source:  # has no name, so nothing is left
            while block := source.read(1 << 22):
                f.write(block)
            f.flush()
            mapped = mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ)
    size = int.from_bytes(mapped[:8], "little")
    head = json.loads(mapped[8 : 8 + size])
    return {k: np.frombuffer(mapped, kind, n, 8 + size + at) for k, (kind, at, n) in head.items()}


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def part_start(part: int, parts: int) -> int:
    """The least hash of a range."""
    return (-(-(part << 32) // parts)) << 32


class Words:
    """Level 1, all parts: numbers, counts, back-off weights and ranges of successors of words."""

    def __init__(self, path: str, sizes: dict[int, tuple[int, int]], parts: int):
        self.path, self.sizes, self.parts = path, sizes, parts
        self.total = sum(n for _, n in sizes.values())
        self.distinct = sum(v for v, _ in sizes.values())
        self.offset, at = {}, 0
        for p in sorted(sizes):
            self.offset[p], at = at, at + sizes[p][0]
        self.kept: dict[str, dict[str, np.ndarray]] = {}

    def level(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.kept:
            self.kept[name] = open_level(self.path, name)
        return self.kept[name]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of ascending hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = part_of(hashes, self.parts)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            p = int(part[lo])
            if p not in self.sizes:
                continue
            level = self.level(f"words-{p:06d}")
            at = EliasFano(level, "hash.").find(hashes[lo:hi] - np.uint64(part_start(p, self.parts)))
            hit = np.flatnonzero(at >= 0)
            number[lo + hit] = at[hit] + self.offset[p]
            count[lo + hit] = level["counts"][at[hit]]
        return number, count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def pairs(self, first: np.ndarray, second: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 probability of the second word after the first, for pairs ascending by the first; lower: log10
        unigram probabilities of the second. Unknown words: -1."""
        out = lower.copy()
        starts = np.array([self.offset[p] for p in sorted(self.offset)], np.int64)
        order = sorted(self.offset)
        known = np.flatnonzero(first >= 0)
        if not len(known):
            return out
        part = np.searchsorted(starts, first[known], side="right") - 1
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            p, at = order[int(part[lo])], known[lo:hi]
            level = self.level(f"pairs-{p:06d}")
            context, back = np.unique(first[at] - self.offset[p], return_inverse=True)
            out[at] += level["weight_book"][level["weights"][context]][back]
            group, place = level["group"][context], level["place"][context].astype(np.int64)
            value = (place.astype(np.uint64) * np.uint64(self.distinct))[back] + second[at].astype(np.uint64)
            asked = (second[at] >= 0) & (group != NO_GROUP)[back]
            for g in np.unique(group):
                if g == NO_GROUP:
                    continue
                ask = np.flatnonzero(asked & (group == g)[back])
                found = EliasFano(level, f"next{g}.").find(value[ask])
                hit = np.flatnonzero(found >= 0)
                ask, found = ask[hit], found[hit]
                own, of = np.unique(back[ask], return_inverse=True)
                pointers = EliasFano(level, f"pointer{g}.")
                good = (found >= pointers.get(place[own]).astype(np.int64)[of]) & (found < pointers.get(place[own] + 1).astype(np.int64)[of])
                out[at[ask[good]]] = level["book"][level[f"codes{g}"][found[good]]]
        return out


# --- building ----------------------------------------------------------------------------------


def _packed(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each part, with its rows of the columns as bytes; part ascends."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
    spans = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(part[a]) for a, _ in spans], pa.int32()), *(pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns)], ["part", *names]
    )


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows of packed columns, gathered by part; the input is sorted by part."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the keys, ascending, and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def build(docs: DataFrame, path: str, training: Column, text_col: str = "text", parts: int | None = None) -> Words:
    """Writes both levels below path."""
    spark = docs.sparkSession
    parts = parts or parts_for(docs, 4)
    texts = docs.where(training).select(text_col)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _packed(part_of(keys, parts), [keys, counts.astype("<u4")], ["keys", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            keys, counts = np.frombuffer(b"".join(r[0] for r in rows), "<u8"), np.frombuffer(b"".join(r[1] for r in rows), "<u4").astype(np.int64)
            (keys,), counts = _summed([keys], counts)
            start = part_start(part, parts)
            hashes = ef_encode(keys - np.uint64(start), part_start(part + 1, parts) - start)
            kind = np.int64 if counts.max(initial=0) >= 1 << 31 else np.int32
            write_level(path, f"words-{part:06d}", {f"hash.{k}": x for k, x in hashes.items()} | {"counts": counts.astype(kind)})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["part", "words", "tokens"])

    gathered = dealt(texts.mapInArrow(count_words, "part int, keys binary, counts binary"), parts).sortWithinPartitions("part")
    sizes = {r["part"]: (r["words"], r["tokens"]) for r in gathered.mapInArrow(write_words, "part int, words bigint, tokens bigint").collect()}
    words = Words(path, sizes, parts)
    kind = "<u4" if words.distinct < 1 << 32 else "<u8"

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(path, sizes, parts)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            distinct, back = np.unique(tokens, return_inverse=True)
            number = own.numbers(distinct)[0][back]
            before = np.empty(len(number), np.int64)
            before[1:] = number[:-1]  # the end of the text before, or of this list, is the first token's context
            before[0] = number[-1]
            (first, second), counts = _summed([before, number], np.ones(len(number), np.int64))
            starts = np.array([own.offset[p] for p in sorted(own.offset)], np.int64)
            part = np.array(sorted(own.offset), np.int64)[np.searchsorted(starts, first, side="right") - 1]
            small = np.minimum(counts, 255).astype(np.uint8)
            return _packed_pairs(part, first, second, counts, small)

        def _packed_pairs(part, first, second, counts, small) -> pa.RecordBatch:
            # counts up to 254 take a byte; 255 stands for an entry of the list of large counts
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
            out = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                large = counts[a:b][small[a:b] == 255]
                out.append((int(part[a]), first[a:b].astype(kind).tobytes(), second[a:b].astype(kind).tobytes(), small[a:b].tobytes(), large.astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), *[pa.binary()] * 4))], ["part", "first", "second", "small", "large"])

        for batch in batches:
            for text in batch.column(0):
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(path, sizes, parts)
        for part, rows in _by_part(batches):
            first, second = (np.frombuffer(b"".join(r[k] for r in rows), kind).astype(np.int64) for k in (0, 1))
            counts = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64)
            counts[counts == 255] = np.frombuffer(b"".join(r[3] for r in rows), "<i8")
            (first, second), counts = _summed([first, second], counts)
            context = first - own.offset[part]
            n = own.sizes[part][0]
            children = np.bincount(context, minlength=n)
            mine = own.level(f"words-{part:06d}")["counts"].astype(np.int64)
            weight = np.log10(np.where(children > 0, DISCOUNT * children / mine, 1.0))
            lower = 10 ** own.unigram(_counts_of(own, second))
            p = np.log10((counts - DISCOUNT) / mine[context] + DISCOUNT * children[context] / mine[context] * lower)
            book, codes = code_book(p)
            weight_book, weights = code_book(weight)
            group = np.full(n, NO_GROUP, np.uint8)
            has = children > 0
            group[has] = (np.log2(children[has]).astype(np.int64) // 2).astype(np.uint8)
            place = np.zeros(n, np.int32)
            arrays = {"book": book, "weights": weights, "weight_book": weight_book, "group": group, "place": place}
            for g in np.unique(group[has]):
                words_of = np.flatnonzero(group == g)
                place[words_of] = np.arange(len(words_of))
                rows_of = np.flatnonzero(group[context] == g)
                value = place[context[rows_of]] * np.int64(own.distinct) + second[rows_of]
                pointer = np.concatenate(([0], children[words_of].cumsum()))
                arrays |= {f"pointer{g}.{k}": x for k, x in ef_encode(pointer, len(rows_of) + 1).items()}
                arrays |= {f"next{g}.{k}": x for k, x in ef_encode(value, len(words_of) * own.distinct).items()}
                arrays[f"codes{g}"] = codes[rows_of]
            write_level(path, f"pairs-{part:06d}", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([len(second)], pa.int64())], ["pairs"])

    def _counts_of(own: Words, number: np.ndarray) -> np.ndarray:
        """Counts of words by number."""
        out = np.zeros(len(number), np.int64)
        order = sorted(own.offset)
        starts = np.array([own.offset[p] for p in order], np.int64)
        part = np.searchsorted(starts, number, side="right") - 1
        by = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=-2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            p, at = order[int(part[by[a]])], by[a:b]
            out[at] = own.level(f"words-{p:06d}")["counts"][number[at] - own.offset[p]]
        return out

    if sizes:
        gathered = dealt(texts.mapInArrow(count_pairs, "part int, first binary, second binary, small binary, large binary"), parts).sortWithinPartitions("part")
        gathered.mapInArrow(write_pairs, "pairs bigint").agg(F.sum("pairs").alias("pairs")).collect()
    return words


# --- scoring -----------------------------------------------------------------------------------


def score(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score. No shuffle."""
    path, sizes, parts = words.path, words.sizes, words.parts
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(path, sizes, parts)
        for batch in batches:
            lo, held, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH // 2:
                    yield scored(own, batch.slice(lo, i + 1 - lo), held)
                    lo, held, size = i + 1, [], 0
            if held:
                yield scored(own, batch.slice(lo), held)

    def scored(own: Words, rows: pa.RecordBatch, held: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(x) for x in held], np.int64)
        distinct, back = np.unique(np.concatenate(held), return_inverse=True)
        number, count = own.numbers(distinct)
        base = own.unigram(count)
        end = np.searchsorted(distinct, END)
        before = np.empty(len(back), np.int64)
        before[1:] = back[:-1]
        first_of = np.concatenate(([0], n.cumsum()[:-1]))
        before[first_of] = end
        # each pair once, by the context's number
        m = len(distinct)
        rank = np.empty(m, np.int64)
        rank[np.argsort(number, kind="stable")] = np.arange(m)
        by_rank = np.argsort(rank)
        pair, at = np.unique(rank[before] * m + back, return_inverse=True)
        first, second = by_rank[pair // m], pair % m
        p = own.pairs(number[first], number[second], base[second])
        owner = np.repeat(np.arange(len(n)), n)
        total = lambda x: np.bincount(owner, weights=x, minlength=len(n))
        cols = [
            rows.column(0),
            pa.array(n),
            pa.array(total((count > 0)[back].astype(float)).astype(np.int64)),
            pa.array(np.full(len(n), own.total, np.int64)),
            pa.array(total(base[back])),
            pa.array(total(p[at])),
        ]
        return pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the documents outside fold 1 and scores all: doc_id, held_out and the columns of score."""
    small_batches(docs.sparkSession)
    held = F.coalesce(fold(id_col) == 1, F.lit(False))
    words = build(docs, path, ~held, text_col)
    out = score(docs, words, id_col, text_col)
    return out.select(id_col, held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
