"""Training-order materialisation (op 1): token ids in fixed-stride shards, in a keyed order.

A document's ids and an end id are cut into sequences of up to SEQ ids. Sequences are numbered
0 .. N-1 in scan order (a first pass counts them by input partition; the driver gets one number a
partition). A keyed Feistel network over the next even power of two, walked along its cycle
until it falls below N, maps each number to its slot: a permutation of 0 .. N-1 that any worker
can compute or invert alone. Records are dealt to ranges of slots, sorted, and written as shards
of a fixed number of records of fixed stride, so slot s lies at byte (s % records) * stride of shard
s // records, and a reader resumes anywhere. Shards are written under a temporary name in their
folder and renamed, so a task that is run again, or twice at once, leaves the same whole files. Each range goes to
a task of its own.

Record: doc_id int64, sequence number in the document uint32, number of ids uint16, two spare bytes,
then SEQ ids as uint16 (padding: the end id), all little-endian.

Both passes must see the same partitions, as those of a table: an input that is shuffled anew may not.

Cases: null and empty texts give one sequence with the end id alone. Null ids are written as -1 and
reported as null, and so is an id of -1; ids must be whole numbers. Ties can't occur: every sequence has a slot of its own. Repeated rows are sequences of their own. Empty table: no shard and no row. Special
strings in a text are ordinary text. Only the id and text columns are read; texts are never cut short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import dealt, parts_for

SEQ = 256
HEADER = 16
RECORDS = 16_384
KEY = 0x5EED5EED
ROUNDS = 6
#: The library looks for special strings; it gets one, and takes it as ordinary text where a text holds it.
UNUSED = "<|unused|>"


def stride(seq: int = SEQ) -> int:
    return HEADER + 2 * seq


# --- order -------------------------------------------------------------------------------------


def _round(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    h = x + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_round(left, key, turn) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, turn) & mask)
    return left << shift | right


def permute(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers below n, or the numbers of slots."""
    x, bits = np.asarray(index).astype(np.uint64), _half_bits(n)
    with np.errstate(over="ignore"):
        x = _network(x, bits, key, back)
        while (out := x >= n).any():  # walk on along the cycle
            x[out] = _network(x[out], bits, key, back)
    return x.astype(np.int64)


# --- tokens ------------------------------------------------------------------------------------


class Coder:
    """The library's byte-pair encoder over a rank file. Ids are taken from its buffer of 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={UNUSED: len(ranks)}).encode_to_numpy

    def numbers(self, text: str | None) -> np.ndarray:
        return self.encode(text, allowed_special=set(), disallowed_special=()) if text else np.zeros(0, np.uint32)

    def count(self, text: str | None) -> int:
        return len(self.numbers(text))

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian uint16."""
        return self.numbers(text).astype("<u2").tobytes()


_coder: dict[int, Coder] = {}


def _coder_for(shipped) -> Coder:
    ranks, pattern = shipped.value
    if len(ranks) not in _coder:
        _coder.clear()
        _coder[len(ranks)] = Coder(ranks, pattern)
    return _coder[len(ranks)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the id, one a line."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# --- shards ------------------------------------------------------------------------------------


def _file_system(path: str):
    """The file system of a path or URI that executors share, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shard(path: str, shard: int, records: list[bytes]) -> None:
    system, base = _file_system(path)
    context = TaskContext.get()
    temporary = f"{base}/.{shard_name(shard)}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(temporary) as f:
        f.write(b"".join(records))
    system.move(temporary, f"{base}/{shard_name(shard)}")


def read_slots(path: str, start: int, stop: int, seq: int = SEQ, records: int = RECORDS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, sequence number, ids) of the slots from start up to stop, in order."""
    system, base = _file_system(path)
    size = stride(seq)
    while start < stop:
        shard, at = divmod(start, records)
        n = min(stop - start, records - at)
        with system.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(at * size)
            data = f.read(n * size)
        for k in range(0, len(data), size):
            doc = int.from_bytes(data[k : k + 8], "little", signed=True)
            number, count = int.from_bytes(data[k + 8 : k + 12], "little"), int.from_bytes(data[k + 12 : k + 14], "little")
            yield doc, number, np.frombuffer(data, "<u2", count, k + HEADER)
        start += n


def materialise(docs: DataFrame, ranks_path: str, pattern: str, path: str, id_col: str = "doc_id", text_col: str = "text", seq: int = SEQ, records: int = RECORDS, key: int = KEY, parts: int | None = None) -> DataFrame:
    """Writes the shards when its rows are read: one row per sequence with doc_id, sequence, n_tokens, slot, shard, byte_offset, crc32."""
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    end = len(ranks)
    if end >= 1 << 16:
        raise ValueError("ids need more than 16 bits")
    shipped = spark.sparkContext.broadcast((ranks, pattern))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n = _coder_for(shipped), 0
        for batch in batches:
            n += sum((coder.count(x.as_py()) + seq) // seq for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    counts = {r["part"]: r["n"] for r in source.mapInArrow(count, "part int, n bigint").collect()}
    total = sum(counts.values())
    first, so_far = {}, 0
    for part in sorted(counts):
        first[part], so_far = so_far, so_far + counts[part]
    parts = parts or parts_for(docs, 4)
    shards = -(-total // records)
    per_part = max(1, -(-shards // parts))
    system, base = _file_system(path)
    system.create_dir(base, recursive=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, index = _coder_for(shipped), first[TaskContext.get().partitionId()]
        stop = int(end).to_bytes(2, "little")
        for batch in batches:
            made: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py()) + stop
                head = (-1 if doc is None else doc).to_bytes(8, "little", signed=True)
                for number, lo in enumerate(range(0, len(ids), 2 * seq)):
                    body = ids[lo : lo + 2 * seq]
                    made.append(head + number.to_bytes(4, "little") + (len(body) // 2).to_bytes(2, "little") + b"\0\0" + body + stop * (seq - len(body) // 2))
                    if len(made) >= 4000:
                        yield packed(index, made)
                        index, made = index + len(made), []
            if made:
                yield packed(index, made)
                index += len(made)

    def packed(index: int, made: list[bytes]) -> pa.RecordBatch:
        slots = permute(np.arange(index, index + len(made)), total, key)
        part = slots // records // per_part
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(slots), pa.array(made, pa.binary())], ["part", "slot", "record"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, slots = -1, [], []
        for batch in batches:
            for slot, record in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if slot // records != now:
                    if held:
                        yield written(now, held, slots)
                    now, held, slots = slot // records, [], []
                held.append(record)
                slots.append(slot)
        if held:
            yield written(now, held, slots)

    def written(shard: int, held: list[bytes], slots: list[int]) -> pa.RecordBatch:
        write_shard(path, shard, held)
        docs_of = [int.from_bytes(r[:8], "little", signed=True) for r in held]
        cols = [
            pa.array([None if d == -1 else d for d in docs_of], pa.int64()),
            pa.array([int.from_bytes(r[8:12], "little") for r in held], pa.int64()),
            pa.array([int.from_bytes(r[12:14], "little") for r in held], pa.int64()),
            pa.array(slots, pa.int64()),
            pa.array([shard] * len(held), pa.int64()),
            pa.array([s % records * stride(seq) for s in slots], pa.int64()),
            pa.array([zlib.crc32(r) for r in held], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "sequence", "n_tokens", "slot", "shard", "byte_offset", "crc32"])

    records_of = dealt(source.mapInArrow(cut, "part int, slot bigint, record binary"), parts).sortWithinPartitions("slot")
    return records_of.mapInArrow(write, "doc_id bigint, sequence bigint, n_tokens bigint, slot bigint, shard bigint, byte_offset bigint, crc32 bigint")
