"""Byte-pair encoding and decoding (op 5).

encode: every pre-token is a doubly linked list of byte symbols and a priority queue of
(merge rank, position); stale queue entries are skipped. decode: vocabulary strings are
concatenated and read as UTF-8. The vocabulary file is a parameter (tokenizers' JSON,
byte level); the driver reads it and broadcasts it (a few MB whatever the corpus).

Cases: null and empty texts have no ids and decode to ''. Texts of any length are encoded whole.
Repeated rows give repeated results. An empty table gives an empty result. Columns of the input
other than the id and text columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import small_batches, tidy

#: The pre-token pattern of byte-level BPE and its table of printable stand-ins for bytes.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Entries that a worker keeps of each kind before it starts anew.
CACHE_ENTRIES = 300_000


def byte_symbols() -> dict[int, str]:
    """Printable stand-in of each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def keep(kept: dict[str, bytes], key: str, known: bytes) -> None:
    if len(key) <= 64:
        if len(kept) >= CACHE_ENTRIES:
            kept.clear()
        kept[key] = known


class BytePairCoder:
    """Encoder and decoder over a vocabulary and ranked merges."""

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        stand_in = byte_symbols()
        back = {s: b for b, s in stand_in.items()}
        self.byte_id = [vocab[stand_in[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        #: left id << 24 | right id: rank of the merge; what each rank makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 24 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: ids of pieces that follow a space, without that space, and of pre-tokens that don't
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def merge_symbols(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        byte_id, find, made_by = self.byte_id, self.rank.get, self.made
        ids = [byte_id[b] for b in raw]
        n = len(ids)
        #: rank of the pair that starts at a symbol, -1 if it can't merge or the symbol is gone
        ranks, queue = [], []
        for i in range(1, n):
            r = find(ids[i - 1] << 24 | ids[i], -1)
            ranks.append(r)
            if r >= 0:
                queue.append(r << 32 | i - 1)
        if not queue:
            return ids
        ranks.append(-1)
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            top = heappop(queue)
            i, r = top & 0xFFFFFFFF, top >> 32
            if ranks[i] != r:
                continue  # stale: one side was merged meanwhile
            j = after[i]
            made = ids[i] = made_by[r]
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks[i] = find(made << 24 | ids[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                r = ranks[h] = find(ids[h] << 24 | made, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _pretoken(self, token: str) -> bytes:
        """Ids of one pre-token; those that start with a space are kept with the pieces."""
        kept, key = (self.spaced, token[1:]) if token[0] == " " else (self.bare, token)
        known = kept.get(key)
        if known is None:
            known = pack(self.merge_symbols(token.encode()))
            keep(kept, key, known)
        return known

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that holds whole pre-tokens."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return self._pretoken(piece)
        word = body.rstrip(_MARKS)
        if word.isalpha():  # letters, then marks: two pre-tokens
            cut = len(piece) - len(body) + len(word)
            return self._pretoken(piece[:cut]) + self._pretoken(piece[cut:])
        known = b"".join([self._pretoken(t) for t in PRETOKEN.findall(piece)])
        if piece[:1] == " ":
            keep(self.spaced, body, known)
        return known

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special strings. A space between two characters that are no white space
        always starts a pre-token, so the text is cut there; the parts are encoded, and kept, alone."""
        parts = text.split(" ")
        if "" in parts or _SPACED.search(text):
            joined: list[str] = [parts[0]]
            for p in parts[1:]:
                if not p or p[0].isspace() or joined[-1] == "" or joined[-1][-1].isspace():
                    joined[-1] += " " + p
                else:
                    joined.append(p)
            parts = joined
        out = list(map(self.spaced.get, parts))
        out[0] = self._piece(parts[0]) if parts[0] else b""
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    out[i] = self._piece(" " + parts[i])
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(pack([self.special[p]]) if p in self.special else self._plain(p) for p in self.split_special.split(text) if p)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.strings.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


_MARKS = ".,;:!?*%&#$|)\"-"
_SPACED = re.compile(r" \s")
_coders: dict[str, BytePairCoder] = {}


def coder_for(spec_json: str) -> BytePairCoder:
    """The coder of a vocabulary; a worker makes it once."""
    key = hashlib.sha256(spec_json.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = BytePairCoder(json.loads(spec_json))
    return _coders[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded on demand). No shuffle."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(shipped.value)
        for batch in batches:
            n, digests, decoded, lists, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = coder.encode_bytes(text)
                ids = np.frombuffer(packed, "<u4").tolist()
                raw = coder.decode_bytes(ids)
                n.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    lists.append(ids)
                    texts.append(raw.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "a", "b", "c", "d"][: len(cols)]).rename_columns(names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
