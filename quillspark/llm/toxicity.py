"""Toxicity classifier (op 8): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its whole form and its character n-grams (of its UTF-8 bytes, with marks for
start and end), hashed into BUCKETS rows of an embedding. A word's vector is the mean of its rows, a
text's vector the mean of its words' vectors, and two softmax outputs are linear in it. Embedding
and softmax are trained together by gradient descent in numpy in one task, on at most MAX_PER_CLASS
labelled texts of each class (chosen by hash; documented bound); the driver gets the model alone. Every row that a training text has is
trained, weighed by how far its presence tells the classes apart; rows that none has stay zero. As everything after the embedding is linear, scoring needs one
number per bucket, which is broadcast (BUCKETS floats whatever the corpus). Misspelt words that were
never seen share n-grams with those that were.

Cases: null and empty texts have the zero vector and so the score of the softmax's bias. Labels
that are null are ignored; with several labels a document counts as toxic if one says so; of several texts under
one id the one whose bag is least is trained on. Ties between hashes go to the lesser id. Without any training label
all scores are near 0. Repeated rows are scored alike. Very long texts are read whole. An empty table gives an empty
result. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold, small_batches, tidy

BUCKETS = 1 << 20
DIM = 8
NGRAMS = (4, 5, 6, 7)
MAX_PER_CLASS = 800
EPOCHS = 10
#: A row whose presence tells the classes apart by a chi-square of so much counts half; shrinkage for each batch.
TRUST, DECAY = 40.0, 1e-4
_SPLIT = re.compile(r"[^\W\d_]+", re.UNICODE)
_MIX, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(1099511628211)
WORD_CACHE = 150_000


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _SPLIT.findall(text.lower()) if text else []


def subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all subwords of all words: which word, which bucket."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [b"<%b>" % w.encode() for w in found]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, raw), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    whole = np.fromiter((zlib.crc32(w) for w in raw), np.uint64, n)
    owners, codes = [np.arange(n)], [whole * _PRIME + np.uint64(1)]
    for k in NGRAMS:
        m = len(flat) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for t in range(k):
            h = h * _PRIME + flat[t : t + m]
        inside = owner[:m] == owner[k - 1 : k - 1 + m]
        owners.append(owner[:m][inside])
        codes.append(h[inside])
    code = np.concatenate(codes)
    code = (code ^ (code >> np.uint64(29))) * _MIX >> np.uint64(32)
    return np.concatenate(owners), (code % np.uint64(BUCKETS)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights: the mean over words of the mean over subwords."""
    found = letters(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct: dict[str, int] = {}
    at = np.fromiter((distinct.setdefault(w, len(distinct)) for w in found), np.int64, len(found))
    times = np.bincount(at)
    owner, bucket = subwords(list(distinct))
    weight = (times / np.bincount(owner) / len(found))[owner]
    buckets, inverse = np.unique(bucket, return_inverse=True)
    return buckets, np.bincount(inverse, weights=weight)


class Model:
    """Embedding and softmax; `value` holds each bucket's share of the log odds of class 1."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), float(bias)
        self.kept: dict[str, float] = {}

    def word_values(self, found: list[str]) -> np.ndarray:
        owner, bucket = subwords(found)
        return np.bincount(owner, weights=self.value[bucket], minlength=len(found)) / np.maximum(np.bincount(owner, minlength=len(found)), 1)

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        lists = [letters(t) for t in texts]
        kept = self.kept
        if len(kept) > WORD_CACHE:
            kept.clear()
        new = list({w for x in lists for w in x if w not in kept})
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            kept.update(zip(part, self.word_values(part).tolist(), strict=True))
        return np.array([sum(map(kept.__getitem__, x)) / len(x) if x else 0.0 for x in lists]) + self.bias


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adaptive gradient descent over embedding and softmax together. bags: buckets and weights; prior: share of class
    1 among all labels."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 30.0 if len(labels) and labels.min() == 1 else -30.0)
    rng, size, scale, f = np.random.default_rng(seed), 128, 30.0, np.float32  # scale: a text's vector is a mean over hundreds of words
    seen = np.zeros(BUCKETS, bool)
    for b, _ in bags:
        seen[b] = True
    rows_of, share = np.flatnonzero(seen), labels.mean()
    number = np.cumsum(seen, dtype=np.int32) - 1
    found = [number[b] for b, _ in bags]
    texts, toxic = np.zeros(len(rows_of)), np.zeros(len(rows_of))
    for at, label in zip(found, labels, strict=True):
        texts[at] += 1
        toxic[at] += label
    chi = (toxic - texts * share) ** 2 / (texts * share * (1 - share))
    trust = scale * chi / (chi + TRUST)
    trust = trust.astype(f)
    bags = [(at, w.astype(f) * trust[at]) for at, (_, w) in zip(found, bags, strict=True)]
    emb, soft, bias = np.stack([rng.normal(0, 0.1, len(rows_of)).astype(f) for _ in range(DIM)]), rng.normal(0, 0.5, (DIM, 2)).astype(f), np.zeros(2, f)
    seen_emb, seen_soft, seen_bias = (np.full_like(x, 1e-8) for x in (emb, soft, bias))
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(f)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(labels)), f(0.2 * (1 - epoch / epochs))
        for lo in range(0, len(order), size):
            batch = order[lo : lo + size]
            rows, weights = (np.concatenate([bags[i][k] for i in batch]) for k in (0, 1))
            owner = np.repeat(np.arange(len(batch)), [len(bags[i][0]) for i in batch])
            hidden = np.stack([np.bincount(owner, weights=emb[d, rows] * weights, minlength=len(batch)) for d in range(DIM)], 1).astype(f)
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= (cost[batch] / len(batch))[:, None]
            back = p @ soft.T
            for d in range(DIM):
                grad = np.bincount(rows, weights=back[owner, d] * weights, minlength=len(rows_of)).astype(f)
                seen_emb[d] += grad * grad
                emb[d] = (emb[d] - rate * grad / np.sqrt(seen_emb[d])) * f(1 - DECAY)
            for x, seen, grad in ((soft, seen_soft, hidden.T @ p), (bias, seen_bias, p.sum(0))):
                seen += grad * grad
                x -= rate * grad / np.sqrt(seen)
    # both classes weighed alike in training; half of the labels' log odds come back into the bias
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    value = np.zeros(BUCKETS)
    value[rows_of] = trust * ((soft[:, 1] - soft[:, 0]) @ emb)
    return Model(value, bias[1] - bias[0] + 0.5 * np.log(prior / (1 - prior)))


def training_labels(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One label a document, without those held out (fold 0)."""
    known = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    return known.groupBy(id_col).agg(F.max(column).cast("int").alias("label"))


def sample_labels(labels: DataFrame, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most so many ids of each class, those of the least hash: a bounded table."""
    order = F.xxhash64(F.col(id_col), F.lit(17))
    parts = [labels.where(F.col("label") == k).orderBy(order, id_col).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = MAX_PER_CLASS) -> Model:
    """Trains on labelled documents outside fold 0. Executors make the bags; one task trains on at most 2 * per_class."""
    small_batches(docs.sparkSession)
    known = training_labels(labels, column, id_col)
    picked = docs.select(id_col, text_col).join(F.broadcast(sample_labels(known, per_class, id_col)), id_col).select(id_col, text_col, "label")
    prior = known.agg(F.avg("label").alias("p")).first()["p"]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bag(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b.astype("<i4").tobytes() for b, _ in made], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in made], pa.binary())],
                ["id", "label", "buckets", "weights"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    made = picked.mapInArrow(tidy(bags), f"id {kind}, label int, buckets binary, weights binary")
    least = made.groupBy("id").agg(F.min(F.struct("buckets", "weights", "label")).alias("r")).select("id", "r.*")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().sort_by("id")
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
        model = train(list(zip(read("buckets", "<i4"), read("weights", "<f4"), strict=True)), rows.column("label").to_numpy().astype(np.int64), prior or 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([model.value.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["value", "bias"])

    found = least.coalesce(1).mapInArrow(tidy(trained), "value binary, bias double").first()
    return Model(np.frombuffer(found["value"], "<f4"), found["bias"]) if found else train([], np.zeros(0, np.int64), 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, score, predicted. No shuffle."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                odds = np.clip(own.log_odds(part.column(1).to_pylist()), -500, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-odds)))], [id_col, "score"])

    out = docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double")
    return out.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold. No shuffle."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                odds = np.clip(own.log_odds(part.column(at).to_pylist()), -500, 500)
                yield part.filter(pa.array(1 / (1 + np.exp(-odds)) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
