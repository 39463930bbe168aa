"""Quality classifier (op 7): a sparse rule ensemble over text statistics.

Small regression trees are boosted on the logistic loss of a bounded sample of labelled texts
(MAX_TRAIN rows, chosen by hash); every path from a root to a node is a conjunctive rule over the
statistics. Logistic weights of the rules are fitted with a lasso penalty (proximal gradient), and
the rules with a weight are compiled into one Spark column expression, which scores every row.

Cases: null and empty texts have statistics of 0 and are scored as such. Null labels are ignored;
of several labels of a document the largest counts, of several texts under one id that of the least statistics. Without any training label all scores are 0.5.
Ties in a split's gain go to the first statistic and threshold. Repeated rows are scored alike, an
empty table gives an empty result, and only the named columns are read. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold, small_batches

STATISTICS = (
    "n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "bar_share", "bang_share",
    "distinct_share", "top_word_share", "dup_line_share", "words_a_line", "stop_share", "short_share", "repeat_share", "other_share",
)
MAX_TRAIN = 20_000
TREES, DEPTH, BINS = 24, 3, 32
LASSO = 2e-3
_WHITE = b"\t\n\v\f\r "


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    text = text or ""
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(raw.sum() - raw[list(_WHITE)].sum()))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, n)
    times = np.bincount(ids)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = ids[:-1] * n + ids[1:]
    return [
        float(n),
        sum(map(len, found)) / n,
        float(raw[list(b"#*$%&<>|")].sum()) / size,
        float(raw[65:91].sum()) / letters,
        float(raw[48:58].sum()) / size,
        float(raw[124]) / n,
        float(raw[33]) / n,
        len(seen) / n,
        float(times.max()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        float(raw[46]) / n,
        sum(len(w) <= 3 for w in found) / n,
        1 - len(np.unique(pairs)) / max(1, len(pairs)),
        float(raw[128:].sum()) / size,
    ]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, cut in self.terms:
            out &= (x[:, k] <= cut) == below
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, below, cut in self.terms:
            c = F.col(STATISTICS[k])
            out = out & (c <= F.lit(cut) if below else c > F.lit(cut))
        return out


def tree_paths(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """All paths of one regression tree on the gradients, and its Newton steps."""
    rules: list[Rule] = []
    step = np.zeros(len(x))

    def grow(at: np.ndarray, terms: tuple, left: int) -> None:
        g, h = grad[at].sum(), hess[at].sum()
        step[at] = -g / (h + 1)
        if not left or len(at) < 2 * least:
            return
        best = (1e-6, -1, 0.0)
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            place = np.searchsorted(edges, x[at, k], side="left")
            gs = np.bincount(place, weights=grad[at], minlength=len(edges) + 1).cumsum()[:-1]
            hs = np.bincount(place, weights=hess[at], minlength=len(edges) + 1).cumsum()[:-1]
            ns = np.bincount(place, minlength=len(edges) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < least) | (len(at) - ns < least)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), k, float(edges[j]))
        if best[1] < 0:
            return
        below = x[at, best[1]] <= best[2]
        for side in (True, False):
            path = (*terms, (best[1], side, best[2]))
            rules.append(Rule(path))
            grow(at[below == side], path, left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, step


def lasso_logistic(features: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is free."""
    n, m = features.shape
    center = features.mean(0)
    z = features - center
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    # a bound of the Hessian's norm by power iteration
    u = np.ones(m) / np.sqrt(m)
    for _ in range(20):
        u = z.T @ (z @ u)
        u /= max(np.linalg.norm(u), 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(z @ u) ** 2 / n + 1) * 1.05)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        w_new = v - rate * (z.T @ (p - y) / n)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * penalty, 0)
        b_new = c - rate * (p - y).mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b - center @ w)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            out += w * rule.holds(x)
        return out

    def column(self) -> Column:
        """The score as a column over STATISTICS."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    """Boosted trees give the rules, the lasso their weights."""
    if not len(y):
        return RuleModel((), (), 0.0)
    if y.min() == y.max():
        return RuleModel((), (), 10.0 if y[0] == 1 else -10.0)
    rng = np.random.default_rng(seed)
    cuts = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(q[q < x[:, k].max()])
    odds, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    least = max(5, len(y) // 400)
    for _ in range(TREES):
        pick = rng.random(len(y)) < 0.7
        p = 1 / (1 + np.exp(-odds))
        grad, hess = np.where(pick, p - y, 0), np.where(pick, p * (1 - p), 0)
        found, step = tree_paths(x, grad, hess, cuts, DEPTH, least)
        odds = odds + 0.3 * step
        rules |= dict.fromkeys(found)
    kept, columns, seen = [], [], set()
    for rule in rules:
        held = rule.holds(x)
        key = held.tobytes()
        if key not in seen and 0 < held.sum() < len(y):
            seen.add(key)
            kept.append(rule)
            columns.append(held)
    if not kept:
        return RuleModel((), (), float(odds.mean()))
    weights, bias = lasso_logistic(np.stack(columns, 1).astype(float), y.astype(float), LASSO)
    used = [i for i in range(len(kept)) if abs(weights[i]) > 1e-6]
    return RuleModel(tuple(kept[i] for i in used), tuple(float(weights[i]) for i in used), bias)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """The id, further columns and the statistics of every whole text. No shuffle."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.select(id_col, *more).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", {x} double" for x in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py()) for x in batch.column(0)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], [f.name for f in kept] + list(STATISTICS))

    return docs.select(text_col, id_col, *more).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> RuleModel:
    """Trains on at most max_train labelled documents outside fold 0; the driver gets their statistics only."""
    known = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(id_col).agg(F.max(column).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col), F.lit(23)), id_col).limit(max_train)
    picked = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    least = F.min(F.struct(*STATISTICS, "label")).alias("r")  # of several texts under one id
    rows = with_statistics(picked, id_col, text_col, ("label",)).groupBy(id_col).agg(least).select(id_col, "r.*").toArrow().to_pandas().sort_values(id_col)
    return train(rows[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), rows["label"].to_numpy(int))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted. No shuffle."""
    out = with_statistics(docs, id_col, text_col).withColumn("score", model.column())
    return out.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
