"""Fuzzy answer resolution for the items that exact rules leave: an Arrow UDF over that residue."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.functions import mcq

LEAST, MARGIN = 0.96, 0.05


@F.pandas_udf(LongType())
def _best(variants: pd.Series, payloads: pd.Series) -> pd.Series:
    def one(texts, options):
        for text in texts if texts is not None else ():
            if not text or options is None or not len(options):
                continue
            scores = [SequenceMatcher(None, text, o).ratio() for o in options]
            order = sorted(range(len(scores)), key=lambda i: -scores[i])
            if scores[order[0]] >= LEAST and scores[order[0]] - (scores[order[1]] if len(order) > 1 else 0.0) >= MARGIN:
                return order[0]
        return None

    return pd.Series([one(v, p) for v, p in zip(variants, payloads, strict=True)], dtype="Int64")


def resolved(items: DataFrame, options: str = "candidate_answers", truth: str = "ground_truth") -> DataFrame:
    """items with method and gold_index: the exact rules in the plan, and fuzzy_payload where they fail. The UDF gets
    nulls for the rows that the exact rules settle."""
    rows = mcq.with_resolution(items, options, truth)
    left = F.col("_method") == "unresolved"
    rows = rows.withColumn("_f", _best(F.when(left, F.col("_variants")), F.when(left, F.col("_payload"))))
    found = {"method": F.when(F.col("_f").isNotNull(), "fuzzy_payload").otherwise(F.col("_method")), "gold_index": F.coalesce("_f", "_index")}
    return rows.withColumns(found).drop("_method", "_index", "_variants", "_payload", "_f")
