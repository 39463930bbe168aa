"""Model calls: a provider is a function from a list of requests to a list of answers, run over batches on the executors.

A provider gets the texts of one batch and returns one answer for each: a string, or an exception. Failed calls are tried
again as the policy says and then give a row with an error, so one bad answer never ends a job. Without a provider a run
is dry: it counts what would be called.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[Any]]


class CallError(Exception):
    """A failed call: an HTTP status, or a fault of the transport (status None)."""

    def __init__(self, reason: str, status: int | None = None):
        super().__init__(reason)
        self.reason, self.status = reason, status


def always(error: Exception) -> bool:
    """Any fault of a call is tried again."""
    return True


def transient(error: Exception) -> bool:
    """Busy and broken servers, and faults of the transport; a refusal stays."""
    status = getattr(error, "status", None)
    return status is None or status == 429 or 500 <= status < 600


def truncated_only(error: Exception) -> bool:
    """Faults of the transport and answers that were cut off, never what the server refused."""
    return getattr(error, "status", None) is None


def call(provider: Provider, texts: list[str], policy: Callable[[Exception], bool], retries: int, pause: float) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, retries) of every text; waits pause * min(2**k, 4) before try k + 1."""
    out: list[tuple[str | None, str | None, int]] = [(None, None, 0)] * len(texts)
    left = list(range(len(texts)))
    for attempt in range(retries + 1):
        try:
            answers = provider([texts[i] for i in left])
        except Exception as e:  # noqa: BLE001  a provider's fault is a row's error
            answers = [e] * len(left)
        again = []
        for i, a in zip(left, answers, strict=True):
            failed = isinstance(a, Exception)
            out[i] = (None if failed else a, getattr(a, "reason", type(a).__name__) if failed else None, attempt)
            if failed and policy(a) and attempt < retries:
                again.append(i)
        left = again
        if not left:
            break
        time.sleep(pause * min(2**attempt, 4))
    return out


def answered(rows: DataFrame, prompt: str, provider: Provider, policy: Callable[[Exception], bool] = transient, retries: int = 2, batch: int = 32, pause: float = 1.0) -> DataFrame:
    """rows with raw, error and retry_count, in batches of so many prompts; null prompts are not called."""
    schema = rows.selectExpr("*", "cast(null as string) as raw", "cast(null as string) as error", "cast(null as int) as retry_count").schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                asked = part[prompt].notna()
                found = call(provider, part.loc[asked, prompt].tolist(), policy, retries, pause) if asked.any() else []
                part["raw"], part["error"], part["retry_count"] = None, None, 0
                part.loc[asked, ["raw", "error", "retry_count"]] = pd.DataFrame(found, index=part.index[asked], columns=["raw", "error", "retry_count"])
                yield part.astype({"retry_count": "int32"})

    return rows.mapInPandas(run, schema)


def dry_run(plan: DataFrame, method: str = "method") -> DataFrame:
    """Rows and calls by method: two-stage cells make two calls."""
    return plan.groupBy(method).agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col(method) == "ecm", 2).otherwise(1)).alias("n_calls"))


def executed(plan: DataFrame, prompt: str, provider: Provider | None, fault: Callable[[Column], Column], **options: Any) -> DataFrame:
    """The ledger of a plan: each row's answer, status and reason. fault gives the first fault of an answer, or null.
    Without a provider nothing is called and the status is DRY_RUN."""
    if provider is None:
        return plan.select("*", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("retry_count"), F.lit("DRY_RUN").alias("status"), F.lit(None).cast("string").alias("reason"))
    rows = answered(plan, prompt, provider, **options).withColumn("_fault", fault(F.col("raw")))
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("_fault").isNotNull(), "REJECTED").otherwise("PARSED")
    return rows.withColumns({"status": status, "reason": F.coalesce("error", "_fault")}).drop("_fault")


def two_stages(plan: DataFrame, first: str, provider: Provider | None, gate: Callable[[Column], Column], second: Callable[[Column], Column], fault: Callable[[Column], Column], **options: Any) -> DataFrame:
    """A second call for the rows whose first answer passes the gate; its prompt is made from that answer. Rows that
    fail keep the first stage's reason."""
    planned = executed(plan, first, provider, gate, **options).withColumnsRenamed({"raw": "plan_raw", "status": "plan_status", "reason": "plan_reason", "error": "plan_error", "retry_count": "plan_retries"})
    if provider is None:
        return planned.withColumns({"raw": F.lit(None).cast("string"), "status": F.lit("DRY_RUN"), "reason": F.lit(None).cast("string")})
    asked = planned.withColumn("realise_prompt", F.when(F.col("plan_status") == "PARSED", second(F.col("plan_raw"))))
    done = executed(asked, "realise_prompt", provider, fault, **options)
    late = F.col("plan_status") != "PARSED"
    return done.withColumns({"status": F.when(late, F.col("plan_status")).otherwise(F.col("status")), "reason": F.when(late, F.concat(F.lit("stage1:"), "plan_reason")).otherwise(F.col("reason"))})


def endpoint_fault(url: Column, prefix: str) -> Column:
    """Generation may go to one endpoint only."""
    return F.when(~url.startswith(prefix), F.concat(F.lit("BLOCKED_ROLE_ENDPOINT:got="), url))
