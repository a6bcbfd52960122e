"""Hook for model-made verdicts: any batch function of texts, run beside the data.

Judges are outside this engine.  ``judge`` runs a user's function over Arrow batches and
turns its failures into null verdicts, so every later step treats an error the same
way.  ``regex_judge`` is a deterministic judge to run everything without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], *, key: str, flag: str = "flag", rows_per_call: int = 40, retries: int = 2) -> DataFrame:
    """(key, flag, attempts): ``fn`` gets ``rows_per_call`` rows and returns a boolean a row (null: error).

    A call that raises is tried again; after the last failure its rows have null flags.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), rows_per_call):
                part = pdf.iloc[a : a + rows_per_call]
                verdict, attempt = pd.Series([None] * len(part), dtype="boolean"), 0
                for attempt in range(1, retries + 2):
                    try:
                        got = fn(part)
                        if len(got) == len(part):
                            verdict = pd.Series(list(got), dtype="boolean")
                            break
                    except Exception:  # noqa: BLE001 - a judge may fail in any way
                        continue
                yield pd.DataFrame({key: part[key].to_numpy(), flag: verdict.to_numpy(dtype=object, na_value=None), "attempts": attempt})

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(run, f"{key} {kind}, {flag} boolean, attempts int")


def regex_judge(df: DataFrame, criteria: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, crit_id, ord, flag) of criteria(crit_id, ord, pattern) as a rule-based judge."""
    return df.select(key, text).crossJoin(F.broadcast(criteria)).select(key, "crit_id", "ord", F.rlike(F.col(text), F.col("pattern")).alias("flag"))
