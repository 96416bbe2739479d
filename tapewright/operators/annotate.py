"""User functions over snapshot rows: zero or more annotations per row, checked before they count."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError

MAX_OUTPUT_BYTES = 65_536
SCHEMA = "input_symbol string, now_ms long, symbol string, label string, detail string"

# Wording an annotation may not contain.
BANNED_LABEL_WORDS = ["order", "wallet"]
BANNED_DETAIL_WORDS = ["private key", "place trade"]


def annotate_rows(
    snapshots: DataFrame,
    function: Callable[[pd.DataFrame], Iterable[tuple[int, str, str, str]]],
    columns: list[str],
) -> DataFrame:
    """Apply a user function to Arrow batches of the named columns.

    The function gets a frame and yields (row position, symbol, label, detail). Only the named columns
    travel to Python.
    """
    def run(batches):
        for pdf in batches:
            out = list(function(pdf[columns]))
            at = [i for i, *_ in out]
            yield pd.DataFrame(
                {
                    "input_symbol": pdf["_symbol"].to_numpy()[at],
                    "now_ms": pdf["_now_ms"].to_numpy()[at],
                    "symbol": [r[1] for r in out],
                    "label": [r[2] for r in out],
                    "detail": [r[3] for r in out],
                }
            )

    narrow = snapshots.select(F.col("symbol").alias("_symbol"), F.col("now_ms").alias("_now_ms"), *columns)
    return narrow.mapInPandas(run, SCHEMA)


def annotation_problem(max_output_bytes: int = MAX_OUTPUT_BYTES):
    """Why an annotation is refused, null when it is fine."""
    blank = F.greatest(*[(F.coalesce(F.trim(c), F.lit("")) == "") for c in ("symbol", "label", "detail")])
    unsafe = F.lit(False)
    for word in BANNED_LABEL_WORDS:
        unsafe = unsafe | F.contains(F.col("label"), F.lit(word))
    for word in BANNED_DETAIL_WORDS:
        unsafe = unsafe | F.contains(F.col("detail"), F.lit(word))
    return (
        F.when(blank, "symbol, label and detail are required")
        .when(F.col("symbol") != F.col("input_symbol"), "symbol does not match the input")
        .when(unsafe, "unsafe action wording")
    )


def validate_annotations(annotations: DataFrame, max_output_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """Add ``problem``. One bad annotation, or too much text, refuses all of that input row."""
    size = F.length("symbol") + F.length("label") + F.length("detail")
    rows = annotations.withColumn("_p", annotation_problem())
    per = rows.groupBy("input_symbol", "now_ms").agg(F.min("_p").alias("_bad"), (F.sum(size) + 2).alias("_size"))
    too_long = F.when(F.col("_size") > max_output_bytes, F.lit(f"annotations exceed {max_output_bytes} bytes"))
    return (
        rows.join(per, ["input_symbol", "now_ms"])
        .withColumn("problem", F.coalesce("_p", "_bad", too_long))
        .drop("_p", "_bad", "_size")
    )


def accepted_annotations(annotations: DataFrame, max_output_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    rows = validate_annotations(annotations, max_output_bytes)
    return rows.filter(F.col("problem").isNull()).select("symbol", "now_ms", "label", "detail")


def annotation_freshness(symbols: DataFrame, annotations: DataFrame, now_ms: int, stale_after_ms: int = 2_000, worker_ready: bool = True) -> DataFrame:
    """Per symbol: fresh, stale or unavailable, from the time of its newest annotations."""
    if stale_after_ms <= 0:
        raise ContractError("stale_after must be positive")
    newest = annotations.groupBy("symbol").agg(F.max("now_ms").alias("annotated_at_ms"))
    recent = F.lit(worker_ready) & (F.lit(now_ms) - F.col("annotated_at_ms") <= stale_after_ms)
    label = F.when(F.col("annotated_at_ms").isNull(), "unavailable").when(recent, "fresh").otherwise("stale")
    return symbols.join(newest, "symbol", "left").withColumn("freshness", label)
