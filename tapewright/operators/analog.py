"""Nearest-analog search over historical snapshots."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.errors import ContractError
from tapewright.functions.common import EPSILON, finite_or_null
from tapewright.operators import features
from tapewright.operators.ordered import newest_per_key, ordered_scan
from tapewright.operators.timegrid import DecisionTimes
from tapewright.session import cut_lineage

# Compared fields with their scales, the two score fields, floors and bounds.
FIELDS = {
    "spread_bps": 100.0,
    "tob_imbalance": 1.0,
    "signed_notional_flow_30s": 10_000.0,
    "bbo_ofi_proxy_30s": 10_000.0,
    "rv_5m": 1.0,
    "liquidity_score": 100.0,
    "momentum_score": 100.0,
}
SCORE_FIELDS = {"liquidity_score", "momentum_score"}
MIN_FIELDS = 3
CADENCE_MS = 300_000
INDEX_VERSION = 1
TARGETS_PER_BLOCK = 2_048


def sample_clock(updates: DataFrame, cadence_ms: int = CADENCE_MS, exact: bool = False) -> list[int] | DecisionTimes:
    """Decision times from update times (column ``ms``).

    Default: a regular grid from the first update, plus the last one. ``exact`` follows the updates in arrival order
    (``exact_clock``); the samples come back as a list, at most one per cadence.
    """
    if exact:
        return [row["sample_ms"] for row in exact_clock(updates, cadence_ms).orderBy("sample_ms").collect()]
    bounds = updates.filter("ms > 0").agg(F.min("ms").alias("a"), F.max("ms").alias("b")).first()
    return [] if bounds["a"] is None else DecisionTimes.covering(bounds["a"], bounds["b"], cadence_ms)


def exact_clock(updates: DataFrame, cadence_ms: int = CADENCE_MS) -> DataFrame:
    """sample_ms: the first update, then each first update at least one cadence after the sample before, and the last update.

    Updates (``ms``, and ``ingest_seq`` for the order of arrival) move the clock only forwards, so that only those later than all before count. Of these
    every one points to the first one a cadence later, which lies in the next bucket of one cadence or is the first of the
    next bucket with any. The chain from the first update is found by pointer doubling: the samples known so far jump as
    far as they are many, so their number doubles with every round, and pointers are joined with themselves.
    """
    cadence_ms = max(1, cadence_ms)
    positive = updates.filter("ms > 0").withColumn("_all", F.lit(0))
    if "ingest_seq" in updates.columns:
        positive = ordered_scan(positive, ["_all"], "ingest_seq", "ingest_seq", running_max={"_newest": "ms"})
        positive = positive.filter(F.col("ms") == F.col("_newest"))
    records = cut_lineage(positive.select("ms").distinct().withColumn("_bucket", F.floor(F.col("ms") / F.lit(cadence_ms))))
    firsts = records.groupBy("_bucket").agg(F.min("ms").alias("_first")).withColumn("_all", F.lit(0))
    following = ordered_scan(firsts, ["_all"], "_bucket", "_bucket", following=["_bucket", "_first"]).select("_bucket", F.col("next._bucket").alias("_to"), F.col("next._first").alias("_first"))
    # in the next bucket: the first record that is at least a cadence later, by a scan over records and the times asked for
    asked = records.select("ms", (F.col("_bucket") + 1).alias("_bucket"), (F.col("ms") + cadence_ms).alias("_at"), F.lit(1).alias("_asks"))
    held = records.select(F.lit(None).cast("long").alias("ms"), "_bucket", F.col("ms").alias("_at"), F.lit(0).alias("_asks"))
    later = Window.partitionBy("_bucket").orderBy(F.desc("_at"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    near = held.unionByName(asked).withColumn("_near", F.min(F.when(F.col("_asks") == 0, F.col("_at"))).over(later)).filter("_asks = 1").select("ms", "_bucket", "_near")
    # otherwise the first record of the first bucket after it
    own = near.withColumn("_own", F.col("_bucket") - 1)
    hop = own.join(following.select(F.col("_bucket").alias("_own"), "_to", "_first"), "_own", "left")
    after = following.select(F.col("_bucket").alias("_to"), F.col("_first").alias("_second"))
    hop = hop.join(after, "_to", "left")
    skipped = F.when(F.col("_to") == F.col("_bucket"), F.col("_second")).otherwise(F.col("_first"))
    hops = cut_lineage(hop.select("ms", F.coalesce("_near", skipped).alias("to")).filter("to IS NOT NULL"))
    reached = cut_lineage(records.agg(F.min("ms").alias("ms")).filter("ms IS NOT NULL"))
    while True:
        new = cut_lineage(reached.join(hops, "ms").select(F.col("to").alias("ms")))
        if new.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(new))
        hops = cut_lineage(hops.join(hops.select(F.col("ms").alias("to"), F.col("to").alias("_far")), "to").select("ms", F.col("_far").alias("to")))
    last = records.agg(F.max("ms").alias("ms")).filter("ms IS NOT NULL")
    return reached.unionByName(last).select(F.col("ms").alias("sample_ms")).distinct()


def analog_candidates(market: features.Market, times: DecisionTimes, options=features.SnapshotOptions(), cap: int | None = None) -> DataFrame:
    """Snapshots at all sample times; with ``cap`` only at the newest ``cap`` of them."""
    kept = times.count if cap is None else max(1, cap)
    if times.count > kept:
        times = DecisionTimes(times.start_ms + (times.count - kept) * times.step_ms, times.step_ms, kept)
    return features.snapshots_at(market, times, options)


def candidates_from(snapshots: DataFrame, cap: int | None = None) -> DataFrame:
    if cap is None:
        return snapshots
    return newest_per_key(snapshots, ["symbol"], [F.col("now_ms").desc()], max(1, cap))


def _driver(field: str, target: float | None) -> Column:
    """Comparison record of one field, null where the field is not comparable."""
    value = finite_or_null(F.col(field).cast("double"))
    if target is None or not np.isfinite(target):
        return F.lit(None).cast("struct<field:string,target:double,candidate:double,contribution:double>")
    usable = value.isNotNull()
    if field in SCORE_FIELDS and abs(target) <= EPSILON:
        usable = usable & (F.abs(value) > EPSILON)
    record = F.struct(
        F.lit(field).alias("field"),
        F.lit(float(target)).alias("target"),
        value.alias("candidate"),
        (F.abs(value - F.lit(float(target))) / F.lit(FIELDS[field])).alias("contribution"),
    )
    return F.when(usable, record)


def analog_distance(candidates: DataFrame, target: dict) -> DataFrame:
    """Add ``distance`` and ``drivers`` (top three contributions) against one target's values."""
    drivers = F.array_compact(F.array(*[_driver(field, target.get(field)) for field in FIELDS]))
    rows = candidates.withColumn("_d", drivers).filter(F.size("_d") >= MIN_FIELDS)
    squares = F.aggregate("_d", F.lit(0.0), lambda acc, d: acc + d["contribution"] * d["contribution"])
    ordered = F.array_sort(
        F.col("_d"),
        lambda a, b: F.when(a["contribution"] > b["contribution"], -1)
        .when(a["contribution"] < b["contribution"], 1)
        .when(a["field"] < b["field"], -1)
        .when(a["field"] > b["field"], 1)
        .otherwise(0),
    )
    return rows.withColumns(
        {"distance": F.sqrt(squares / F.size("_d")), "drivers": F.slice(ordered, 1, 3)}
    ).drop("_d")


def analog_search(candidates: DataFrame, target: dict, limit: int = 5, min_candidates: int = 1) -> tuple[DataFrame, dict]:
    """Nearest candidates of one target row (symbol, now_ms and the compared fields).

    Returns (matches, report); with too few comparable candidates the matches are empty and the
    report says why.
    """
    others = candidates.filter(
        ~((F.col("symbol") == target["symbol"]) & (F.col("now_ms") == int(target["now_ms"])))
    )
    scored = analog_distance(others, target)
    count, needed = scored.count(), max(1, min_candidates)
    report = {"target_symbol": target["symbol"], "target_ts_ms": int(target["now_ms"]), "candidate_count": count}
    report["insufficient_evidence"] = (
        None
        if count >= needed
        else f"insufficient comparable analog evidence: {count} candidates with at least {MIN_FIELDS} "
        f"comparable fields; required {needed}"
    )
    keep = max(1, limit) if count >= needed else 0
    matches = scored.select("symbol", "now_ms", "distance", "drivers").orderBy("distance", "symbol", "now_ms")
    return matches.limit(keep), report


def latest_target(candidates: DataFrame, symbol: str) -> dict:
    """Newest candidate row of a symbol as plain values: one row to the driver."""
    row = (
        candidates.filter(F.col("symbol") == symbol)
        .select("symbol", "now_ms", *[F.col(f).cast("double").alias(f) for f in FIELDS])
        .orderBy(F.col("now_ms").desc())
        .first()
    )
    if row is None:
        raise ContractError(f"symbol '{symbol}' has no candidate")
    return row.asDict()


MATCH_SCHEMA = "target_symbol string, target_ms long, symbol string, now_ms long, distance double, candidates long"


def _nearest_in_batch(targets: pd.DataFrame, k: int):
    """Per Arrow batch of candidates: the ``k`` best of the batch for every target of the block."""
    names, scales = list(FIELDS), np.array(list(FIELDS.values()))
    score = np.array([f in SCORE_FIELDS for f in names])
    t = targets[names].to_numpy(float)
    t_zero = np.abs(t) <= EPSILON
    t_key = list(zip(targets["symbol"], targets["now_ms"]))

    def run(batches):
        for pdf in batches:
            c = pdf[names].to_numpy(float)
            c_zero = np.abs(c) <= EPSILON
            symbols, times = pdf["symbol"].to_numpy(), pdf["now_ms"].to_numpy()
            parts = []
            for i, (symbol, ms) in enumerate(t_key):
                diff = np.abs(c - t[i]) / scales
                usable = np.isfinite(diff) & ~(score & t_zero[i] & c_zero)
                n = usable.sum(axis=1)
                ok = (n >= MIN_FIELDS) & ~((symbols == symbol) & (times == ms))
                found = int(ok.sum())
                if not found:
                    continue
                total = np.where(usable, diff, 0.0) ** 2
                distance = np.sqrt(total.sum(axis=1) / np.maximum(n, 1))
                at = np.flatnonzero(ok)
                best = at[np.lexsort((times[at], symbols[at].astype(str), distance[at]))[:k]]
                part = pd.DataFrame(
                    {"target_symbol": symbol, "target_ms": ms, "symbol": symbols[best], "now_ms": times[best], "distance": distance[best]}
                )
                part["candidates"] = 0
                part.loc[0, "candidates"] = found
                parts.append(part)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def analog_search_many(candidates: DataFrame, targets: DataFrame, k: int = 5, min_candidates: int = 1) -> DataFrame:
    """Top ``k`` per target over all candidates, exactly.

    Targets are taken to the tasks in blocks of a fixed size (numbers only, about 100 bytes each);
    every candidate batch gives back its own best ``k`` per target, so pairs are never emitted and
    the shuffle carries k rows per target and batch. A final rank per target merges them.
    """
    cols = [F.col("symbol"), F.col("now_ms"), *[F.col(f).cast("double").alias(f) for f in FIELDS]]
    narrow = candidates.select(*cols)
    blocks, block = [], []
    for row in targets.select(*cols).toLocalIterator():
        block.append(row.asDict())
        if len(block) == TARGETS_PER_BLOCK:
            blocks.append(block)
            block = []
    if block:
        blocks.append(block)
    if not blocks:
        return candidates.sparkSession.createDataFrame([], MATCH_SCHEMA.replace("candidates long", "candidate_count long, rank int"))
    found = None
    for rows in blocks:
        part = narrow.mapInPandas(_nearest_in_batch(pd.DataFrame(rows), max(1, k)), MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    target = Window.partitionBy("target_symbol", "target_ms")
    ranked = found.withColumns(
        {
            "candidate_count": F.sum("candidates").over(target),
            "rank": F.row_number().over(target.orderBy("distance", "symbol", "now_ms")),
        }
    )
    return ranked.filter((F.col("rank") <= max(1, k)) & (F.col("candidate_count") >= max(1, min_candidates))).drop("candidates")


def latest_targets(candidates: DataFrame) -> DataFrame:
    return newest_per_key(candidates, ["symbol"], [F.col("now_ms").desc()], 1)


# --- persisted index ----------------------------------------------------------------------------

def write_index(candidates: DataFrame, path: str, run_id: str, target_symbol: str) -> None:
    """Candidate table plus a one-row manifest; refuses blank ids and existing paths."""
    if not run_id.strip() or not target_symbol.strip():
        raise ContractError("analog index needs a run id and a target symbol")
    target = latest_target(candidates, target_symbol)
    manifest = {
        "schema_version": INDEX_VERSION,
        "source_run_id": run_id,
        "target_symbol": target_symbol,
        "target_ts_ms": int(target["now_ms"]),
    }
    candidates.write.mode("errorifexists").parquet(f"{path}/candidates")
    spark = candidates.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("schema_version") != INDEX_VERSION:
        raise ContractError(f"unsupported analog index version {manifest.get('schema_version')}")
    if not manifest.get("source_run_id", "").strip() or not manifest.get("target_symbol", "").strip():
        raise ContractError("analog index manifest lacks its run id or target symbol")
    return spark.read.parquet(f"{path}/candidates"), manifest
