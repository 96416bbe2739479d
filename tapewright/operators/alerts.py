"""Alert rules compiled to columns, evaluation over snapshots, cooldowns and history."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.errors import ContractError
from tapewright.functions.common import EPSILON

# Fields a threshold can look at and the comparison signs.
ALERT_FIELDS = {
    "confidence_score": "confidence.score",
    "spread_bps": "spread_bps",
    "spread_shock_bps": "spread_shock_bps",
    "tob_depth_usd": "tob_depth_usd",
    "tob_imbalance": "tob_imbalance",
    "signed_notional_flow_30s": "signed_notional_flow_30s",
    "bbo_ofi_proxy_30s": "bbo_ofi_proxy_30s",
    "rv_1m": "rv_1m",
    "rv_5m": "rv_5m",
    "day_ntl_vlm": "day_ntl_vlm",
}
ALERT_OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=="}
SEVERITIES = ("info", "watch", "critical")
KEY = ["playbook_id", "rule_id", "symbol"]


def default_playbook(min_shock_bps: float = 250.0, max_score: int = 70, cooldown_ms: int = 60_000) -> dict:
    return {
        "schema_version": 1,
        "id": "builtin",
        "description": "spread shock while confidence is low",
        "rules": [
            {
                "id": "spread_shock_low_confidence",
                "description": "spread shock while confidence is low",
                "severity": "watch",
                "condition": {
                    "type": "spread_shock_and_low_confidence",
                    "min_spread_shock_bps": min_shock_bps,
                    "max_confidence_score": max_score,
                },
                "cooldown_ms": cooldown_ms,
                "source_interval_ms": 60_000,
                "action": "local_only",
            }
        ],
    }


def check_playbook(playbook: dict) -> dict:
    """Refuse a rule document that is not version 1, not local-only or not well formed."""
    if playbook.get("schema_version") != 1:
        raise ContractError("alert playbook schema_version must be 1")
    if not str(playbook.get("id", "")).strip():
        raise ContractError("alert playbook id is required")
    rules = playbook.get("rules") or []
    if not rules:
        raise ContractError("alert playbook must define at least one rule")
    seen = set()
    for rule in rules:
        name = str(rule.get("id", ""))
        if not name.strip():
            raise ContractError("alert rule id is required")
        if name in seen:
            raise ContractError(f"duplicate alert rule id '{name}'")
        seen.add(name)
        if rule.get("action") != "local_only":
            raise ContractError(f"alert rule '{name}' must be local-only")
        if rule.get("severity") not in SEVERITIES:
            raise ContractError(f"alert rule '{name}' has an unknown severity")
        if rule.get("cooldown_ms", -1) < 0 or rule.get("source_interval_ms", 0) <= 0:
            raise ContractError(f"alert rule '{name}' needs cooldown_ms >= 0 and source_interval_ms > 0")
        _check_condition(rule["condition"], name)
    return playbook


def _check_condition(tree: dict, name: str) -> None:
    kind = tree.get("type")
    if kind == "spread_shock_and_low_confidence":
        if not math.isfinite(tree["min_spread_shock_bps"]) or tree["min_spread_shock_bps"] <= 0:
            raise ContractError(f"alert rule '{name}' min_spread_shock_bps must be positive and finite")
    elif kind == "field_threshold":
        if tree.get("field") not in ALERT_FIELDS or tree.get("op") not in ALERT_OPS:
            raise ContractError(f"alert rule '{name}' names an unknown field or comparison")
        if not math.isfinite(tree["value"]):
            raise ContractError(f"alert rule '{name}' threshold must be finite")
    elif kind in ("all", "any"):
        if not tree.get("conditions"):
            raise ContractError(f"alert rule '{name}' {kind} needs at least one child condition")
        for child in tree["conditions"]:
            _check_condition(child, name)
    elif kind == "not":
        _check_condition(tree["condition"], name)
    else:
        raise ContractError(f"alert rule '{name}' has an unknown condition type '{kind}'")


def compile_condition(tree: dict) -> tuple[Column, Column]:
    """(matched, reason) of a rule tree. A leaf on a missing value is false, so its negation is true."""
    kind = tree["type"]
    if kind == "spread_shock_and_low_confidence":
        shock, score = F.col("spread_shock_bps"), F.col("confidence.score")
        hit = (shock >= tree["min_spread_shock_bps"]) & (score <= tree["max_confidence_score"])
        reason = F.format_string(
            "spread shock %.1f bps with confidence %d (%s)", shock, score, F.col("confidence.level")
        )
        return F.coalesce(hit, F.lit(False)), reason
    if kind == "field_threshold":
        actual, wanted = F.col(ALERT_FIELDS[tree["field"]]).cast("double"), float(tree["value"])
        sign = ALERT_OPS[tree["op"]]
        hit = {
            ">": actual > wanted,
            ">=": actual >= wanted,
            "<": actual < wanted,
            "<=": actual <= wanted,
            "==": F.abs(actual - wanted) <= EPSILON,
        }[sign]
        reason = F.format_string(f"{tree['field']} %.4f {sign} %.4f", actual, F.lit(wanted))
        return F.coalesce(hit, F.lit(False)), reason
    if kind == "not":
        hit, _ = compile_condition(tree["condition"])
        return ~hit, F.lit("not(condition matched false or unavailable)")
    children = [compile_condition(child) for child in tree["conditions"]]
    if kind == "all":
        return reduce(lambda a, b: a & b, [h for h, _ in children]), F.concat_ws("; ", *[r for _, r in children])
    first = F.coalesce(*[F.when(h, r) for h, r in children])
    return reduce(lambda a, b: a | b, [h for h, _ in children]), F.concat(F.lit("any("), first, F.lit(")"))


def evaluate_alerts(snapshots: DataFrame, playbook: dict) -> DataFrame:
    """One row per rule and snapshot that match, in one pass over the snapshots."""
    check_playbook(playbook)
    options = []
    for order, rule in enumerate(playbook["rules"]):
        hit, reason = compile_condition(rule["condition"])
        record = F.struct(
            F.lit(playbook["id"]).alias("playbook_id"),
            F.lit(rule["id"]).alias("rule_id"),
            F.lit(order).alias("rule_order"),
            F.lit(rule["severity"]).alias("severity"),
            F.lit(int(rule["cooldown_ms"])).cast("long").alias("cooldown_ms"),
            F.lit(int(rule["source_interval_ms"])).cast("long").alias("source_interval_ms"),
            reason.alias("reason"),
        )
        options.append(F.when(hit, record))
    return snapshots.select(
        "symbol",
        F.col("now_ms").alias("at_ms"),
        F.col("confidence.level").alias("confidence_level"),
        F.col("confidence.score").alias("confidence_score"),
        F.lit("local_only").alias("action"),
        F.inline(F.array_compact(F.array(*options))),
    )


def seed_cooldowns(history: DataFrame) -> DataFrame:
    """Latest emission per key; suppressed rows do not count."""
    emitted = history.filter(F.col("cooldown_status") == "emitted")
    return emitted.groupBy(*KEY).agg(F.max("at_ms").alias("last_emitted_ms"))


def cooldown_pass(times: np.ndarray, wait: int, last: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """For sorted times of one key: which are emitted, the emission in force at each, and the last one."""
    emitted, before, at = np.zeros(len(times), bool), np.zeros(len(times), np.int64), 0
    while at < len(times):
        due = at if last is None or wait == 0 else max(at, int(np.searchsorted(times, last + wait)))
        before[at:due] = last or 0
        if due == len(times):
            break
        last = int(times[due])
        emitted[due], before[due] = True, last
        at = due + 1
    return emitted, before, last


def apply_cooldown(matches: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Mark each match emitted or suppressed (with the remaining cooldown).

    One sorted pass per key that remembers the last emission only: the next one is the first match at least one
    cooldown later, found by bisection in each Arrow batch. Matches of a key at one time are told apart by their
    place in the order, so only the first of them can be emitted.
    """
    if seeds is None:
        rows = matches.withColumn("last_emitted_ms", F.lit(None).cast("long"))
    else:
        rows = matches.join(seeds.select(*KEY, "last_emitted_ms"), KEY, "left")
    kept = [c for c in rows.columns if c != "last_emitted_ms"]
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "at_ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            times = batch.column("at_ms").to_numpy()
            cooldown = batch.column("cooldown_ms").to_numpy()
            seeded = batch.column("last_emitted_ms").to_pylist()
            starts = [0] * bool(keys) + [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            emitted, before = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key:
                    key, last = keys[start], seeded[start]
                emitted[start:end], before[start:end], last = cooldown_pass(times[start:end], int(cooldown[start]), last)
            remaining = cooldown - np.maximum(times - before, 0)
            status = pa.array(np.where(emitted, "emitted", "suppressed").tolist(), pa.string())
            out = batch.select(kept).append_column("cooldown_status", status)
            yield out.append_column("cooldown_remaining_ms", pa.array(remaining, pa.int64(), mask=emitted))

    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("cooldown_status", T.StringType()), T.StructField("cooldown_remaining_ms", T.LongType())])
    return rows.mapInArrow(run, schema)


HISTORY_COLUMNS = [
    "history_seq", "playbook_id", "rule_id", "symbol", "severity", "at_ms", "reason", "confidence_level", "confidence_score",
    "source_interval_ms", "cooldown_status", "cooldown_remaining_ms", "action",
]


def append_history(evaluated: DataFrame, path: str) -> None:
    """Append alert records; ``history_seq`` orders them by time, rule and symbol."""
    seq = F.struct("at_ms", "rule_order", "symbol")
    evaluated.withColumn("history_seq", seq).select(*HISTORY_COLUMNS).write.mode("append").parquet(path)


def alert_history(history: DataFrame, symbol: str | None = None, limit: int = 20) -> DataFrame:
    """Newest records first."""
    rows = history if symbol is None else history.filter(F.col("symbol") == symbol)
    return rows.orderBy(F.col("history_seq").desc()).limit(limit)
