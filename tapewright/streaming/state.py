"""Keyed streaming state: per-symbol trade state with window features (``market`` has all streams), and alert cooldowns.

Both run on ``transformWithStateInPandas`` with the RocksDB state store. Rows of a key arrive as an
iterator of Arrow batches. Alerts put the batches of a key and micro-batch together before they sort them, so
that results do not depend on the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapewright.operators.alerts import cooldown_pass
from tapewright.operators.features import FeatureParams
from tapewright.streaming.market import StreamParams, market_events, market_state

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
HOUR_MS = 3_600_000

def symbol_state(trades: DataFrame, window_ms: int, flow_ms: int, retention_ms: int = HOUR_MS) -> DataFrame:
    """Trades alone: state and window features as of the symbol's newest trade, one row per symbol and micro-batch.

    Late trades are inserted where they belong and never move the last price backwards; anything older than the retention before the
    newest trade is dropped on arrival, without counting as a duplicate.
    """
    windows = FeatureParams(returns_ms=(("w", window_ms),), flow_ms=flow_ms, retention_ms=retention_ms)
    params = StreamParams(windows, pane_ms=max(1, min(window_ms, flow_ms) // 8))
    rows = market_state(market_events(trades=trades), params)
    kept = ["symbol", "last_update_ms", "last_trade_price", "duplicate_trade_count", "retained"]
    renamed = {"ret": "ret_w", "rv": "rv_w", "flow": "signed_notional_flow_30s"}
    return rows.select(*kept, *[F.col(old).alias(new) for new, old in renamed.items()])


ALERT_SCHEMA = (
    "playbook_id string, rule_id string, symbol string, at_ms bigint, reason string, cooldown_status string, "
    "cooldown_remaining_ms bigint"
)


class Cooldowns(StatefulProcessor):
    """Last emission and last observation per (playbook, rule, symbol).

    A row whose observed values equal the previous ones is not evaluated again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "emitted bigint, observed bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        emitted, observed = self.last.get() if self.last.exists() else (None, None)
        # all rows of the key in this micro-batch, however many Arrow batches they came in
        frame = pd.concat(list(rows), ignore_index=True).sort_values("at_ms", kind="stable")
        before = frame["observed"].shift(1)
        repeated = frame["observed"] == before
        repeated.iloc[0] = observed is not None and observed == int(frame["observed"].iloc[0])
        observed = int(frame["observed"].iloc[-1])
        due = frame[frame["matched"].astype(bool) & ~repeated]
        if len(due):
            times, wait = due["at_ms"].to_numpy(), int(due["cooldown_ms"].iloc[0])
            fresh, since, emitted = cooldown_pass(times, wait, emitted)
            out = pd.DataFrame({"at_ms": times, "reason": due["reason"].to_numpy(), "cooldown_status": np.where(fresh, "emitted", "suppressed")})
            out["cooldown_remaining_ms"] = pd.array(np.where(fresh, 0, wait - np.maximum(times - since, 0)), dtype="Int64")
            out.loc[fresh, "cooldown_remaining_ms"] = pd.NA
            for place, name in enumerate(("playbook_id", "rule_id", "symbol")):
                out.insert(place, name, key[place])
            yield out
        self.last.update((emitted, observed))

    def close(self) -> None:
        pass


def stream_alerts(snapshots: DataFrame, playbook: dict) -> DataFrame:
    """Alerts of a stream of snapshots: every rule keeps its own cooldown per symbol."""
    from tapewright.operators import alerts
    from tapewright.operators.state import ALERT_OBSERVATION

    alerts.check_playbook(playbook)
    options = []
    for rule in playbook["rules"]:
        hit, reason = alerts.compile_condition(rule["condition"])
        options.append(
            F.struct(
                F.lit(playbook["id"]).alias("playbook_id"),
                F.lit(rule["id"]).alias("rule_id"),
                hit.alias("matched"),
                reason.alias("reason"),
                F.lit(int(rule["cooldown_ms"])).cast("long").alias("cooldown_ms"),
            )
        )
    observed = F.xxhash64(*[F.col(alerts.ALERT_FIELDS[c]) for c in ALERT_OBSERVATION])
    rows = snapshots.select("symbol", F.col("now_ms").alias("at_ms"), observed.alias("observed"), F.inline(F.array(*options)))
    return rows.groupBy("playbook_id", "rule_id", "symbol").transformWithStateInPandas(
        statefulProcessor=Cooldowns(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="None"
    )
