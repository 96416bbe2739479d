"""Research metric array: eight (name, support, value, unit, reason) records per snapshot."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.functions import book
from tapewright.functions.common import signed
from tapewright.operators.ordered import ordered_scan

METRIC_TYPE = "struct<name:string,support:string,value:double,unit:string,reason:string>"

# Metric order, units and the reason texts that go with each outcome.
NAMES = [
    "public_trade_vwap_1m",
    "public_trade_return_1m",
    "amihud_1m",
    "roll_effective_spread",
    "bipower_variation_5m",
    "bbo_ofi_proxy_30s",
    "signed_flow_toxicity_proxy_30s",
    "adverse_selection_toxicity_proxy",
]
UNITS = {
    "public_trade_vwap_1m": "price",
    "public_trade_return_1m": "decimal_return",
    "amihud_1m": "return_per_usd",
    "roll_effective_spread": "price",
    "bipower_variation_5m": "decimal_variance",
    "bbo_ofi_proxy_30s": "usd_notional",
    "signed_flow_toxicity_proxy_30s": "ratio",
    "adverse_selection_toxicity_proxy": "ordinal",
}
CANONICAL = {"public_trade_vwap_1m", "public_trade_return_1m"}
PROXY_REASON = {
    "amihud_1m": "bounded public-trade Amihud-style proxy; not a canonical production estimate",
    "roll_effective_spread": "bounded public-trade Roll-style proxy without production sampling validation",
    "bipower_variation_5m": "bounded trade-to-trade bipower-style proxy without canonical time-bar sampling",
    "bbo_ofi_proxy_30s": "top-of-book proxy, not full-depth order-flow imbalance",
    "signed_flow_toxicity_proxy_30s": "public trade signed-flow concentration proxy, not canonical toxicity or fill quality",
    "adverse_selection_toxicity_proxy": "ordinal proxy from top-of-book resilience, signed flow, and BBO OFI",
}
TOO_FEW_REASON = {
    "public_trade_vwap_1m": "need at least three valid public trades in the 1m exchange-time window",
    "public_trade_return_1m": "need at least three valid public trades in the 1m exchange-time window",
    "amihud_1m": "need at least two trades in the 1m public trade window",
    "roll_effective_spread": "need at least four trades for adjacent price-change covariance",
    "bipower_variation_5m": "need at least three trades for adjacent absolute return products",
    "bbo_ofi_proxy_30s": "need at least two public BBO updates in the 30s window",
    "signed_flow_toxicity_proxy_30s": "need at least two trades in the 30s public trade window",
    "adverse_selection_toxicity_proxy": "need signed flow, BBO OFI proxy, and top-of-book depth",
}
BAD_INPUT_REASON = {
    "public_trade_vwap_1m": "public trade size and notional must be finite and positive",
    "public_trade_return_1m": "public trade prices must be finite and positive",
    "amihud_1m": "1m public trade notional must be positive",
    "roll_effective_spread": "non-negative adjacent price-change covariance does not support Roll spread estimate",
    "bipower_variation_5m": "trade prices must be finite and positive",
    "signed_flow_toxicity_proxy_30s": "30s public trade notional must be positive",
}


def metric_scan(trades: DataFrame, all_small: bool = False) -> DataFrame:
    """Trades with ``prev``, ``prev2`` and ``next`` in (time, trade id) order.

    These metrics order trades by trade id on equal times, unlike the return windows, which keep arrival
    order; hence their own scan.
    """
    return ordered_scan(trades, ["symbol"], "exchange_ts_ms", "tid", previous=["price"], depth=2, position="_mpos", following=["price"], all_small=all_small)


SHORT_PARTS = {"m_n", "m_size", "m_px_size", "m_notional", "m_first", "m_last"}
LONG_PARTS = {"m_n", "m_first", "m_triples", "m_cov", "m_bipower"}
FLOW_PARTS = {"m_n", "m_gross", "m_net"}


def metric_parts() -> dict[str, tuple[str, Column]]:
    """What a window adds up over its trades (``metric_scan``); triples end at the trade of the row."""
    price, prev, prev2, after = F.col("price"), F.col("prev.price"), F.col("prev2.price"), F.col("next.price")
    cov = (prev - prev2) * (price - prev)
    bipower = F.abs(book.simple_return(prev2, prev)) * F.abs(book.simple_return(prev, price))
    next_cov = (price - prev) * (after - price)
    next_bipower = F.abs(book.simple_return(prev, price)) * F.abs(book.simple_return(price, after))
    usable = (F.abs("notional") < float("inf")) & (F.col("notional") > 0)
    first = F.struct("_mpos", price.alias("price"), cov.alias("cov"), bipower.alias("bipower"), next_cov.alias("next_cov"), next_bipower.alias("next_bipower"))
    return {
        "m_n": ("sum", F.lit(1).cast("long")),
        "m_size": ("sum", F.col("size")),
        "m_px_size": ("sum", price * F.col("size")),
        "m_notional": ("sum", F.col("notional")),
        "m_first": ("min", first),
        "m_last": ("max", F.struct("_mpos", price.alias("price"))),
        "m_triples": ("sum", F.when(cov.isNotNull(), 1).otherwise(0).cast("long")),
        "m_cov": ("sum", cov),
        "m_bipower": ("sum", bipower),
        "m_gross": ("sum", F.when(usable, F.col("notional"))),
        "m_net": ("sum", F.when(usable, signed("side", "notional"))),
    }


def metric_columns(p) -> dict[str, Column]:
    """Raw values and observation counts of the trade-based metrics from the windows of ``sliding``.

    Triples that reach back before the window are those of its first two trades; they are taken off again.
    """
    short, long, flow = (F.col(f"w{ms}") for ms in (p.vwap_ms, p.roll_ms, p.flow_ms))
    two = long["m_n"] >= 2

    def inside(total: Column, name: str) -> Column:
        first = long["m_first"]
        return total - F.coalesce(first[name], F.lit(0.0)) - F.when(two, F.coalesce(first[f"next_{name}"], F.lit(0.0))).otherwise(F.lit(0.0))

    def missing(name: str) -> Column:
        return F.when(long["m_first"][name].isNotNull(), 1).otherwise(0)

    triples = long["m_triples"] - missing("cov") - F.when(two, missing("next_cov")).otherwise(0)
    return {
        "m_n_short": F.coalesce(short["m_n"], F.lit(0).cast("long")),
        "m_n_long": F.coalesce(long["m_n"], F.lit(0).cast("long")),
        "m_n_flow": F.coalesce(flow["m_n"], F.lit(0).cast("long")),
        "m_size": short["m_size"],
        "m_px_size": short["m_px_size"],
        "m_notional": short["m_notional"],
        "m_ret": book.simple_return(short["m_first"]["price"], short["m_last"]["price"]),
        "m_cov": F.when(triples > 0, inside(long["m_cov"], "cov") / triples),
        "m_bipower": F.when(triples > 0, F.greatest(inside(long["m_bipower"], "bipower"), F.lit(0.0))),
        "m_abs_flow": flow["m_gross"],
        "m_net_flow": flow["m_net"],
    }


def _enough(count: str, floor: int) -> Column:
    return F.coalesce(F.col(count), F.lit(0)) >= floor


def metric_values() -> dict[str, tuple[Column, Column]]:
    """Per metric: (enough observations, value or null when its inputs are unusable)."""
    def finite(c: Column) -> Column:
        return F.when(F.abs(c) < float("inf"), c)

    px, sz, ntl = F.col("m_px_size"), F.col("m_size"), F.col("m_notional")
    ordinal = (
        F.when(F.col("adverse_selection_proxy") == "normal", 0.0)
        .when(F.col("adverse_selection_proxy") == "watch", 1.0)
        .when(F.col("adverse_selection_proxy") == "brittle", 2.0)
    )
    return {
        "public_trade_vwap_1m": (_enough("m_n_short", 3), finite(F.when((sz > 0) & (px > 0), px / F.when(sz > 0, sz)))),
        "public_trade_return_1m": (_enough("m_n_short", 3), finite(F.col("m_ret"))),
        "amihud_1m": (_enough("m_n_short", 2), finite(F.abs("m_ret") / F.when(ntl > 0, ntl))),
        "roll_effective_spread": (
            _enough("m_n_long", 4),
            F.when(finite(F.col("m_cov")) < 0, 2.0 * F.sqrt(F.greatest(-F.col("m_cov"), F.lit(0.0)))),
        ),
        "bipower_variation_5m": (_enough("m_n_long", 3), F.lit(math.pi / 2) * F.col("m_bipower")),
        "bbo_ofi_proxy_30s": (F.col("bbo_ofi_proxy_30s").isNotNull(), finite(F.col("bbo_ofi_proxy_30s"))),
        "signed_flow_toxicity_proxy_30s": (
            _enough("m_n_flow", 2),
            F.when(
                finite(F.col("m_abs_flow")) > 0,
                F.least(F.abs("m_net_flow") / F.when(F.col("m_abs_flow") > 0, F.col("m_abs_flow")), F.lit(1.0)),
            ),
        ),
        "adverse_selection_toxicity_proxy": (ordinal.isNotNull(), ordinal),
    }


def metric_record(name: str, enough: Column, value: Column) -> Column:
    good = enough & value.isNotNull()
    support = F.when(good, "canonical" if name in CANONICAL else "proxy").otherwise("unavailable")
    reason = (
        F.when(good, F.lit(PROXY_REASON.get(name)))
        .when(enough, F.lit(BAD_INPUT_REASON.get(name, TOO_FEW_REASON[name])))
        .otherwise(F.lit(TOO_FEW_REASON[name]))
    )
    return F.struct(
        F.lit(name).alias("name"),
        support.alias("support"),
        F.when(good, value).alias("value"),
        F.lit(UNITS[name]).alias("unit"),
        reason.alias("reason"),
    )


def metric_array() -> Column:
    values = metric_values()
    return F.array(*[metric_record(name, *values[name]) for name in NAMES])


def metric_rows(snapshots: DataFrame) -> DataFrame:
    """Tall form: one row per symbol, decision time and metric, in the fixed metric order."""
    return snapshots.select("symbol", "now_ms", F.posexplode("microstructure_metrics").alias("position", "m")).select(
        "symbol", "now_ms", "position", "m.*"
    )


def metric(snapshots: DataFrame, name: str) -> DataFrame:
    """One metric for every snapshot, without exploding the others."""
    record = F.get("microstructure_metrics", F.lit(NAMES.index(name)))
    return snapshots.select("symbol", "now_ms", record.alias("m")).select("symbol", "now_ms", "m.*")


@dataclass(frozen=True)
class SamplingContract:
    metric_name: str
    unit: str
    version: int = 1
    window_ms: int = 60_000
    minimum_observations: int = 3
    absolute_tolerance: float = 1e-12
    relative_tolerance: float = 1e-12

    def check(self) -> None:
        tolerances = (self.absolute_tolerance, self.relative_tolerance)
        problems = {
            "metric name must be snake_case": not (
                self.metric_name and self.metric_name[0].isalpha()
                and all(c.islower() or c.isdigit() or c == "_" for c in self.metric_name)
            ),
            "version must be positive": self.version <= 0,
            "window must be positive": self.window_ms <= 0,
            "observation floor must be positive": self.minimum_observations <= 0,
            "unit cannot be empty": not self.unit.strip(),
            "tolerances must be finite, non-negative and not both zero": (
                any(not math.isfinite(t) or t < 0 for t in tolerances) or not any(tolerances)
            ),
        }
        for text, broken in problems.items():
            if broken:
                raise ContractError(f"sampling contract '{self.metric_name}': {text}")


CANONICAL_CONTRACTS = [SamplingContract(name, UNITS[name]) for name in NAMES if name in CANONICAL]


def validate_metric(actual: DataFrame, expected: DataFrame, contract: SamplingContract, keys: list[str]) -> DataFrame:
    """Compare ``value`` with ``expected_value``; ``observations`` must reach the contract's floor.

    Adds ``difference``, ``allowed`` and ``verdict`` (ok / insufficient / not_finite / drift).
    """
    contract.check()
    inf = float("inf")
    allowed = F.greatest(
        F.lit(contract.absolute_tolerance), F.lit(contract.relative_tolerance) * F.abs("expected_value")
    )
    joined = actual.join(expected, keys).withColumn("difference", F.abs(F.col("value") - F.col("expected_value")))
    finite = F.coalesce((F.abs("value") < inf) & (F.abs("expected_value") < inf), F.lit(False))
    return joined.withColumn("allowed", allowed).withColumn(
        "verdict",
        F.when(F.col("observations") < contract.minimum_observations, "insufficient")
        .when(~finite, "not_finite")
        .when(F.col("difference") > F.col("allowed"), "drift")
        .otherwise("ok"),
    )
