"""Screening: named fields, rule text, presets, sorting, limits, selectors, many rules at once.

Rules are Spark SQL expressions over ``screen_view``; Spark parses and plans them. Before that the
fields a rule mentions are checked against the view and each comparison against the field's type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.functions.common import finite_or_null
from tapewright.functions.labels import display_symbol
from tapewright.operators.metadata import selector_match

NUMBER_FIELDS = [
    "price", "mid_px", "mark_px", "day_ntl_vlm", "bid_px", "ask_px", "spread_bps", "confidence_score",
    "spread_shock_bps", "spread_recovery_ms", "fee_expected_round_trip_cost_bps", "signed_notional_flow_30s",
    "bbo_ofi_proxy_30s", "tob_depth_usd", "tob_imbalance", "ret_1m", "ret_5m", "ret_1h", "rv_1m", "rv_5m", "rv_1h",
    "volume_z_1h", "trade_count_z_1h", "liquidity_score", "momentum_score", "mean_reversion_score", "score_total",
    "score_raw_total", "score_confidence_penalty", "metadata_fetched_at_ms", "listing_age_ms", "deploy_time_ms",
    "seeded_usdc", "max_supply", "circulating_supply", "updated_ms_ago",
]
TEXT_FIELDS = [
    "symbol", "confidence_state", "resilience_state", "tradeability_state", "fee_tradeability_state", "fee_profile",
    "adverse_selection_proxy", "metadata_state", "metadata_source", "deployer",
]
TAG_FIELD = "cohort_tag"
COMPONENT_PREFIX = "score_component."
MAX_RULE_LENGTH = 8_192

RENAMED = {
    "confidence_score": "confidence.score",
    "confidence_state": "confidence.level",
    "fee_tradeability_state": "fee_aware_tradeability.state",
    "fee_expected_round_trip_cost_bps": "fee_aware_tradeability.expected_round_trip_cost_bps",
    "fee_profile": "fee_aware_tradeability.profile_name",
    "score_total": "score_breakdown.adjusted_total",
    "score_raw_total": "score_breakdown.raw_total",
    "metadata_source": "metadata.metadata_source",
    "metadata_fetched_at_ms": "metadata.metadata_fetched_at_ms",
    "listing_age_ms": "metadata.listing_age_ms",
    "deployer": "metadata.deployer",
    "deploy_time_ms": "metadata.deploy_time_ms",
    "seeded_usdc": "metadata.seeded_usdc",
    "max_supply": "metadata.max_supply",
    "circulating_supply": "metadata.circulating_supply",
}


def screen_view(snapshots: DataFrame) -> DataFrame:
    """The named screen fields; unused ones are pruned by the optimizer."""
    cols: list[Column] = []
    for name in NUMBER_FIELDS:
        if name == "score_confidence_penalty":
            source = F.col("score_breakdown.adjusted_total") - F.col("score_breakdown.raw_total")
        else:
            source = F.col(RENAMED.get(name, name))
        cols.append(finite_or_null(source.cast("double")).alias(name))
    for name in TEXT_FIELDS:
        if name == "metadata_state":
            complete = F.when(F.size("metadata.unknown_fields") == 0, "complete").otherwise("partial")
            cols.append(F.when(F.col("metadata").isNull(), "missing").otherwise(complete).alias(name))
        else:
            cols.append(F.col(RENAMED.get(name, name)).alias(name))
    listed = F.col("metadata.cohort_tags")
    cols.append(F.coalesce(listed, F.array(F.lit("unknown_metadata"))).alias(TAG_FIELD))
    entries = F.transform("score_breakdown.components", lambda c: F.struct(c["name"], c["signed_contribution"]))
    cols.append(F.map_from_entries(entries).alias("score_component"))
    cols.append(display_symbol().alias("display_symbol"))
    if "now_ms" in snapshots.columns:
        cols.append(F.col("now_ms"))
    return snapshots.select(*cols)


# --- rule text ----------------------------------------------------------------------------------

_OPERAND = r'(?:abs\(\s*[\w.]+\s*\)|"[^"]*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z_][\w.]*)'
_COMPARISON = re.compile(rf"({_OPERAND})\s*(>=|<=|==|!=|>|<)\s*({_OPERAND})")


def _kind(operand: str) -> str:
    if operand.startswith('"'):
        return "text"
    if operand in ("true", "false"):
        return "bool"
    if re.match(r"-?\d", operand):
        return "number"
    name = re.sub(r"^abs\(\s*|\s*\)$", "", operand)
    if name.startswith(COMPONENT_PREFIX) and len(name) > len(COMPONENT_PREFIX) or name in NUMBER_FIELDS:
        return "number"
    if name in TEXT_FIELDS:
        return "text" if name == operand else "missing"
    if name == TAG_FIELD:
        return "tags" if name == operand else "missing"
    raise ContractError(f"unknown field '{name}'")


def _one_comparison(match: re.Match) -> str:
    left, op, right = match.groups()
    kinds = {_kind(left), _kind(right)}
    if "missing" in kinds:
        return "false"
    if "tags" in kinds:
        if op not in ("==", "!=") or kinds - {"tags", "text"}:
            raise ContractError("a tag list compares only with text, by == or !=")
        if kinds == {"tags"}:
            found = f"arrays_overlap({left}, {right})"
        else:
            tag, text = (left, right) if _kind(left) == "tags" else (right, left)
            found = f"array_contains({tag}, {text})"
        return found if op == "==" else f"not {found}"
    if len(kinds) > 1:
        raise ContractError(f"type-incompatible comparison '{match.group(0)}'")
    if kinds != {"number"} and op not in ("==", "!="):
        raise ContractError("ordered comparisons require numeric values")
    return match.group(0)


def rule_column(where: str) -> Column:
    """Check a rule's fields and types and return it as a predicate column."""
    if len(where) > MAX_RULE_LENGTH:
        raise ContractError("rule text is too long")
    checked = _COMPARISON.sub(_one_comparison, where)
    leftover = _COMPARISON.sub(" ", where)
    words = set(re.findall(r"[A-Za-z_][\w.]*", leftover)) - {"and", "or", "AND", "OR"}
    if words or not _COMPARISON.search(where):
        raise ContractError(f"rule has a part that is not a comparison: {sorted(words) or where!r}")
    try:
        return F.expr(f"({checked})")
    except PySparkException as error:
        raise ContractError(f"rule cannot be parsed: {where!r}") from error


def screen_filter(view: DataFrame, where: str) -> DataFrame:
    """Rows whose rule is true; a missing value never matches."""
    try:
        return view.filter(rule_column(where))
    except PySparkException as error:
        raise ContractError(f"rule cannot be planned: {where!r}") from error


def sort_key(text: str) -> tuple[Column, bool]:
    match = re.fullmatch(r"\s*(abs\(\s*([\w.]+)\s*\)|[\w.]+)\s*(?::\s*(asc|desc))?\s*", text)
    if not match:
        raise ContractError(f"sort '{text}' must look like field:desc or abs(field):asc")
    operand = match.group(1)
    kind = _kind(operand)
    if kind == "missing":
        key = F.lit(None).cast("double")
    elif kind == "tags":
        key = F.array_join(operand, ",")
    else:
        key = F.expr(operand)
    return key, match.group(3) == "desc"


def screen_sort(view: DataFrame, sort: str) -> DataFrame:
    """Missing values last in both directions, symbol order among equals."""
    key, descending = sort_key(sort)
    return view.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "symbol")


# Built-in presets (name, rule, order).
PRESETS = {
    "liquid_momentum": (
        "liquidity_score > 70 and volume_z_1h > 2 and ret_5m > 0 and spread_bps < 30",
        "momentum_score:desc",
    ),
    "volume_anomaly": ("volume_z_1h > 3 and trade_count_z_1h > 2", "volume_z_1h:desc"),
    "tight_spread_movers": ("spread_bps < 20 and abs(ret_5m) > 0.01", "abs(ret_5m):desc"),
    "mean_reversion_watch": (
        "mean_reversion_score > 70 and liquidity_score > 60",
        "mean_reversion_score:desc",
    ),
    "thin_books": ("day_ntl_vlm > 100000 and tob_depth_usd < 5000", "tob_depth_usd:asc"),
    "liquidity_resilience": (
        'tradeability_state == "tradeable" and resilience_state == "normal"',
        "tob_depth_usd:desc",
    ),
    "brittle_tradeability": (
        'tradeability_state == "thin" or resilience_state == "brittle" or adverse_selection_proxy == "brittle"',
        "spread_bps:desc",
    ),
    "flow_pressure": ("abs(signed_notional_flow_30s) > 1000", "abs(signed_notional_flow_30s):desc"),
    "new_listings": ('cohort_tag == "new_listing"', "listing_age_ms:asc"),
    "fresh_liquidity": ('cohort_tag == "fresh_liquidity"', "seeded_usdc:desc"),
    "metadata_unknown": ('cohort_tag == "unknown_metadata"', "metadata_fetched_at_ms:desc"),
}


@dataclass(frozen=True)
class ScreenRequest:
    preset: str | None = None
    where: str | None = None
    sort: str | None = None

    def resolved(self) -> tuple[str | None, str | None]:
        """A preset supplies defaults; a custom rule or order replaces only its own part."""
        where = sort = None
        if self.preset is not None:
            if self.preset not in PRESETS:
                raise ContractError(f"unknown preset '{self.preset}'")
            where, sort = PRESETS[self.preset]
        return self.where or where, self.sort or sort


def screen(view: DataFrame, request: ScreenRequest, limit: int | None = None) -> DataFrame:
    where, sort = request.resolved()
    rows = screen_filter(view, where) if where else view
    rows = screen_sort(rows, sort) if sort else rows.orderBy("symbol")
    return screen_limit(rows, limit) if limit is not None else rows


def screen_limit(rows: DataFrame, n: int) -> DataFrame:
    """After a sort this is one top-k step, without a full sort of the rows."""
    return rows.limit(n)


def screen_batch(view: DataFrame, requests: dict[str, ScreenRequest]) -> DataFrame:
    """Many rules in one scan: each row lists the requests it matches, one output row per match.

    ``rank`` follows each request's own order.
    """
    from pyspark.sql.window import Window

    matches, ranks = [], []
    for name, request in requests.items():
        where, sort = request.resolved()
        hit = F.coalesce(rule_column(where), F.lit(False)) if where else F.lit(True)
        key, descending = sort_key(sort or "symbol:asc")
        matches.append(F.when(hit, F.lit(name)))
        order = key.desc_nulls_last() if descending else key.asc_nulls_last()
        ranks.append((name, F.row_number().over(Window.partitionBy("request").orderBy(order, "symbol"))))
    rows = view.withColumn("request", F.explode(F.array_compact(F.array(*matches))))
    rank = reduce(lambda acc, item: acc.when(F.col("request") == item[0], item[1]), ranks, F.when(F.lit(False), 0))
    return rows.withColumn("rank", rank)


class ScreenSession:
    """Keeps the last good result: a request that fails leaves it untouched."""

    def __init__(self) -> None:
        self.request: ScreenRequest | None = None
        self.rows: DataFrame | None = None

    def apply(self, view: DataFrame, request: ScreenRequest) -> DataFrame:
        rows = screen(view, request)
        self.request, self.rows = request, rows
        return rows


def lookup_symbol(view: DataFrame, selector: str) -> DataFrame:
    return view.filter(selector_match(selector, F.col("symbol"), F.col("display_symbol")))


def symbol_candidates(view: DataFrame, text: str, limit: int) -> DataFrame:
    """Rows whose feed id or display name contains the text, ignoring case."""
    needle = text.strip().lower()
    hit = F.contains(F.lower("display_symbol"), F.lit(needle)) | F.contains(F.lower("symbol"), F.lit(needle))
    return view.filter(hit if needle else F.lit(True)).orderBy("symbol").limit(limit)
