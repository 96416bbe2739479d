"""Screen rules, alert rules and cooldowns, annotations: contracts and edge cases."""

import pytest
from pyspark.sql import functions as F

from tapewright.errors import ContractError
from tapewright.operators import alerts, annotate, screen
from tapewright.operators.metadata import select_universe


@pytest.fixture(scope="module")
def view(spark):
    numbers = {c: F.lit(None).cast("double") for c in screen.NUMBER_FIELDS}
    texts = {c: F.lit(None).cast("string") for c in screen.TEXT_FIELDS}
    rows = spark.createDataFrame(
        [("A", 10.0, -0.5, "thin", ["x", "y"]), ("B", None, 0.2, "tradeable", ["y"]), ("C", 40.0, 0.1, "costly", ["unknown_metadata"])],
        "symbol string, spread_bps double, ret_5m double, tradeability_state string, cohort_tag array<string>",
    )
    extra = {k: v for k, v in {**numbers, **texts}.items() if k not in rows.columns}
    rows = rows.withColumns(extra).withColumn("display_symbol", F.concat("symbol", F.lit("/USD")))
    return rows.withColumn("score_component", F.create_map(F.lit("momentum"), F.col("ret_5m")))


def names(df):
    return [r.symbol for r in df.collect()]


def test_missing_never_matches(view):
    assert names(screen.screen_filter(view, "spread_bps != 10")) == ["C"]
    assert names(screen.screen_filter(view, "spread_bps < 50 or abs(ret_5m) < 0.3")) == ["A", "B", "C"]
    assert names(screen.screen_filter(view, "score_component.momentum > 0 and score_component.nope == 1")) == []


def test_tags(view):
    assert names(screen.screen_filter(view, 'cohort_tag == "y"')) == ["A", "B"]
    assert names(screen.screen_filter(view, 'cohort_tag != "y"')) == ["C"]


def test_sort_puts_missing_last_both_ways(view):
    assert names(screen.screen_sort(view, "spread_bps:desc")) == ["C", "A", "B"]
    assert names(screen.screen_sort(view, "spread_bps:asc")) == ["A", "C", "B"]
    assert names(screen.screen_sort(view, "abs(ret_5m):desc")) == ["A", "B", "C"]


@pytest.mark.parametrize(
    "rule",
    ["nope > 1", 'spread_bps > "x"', 'symbol > "A"', "spread_bps", "drop_table(1) > 0", "spread_bps > 1 and", 'cohort_tag > "x"'],
)
def test_bad_rules_are_refused(view, rule):
    with pytest.raises(ContractError):
        screen.screen_filter(view, rule)


def test_session_keeps_last_good_result(view):
    session = screen.ScreenSession()
    session.apply(view, screen.ScreenRequest(where="spread_bps > 5", sort="symbol:desc"))
    with pytest.raises(ContractError):
        session.apply(view, screen.ScreenRequest(preset="no_such_preset"))
    assert names(session.rows) == ["C", "A"]


def test_lookup(view):
    assert names(screen.lookup_symbol(view, "b-usd")) == ["B"]
    assert names(screen.symbol_candidates(view, "/us", 2)) == ["A", "B"]


def playbook(condition, **rule):
    base = {"id": "r", "description": "", "severity": "watch", "condition": condition, "cooldown_ms": 60_000, "source_interval_ms": 1, "action": "local_only"}
    return {"schema_version": 1, "id": "p", "description": "", "rules": [{**base, **rule}]}


LEAF = {"type": "field_threshold", "field": "spread_bps", "op": "gt", "value": 5.0}


@pytest.mark.parametrize(
    "broken",
    [
        playbook({"type": "all", "conditions": []}),
        playbook({**LEAF, "value": float("nan")}),
        playbook({**LEAF, "field": "secret"}),
        playbook(LEAF, action="exchange_action"),
        playbook(LEAF, cooldown_ms=-1),
        {**playbook(LEAF), "schema_version": 2},
        {**playbook(LEAF), "rules": playbook(LEAF)["rules"] * 2},
    ],
)
def test_bad_playbooks_are_refused(broken):
    with pytest.raises(ContractError):
        alerts.check_playbook(broken)


def greedy(times, cooldown, seed=None):
    last, out = seed, []
    for t in times:
        if last is None or max(t - last, 0) >= cooldown:
            last = t
            out.append((t, "emitted", None))
        else:
            out.append((t, "suppressed", cooldown - max(t - last, 0)))
    return out


@pytest.mark.parametrize("seed", [None, 950, 5_000])
def test_cooldown_equals_greedy(spark, seed):
    times = sorted({(i * 7919) % 4_000 for i in range(120)})
    matches = spark.createDataFrame([("p", "r", "A", t, 100, 0) for t in times], "playbook_id string, rule_id string, symbol string, at_ms bigint, cooldown_ms bigint, rule_order int")
    seeds = None if seed is None else spark.createDataFrame([("p", "r", "A", seed)], "playbook_id string, rule_id string, symbol string, last_emitted_ms bigint")
    rows = alerts.apply_cooldown(matches, seeds).orderBy("at_ms").collect()
    assert [(r.at_ms, r.cooldown_status, r.cooldown_remaining_ms) for r in rows] == greedy(times, 100, seed)


def test_second_alert_six_seconds_later_is_suppressed(spark):
    rows = spark.createDataFrame([("p", "r", "A", t, 60_000) for t in (0, 6_000)], "playbook_id string, rule_id string, symbol string, at_ms bigint, cooldown_ms bigint")
    got = [(r.cooldown_status, r.cooldown_remaining_ms) for r in alerts.apply_cooldown(rows).orderBy("at_ms").collect()]
    assert got == [("emitted", None), ("suppressed", 54_000)]


def test_annotations_are_checked(spark):
    rows = spark.createDataFrame(
        [("A", 1, "A", "fine", "text"), ("A", 1, "B", "other", "text"), ("B", 1, "B", "place order", "x"), ("C", 1, "C", "ok", "x" * 50), ("D", 1, "D", "ok", "x")],
        annotate.SCHEMA,
    )
    got = {r.input_symbol: r.problem for r in annotate.validate_annotations(rows, 40).collect() if r.label != "other"}
    assert got["A"].startswith("symbol does not match") and got["B"].startswith("unsafe") and "bytes" in got["C"] and got["D"] is None
    assert [r.symbol for r in annotate.accepted_annotations(rows, 40).collect()] == ["D"]


def test_universe_selection(spark):
    rows = spark.createDataFrame([("@1", "A/U", 5.0), ("@2", "B/U", None), ("@3", "C/U", 9.0)], "symbol string, display_name string, day_ntl_vlm double")
    assert [r.symbol for r in select_universe(rows, 3).collect()] == ["@3", "@1", "@2"]
    assert [r.symbol for r in select_universe(rows, 3, include=["a-u", "@2"], exclude=["B/U"]).collect()] == ["@1"]
    with pytest.raises(ContractError):
        select_universe(rows, 0)
