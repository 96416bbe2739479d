"""Listing metadata: symbols, contexts, token details, cohort tags, universe selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.errors import ContractError
from tapewright.functions.common import tags
from tapewright.operators.ordered import lookup_join
from tapewright.operators.scoring import METADATA_TYPE

# Cohort rules and the one pair whose feed id is its name.
NEW_LISTING_MS = 14 * 24 * 3_600_000
LOW_FLOAT_RATIO = 0.25
NAMED_FEED_PAIR = "PURR/USDC"
OPTIONAL_FIELDS = ["deployer", "deploy_time_ms", "seeded_usdc", "max_supply", "circulating_supply"]

TOKEN = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("index", T.IntegerType()),
            T.StructField("szDecimals", T.IntegerType()),
            T.StructField("weiDecimals", T.IntegerType()),
            T.StructField("isCanonical", T.BooleanType()),
            T.StructField("tokenId", T.StringType()),
        ]
    )
)
PAIR = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("tokens", T.ArrayType(T.IntegerType())),
            T.StructField("index", T.IntegerType()),
            T.StructField("isCanonical", T.BooleanType()),
        ]
    )
)


def _rows(raw: DataFrame, path: str, schema: T.DataType) -> DataFrame:
    """Explode a JSON array found at ``path`` of column ``json``, keeping array positions."""
    array = F.from_json(F.get_json_object("json", path), schema)
    return raw.select(F.posexplode(array).alias("position", "r")).select("position", "r.*")


def tokens_from_meta(raw: DataFrame, root: str = "$") -> DataFrame:
    return _rows(raw, f"{root}.tokens", TOKEN)


def universe_from_meta(raw: DataFrame, root: str = "$") -> DataFrame:
    return _rows(raw, f"{root}.universe", PAIR)


def feed_id(display_name: Column, spot_index: Column) -> Column:
    named = F.upper(display_name) == NAMED_FEED_PAIR
    return F.when(named, NAMED_FEED_PAIR).otherwise(F.concat(F.lit("@"), spot_index.cast("string")))


def symbols_from_meta(tokens: DataFrame, universe: DataFrame) -> DataFrame:
    """Pairs with display name and feed id; ``problem`` tells why a pair is not usable."""
    side = lambda prefix: tokens.select(
        F.col("index").alias(f"{prefix}_token_index"),
        F.col("name").alias(f"_{prefix}_name"),
        F.col("szDecimals").alias(f"_{prefix}_sz"),
        F.col("weiDecimals").alias(f"_{prefix}_wei"),
        F.coalesce("isCanonical", F.lit(False)).alias(f"_{prefix}_canonical"),
        F.col("tokenId").alias(f"_{prefix}_token_id"),
    )
    pairs = universe.withColumns(
        {"base_token_index": F.get("tokens", F.lit(0)), "quote_token_index": F.get("tokens", F.lit(1))}
    )
    joined = lookup_join(lookup_join(pairs, side("base"), ["base_token_index"]), side("quote"), ["quote_token_index"])
    display = F.trim(F.concat_ws("/", "_base_name", "_quote_name"))
    problem = (
        F.when(F.col("base_token_index").isNull(), "missing base token")
        .when(F.col("quote_token_index").isNull(), "missing quote token")
        .when(F.col("_base_name").isNull(), "unknown base token")
        .when(F.col("_quote_name").isNull(), "unknown quote token")
    )
    return joined.select(
        "position",
        F.col("index").alias("symbol_id"),
        display.alias("display_name"),
        feed_id(display, F.col("index")).alias("symbol"),
        F.col("index").alias("spot_index"),
        "base_token_index",
        "quote_token_index",
        F.col("_base_sz").alias("sz_decimals"),
        F.col("_base_wei").alias("wei_decimals"),
        (F.coalesce("isCanonical", F.lit(False)) & F.col("_base_canonical")).alias("is_canonical"),
        F.col("_base_token_id").alias("base_token_id"),
        problem.alias("problem"),
    )


def checked_symbols(tokens: DataFrame, universe: DataFrame) -> DataFrame:
    """``symbols_from_meta`` that refuses a universe with an unusable pair."""
    rows = symbols_from_meta(tokens, universe)
    bad = rows.filter(F.col("problem").isNotNull()).select("position", "problem").first()
    if bad:
        raise ContractError(f"universe entry {bad['position']}: {bad['problem']}")
    return rows.drop("problem")


def _number(field: str, zero_is_missing: bool = False) -> Column:
    parsed = F.expr(f"try_cast({field} AS double)")
    parsed = F.when(F.abs(parsed) < float("inf"), parsed)
    return F.when(parsed > 0, parsed) if zero_is_missing else F.when(parsed >= 0, parsed)


CONTEXT = T.ArrayType(
    T.StructType(
        [T.StructField(c, T.StringType()) for c in ("coin", "dayNtlVlm", "prevDayPx", "markPx", "midPx", "circulatingSupply")]
    )
)


def contexts_from_meta(raw: DataFrame, path: str = "$[1]") -> DataFrame:
    return _rows(raw, path, CONTEXT)


def market_contexts(symbols: DataFrame, contexts: DataFrame, details: DataFrame, fetched_at_ms: int, now_ms: int) -> DataFrame:
    """Symbols with their context and enrichment.

    Contexts join by coin as soon as one of them names a coin, else by array position. Token details
    override the context's circulating supply.
    """
    numbers = contexts.select(
        "position",
        "coin",
        _number("dayNtlVlm").alias("day_ntl_vlm"),
        _number("prevDayPx", True).alias("prev_day_px"),
        _number("markPx", True).alias("mark_px"),
        _number("midPx", True).alias("mid_px"),
        _number("circulatingSupply").alias("_context_supply"),
    )
    by_coin = bool(contexts.filter(F.col("coin").isNotNull()).limit(1).count())
    if by_coin:
        side = numbers.filter(F.col("coin").isNotNull()).drop("position").withColumnRenamed("coin", "symbol")
        joined = symbols.join(side, "symbol", "left")
    else:
        joined = symbols.join(numbers.drop("coin"), "position", "left")
    extra = details.select(
        F.col("token_id").alias("base_token_id"),
        F.lit(True).alias("_known"),
        "deployer",
        "deploy_time_ms",
        "seeded_usdc",
        "max_supply",
        F.col("circulating_supply").alias("_detail_supply"),
    )
    joined = joined.join(extra, "base_token_id", "left").withColumns(
        {
            "circulating_supply": F.coalesce("_detail_supply", "_context_supply"),
            "feed_identifier": F.col("symbol"),
            "metadata_source": F.when(F.col("_known"), "spotMetaAndAssetCtxs+tokenDetails").otherwise("spotMetaAndAssetCtxs"),
        }
    )
    enriched = enrich_metadata(joined, fetched_at_ms, now_ms, keep=["position", "day_ntl_vlm", "prev_day_px", "mark_px", "mid_px"])
    return enriched


DETAILS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name", "deployer", "deployTime", "seededUsdc", "maxSupply", "circulatingSupply")]
)


def token_details(raw: DataFrame) -> DataFrame:
    """From (token_id, json): typed details; UTC datetime to milliseconds, blank deployer is missing."""
    parsed = raw.select("token_id", F.from_json("json", DETAILS).alias("d")).select("token_id", "d.*")
    utc = F.expr("try_to_timestamp(concat(substr(deployTime, 1, 19), ' UTC'), \"yyyy-MM-dd'T'HH:mm:ss VV\")")
    fraction = F.regexp_extract("deployTime", r"\.(\d+)$", 1)
    millis = F.expr("unix_seconds(_utc)") * 1000 + F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("long")
    return (
        parsed.withColumn("_utc", utc)
        .select(
            "token_id",
            "name",
            F.when(F.trim("deployer") != "", F.col("deployer")).alias("deployer"),
            F.when(F.col("_utc").isNotNull(), millis).alias("deploy_time_ms"),
            _number("seededUsdc").alias("seeded_usdc"),
            _number("maxSupply").alias("max_supply"),
            _number("circulatingSupply").alias("circulating_supply"),
        )
    )


def enrich_metadata(inputs: DataFrame, fetched_at_ms: int, now_ms: int, keep: list[str] = ()) -> DataFrame:
    """Listing age, missing fields and cohort tags of each metadata row."""
    age = F.greatest(F.lit(now_ms).cast("long") - F.col("deploy_time_ms"), F.lit(0).cast("long"))
    missing = {c: F.col(c).isNull() for c in OPTIONAL_FIELDS}
    missing["deployer"] = F.coalesce(F.col("deployer") == "", F.lit(True))
    rows = inputs.withColumn("metadata_fetched_at_ms", F.lit(fetched_at_ms).cast("long"))
    rows = rows.withColumn("listing_age_ms", F.when(F.col("deploy_time_ms").isNotNull(), age))
    rows = rows.withColumn("unknown_fields", tags([(missing[c], c) for c in OPTIONAL_FIELDS]))
    float_ratio = F.col("circulating_supply") / F.when(F.col("max_supply") > 0, F.col("max_supply"))
    known = tags(
        [
            (F.col("listing_age_ms") <= NEW_LISTING_MS, "new_listing"),
            (F.col("seeded_usdc") > 0, "fresh_liquidity"),
            (float_ratio <= LOW_FLOAT_RATIO, "low_float"),
        ]
    )
    incomplete = (F.size("unknown_fields") > 0) | (F.size("_known_tags") == 0)
    unknown = F.when(incomplete, F.array(F.lit("unknown_metadata"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_known_tags", known)
    rows = rows.withColumn("cohort_tags", F.array_sort(F.array_distinct(F.concat("_known_tags", unknown))))
    fields = [f.split(":")[0] for f in METADATA_TYPE[len("struct<"):-1].replace("array<string>", "x").split(",")]
    return rows.select(*fields, *keep)


def attach_metadata(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """Join metadata by feed id or display name; on a shared name the later entry (spot index) wins."""
    record = F.struct(*[F.col(c) for c in metadata.columns]).cast(METADATA_TYPE)
    rows = metadata.withColumn("_m", record)
    keys = rows.select(F.explode(F.array("feed_identifier", "display_name")).alias("symbol"), "spot_index", "_m")
    one = keys.groupBy("symbol").agg(F.max_by("_m", "spot_index").alias("_m"))
    joined = lookup_join(snapshots, one, ["symbol"])
    return joined.withColumn("metadata", F.coalesce("_m", "metadata")).drop("_m").select(*snapshots.columns)


def selector_match(selector: str, feed: Column | None = None, display: Column | None = None) -> Column:
    """Case-insensitive match on display name or feed id; ``-`` in the selector also reads as ``/``."""
    wanted = [selector.strip().lower(), selector.strip().replace("-", "/").lower()]
    feed = F.col("symbol") if feed is None else feed
    match = F.lower(feed) == wanted[0]
    return match if display is None else match | F.lower(display).isin(*wanted)


def select_universe(markets: DataFrame, top_n: int, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Drop excluded, keep included (all when empty), rank by day volume, missing volume last."""
    if top_n <= 0:
        raise ContractError("top_n must be greater than zero")

    def any_of(names) -> Column:
        out = F.lit(False)
        for name in names:
            out = out | F.coalesce(selector_match(name, F.col("symbol"), F.col("display_name")), F.lit(False))
        return out

    rows = markets.filter(~any_of(exclude))
    if include:
        rows = rows.filter(any_of(include))
    return rows.orderBy(F.col("day_ntl_vlm").desc_nulls_last(), "symbol").limit(top_n)


def metadata_cache(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by symbol: the newest fetch replaces, the batch wins on equal times."""
    payload = [c for c in table.columns if c != "symbol"]
    both = table.withColumn("_origin", F.lit(0)).unionByName(batch.withColumn("_origin", F.lit(1)))
    order = F.struct("metadata_fetched_at_ms", "_origin")
    return both.groupBy("symbol").agg(F.max_by(F.struct(*payload), order).alias("_w")).select("symbol", "_w.*")
