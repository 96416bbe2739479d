"""Mixing sources to target weights by Poisson replication (operator 3).

Every document is repeated a Poisson-distributed number of times whose mean is its source's target repetition
rate: target share times total rows over rows of the source. The count inverts the distribution function at a
uniform number hashed from the document id and a seed, so it needs no state and repeats after a lost executor.
Large means are cut into equal parts of at most PART_MEAN, each with a hash of its own (sums of Poisson
variables are Poisson). The copies are dealt to tasks and sorted by a hash of (id, copy): a global shuffle.

All steps are DataFrame functions. The table of rates has one row per source; it is broadcast only below
BROADCAST_SOURCES rows, otherwise the join is left to adaptive execution, which splits hot sources.

Defined results: a null source is a source of its own; a row without id is known by the md5 of its text; rows with equal ids (or texts, without id) get
equal counts; null texts are kept; columns of the input named like the added ones are replaced; without rows the
result is empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import private

SEED = 20240
#: Default target weights are the source sizes to this power (1: as they are, 0: all sources alike).
TEMPERATURE = 0.5
PART_MEAN = 200.0
#: Copies that one task makes of one row before the rest is dealt to others.
COPIES_PER_ROW = 1024
BROADCAST_SOURCES = 50_000
ADDED = ["copy", "n_copies", "mix_key"]


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def order_hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def poisson_table(mean: Column) -> Column:
    """Values of the distribution function at 0, 1, ... until it cannot be told from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all")),
        lambda s, k: F.struct(
            (s["log"] + F.log(mean) - F.log(k.cast("double"))).alias("log"),
            (s["sum"] + F.exp(s["log"] + F.log(mean) - F.log(k.cast("double")))).alias("sum"),
            F.concat(s["all"], F.array(s["sum"] + F.exp(s["log"] + F.log(mean) - F.log(k.cast("double"))))).alias("all"),
        ),
    )
    return F.when(mean > 0, grown["all"]).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """Per source: rows, target share, mean number of copies, parts and the table of one part.

    ``weights`` maps sources to target weights (sources left out get weight 0); by default the weights are the
    sizes to the power ``temperature``. ``epochs`` is the size of the mixture over the size of the input.
    """
    sizes = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    totals = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    share = F.col("weight") / F.col("all_weight")
    mean = F.when(F.col("all_weight") > 0, share * F.col("all_n") * F.lit(float(epochs)) / F.col("n")).otherwise(F.lit(0.0))
    return (
        weighted.join(F.broadcast(totals), how="inner")  # one row
        .select("source", "n", share.alias("share"), mean.alias("mean"))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / F.lit(PART_MEAN))).cast("int"))
        .withColumn("cdf", poisson_table(F.col("mean") / F.col("parts")))
    )


def copies(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The mixture: each input row ``n_copies`` times, numbered by ``copy`` from 0, in random order by ``mix_key``."""
    made = replicated(docs.drop(*ADDED), weights, epochs, temperature, seed)
    return made.withColumnsRenamed({private(c): c for c in ADDED})


def replicated(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The same with private names for the added columns, so that none of the input is replaced."""
    base = docs
    per_source = rates(base, weights, epochs, temperature)
    found = per_source.agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts")).first()
    key, cdf, parts, count, block = (private(x) for x in ("source", "cdf", "parts", "count", "block"))
    side = per_source.select(F.col("source").alias(key), F.col("cdf").alias(cdf), F.col("parts").alias(parts))
    if found["n"] <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in base.columns else F.lit("")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), F.md5(text.cast("binary"))))
    # the uniform numbers first: one md5 per row and part, whatever the length of the table they are looked up in
    units = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda part: unit_hash(doc, F.lit(str(seed)), part.cast("string")))
    drawn = F.aggregate(units, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    counted = base.join(side, F.col("source").eqNullSafe(F.col(key))).withColumn(count, drawn).drop(key, cdf, parts).filter(F.col(count) > 0)
    first, last = F.lit(0), F.col(count) - 1
    if (found["parts"] or 1) * PART_MEAN > COPIES_PER_ROW:  # rare sources: deal the copies of a row in blocks
        starts = F.sequence(F.lit(0), F.col(count) - 1, F.lit(COPIES_PER_ROW))
        counted = counted.withColumn(block, F.explode(starts)).repartition(F.xxhash64(doc, F.col(block)))
        first, last = F.col(block), F.least(F.col(count) - 1, F.col(block) + COPIES_PER_ROW - 1)
    made = counted.select("*", F.explode(F.sequence(first, last)).alias(private("copy"))).select(
        *[F.col(f"`{c}`") for c in base.columns],
        private("copy"),
        F.col(count).alias(private("n_copies")),
        order_hash(doc, F.lit(str(seed)), F.lit("order"), F.col(private("copy")).cast("string")).alias(private("mix_key")),
    )
    return made.repartition(private("mix_key")).sortWithinPartitions(private("mix_key"), private("copy"))


def oracle(docs: str = "documents", epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """DuckDB SQL for ``copies`` over a relation with doc_id, source and further columns."""
    return f"""
WITH sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
weighted AS (SELECT source, n, pow(n::DOUBLE, {temperature}) AS weight FROM sizes),
rate AS (
  SELECT source, weight / sum(weight) OVER () * sum(n) OVER () * {epochs} / n AS mean FROM weighted),
cut AS (SELECT source, mean, greatest(1, ceil(mean / {PART_MEAN}))::INT AS parts FROM rate),
steps AS (
  SELECT source, parts, mean / parts AS m, unnest(generate_series(0, ceil(mean / parts + 12 * sqrt(mean / parts) + 30)::INT)) AS k FROM cut),
cdf AS (
  SELECT source, k, sum(exp(k * ln(m) - m - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
named AS (SELECT *, coalesce(doc_id::VARCHAR, 'null-' || md5(coalesce(text, ''))) AS doc FROM {docs}),
draws AS (
  SELECT d.doc, d.source, unnest(generate_series(0, cut.parts - 1)) AS part
  FROM (SELECT DISTINCT doc, source FROM named) d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source),
units AS (
  SELECT *, CAST('0x' || substr(md5(doc || ':{seed}:' || part), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM draws),
counted AS (
  SELECT u.doc, u.source, count(*) AS n_copies FROM units u JOIN cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u
  GROUP BY u.doc, u.source),
copied AS (
  SELECT doc, source, n_copies, unnest(generate_series(0, n_copies - 1))::INT AS copy FROM counted)
SELECT d.* EXCLUDE (doc), c.copy, c.n_copies::INT AS n_copies,
  CAST('0x' || substr(md5(d.doc || ':{seed}:order:' || c.copy), 1, 15) AS BIGINT) AS mix_key
FROM named d JOIN copied c ON d.doc = c.doc AND d.source IS NOT DISTINCT FROM c.source
"""
