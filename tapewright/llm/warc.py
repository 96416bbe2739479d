"""Merkle fixity audit of archived records (operator 7).

A record's digest is the SHA-256 of its response bytes. Records of one key form a key node; nodes of 256
neighbouring keys form a node of level 1, 256 of these one of level 2, and so on: ordered ranges of keys and, in
key order, of byte offsets. Two replicas are compared from the roots down; only children of nodes whose
hashes differ are looked at, so that a sound replica costs one comparison of roots.

Bounds: a node has at most 256 children. Repeated keys are summed, not listed: a key node hashes the number
of its records, their bytes and the sums of four 60-bit slices of their digests, which Spark adds up map-side, so
one key with a third of all rows is no hot group.

Defined results: null keys count as the smallest long; null urls and bodies count as empty; repeated records
count by number; extra columns are ignored; two empty replicas have no nodes and no mismatch; a range missing
in one replica has a null hash there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut_lineage

BITS = 8
#: Levels above the key nodes; ranges of the top level span 2**(BITS * LEVELS) keys.
LEVELS = 4
NULL_KEY = -(1 << 63)
SLICES = 4


def response(url: Column, body: Column) -> Column:
    """The bytes of a response record: header lines, an empty line, the body, two line ends."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """key, digest and number of bytes of each record."""
    bytes_ = response(F.col("url"), F.col("html"))
    return pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.sha2(bytes_.cast("binary"), 256).alias("digest"),
        F.octet_length(bytes_).cast("long").alias("n_bytes"),
    )


def key_nodes(recs: DataFrame) -> DataFrame:
    slices = [F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(SLICES)]
    summed = recs.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("n_bytes").alias("n_bytes"),
        *[F.sum(s).alias(f"s{k}") for k, s in enumerate(slices)],
    )
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ["key", "n_records", "n_bytes", *[f"s{k}" for k in range(SLICES)]]])
    return summed.select(F.lit(0).alias("level"), F.col("key").alias("node"), F.sha2(text.cast("binary"), 256).alias("hash"), "n_records", "n_bytes")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: hash of the ordered (node, hash) pairs of at most 256 children."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["node"].cast("string"), c["hash"])), ",")
    return nodes.groupBy(F.col("level") + 1, F.shiftright("node", BITS)).agg(
        F.sha2(text.cast("binary"), 256).alias("hash"), F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes")
    ).toDF("level", "node", "hash", "n_records", "n_bytes")


def tree(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All nodes of a replica, with the number of bytes before each in its parent's range."""
    level = cut_lineage(key_nodes(records(pages)))
    nodes = level
    for _ in range(levels):
        level = parents(level)
        nodes = nodes.unionByName(level)
    return nodes


def audit(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Nodes that differ, from the roots down to the keys: level, node, hashes, records and bytes on both sides.

    ``left`` and ``right`` are pages (page_id, url, html). A node appears only if its parent differs.
    """
    a, b = (cut_lineage(tree(x, levels)) for x in (left, right))
    names = ["hash", "n_records", "n_bytes"]
    suspects, found = None, None
    for level in range(levels, -1, -1):
        sides = []
        for side, tag in ((a, "left"), (b, "right")):
            nodes = side.filter(F.col("level") == level).drop("level")
            if suspects is not None:
                nodes = nodes.join(suspects, F.shiftright("node", BITS) == suspects["parent"], "left_semi")
            sides.append(nodes.select("node", *[F.col(c).alias(f"{c}_{tag}") for c in names]))
        differing = sides[0].join(sides[1], "node", "full").filter(~F.col("hash_left").eqNullSafe(F.col("hash_right"))).withColumn("level", F.lit(level))
        found = differing if found is None else found.unionByName(differing)
        suspects = differing.select(F.col("node").alias("parent"))
    return found.select("level", "node", *[f"{c}_{tag}" for c in names for tag in ("left", "right")])


def locate(left: DataFrame, differing: DataFrame) -> DataFrame:
    """Byte range of each differing key of the left replica in its archive file (one file per level-1 range of keys).

    A file holds the records of 256 keys in key order, so the running sum covers 256 key nodes at most.
    """
    from pyspark.sql.window import Window

    keys = key_nodes(records(left)).select(F.shiftright("node", BITS).alias("file"), "node", "n_bytes")
    before = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    return differing.join(placed.select("node", "file", "offset"), "node", "left")


def aged_copy(pages: DataFrame, divisor: int = 53) -> DataFrame:
    """A second replica with known damage: by md5 of the key, one in ``divisor`` bodies altered, as many records
    lost and as many doubled. It stands for a replica read from elsewhere."""
    drawn = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    fate = F.coalesce(drawn % divisor, F.lit(0))
    html = F.when(fate == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html"))
    kept = pages.filter(fate != 8).select("page_id", "url", html.alias("html"), fate.alias("fate"))
    return kept.withColumn("again", F.explode(F.when(F.col("fate") == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fate", "again")


def oracle(levels: int = LEVELS, divisor: int = 53) -> str:
    key_text = " || ':' || ".join(["key", "count(*)", "sum(n_bytes)", *[f"sum(CAST('0x' || substr(digest, {1 + 15 * k}, 15) AS BIGINT))" for k in range(SLICES)]])
    fate = f"coalesce(CAST('0x' || substr(md5(page_id::VARCHAR), 1, 8) AS BIGINT) % {divisor}, 0)"
    parts = []
    for tag, body in (("l", "html"), ("r", "CASE WHEN fate = 7 THEN coalesce(html, '') || '~' ELSE html END")):
        rows = "fated" if tag == "l" else "(SELECT * FROM fated WHERE fate <> 8 UNION ALL SELECT * FROM fated WHERE fate = 9)"
        parts.append(f"""
{tag}rec AS (
  SELECT coalesce(page_id, {NULL_KEY}) AS key, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({body}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({body}, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM {rows}),
{tag}dig AS (SELECT key, sha256(rec) AS digest, strlen(rec) AS n_bytes FROM {tag}rec),
{tag}0 AS (SELECT key AS node, sha256({key_text}) AS hash, count(*) AS n_records, sum(n_bytes)::BIGINT AS n_bytes FROM {tag}dig GROUP BY key)""")
        for k in range(1, levels + 1):
            parts.append(f"""
{tag}{k} AS (SELECT node >> {BITS} AS node, sha256(string_agg(node || '=' || hash, ',' ORDER BY node)) AS hash, sum(n_records)::BIGINT AS n_records, sum(n_bytes)::BIGINT AS n_bytes
  FROM {tag}{k - 1} GROUP BY node >> {BITS})""")
    differs = " UNION ALL ".join(
        f"SELECT {k} AS level, node, l.hash AS hash_left, r.hash AS hash_right, l.n_records AS n_records_left, r.n_records AS n_records_right, l.n_bytes AS n_bytes_left, r.n_bytes AS n_bytes_right "
        f"FROM l{k} l FULL JOIN r{k} r USING (node) WHERE l.hash IS DISTINCT FROM r.hash" for k in range(levels + 1)
    )
    return f"""
WITH fated AS (SELECT page_id, url, html, {fate} AS fate FROM pages),{','.join(parts)},
placed AS (SELECT node, node >> {BITS} AS file, coalesce(sum(n_bytes) OVER (PARTITION BY node >> {BITS} ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l0),
differing AS ({differs})
SELECT d.level, d.node, d.hash_left, d.hash_right, d.n_records_left, d.n_records_right, d.n_bytes_left, d.n_bytes_right,
  CASE WHEN level = 0 THEN p.file END AS file, CASE WHEN level = 0 THEN p."offset" END AS "offset"
FROM differing d LEFT JOIN placed p ON d.node = p.node AND d.level = 0
"""

