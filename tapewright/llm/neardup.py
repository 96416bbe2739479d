"""Near-duplicate classes by DartMinHash (operator 6).

A text is a weighted set: its five-word shingles with their numbers of occurrences (a text of fewer words is one
shingle). The m-th occurrence of a shingle is a unit cell, so that similarity is the weighted Jaccard of counts. Every cell
throws darts along time, a Poisson process seeded by the cell's hash; a dart has a coordinate and an arrival time, and the
earliest dart of each coordinate is the signature. Equal cells throw equal darts, so two texts agree in a coordinate
with the probability of their similarity. A text throws only until its time horizon, about K log K + 2 K darts in all,
whatever its length; texts with an empty coordinate double their horizon.

Equal texts are one node, named by the md5 of the text. Bands of ROWS coordinates make buckets. In each bucket all members
are first compared with one leader: the exact similarity of cells decides. The leader is the member whose buckets
are largest in all: among edited copies of one text, that text. Members that are no copy of the leader get a leader of their
own, and so on while leaders of the bucket find copies. Links form classes (connected components by smallest label
with pointer jumping; labels are written between rounds).

Buckets that still hold more than one class are then finished without loss, linked members included: in a bucket of up to SMALL
members all pairs of different classes are compared; members of larger ones are joined by the rarest of their differences from the
bucket's leader (prefix filter, see ``rare_pairs``, which keeps every pair that can reach the threshold) and the pairs that remain are compared.

Bounds: a bucket costs its size times the number of leaders that find copies; a group of thousands of copies costs one
comparison each. At similarity 0.8 a pair shares a bucket with probability 0.99995 (25 bands of 5); pairs that share one end in one
class. Unlike texts of one template meet in the prefix join only where they share differences from it.

Defined results: null texts and texts without a word are classes of one row; repeated rows share a class; ``class_id`` is
the smallest non-null doc_id of the class (null if there is none) and names a class only where ids are unique: ``label``, the smallest
node of the class, tells classes apart where a doc_id is repeated with different texts or missing; extra columns are ignored by ``near_classes`` and
kept by ``keep_one``, which keeps one row per class: of the smallest doc_id (nulls last); an empty table has no classes.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import cut_lineage, map_rows, private
from tapewright.session import checkpoint_dir

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
DARTS = K * math.log(K) + 2 * K
#: Members up to which all pairs of a bucket are compared once leaders are done.
SMALL = 8
#: Counters that order cells by rarity in the prefix filter; two cells in one counter cost time only.
RARITY_SLOTS = 1 << 20
#: Bits that mark the texts of buckets before texts are exchanged; two texts on one bit cost time only.
MARKS = 1 << 26
#: Text bytes that are hashed at a time: cells and darts take about twelve times as much.
BATCH_BYTES = 2_000_000
#: Distinct words whose hashes one Python process remembers (a memo only).
MEMO = 500_000
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def cells_of(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell hash) of every unit cell, sorted by row."""
    rows, values = [], []
    get = hashes.__getitem__
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if words:
            h = np.fromiter(map(get, words), np.uint64, len(words))
            n = max(1, len(h) - WORDS + 1)
            shingle = np.zeros(n, np.uint64)
            for j in range(min(WORDS, len(h))):
                shingle += mixed(h[j : j + n] + np.uint64(j)) * MULTIPLIERS[j]
            rows.append(np.full(n, k))
            values.append(mixed(shingle))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
    first = np.flatnonzero(new)
    occurrence = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row, mixed(value + occurrence.astype(np.uint64) * MULTIPLIERS[0])


def signatures(row: np.ndarray, cell: np.ndarray, texts: int) -> np.ndarray:
    """Earliest dart per coordinate: one row of K dart names per text (texts without cells: zeros)."""
    out = np.zeros((texts, K), np.uint64)
    weight = np.bincount(row, minlength=texts)
    horizon = DARTS / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        pick = np.flatnonzero(todo[row])
        limit, at, name = horizon[row[pick]], np.zeros(len(pick)), cell[pick]
        slots, times, names = [], [], []
        throw = 0
        while len(pick):
            name = mixed(name + MULTIPLIERS[3])
            at = at - np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
            alive = at < limit
            pick, limit, at, name = pick[alive], limit[alive], at[alive], name[alive]
            dart = mixed(name ^ MULTIPLIERS[4])
            slots.append(row[pick] * K + (dart % np.uint64(K)).astype(np.int64))
            times.append(at)
            names.append(dart)
            throw += 1
        slot, time, dart = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        order = np.lexsort((time, slot))
        slot, dart = slot[order], dart[order]
        first = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
        filled = np.bincount(slot[first] // K, minlength=texts)
        out.reshape(-1)[slot[first]] = dart[first]
        todo &= filled < K
        horizon[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    total = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        total = mixed(total + signature[:, r * BANDS : (r + 1) * BANDS] * MULTIPLIERS[0])
    return total.view(np.int64)


def text_node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node and bands (empty without a word) of every row."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            row, cell = cells_of(texts, hashes)
            keys = band_keys(signatures(row, cell, len(texts)))
            has = np.bincount(row, minlength=len(texts)) > 0
            bands = pa.array([keys[k] if has[k] else [] for k in range(len(texts))], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands], ["doc_id", "node", "bands"])

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node(F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    return map_rows(source, make, "doc_id long, node binary, bands array<long>", BATCH_BYTES)


def cell_sets(texts: DataFrame) -> DataFrame:
    """node, cells (distinct) of the given (node, text) rows."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, cell = cells_of(batch.column(1).to_pylist(), hashes)
            cut = np.searchsorted(row, np.arange(1, batch.num_rows))
            sets = [np.unique(x.view(np.int64)) for x in np.split(cell, cut)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "cells"])

        return step

    return map_rows(texts.select("node", "text"), make, "node binary, cells array<long>", BATCH_BYTES)


def texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (node, text) rows whose node is given, and few others, picked where they are read by a bitmap of fixed size (MARKS)."""
    slot = F.pmod(F.xxhash64("node"), F.lit(MARKS)) + 1
    page, at = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    pages = nodes.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("bits"))  # of 4 KB
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.pmod(at, F.lit(8)) + 1).cast("int")))
    both = texts.join(F.broadcast(pages), page == F.col("page"))  # at most MARKS bits
    return both.filter(bit != 0).select("node", "text")


def written_by_node(rows: DataFrame) -> DataFrame:
    """The rows written once as a table in buckets of their node, as many as a shuffle has partitions: joins by node read it without an exchange."""
    spark = rows.sparkSession
    name = f"tw_cells_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/tables/{name}"
    rows.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").format("parquet").saveAsTable(name)
    return spark.table(name)


def verified(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (leader, node) whose similarity reaches the threshold."""
    left = cells.select(F.col("node").alias("leader"), F.col("cells").alias("leader_cells"))
    both = pairs.join(left, "leader").join(cells, "node")
    common = F.size(F.array_intersect("leader_cells", "cells"))
    similarity = common / (F.size("leader_cells") + F.size("cells") - common)
    return both.withColumn("similarity", similarity).filter(F.col("similarity") >= THRESHOLD).select("leader", "node", "similarity")


def led_by(members: DataFrame) -> DataFrame:
    """The leader of each bucket: the member whose buckets are largest in all (the text that most others come from)."""
    best = F.max_by("node", F.struct(F.col("weight"), F.col("node")))
    return members.groupBy("band", "key").agg(best.alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def bucket_pairs(members: DataFrame) -> DataFrame:
    """All pairs (leader, node) with different labels in each bucket."""
    high = members.select("band", "key", F.col("node").alias("leader"), F.col("label").alias("leader_label"))
    low = members.select("band", "key", "node", "label")
    return high.join(low, ["band", "key"]).filter((F.col("leader") > F.col("node")) & (F.col("leader_label") != F.col("label"))).select("leader", "node")


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of the sets have an element, by counters of fixed number."""
    slot = F.pmod(F.col("element"), F.lit(RARITY_SLOTS))
    counted = sets.select(F.explode("elements").alias("element")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros(RARITY_SLOTS, np.int32)
    out[counted.column("slot").to_numpy()] = np.minimum(counted.column("n").to_numpy(), 2**31 - 1)
    return out


def edits(members: DataFrame, cells: DataFrame) -> DataFrame:
    """leader, node, label, n (cells), elements: in what the node's cells differ from those of the leader.

    An element is the hash of the leader, a cell and whether the node has it instead of the leader.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        elements, sizes = [], []
        for leader, own, base in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
            own, base = np.array(own, np.int64), np.array(base, np.int64)
            seed = np.uint64(xxhash.xxh3_64_intdigest(leader))
            added, gone = (np.setdiff1d(x, y, assume_unique=True).view(np.uint64) for x, y in ((own, base), (base, own)))
            elements.append(mixed(np.concatenate([added * MULTIPLIERS[1], gone * MULTIPLIERS[2]]) + seed).view(np.int64))
            sizes.append(len(own))
        columns = [*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(elements, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["leader", "node", "label", "n", "elements"])

    base = cells.select(F.col("node").alias("leader"), F.col("cells").alias("leader_cells"))
    both = members.join(cells, "node").join(base, "leader").select("leader", "node", "label", "cells", "leader_cells")
    return map_rows(both, lambda: step, "leader binary, node binary, label binary, n int, elements array<long>", BATCH_BYTES)


def rare_pairs(members: DataFrame, cells: DataFrame) -> DataFrame:
    """Every pair (leader, node) with different labels that can reach the threshold, and few others.

    ``members``: (leader, node, label), the leader of a bucket with its members. Two nodes whose differences from the leader have nothing in common are
    at most as similar to each other as the less similar of the two is to the leader; so a similar pair, of which one is no
    copy of the leader, shares differences: with e and f differences, n and m cells, at least (e + f - (n + m) (1 - T) / (1 + T)) / 2,
    and at least one. What all members of a family share drops out, however many they are. Differences are put in
    one order, rarest first, and a pair meets in the first ones (prefix filter), under a condition on sizes and places.
    Members of the leader's most frequent label never meet each other.
    """
    sets = cut_lineage(edits(members, cells))
    labels = sets.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("k"), F.min(F.size("elements")).alias("e"))
    main = labels.groupBy("leader").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.min("e").alias("least"))
    other = labels.join(main, "leader").filter(F.col("label") != F.col("main")).groupBy("leader").agg(F.min("e").alias("least_other"))
    is_main = F.col("label") == F.col("main")
    known = sets.join(main.join(other, "leader"), "leader")
    known = known.select("node", "label", "n", "elements", is_main.alias("main"), F.when(is_main, F.col("least_other")).otherwise(F.col("least")).alias("least"))
    known = cut_lineage(known)
    # a pair has at least one node outside the main label: what no such node has is never shared and comes first in the order
    outside = known.sparkSession.sparkContext.broadcast(rarity(known.filter("NOT main")) > 0)  # fixed by RARITY_SLOTS

    def shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.array(own, np.int64) for own in batch.column(3).to_pylist()]
        kept = [own[outside.value[np.mod(own, RARITY_SLOTS)]] for own in lists]
        columns = [*batch.columns[:3], pa.array(kept, pa.list_(pa.int64())), *batch.columns[4:], pa.array([len(x) for x in lists], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["node", "label", "n", "elements", "main", "least", "e"])

    known = cut_lineage(map_rows(known, lambda: shared, "node binary, label binary, n int, elements array<long>, main boolean, least int, e int", BATCH_BYTES))
    often = known.sparkSession.sparkContext.broadcast(rarity(known))  # fixed by RARITY_SLOTS

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, kept = [], [], []
        for k, (n, own, least, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 5, 6)), strict=True)):
            own = np.array(own, np.int64)
            # a partner has at most n / T cells and differs from this node in at most n (1 - T) / T
            apart = n * (1 - THRESHOLD) / THRESHOLD + 1e-6
            common = max(1, math.ceil((e + least - apart) / 2), math.ceil(e - apart))
            count = often.value[np.mod(own, RARITY_SLOTS)]
            at = np.arange(e - len(own), max(e - len(own), e - common + 1))
            first = np.lexsort((own, count))[at - (e - len(own))]
            at, first = at[count[first] > 1], first[count[first] > 1]
            rows.append(np.full(len(at), k))
            places.append(at)
            kept.append(own[first])
        row = pa.array(np.concatenate(rows))
        taken = [batch.column(c).take(row) for c in (0, 1, 2, 4, 6)]
        return pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate(kept)), pa.array(np.concatenate(places).astype(np.int32))], ["node", "label", "n", "main", "e", "element", "at"])

    rows = cut_lineage(map_rows(known, lambda: step, "node binary, label binary, n int, main boolean, e int, element long, at int", BATCH_BYTES))
    one = rows.filter("NOT main").select("element", *[F.col(c).alias(f"one_{c}") for c in ("node", "label", "n", "e", "at")])
    needed = (F.col("one_e") + F.col("e") - (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col("one_n") + F.col("n"))) / 2 - 1e-6
    like = (F.least("one_n", "n") >= THRESHOLD * F.greatest("one_n", "n") - 1e-6) & (F.least(F.col("one_e") - F.col("one_at"), F.col("e") - F.col("at")) >= needed)
    once = F.col("main") | (F.col("one_node") > F.col("node"))
    met = one.join(rows, (one["element"] == rows["element"]) & (F.col("one_label") != F.col("label")) & once & like)
    return met.select(F.greatest("one_node", "node").alias("leader"), F.least("one_node", "node").alias("node")).distinct()


def left_out(in_buckets: DataFrame, found: DataFrame, compared: DataFrame, cells: DataFrame) -> DataFrame:
    """Verified links between members of one bucket whose classes the leaders left apart."""
    labelled = in_buckets.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = cut_lineage(labelled)
    apart = labelled.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    apart = apart.filter(F.col("low") != F.col("high")).drop("low", "high")
    members = cut_lineage(labelled.join(apart, ["band", "key"]))
    pairs = bucket_pairs(members.filter(F.col("members") <= SMALL))
    hubs = members.filter(F.col("members") > SMALL)
    led = hubs.join(led_by(hubs), ["band", "key"])
    large = cut_lineage(led.filter(F.col("node") != F.col("leader")).select("leader", "node", "label").distinct())  # leaders are compared
    if not large.isEmpty():
        pairs = pairs.unionByName(rare_pairs(large, cells))
    return verified(cut_lineage(pairs.distinct().join(compared, ["leader", "node"], "left_anti")), cells)


def links(docs: DataFrame, sign: DataFrame) -> DataFrame:
    """Verified (leader, node) links between different texts."""
    nodes = sign.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    in_buckets = cut_lineage(rows.join(shared, ["band", "key"]))
    weights = cut_lineage(in_buckets.groupBy("node").agg(F.sum("n").alias("weight")))
    open_ = cut_lineage(in_buckets.drop("n").join(weights, "node"))
    texts = docs.select(text_node(F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    # only texts of buckets are exchanged, one of each; their cells stay where they are
    one = texts_of(texts, weights).groupBy("node").agg(F.first("text").alias("text"))
    cells = written_by_node(cell_sets(one.join(weights.select("node"), "node", "left_semi")))
    found, compared, first = None, None, True
    while first or not open_.isEmpty():
        stars = cut_lineage(open_.join(led_by(open_), ["band", "key"]).filter(F.col("node") != F.col("leader")))
        pairs = stars.select(F.greatest("leader", "node").alias("leader"), F.least("leader", "node").alias("node")).distinct()
        pairs = pairs if first else pairs.join(compared, ["leader", "node"], "left_anti")
        pairs = cut_lineage(pairs)
        new = cut_lineage(verified(pairs, cells))
        compared = pairs if first else cut_lineage(compared.unionByName(pairs))
        found = new if first else cut_lineage(found.unionByName(new))
        ends = found.select(F.col("leader").alias("high"), F.col("node").alias("low"), F.lit(True).alias("linked"))
        marked = stars.withColumns({"high": F.greatest("leader", "node"), "low": F.least("leader", "node")}).join(ends, ["high", "low"], "left")
        marked = cut_lineage(marked.select("band", "key", "node", "weight", F.coalesce("linked", F.lit(False)).alias("linked")))
        rest = marked.filter(~F.col("linked")).drop("linked")
        if not first:  # a bucket stays open while its leaders find copies
            rest = rest.join(marked.filter("linked").select("band", "key").distinct(), ["band", "key"], "left_semi")
        open_, first = cut_lineage(rest), False
    return cut_lineage(found.unionByName(left_out(in_buckets.drop("n").join(weights, "node"), found, compared, cells)))


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node with an edge."""
    both = cut_lineage(edges.select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(edges.select(F.col("node").alias("a"), F.col("leader").alias("b"))))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        joined = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = cut_lineage(joined.join(far, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = not after.filter(F.col("new") != F.col("label")).isEmpty()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links (links of its text to other texts), node, label (smallest node of the class)."""
    sign = cut_lineage(signed(docs))
    found = links(docs, sign)
    labels = components(found)
    ends = found.select(F.explode(F.array("leader", "node")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    marks = labels.join(degree, "node", "left")
    worded = sign.filter(F.size("bands") > 0).select("doc_id", "node").join(marks, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    worded = cut_lineage(worded)
    sizes = worded.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    classed = worded.join(sizes, "label").select("doc_id", "class_id", "class_size", "n_links", "node", "label")
    single = sign.filter(F.size("bands") == 0).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("binary").alias("label"))
    return classed.unionByName(single)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row per class, with all columns of the input; wordless rows all stay."""
    classes = cut_lineage(near_classes(docs))
    node, rank, keep = private("node"), private("rank"), private("keep")
    # per class the text of its smallest doc_id (smallest text among equals)
    best = classes.filter(F.col("node").isNotNull()).groupBy("label")
    chosen = best.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m")).select(F.col("m.doc_id").alias(keep), F.col("m.node").alias(node))
    tagged = docs.withColumn(private("of"), text_node(F.col("text")))
    joined = tagged.join(chosen, (F.col("doc_id").cast("long").eqNullSafe(F.col(keep))) & (F.col(private("of")) == F.col(node)))
    first = Window.partitionBy("doc_id", private("of")).orderBy(private("of"))
    one = joined.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
    wordless = docs.filter(F.coalesce(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]", ""), F.lit("")) == "")
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(wordless)
