"""Ranked lexical search by a dual tree over items and documents (operator 12).

Terms are runs of ASCII letters and digits and of characters outside ASCII; only A-Z is lower-cased. A document's value in the
coordinate of a term is its saturated frequency (an integer); an item's value is the term's weight times its repeats; the score
is their product sum. Items stand in a tree, the documents of a task, some at a time, in another; each node holds
the maximum of its members in every coordinate. The product sum of an item node and a document node bounds the score of
every pair below them. Where it is less than the weakest k-th score of the node's items, all pairs below are left out;
otherwise both nodes are opened. A pair of one item and one document has its score as bound. All numbers are whole, so
no rounding decides; equal scores are never left out.

Spark does the rest: one pass over the texts writes the sparse vectors of the items' terms; document frequencies, numbers of
documents and terms are aggregates over them; about one document in SHARE (by hash, in proportion to the input) gives
k-th scores to start from, which only bound; then every vector goes through the tree search, and each item's best
rows are ranked by a window. Items are taken in blocks of about BLOCK_ITEMS items, BLOCK_BYTES of text, so that what the tasks get
(vectors, terms and k-th scores of a block) is bounded whatever the number of items; a block costs one pass.

Defined results: null texts have no terms; a document without terms is not counted and never found; an item without terms, or
whose terms no document holds, has no rows; every item row is an item of its own, null ids included, and so is every document
row (repeated documents take a rank each); null doc_ids come last among equal scores; extra columns are ignored; without
documents or items the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import cut_lineage, give_back, map_rows

TOP = 20
#: Items and text bytes of a block of items (on average; an item is never cut).
BLOCK_ITEMS, BLOCK_BYTES = 256, 250_000
#: Documents that give starting k-th scores: one in so many.
SHARE = 16
#: Children of a node.
FANOUT = 8
#: Numbers in the dense vectors of the documents that stand in one tree.
TREE_CELLS = 3_000_000
BATCH_BYTES = 4_000_000
#: Product sums below this are exact in doubles.
EXACT = 2.0**53
SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = bytes(0x20 if b in SEPARATORS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def item_vectors(items: DataFrame) -> DataFrame:
    """item_id, block, terms and their repeats of every item row with a term."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["b"] or 0) / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [Counter(terms_of(t)) for t in batch.column(2).to_pylist()]
        terms, repeats = [list(c) for c in counts], [list(c.values()) for c in counts]
        arrays = [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary())), pa.array(repeats, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["item_id", "block", "terms", "repeats"])

    made = map_rows(rows.select("item_id", block.alias("block"), "text"), lambda: step, "item_id long, block int, terms array<binary>, repeats array<long>", BATCH_BYTES)
    return cut_lineage(made.filter(F.size("terms") > 0))


def document_vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), terms (numbers in the list) and tf of every document row with a term."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})  # the terms of a block of items

    def make():
        number = shared.value.get

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, found, often = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                hits = np.array([k for k in map(number, words) if k is not None], np.int64)
                own, tf = np.unique(hits, return_counts=True)
                found.append(own)
                often.append(tf)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x).astype(t))) for x, t in ((found, np.int32), (often, np.int64))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(source, make, "doc_id long, n long, terms array<int>, tf array<long>", BATCH_BYTES).filter("n > 0")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """A document's values in the coordinates of its terms (``n``: its length, once per value)."""
    if len(n) and 25 * int(n.max()) * documents >= 2**63:  # Python numbers where 64 bits end
        share = np.array([25 * int(x) * documents // all_terms for x in n], np.int64)
    else:
        share = (25 * n * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + share))


def tree_order(rows: np.ndarray) -> np.ndarray:
    """An order in which like rows stand together: halves by nearness to two far rows, again and again."""
    order = np.arange(len(rows))
    todo = [(0, len(rows))]
    while todo:
        start, end = todo.pop()
        if end - start <= 2:
            continue
        own = rows[order[start:end]]
        total = own.sum(0, dtype=np.float64)
        one = own[np.argmin(own @ total)]
        two = own[np.argmax(own @ (total - one * len(own)))]
        side = np.argsort(own @ (two - one), kind="stable")
        order[start:end] = order[start:end][side]
        middle = start + (end - start) // 2
        todo += [(start, middle), (middle, end)]
    return order


def levels(rows: np.ndarray) -> list[np.ndarray]:
    """Maxima of every node, from single rows up to one root; node k of a level has the nodes FANOUT k ... below it."""
    out = [rows]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), FANOUT)))
    return out


def children(nodes: np.ndarray, below: int) -> np.ndarray:
    """Numbers of the nodes under the given ones in a level of ``below`` nodes."""
    all_ = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    return all_[all_ < below]


@dataclass
class Items:
    """A block of items in tree order: ids, node maxima and their coordinates, k-th scores to start from."""

    ids: list[int | None]
    tree: list[np.ndarray]
    support: list[list[np.ndarray]]
    weakest: np.ndarray
    documents: int
    all_terms: int

    @property
    def dtype(self) -> type:
        return self.tree[0].dtype.type


def items_of(rows: list, numbers: dict[bytes, int], weights: np.ndarray, documents: int, all_terms: int) -> Items:
    values = np.zeros((len(rows), len(numbers)), np.int64)
    for k, row in enumerate(rows):
        own = [numbers[bytes(t)] for t in row["terms"]]
        values[k, own] = weights[own] * np.array(row["repeats"], np.int64)
    # a saturated frequency is less than 1e6
    kind = np.float64 if float(values.sum(1, dtype=np.float64).max()) * 1e6 < EXACT else np.int64
    order = tree_order(values.astype(np.float64))
    tree = levels(values[order].astype(kind))
    support = [[np.flatnonzero(x) for x in level] for level in tree]
    return Items([rows[k]["item_id"] for k in order], tree, support, np.zeros(len(rows), np.int64), documents, all_terms)


class Search:
    """The best rows of each item among the documents seen so far."""

    def __init__(self, items: Items, top: int):
        self.items, self.top = items, top
        self.floor = items.weakest.copy()
        none = np.zeros(0, np.int64)
        self.best = [(none, none, np.zeros(0, bool)) for _ in items.ids]
        self.bounds = 0  # node pairs looked at

    def add(self, ids: np.ndarray, missing: np.ndarray, vectors: np.ndarray) -> None:
        """Search documents given as dense vectors."""
        order = tree_order(vectors)
        self.ids, self.missing = ids[order], missing[order]
        self.docs = levels(vectors[order])
        self.open(len(self.items.tree) - 1, 0, len(self.docs) - 1, np.zeros(1, np.int64))

    def open(self, level: int, node: int, depth: int, nodes: np.ndarray) -> None:
        """All pairs below an item node and some document nodes of one level."""
        support = self.items.support[level][node]
        if not len(support):
            return
        width = FANOUT**level
        weakest = self.floor[node * width : (node + 1) * width].min()
        bound = self.docs[depth][np.ix_(nodes, support)] @ self.items.tree[level][node][support]
        self.bounds += len(nodes)
        kept = bound >= max(weakest, 1)
        nodes = nodes[kept]
        if not len(nodes):
            return
        if not level and not depth:
            self.keep(node, nodes, bound[kept].astype(np.int64))
            return
        if depth:
            depth -= 1
            nodes = children(nodes, len(self.docs[depth]))
        below = [node] if not level else range(node * FANOUT, min((node + 1) * FANOUT, len(self.items.tree[level - 1])))
        for child in below:
            self.open(max(level - 1, 0), child, depth, nodes)

    def keep(self, item: int, rows: np.ndarray, scores: np.ndarray) -> None:
        old = self.best[item]
        score, ids, missing = (np.concatenate(x) for x in zip(old, (scores, self.ids[rows], self.missing[rows]), strict=True))
        order = np.lexsort((ids, missing, -score))[: self.top]
        self.best[item] = (score[order], ids[order], missing[order])
        if len(order) == self.top:
            self.floor[item] = max(self.floor[item], int(score[order[-1]]))

    def rows(self) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in self.best]
        score, ids, missing = (np.concatenate(x) for x in zip(*self.best, strict=True))
        item = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=missing), pa.array(score)], ["item", "doc_id", "score"])


def searched(vectors: DataFrame, items: Items, top: int) -> DataFrame:
    """item (number in tree order), doc_id, score: of every task the rows that can be among an item's best."""
    shared = vectors.sparkSession.sparkContext.broadcast(items)  # bounded by a block of items
    cells = items.tree[0].shape[1]
    at_once = max(FANOUT, TREE_CELLS // max(cells, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        search = Search(known, top)
        for batch in batches:
            ids, n, terms, tf = batch.columns
            missing = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            ends = np.asarray(terms.offsets)
            length = np.repeat(n.to_numpy(), np.diff(ends))
            term, often = terms.flatten().to_numpy(), tf.flatten().to_numpy()
            value = saturated(often, length, known.documents, known.all_terms)
            ends = ends - ends[0]
            for start in range(0, batch.num_rows, at_once):
                end = min(start + at_once, batch.num_rows)
                part = slice(ends[start], ends[end])
                row = np.repeat(np.arange(end - start), np.diff(ends[start : end + 1]))
                dense = np.zeros((end - start, cells), known.dtype)
                dense[row, term[part]] = value[part]
                search.add(ids[start:end], missing[start:end], dense)
        yield search.rows()
        give_back()

    return vectors.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """The best documents of a block of items: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    terms = sorted({bytes(t) for row in rows for t in row["terms"]})
    vectors = cut_lineage(document_vectors(docs, terms))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    holding = np.zeros(len(terms), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # terms of the block
        holding[row["term"]] = row["n"]
    weights = np.array([term_weight(size["n"], int(h)) for h in holding], np.int64)
    items = items_of(rows, {t: k for k, t in enumerate(terms)}, weights, size["n"], size["terms"] or 0)
    part = vectors.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SHARE)) == 0)
    start = ranked(searched(part, items, top), top).filter(F.col("rank") == top).select("item", "score")
    for row in start.collect():  # a row per item of the block
        items.weakest[row["item"]] = row["score"]
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return ranked(searched(vectors, items, top), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row per item


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    vectors = item_vectors(items)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = [row["block"] for row in vectors.select("block").distinct().orderBy("block").collect()]  # a number per block
    for block in blocks:
        rows = vectors.filter(F.col("block") == block).collect()  # bounded by the size of a block
        found = search_block(docs, rows, top)
        out = found if len(blocks) == 1 else cut_lineage(out.unionByName(found))
    return out


def oracle(docs: str = "documents", items: str = "benchmark", top: int = TOP) -> str:
    """DuckDB SQL for ``search``."""
    lower = "translate({}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = "unnest(regexp_extract_all(" + lower + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
WITH item AS (SELECT row_number() OVER () AS k, item_id, text FROM {items}),
doc AS (SELECT row_number() OVER () AS d, doc_id, text FROM {docs}),
asked AS (SELECT k, term, count(*) AS repeats FROM (SELECT k, {terms.format("item")} AS term FROM item) GROUP BY ALL),
held AS (SELECT d, term, count(*) AS tf FROM (SELECT d, {terms.format("doc")} AS term FROM doc) GROUP BY ALL),
sizes AS (SELECT d, sum(tf)::BIGINT AS n FROM held GROUP BY d),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term),
scored AS (
  SELECT a.k, h.d, sum(a.repeats * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * s.n * whole.docs) // whole.terms))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term) JOIN sizes s USING (d), whole GROUP BY a.k, h.d),
placed AS (
  SELECT item.item_id, doc.doc_id, score,
    row_number() OVER (PARTITION BY scored.k ORDER BY score DESC, doc.doc_id ASC NULLS LAST) AS place
  FROM scored JOIN item USING (k) JOIN doc USING (d) WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM placed WHERE place <= {top}
"""
