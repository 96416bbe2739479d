"""Quality rules with an isolation forest on the rule statistics (operator 2).

``rule_statistics`` computes exact counts per text; ``fit_forest`` grows random isolation trees on
subsamples of rows that pass the base rules; ``calibrate`` reads the score threshold off labelled rows.

Defined results: a null text counts as empty; an empty or short text fails the base rules; repeated rows
get equal results each; a null ``doc_id`` is kept as null; extra columns of the input are ignored by
``score_quality`` and kept by ``keep_good``, whose helper columns have private names. Without rows the
result is empty, without labelled rows nothing is rejected beyond the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import arrow_rows, cut_lineage, give_back, map_rows

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
SPACES = b" \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest looks at; the base rules already decide on length and repetition.
SHARES = ["symbols", "upper", "word_length", "distinct"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in SHARES)

MIN_WORDS = 50
TREES = 100
SUBSAMPLE = 256
#: Rows that reach the driver for growing trees, on average; a bound by hash rate, not a prefix.
SAMPLE_ROWS = 32_768
SCORE_BINS = 1000
BAD_SHARE = 4
#: Words of typical text that every text is topped up with, so that short texts do not look odd by chance.
PRIOR_WORDS = 30
#: Share of labelled good rows that the threshold may reject at most.
GOOD_LOSS = 0.001


def repeated_word_count(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice in the text, the first included."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, window, counts = np.unique(pairs[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_statistics(text: str | None) -> tuple:
    """Counts and shares of one text, see COUNTS and SHARES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeats = repeated_word_count(ids)
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    return (
        n, word_chars, symbols, duplicates, repeats,
        symbols / max(n, 1), upper / max(upper + lower, 1), word_chars / max(n, 1), len(seen) / max(n, 1) ** 0.8,
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row per document with COUNTS and SHARES of its whole text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [text_statistics(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]] + [pa.array(c, pa.float64()) for c in columns[len(COUNTS) :]]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *COUNTS, *SHARES])

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, SCHEMA)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Forest:
    """Trees as arrays: node -> feature (-1: leaf), cut, left child, right child, path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    typical: float
    middle: np.ndarray

    def anomaly(self, n_words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Score in (0, 1]: 2 to the minus mean path length over the typical one."""
        if not len(rows) or not self.feature.shape[0]:
            return np.zeros(len(rows))
        rows = topped_up(n_words, rows, self.middle)
        total, pick = np.zeros(len(rows)), np.arange(len(rows))
        for tree in range(self.feature.shape[0]):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                feature = self.feature[tree, node]
                below = rows[pick, np.maximum(feature, 0)] < self.cut[tree, node]
                node = np.where(feature < 0, node, np.where(below, self.left[tree, node], self.right[tree, node]))
            total += self.path[tree, node]
        return 2.0 ** (-total / self.feature.shape[0] / self.typical)


def typical_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n keys of a binary tree."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def topped_up(n_words: np.ndarray, rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
    n = n_words.reshape(-1, 1).astype(float)
    return (rows * n + middle * PRIOR_WORDS) / (n + PRIOR_WORDS)


def grow_forest(n_words: np.ndarray, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    middle = np.median(rows, axis=0) if len(rows) else np.zeros(len(SHARES))
    rows = topped_up(n_words, rows, middle)
    size = min(subsample, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 * max(size, 1)
    if not len(rows):
        trees = 0
    shape = (trees, nodes)
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape, int), np.zeros(shape, int), np.zeros(shape), depth, max(typical_path(size), 1e-9), middle)
    for tree in range(trees):
        todo, used = [(0, rows[rng.choice(len(rows), size, replace=False)], 0)], 1
        while todo:
            node, part, level = todo.pop()
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
            if level == depth or len(part) <= 1 or not len(spread):
                forest.path[tree, node] = level + typical_path(len(part))
                continue
            feature = int(rng.choice(spread))
            low, high = part[:, feature].min(), part[:, feature].max()
            cut = rng.uniform(low, high)
            cut = high if cut <= low else cut
            below = part[:, feature] < cut
            forest.feature[tree, node], forest.cut[tree, node] = feature, cut
            forest.left[tree, node], forest.right[tree, node] = used, used + 1
            todo += [(used, part[below], level + 1), (used + 1, part[~below], level + 1)]
            used += 2
    return forest


def truth(labels: DataFrame) -> DataFrame:
    """One row per labelled document; labelled more than once, it counts as good if any label says so."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))


def fit_forest(statistics: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Forest:
    """Forest over rows that pass the base rules; of those labelled bad only one in BAD_SHARE, so that they stay odd
    but their values lie inside the range that the trees cut. About ``sample_rows`` rows reach the
    driver, chosen by hash at a rate from the row count, so their number does not grow with the input."""
    passing = statistics.filter(~base_failed())
    rate = min(1.0, sample_rows / max(passing.count(), 1))
    chosen = F.pmod(F.xxhash64("doc_id", *SHARES, F.lit(seed)), F.lit(1 << 20)) < int(rate * (1 << 20))
    dropped = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BAD_SHARE)) > 0
    bad = truth(labels).filter((F.col("quality") == 0) & dropped).select("doc_id")
    rows = passing.filter(chosen).join(bad, "doc_id", "left_anti").select("n_words", *SHARES).toPandas().to_numpy(float).reshape(-1, 1 + len(SHARES))
    rows = rows[np.lexsort(rows.T)] if len(rows) else rows
    return grow_forest(rows[:, 0], rows[:, 1:], seed=seed)


def score_rows(statistics: DataFrame, forest: Forest) -> DataFrame:
    """The statistics with ``anomaly``; the forest has a fixed size and travels with the task."""
    schema = statistics.schema

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SHARES]) if batch.num_rows else np.zeros((0, len(SHARES)))
            n_words = batch.column("n_words").to_numpy(zero_copy_only=False)
            return batch.append_column("anomaly", pa.array(forest.anomaly(n_words, rows), pa.float64()))

        return step

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", anomaly double"
    return map_rows(statistics, make, fields)


def calibrate(scored: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """Smallest threshold with at most ``good_loss`` of labelled good rows at or above it.

    Works on a histogram of all labelled rows that pass the base rules (at most two times SCORE_BINS + 1
    rows reach the driver).
    """
    bins = (
        scored.filter(~base_failed()).select("doc_id", F.floor(F.col("anomaly") * SCORE_BINS).cast("int").alias("bin"))
        .join(truth(labels), "doc_id").groupBy("quality", "bin").count().toPandas()
    )
    good = np.zeros(SCORE_BINS + 2)
    bad = np.zeros(SCORE_BINS + 2)
    for quality, at, n in bins.itertuples(index=False):
        (good if quality else bad)[at] += n
    if not good.sum() or not bad.sum():
        return float("inf")
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    allowed = np.flatnonzero(lost <= good_loss * good.sum())
    best = allowed[0]
    # in a gap between the classes: a quarter of it above the good rows
    same = [at for at in allowed if caught[at] == caught[best]]
    return (0.75 * same[0] + 0.25 * same[-1]) / SCORE_BINS if caught[best] else float("inf")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: counts, ``base_failed``, ``anomaly`` and the verdict ``kept``."""
    statistics = cut_lineage(rule_statistics(docs))
    scored = score_rows(statistics, fit_forest(statistics, labels))
    threshold = calibrate(scored, labels)
    verdict = F.col("anomaly") < F.lit(threshold)
    return scored.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"), "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. The verdict is taken per row of the same
    scan, without a join back: the statistics only serve to fit the forest and the threshold."""
    statistics = cut_lineage(rule_statistics(docs))
    forest = fit_forest(statistics, labels)
    threshold = calibrate(score_rows(statistics, forest), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            rows = [text_statistics(t) for t in batch.column("text").to_pylist()]
            shares = np.array([r[len(COUNTS) :] for r in rows]).reshape(-1, len(SHARES))
            failed = np.array([r[0] < MIN_WORDS or 100 * r[4] > 50 * r[0] for r in rows], bool)
            n_words = np.array([r[0] for r in rows])
            yield batch.filter(pa.array(~failed & (forest.anomaly(n_words, shares) < threshold)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
