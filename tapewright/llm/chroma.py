"""Chroma fingerprints of audio columns and their alignment (operator 10).

Sound is an array of float samples per row. Frames of FRAME samples, HOP apart, give the energy of the twelve
pitch classes; an integral image over (time, pitch class) makes the sum over any rectangle four look-ups, and
SIXTEEN filters compare such sums. Each filter result is cut to two bits at the quartiles of the whole corpus (from
histograms over all rows), so a frame position is one packed 32-bit integer in Gray code.

Queries are compared with all sounds in blocks: chunks of sounds meet blocks of queries. Within a pair of them each third
of a print (11, 11 and 10 bits) is looked up among the queries' thirds; equal ones count in the histogram of offsets of
the sound and each query. Every offset with LEAST_HITS equal thirds is checked by its bit error over the whole overlap,
and the best one is returned. A run of equal thirds (silence) is one entry, however long: two runs add a trapezium to the
histogram, kept as its second differences.

Distinct fingerprints form classes (exact copies share one), so a sound copied thousands of times is compared once.

Defined results: a null or too short sound has an empty fingerprint and no matches, and shares a class with equal samples
only; samples that are null or not finite count as 0; repeated ids are kept as rows; a class whose ids are all null has a
null class_id and is compared all the same; extra columns are ignored; without rows the results are empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut_lineage, trimmed

RATE = 4000
FRAME = 512
HOP = 128
CLASSES = 12
LOWEST, HIGHEST = 55.0, 1760.0
#: Filters: kind, first pitch class, pitch classes high, frames wide. By rule: every kind at four places.
KINDS = ("total", "rows", "columns", "cross")
WIDTHS = (4, 8, 12, 16)
FILTERS = [(kind, (3 * k + 2 * w) % 9, 4 - k % 2, width) for k, kind in enumerate(KINDS) for w, width in enumerate(WIDTHS)]
WIDEST = max(WIDTHS)
#: Overlap in positions that a match needs, and the share of differing bits it may have.
LEAST_OVERLAP = 16
BIT_ERROR = 0.25
#: Equal thirds at one offset that make it a candidate.
LEAST_HITS = 3
THIRDS = ((0, 11), (11, 11), (22, 10))
#: Bins of the histograms behind the quartiles; filter results lie within plus and minus TOP.
BINS, TOP = 8192, 6.0
#: Queries of a block, bytes of prints of a chunk of sounds, cells of the histograms held at once.
QUERIES_PER_BLOCK = 1000
CHUNK_BYTES = 1_000_000
MOST_CELLS = 1_000_000


def pitch_matrix(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Which pitch class each Fourier bin belongs to (bins outside the range to none)."""
    hertz = np.arange(frame // 2 + 1) * rate / frame
    inside = (hertz >= LOWEST) & (hertz <= HIGHEST)
    note = np.zeros(len(hertz), int)
    note[inside] = np.round(12 * np.log2(hertz[inside] / 440.0)).astype(int) % CLASSES
    matrix = np.zeros((len(hertz), CLASSES))
    matrix[np.flatnonzero(inside), note[inside]] = 1.0
    return matrix


PITCHES = pitch_matrix()
TAPER = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy per frame and pitch class, each frame scaled to length 1."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    samples = np.where(np.isfinite(samples), samples, 0.0)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * TAPER, axis=1)) ** 2 @ PITCHES
    length = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.divide(energy, length, out=np.zeros_like(energy), where=length > 1e-12)


def filter_results(frames: np.ndarray) -> np.ndarray:
    """Log ratios of the filters at every frame position, from one integral image."""
    positions = len(frames) - WIDEST + 1
    if positions <= 0:
        return np.zeros((0, len(FILTERS)))
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(positions)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.empty((positions, len(FILTERS)))
    for k, (kind, low, high, width) in enumerate(FILTERS):
        top, mid, half = low + high, low + high // 2, width // 2
        whole = area(0, width, low, top)
        if kind == "total":
            part = whole - area(0, width, 0, CLASSES) * high / CLASSES
            plus, minus = whole, whole - part
        elif kind == "rows":
            plus = area(0, width, mid, top)
            minus = whole - plus
        elif kind == "columns":
            plus = area(half, width, low, top)
            minus = whole - plus
        else:
            plus = area(0, half, low, mid) + area(half, width, mid, top)
            minus = whole - plus
        out[:, k] = np.log((1.0 + np.maximum(plus, 0)) / (1.0 + np.maximum(minus, 0)))
    return out


def packed(results: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two bits per filter in Gray code, as 32-bit integers (signed, for Spark)."""
    total = np.zeros(len(results), np.uint64)
    for k in range(len(FILTERS)):
        level = np.searchsorted(cuts[k], results[:, k], side="right").astype(np.uint64)
        total |= (level ^ (level >> np.uint64(1))) << np.uint64(2 * k)
    return total.astype(np.uint32).view(np.int32)


def quartiles(sounds: DataFrame) -> np.ndarray:
    """Three cuts per filter from histograms over every frame position of all rows (a fixed number of counters)."""
    n_filters = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_filters * BINS, np.int64)
        for batch in batches:
            for sound in samples_of(batch.column(0)):
                results = filter_results(chroma(sound))
                cell = np.clip(((results + TOP) * (BINS / (2 * TOP))).astype(np.int64), 0, BINS - 1)
                counts += np.bincount((cell + np.arange(n_filters) * BINS).ravel(), minlength=n_filters * BINS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used // BINS, pa.int32()), pa.array(used % BINS, pa.int32()), pa.array(counts[used], pa.int64())], ["filter", "bin", "n"])

    found = sounds.select("sound").mapInArrow(run, "filter int, bin int, n long").groupBy("filter", "bin").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return np.tile([-0.1, 0.0, 0.1], (n_filters, 1))
    counts = np.zeros((n_filters, BINS))
    counts[found["filter"], found["bin"]] = found["n"]
    share = counts.cumsum(axis=1) / counts.sum(axis=1, keepdims=True)
    edges = (np.arange(BINS) + 1) * (2 * TOP / BINS) - TOP
    return np.array([edges[np.searchsorted(row, [0.25, 0.5, 0.75])] for row in share])


def samples_of(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def fingerprints(sounds: DataFrame, cuts: np.ndarray) -> DataFrame:
    """id, prints (packed integers of the whole sound) and their digest (of the samples where there are no prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for sound, known in zip(samples_of(batch.column(1)), batch.column(1).is_valid().to_pylist(), strict=True):
                prints.append(packed(filter_results(chroma(sound)), cuts))
                own = b"p" + prints[-1].tobytes() if len(prints[-1]) else b"s" + sound.tobytes() if known else b""
                keys.append(hashlib.md5(own).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int32())), pa.array(keys, pa.binary())], ["id", "prints", "key"])

    return sounds.select("id", "sound").mapInArrow(run, "id long, prints array<int>, key binary")


def classes(prints: DataFrame) -> DataFrame:
    """id, class_id: the smallest id with the same fingerprint (without one: with the same samples)."""
    first = prints.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return prints.select("id", "key").join(first, "key").select("id", "class_id", "class_size")


def representatives(prints: DataFrame, name: str) -> DataFrame:
    """Smallest id (called ``name``) and fingerprint of each class whose fingerprint is not empty, with its digest."""
    return prints.filter(F.size("prints") > 0).groupBy("key").agg(F.min("id").alias(name), F.first("prints").alias("prints"))


def runs(prints: list[np.ndarray], shift: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one third in consecutive positions: whose, value, first position, length."""
    sizes = np.fromiter(map(len, prints), np.int64, len(prints))
    value = (np.concatenate(prints).view(np.uint32) >> np.uint32(shift)) & np.uint32((1 << width) - 1)
    owner = np.repeat(np.arange(len(prints)), sizes)
    at = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
    return owner[first], value[first].astype(np.int64), at[first], np.diff(np.append(first, len(value)))


class Asked:
    """Queries of one block, with their thirds by value."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        self.sizes = np.fromiter(map(len, prints), np.int64, len(prints))
        self.flat = np.concatenate(prints).view(np.uint32)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.tables = []
        for shift, width in THIRDS:
            owner, value, at, length = runs(prints, shift, width)
            order = np.argsort(value, kind="stable")
            self.tables.append((owner[order], value[order], at[order], length[order]))

    def hits(self, sound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, offset and hits of every offset with LEAST_HITS equal thirds, from the offset histograms."""
        room = self.sizes + len(sound) + 1  # offsets from 1 - size to len(sound) - 1, and two places for the differences
        base = np.cumsum(room) - room
        steps = np.zeros(int(room.sum()), np.int64)
        for (shift, width), (owner, value, at, length) in zip(THIRDS, self.tables, strict=True):
            _, own_value, own_at, own_length = runs([sound], shift, width)
            low, high = np.searchsorted(value, own_value, "left"), np.searchsorted(value, own_value, "right")
            n = high - low
            mine = np.repeat(np.arange(len(n)), n)
            other = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, lq, lx = owner[other], length[other], own_length[mine]
            start = base[q] + self.sizes[q] + own_at[mine] - at[other] - lq
            ends = np.concatenate([start + lq, start + lx])
            steps += np.bincount(np.concatenate([start, start + lq + lx]), minlength=len(steps)) - np.bincount(ends, minlength=len(steps))
        # the differences of each query sum to 0, so sums run over all of them at once
        total = steps.cumsum().cumsum()
        found = np.flatnonzero(total >= LEAST_HITS)
        q = np.searchsorted(base, found, "right") - 1
        return q, found - base[q] - self.sizes[q] + 1, total[found]

    def errors(self, sound: np.ndarray, q: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlap and differing bits of each (query, offset)."""
        start = np.maximum(0, -offset)
        overlap = np.minimum(self.sizes[q] - start, len(sound) - np.maximum(0, offset))
        wrong = np.zeros(len(q), np.int64)
        unsigned = sound.view(np.uint32)
        cut = np.append(np.flatnonzero(np.diff(np.cumsum(overlap) // MOST_CELLS, prepend=-1)), len(q))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            n = overlap[a:b]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first, n)
            differ = self.flat[np.repeat(self.begins[q[a:b]] + start[a:b], n) + place] ^ unsigned[np.repeat(np.maximum(0, offset[a:b]), n) + place]
            wrong[a:b] = np.add.reduceat(np.bitwise_count(differ).astype(np.int64), first)
        return overlap, wrong


def aligned(queries: list[np.ndarray], sounds: list[np.ndarray]) -> list[tuple[int, int, int, int, int, float]]:
    """(query, sound, offset, hits, overlap, bit error) of the best offset of each pair that aligns."""
    out: list[tuple[int, int, int, int, int, float]] = []
    order = np.argsort([len(x) for x in queries], kind="stable")
    blocks: dict[int, list[tuple[np.ndarray, Asked]]] = {}
    for k, sound in enumerate(sounds):
        # as many queries at a time as the room for histograms allows; block sizes are powers of two, so few are built
        at_once = 1 << int(math.log2(max(1, min(len(queries), MOST_CELLS // (len(sound) + len(queries[order[-1]]) + 1)))))
        if at_once not in blocks:
            cuts = [order[a : a + at_once] for a in range(0, len(order), at_once)]
            blocks[at_once] = [(own, Asked([queries[x] for x in own])) for own in cuts]
        for own, asked in blocks[at_once]:
            q, offset, hits = asked.hits(sound)
            room = np.minimum(asked.sizes[q] - np.maximum(0, -offset), len(sound) - np.maximum(0, offset)) >= LEAST_OVERLAP
            q, offset, hits = q[room], offset[room], hits[room]
            if not len(q):
                continue
            overlap, wrong = asked.errors(sound, q, offset)
            error = wrong / (32.0 * overlap)
            fits = np.flatnonzero(error <= BIT_ERROR)
            best = fits[np.lexsort((offset[fits], np.abs(offset[fits]), -overlap[fits], error[fits], q[fits]))]
            best = best[np.append(True, q[best][1:] != q[best][:-1])] if len(best) else best
            out += [(int(own[q[x]]), k, int(offset[x]), int(hits[x]), int(overlap[x]), float(error[x])) for x in best]
    return out


def matches(prints: DataFrame, query_prints: DataFrame) -> DataFrame:
    """Pairs (query class, class) that align: best offset, its hits, overlap and bit error.

    The queries are a stated set that meets all sounds in blocks: chunks of sounds go to every block of queries.
    """
    ones, asking = cut_lineage(representatives(prints, "class_id")), cut_lineage(representatives(query_prints, "query_id"))
    blocks = max(1, math.ceil(asking.count() / QUERIES_PER_BLOCK))
    size = ones.agg(F.sum(F.size("prints").cast("long") * 4 + 32).alias("n")).first()["n"] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))

    def dealt(rows: DataFrame, own: str, n: int, other: str, copies: int) -> DataFrame:
        deal = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias(own)
        return rows.select(deal, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other), F.col(rows.columns[1]), "prints")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, sounds = (t.column("prints").combine_chunks() for t in (left, right))
        found = aligned(lists_of(asked), lists_of(sounds)) if len(asked) and len(sounds) else []
        q, k, offset, hits, overlap, error = zip(*found, strict=True) if found else ((),) * 6
        return pa.table({
            "query_id": left.column("query_id").take(pa.array(q, pa.int64())), "class_id": right.column("class_id").take(pa.array(k, pa.int64())),
            "offset": pa.array(offset, pa.int32()), "hits": pa.array(hits, pa.int64()), "overlap": pa.array(overlap, pa.int32()), "bit_error": pa.array(error, pa.float64()),
        })

    left = dealt(asking, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    right = dealt(ones, "chunk", chunks, "block", blocks).groupBy("block", "chunk")
    return left.cogroup(right).applyInArrow(trimmed(compare), "query_id long, class_id long, offset int, hits long, overlap int, bit_error double")


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """Integer arrays of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])


def rendered(embeddings: DataFrame, note: int = 160) -> DataFrame:
    """Sounds made of stored vectors, as test material: value k of a vector is the pitch of note k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = samples_of(batch.column(1))
            for start in range(0, len(vectors), 64):
                sounds = []
                for v in vectors[start : start + 64]:
                    hertz = 220.0 * 2.0 ** np.clip(np.nan_to_num(v) * 6, -1.5, 2.5)
                    phase = np.cumsum(np.repeat(hertz, note)) * (2 * np.pi / RATE)
                    sounds.append(np.sin(phase).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 64), pa.array(sounds, pa.list_(pa.float32()))], ["id", "sound"])

    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).mapInArrow(run, "id long, sound array<float>")


def recorded(sounds: DataFrame, skip: int = 9 * HOP, noise: float = 0.02) -> DataFrame:
    """The sounds as a second recording has them: begun later, at half the volume, with hiss (fixed by the id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, sound in zip(batch.column(0).to_pylist(), samples_of(batch.column(1)), strict=True):
                rng = np.random.default_rng(abs(key or 0))
                out.append((0.5 * sound[skip:] + noise * rng.standard_normal(len(sound[skip:]))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], ["id", "sound"])

    return sounds.select("id", "sound").mapInArrow(run, "id long, sound array<float>")


def search(sounds: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership of the sounds, membership of the queries, matches between their classes)."""
    cuts = quartiles(sounds)
    prints, query_prints = (cut_lineage(fingerprints(x, cuts)) for x in (sounds, queries))
    members, query_members = classes(prints), classes(query_prints)
    return members, query_members, matches(prints, query_prints)
