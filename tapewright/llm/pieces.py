"""Encoding and decoding with a SentencePiece BPE model as a relational lattice (operator 5).

A text becomes the model's internal form (a space in front, spaces as U+2581) and is cut into chunks that no piece
crosses: before a run of spaces, and around line ends. Chunks are dealt to parts by hash, so each distinct one is solved once. Its
substrings are joined with the pieces character by character (a table of prefixes, so a substring that begins no piece is not
extended), which leaves the edges of its lattice. The model is a BPE model: the path that a sum of scores would choose is not the one the
library takes. So the fold applies, step by step, the best-scored edge that spans exactly two neighbouring parts, leftmost
first, which gives the library's pieces exactly; the bounds between parts are bits of one long. A step is taken for all chunks
of a part at once. Characters outside the piece table become byte pieces.

Texts stay where they are read: each scan task packs them, compressed, into blocks, names the distinct chunks of a block
once, and gets their ids back in the order asked. Texts are then put together from their chunks: a chunk is decoded and its ids are
written out once per block.

Chunks longer than LONG characters (texts without spaces) would make the fold quadratic; they are merged by a
heap over the same pieces where the text is read, with the same result.

Defined results: a null or empty text has no ids; repeated rows and null ids keep a row each; extra columns are
ignored; U+2581 inside a text decodes to a space, as in the library; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import arrow_rows, blocks_for, trimmed
from tapewright.llm.wordjoin import SEPARATOR, by_part, requests, squeezed, unpack, unsqueezed

SPACE = "▁"
LONG = 48
BLOCK_BYTES = 6_000_000
#: Chunks solved together: what the edges of one call hold (about 1 KB a chunk).
TOGETHER = 5_000
#: Bits of a code point in a key of the prefix table.
CODE_BITS = 21
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Pieces:
    """The pieces of a model file: ids and scores by string, byte pieces, and strings by id."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[1:-1], 16)] = k
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.raw.append(b"")
            else:
                self.id_of[piece], self.score[piece] = k, model.get_score(k)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.names = [b"%d" % k for k in range(len(self.raw))]
        self.longest = max(map(len, self.id_of), default=1)

    def merged(self, chunk: str) -> list[int]:
        """Ids of one chunk by merging with a heap (for long chunks)."""
        parts, n = list(chunk), len(chunk)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(-s, k, 2) for k in range(n - 1) if (s := self.score.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            if not alive[k] or (j := after[k]) >= n or len(parts[k]) + len(parts[j]) != size:
                continue
            parts[k] += parts[j]
            alive[j], after[k] = False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and (b := after[a]) < n and (s := self.score.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, len(parts[a]) + len(parts[b])))
        ids = []
        for part, keep in zip(parts, alive, strict=True):
            if keep:
                known = self.id_of.get(part)
                ids += [known] if known is not None else [self.byte_id[b] for b in part.encode("utf-8", "surrogatepass")]
        return ids

    @functools.cached_property
    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table of all prefixes of pieces: sorted keys (shorter prefix, code point) and the prefix each leads to; id (-1: no piece) and rank by prefix."""
        rank = {score: k for k, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        nodes: dict[int, int] = {}
        ids, ranks = [-1], [0]
        for piece, number in self.id_of.items():
            node = 0
            for letter in piece:
                node = nodes.setdefault(node << CODE_BITS | ord(letter), len(ids))
                if node == len(ids):
                    ids.append(-1)
                    ranks.append(0)
            ids[node], ranks[node] = number, rank[self.score[piece]]
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        return keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order], np.array(ids), np.array(ranks)

    def solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of LONG characters at most, one after the other, and how many each has."""
        parts = [self.fold(chunks[k : k + TOGETHER]) for k in range(0, len(chunks), TOGETHER)] or [self.fold([])]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that occur in code points, of which ``left`` belong to the same chunk from each on: place, size, rank, id."""
        keys, leads_to, id_of, rank_of = self.prefixes
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        for size in range(1, self.longest + 1):
            if size > 1:
                on = left[at] >= size
                at, node = at[on], node[on]
            if not len(at) or not len(keys):
                break
            wanted = node << CODE_BITS | codes[at + (size - 1)]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            on = keys[place] == wanted
            at, node = at[on], leads_to[place[on]]
            piece = id_of[node] >= 0
            found.append((at[piece], np.full(int(piece.sum()), size), rank_of[node[piece]], id_of[node[piece]]))
        none = np.zeros((4, 1, 0), np.int64)
        return tuple(np.concatenate(x) for x in (zip(*found, strict=True) if found else none))

    def fold(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begins, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chunks)), sizes)
        at, size, rank, ids = self.edges(codes, (begins + sizes)[of] - np.arange(len(codes)))
        part = np.full(len(codes), -1)  # id of the part that begins at a place
        single = size == 1
        part[at[single]] = ids[single]
        at, size, rank, ids = (x[~single] for x in (at, size, rank, ids))
        # by chunk, best first, then leftmost; a rank is below the number of pieces
        order = np.argsort((of[at] * (len(self.score) + 1) + rank) * (LONG + 1) + at - begins[of[at]])
        at, size, ids = at[order], size[order], ids[order]
        chunk = of[at]
        low = np.int64(1) << (at - begins[chunk])
        high = low << size
        ends, inner = low | high, high - (low << 1)
        bounds = (np.int64(1) << (sizes + 1)) - 1
        while len(chunk):
            now = bounds[chunk]
            inside = now & inner
            possible = ((now & ends) == ends) & (inside != 0)  # both ends are still bounds, and it is not a part yet
            turn = np.flatnonzero(possible & ((inside & (inside - 1)) == 0))
            turn = turn[np.append(True, chunk[turn][1:] != chunk[turn][:-1])] if len(turn) else turn
            bounds[chunk[turn]] -= inside[turn]
            part[at[turn]] = ids[turn]
            moved = np.zeros(len(chunks), bool)
            moved[chunk[turn]] = True  # where nothing merged, nothing ever will
            on = possible & moved[chunk]
            on[turn] = False
            chunk, at, ids, ends, inner = chunk[on], at[on], ids[on], ends[on], inner[on]
        starts = np.flatnonzero(bounds[of] >> (np.arange(len(codes)) - begins[of]) & 1)
        out, owner = part[starts], of[starts]
        raw = np.flatnonzero(out < 0)
        if len(raw):
            spelled = [[self.byte_id.get(b, 0) for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes[starts[raw]]]
            many = np.ones(len(out), np.int64)
            many[raw] = [len(x) for x in spelled]
            places = (np.cumsum(many) - many)[raw]
            out, owner = np.repeat(out, many), np.repeat(owner, many)
            out[slices(places, many[raw])] = [k for x in spelled for k in x]
        return out, np.bincount(owner, minlength=len(chunks))

    def text(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join([self.raw[k] for k in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks(text: str) -> list[str]:
    return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


def lattice(chunk_rows: DataFrame, path: str) -> DataFrame:
    """(of_part, chunk) -> ids of rows (part, chunk), where the rows are; chunks have LONG characters at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = pieces(path).solve(batch.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("chunk"), id_lists(flat, sizes)], ["of_part", "chunk", "ids"])

    return chunk_rows.select("part", F.col("chunk").cast("string").alias("chunk")).mapInArrow(run, f"of_part {chunk_rows.schema['part'].dataType.simpleString()}, chunk string, ids array<int>")


def id_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))


def packed_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """block, packed: the rows (doc_id, text) of each scan task, compressed, in blocks of BLOCK_BYTES at most or one row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(arrow_rows(batches, BLOCK_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.array([pack_rows(rows)], pa.binary())], ["block", "packed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return source.mapInArrow(run, "block long, packed binary").repartition(blocks, "block")


def pack_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def rows_of(block: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(block.column("packed")[0].as_py()).read_all()


class Found(NamedTuple):
    """The chunks of a block, their ids (``flat``, from ``begins``, ``sizes`` of them), and the texts as chunk numbers, one after the other."""

    chunks: list[str]
    flat: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    texts: list[np.ndarray]

    def ids(self) -> pa.ListArray:
        """Ids of every text."""
        flat = [self.flat[slices(self.begins[x], self.sizes[x])] for x in self.texts]
        return id_lists(np.concatenate([*flat, np.zeros(0, np.int64)]), np.fromiter(map(len, flat), np.int64, len(flat)))


class Numbers(dict):
    """Consecutive numbers, given when a key is first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def assembled(docs: DataFrame, path: str, finish: Callable[[pa.Table, Found], pa.Table], schema: str) -> DataFrame:
    """``finish`` of every block of texts (doc_id, text) and the ids of their chunks."""
    blocks = blocks_for(docs, "text", BLOCK_BYTES)
    blocked = packed_blocks(docs, blocks)
    wide = "<u2" if len(pieces(path).raw) <= 1 << 16 else "<u4"

    def count(block: pa.Table) -> tuple[list[bytes], list[dict[bytes, int]]]:
        found: set[str] = set()
        for text in rows_of(block).column("text").to_pylist():
            found.update(chunks(text))
        return [c.encode() for c in found if len(c) <= LONG and c != "\n"], []

    asked = requests(blocked, blocks, count, squeeze=True).select("part", "block", "words")

    def answer(wanted: pa.Table) -> pa.Table:
        lists = [unpack(unsqueezed(w)) for w in wanted.column("words").to_pylist()]
        place = Numbers()
        at = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in lists]
        flat, sizes = pieces(path).solve([w.decode() for w in place])
        flat, sizes = flat.astype(wide), sizes.astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        return pa.table({
            "of_block": wanted.column("block"), "part": wanted.column("part"), "n": pa.array(list(map(len, lists)), pa.int32()),
            "asked": pa.array([zlib.crc32(SEPARATOR.join(words)) for words in lists], pa.int64()),
            "pack": pa.array([squeezed(sizes[x].astype("u1").tobytes() + flat[slices(begins[x], sizes[x])].tobytes()) for x in at], pa.binary()),
        })

    answers = asked.groupBy("part").applyInArrow(trimmed(answer), "of_block long, part int, n int, asked long, pack binary")

    def read(key: tuple, block: pa.Table, packs: pa.Table) -> pa.Table:
        own = pieces(path)
        texts = rows_of(block)
        numbers = Numbers()
        lists = []
        for text in texts.column("text").to_pylist():
            cs = chunks(text)
            lists.append(np.fromiter(map(numbers.__getitem__, cs), np.int32, len(cs)))
        begins, sizes = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        rows = by_part((c.encode() for c in numbers if len(c) <= LONG and c != "\n"), blocks)
        flats, at = [], 0
        for part, n, asked_sum, pack in zip(*(packs.column(c).to_pylist() for c in ("part", "n", "asked", "pack")), strict=True):
            if zlib.crc32(SEPARATOR.join(rows[part])) != asked_sum:  # the rows of a lost task came back in another order
                raise RuntimeError("a block of texts changed between asking and reading; write the input first")
            own_at = np.fromiter((numbers[w.decode()] for w in rows[part]), np.int64, n)
            raw = unsqueezed(pack)
            size = np.frombuffer(raw, "u1", n).astype(np.int64)
            sizes[own_at], begins[own_at] = size, at + np.cumsum(size) - size
            flats.append(np.frombuffer(raw, wide, offset=n))
            at += len(flats[-1])
        for chunk, number in numbers.items():
            if len(chunk) > LONG or chunk == "\n":
                ids = np.array(own.merged(chunk), wide)
                sizes[number], begins[number] = len(ids), at
                flats.append(ids)
                at += len(ids)
        flat = np.concatenate([*flats, np.zeros(0, wide)]).astype(np.int32)
        return finish(texts, Found(list(numbers), flat, begins, sizes, lists))

    return blocked.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(trimmed(read), schema)


def slices(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of consecutive slices of an array, one after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids of every document's whole text."""

    def finish(texts: pa.Table, found: Found) -> pa.Table:
        return pa.table({"doc_id": texts.column("doc_id"), "text": texts.column("text"), "ids": found.ids()})

    return assembled(docs, path, finish, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The input with ``decoded``: the text of each row's ids."""

    def run(batches):
        own = pieces(path)
        for batch in batches:
            texts = [own.text(ids or []) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, fields + ", decoded string")


def summary(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by spaces), whether decoding gives the text back; ids on demand."""

    def finish(texts: pa.Table, found: Found) -> pa.Table:
        own = pieces(path)
        flat = found.flat.tolist()
        spans = list(zip(found.begins.tolist(), (found.begins + found.sizes).tolist(), strict=True))
        names, raw = [own.names[k] for k in flat], [own.raw[k] for k in flat]
        listed = [b" ".join(names[a:b]) for a, b in spans]
        # texts are joined from chunks and their decoding from that of the chunks: one that differs shows in its chunk
        plain = np.array([b"".join(raw[a:b]) == c.replace(SPACE, " ").encode() for (a, b), c in zip(spans, found.chunks, strict=True)], bool)
        same = [
            bool(plain[x].all()) or own.text(found.flat[slices(found.begins[x], found.sizes[x])].tolist()) == t.replace(SPACE, " ")
            for x, t in zip(found.texts, texts.column("text").to_pylist(), strict=True)
        ]
        out = {
            "doc_id": texts.column("doc_id"), "n_tokens": pa.array([int(found.sizes[x].sum()) for x in found.texts], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(b" ".join([listed[k] for k in x.tolist()])).hexdigest() for x in found.texts], pa.string()),
            "round_trip": pa.array(same, pa.bool_()),
        }
        return pa.table({**out, "ids": found.ids()} if with_ids else out)

    return assembled(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
