"""Byte-level BPE by a segment tree over the ranks of adjacent pairs (operator 11).

A pre-token starts as its bytes. Leaf k of a segment tree holds (rank, k) of the merge rule for part k and the part after
it, or nothing; every inner node holds the smaller of its children, so the root is the lowest rank and, among equals, the
leftmost place. A merge changes three leaves (the merged part, the one it swallowed, the one before) and the nodes above
them, a number logarithmic in the length; it goes on until the root is empty. A pre-token of n bytes takes O(n log n).

Short pre-tokens of one batch are merged side by side: their trees are rows of one array, and each step takes the roots of
all trees that still have a merge. Long pre-tokens (texts without spaces) have a tree of their own. Both are the same tree.

Distinct pre-tokens are merged once per batch and remembered in a bounded memo, which costs time only when full.
Decoding joins the bytes of the pieces and reads them as UTF-8 (what is none becomes U+FFFD), as the library does.

Defined results: a null or empty text has no ids and decodes to the empty text; special strings inside texts are one token each, as
by the library's default; repeated rows and null ids keep a row each; extra columns are ignored; an empty table gives an empty
result. A null list of ids decodes to null; ids outside the vocabulary are refused. Files with another normalizer, pre-tokenizer,
decoder or model are refused.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import map_rows
from tapewright.llm.tokencount import PATTERN, byte_letters

#: Bytes from which a pre-token has a tree of its own instead of a row of the shared array.
LONG = 256
#: Leaves of one shared array (8 bytes for each of its nodes, and as much for links).
LEAVES = 1 << 19
#: Pre-tokens that one Python process remembers, and the longest of them in bytes.
MEMO, MEMO_BYTES = 300_000, 64
#: Text bytes of one batch, and pre-tokens of one step through a text.
BATCH_BYTES = 3_000_000
WORDS_AT_ONCE = 400_000
NONE = np.iinfo(np.int64).max
PLACE = (1 << 32) - 1


class Rules:
    """Merge rules, pieces and special strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bytewise = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or not bytewise or spec.get("normalizer") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocabulary: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        added = spec.get("added_tokens") or []
        size = 1 + max(itertools.chain(vocabulary.values(), (t["id"] for t in added)))
        self.pieces: list[bytes | None] = [None] * size
        for piece, k in vocabulary.items():
            self.pieces[k] = bytes(byte_of[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in added}
        for content, k in self.special.items():
            self.pieces[k] = content.encode("utf-8")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.byte_ids = np.array([vocabulary[c] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = size
        keys = np.array([vocabulary[a] * size + vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)  # by rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order, 0)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) in one number of each pair; NONE for pairs without a rule and for ids below 0."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, (self.ranks[at] << 32) | place, NONE)


def merge_one(word: bytes, rules: Rules) -> np.ndarray:
    """Ids of one pre-token by a tree of its own."""
    ids = rules.byte_ids[np.frombuffer(word, np.uint8)]
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    tree = np.full(2 * size, NONE, np.int64)
    tree[size : size + n - 1] = rules.leaves(ids[:-1], ids[1:], np.arange(n - 1))
    level = size
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    node, part, made, rank_of, base = tree.tolist(), ids.tolist(), rules.made.tolist(), rules.rank_of.get, rules.base
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    while node[1] < NONE:
        at, new = node[1] & PLACE, made[node[1] >> 32]
        gone = after[at]
        right, left = after[gone], before[at]
        part[at], part[gone], after[at] = new, -1, right
        changed = [(gone, None), (at, None)]
        if right >= 0:
            before[right] = at
            changed[1] = (at, rank_of(new * base + part[right]))
        if left >= 0:
            changed.append((left, rank_of(part[left] * base + new)))
        for place, rank in changed:
            k = place + size
            node[k] = NONE if rank is None else (rank << 32) | place
            while k > 1:
                k >>= 1
                low, high = node[2 * k], node[2 * k + 1]
                node[k] = low if low < high else high
    return np.array([x for x in part if x >= 0], np.int32)


def merge_side_by_side(words: list[bytes], size: int, rules: Rules) -> list[bytes]:
    """Ids (32-bit numbers) of pre-tokens of at most ``size`` bytes (a power of two); their trees are rows of one array."""
    count, columns = len(words), np.arange(size)
    lengths = np.fromiter(map(len, words), np.int64, count)[:, None]
    raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
    part = np.full((count, size + 1), -1, np.int32)  # the last column stands for "no part"
    part[:, :size] = np.where(columns < lengths, rules.byte_ids[raw], -1)
    after = np.tile(np.arange(1, size + 2), (count, 1))
    after[:, :size][columns >= lengths - 1] = size
    before = np.tile(np.arange(-1, size), (count, 1))
    tree = np.full((count, 2 * size), NONE, np.int64)
    tree[:, size:] = rules.leaves(part[:, :size], part[:, 1:], columns)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    row = np.arange(count)
    while True:
        root = tree[row, 1]
        row, root = row[root < NONE], root[root < NONE]
        if not len(row):
            break
        at, new = root & PLACE, rules.made[root >> 32]
        gone = after[row, at]
        right, left = after[row, gone], before[row, at]
        part[row, at], part[row, gone] = new, -1
        after[row, at], before[row, right] = right, at
        has_left = left >= 0
        beside = np.where(has_left, left, at)
        tree[row, gone + size] = NONE
        tree[row, at + size] = rules.leaves(new, part[row, right], at)
        first, place = row[has_left], left[has_left]
        tree[first, place + size] = rules.leaves(part[first, place], new[has_left], place)
        node = np.concatenate([gone, at, beside]) + size
        rows = np.concatenate([row, row, row])
        for _ in range(size.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
    kept = part[:, :size] >= 0
    flat, ends = part[:, :size][kept].tobytes(), [0, *(4 * np.cumsum(kept.sum(1))).tolist()]
    return [flat[a:b] for a, b in itertools.pairwise(ends)]


def merge_words(words: list[bytes], rules: Rules) -> list[bytes]:
    """Ids (32-bit numbers) of each pre-token."""
    out: list[bytes] = [b""] * len(words)
    classes: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        if len(word) > LONG:
            out[k] = merge_one(word, rules).tobytes()
        else:
            classes.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(k)
    for size, members in classes.items():
        step = max(1, LEAVES // size)
        for start in range(0, len(members), step):
            chosen = members[start : start + step]
            for k, ids in zip(chosen, merge_side_by_side([words[k] for k in chosen], size, rules), strict=True):
                out[k] = ids
    return out


class Codec:
    """Encodes and decodes; remembers the ids of frequent pre-tokens."""

    def __init__(self, path: str):
        self.rules = Rules(path)
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def words_to_ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids (32-bit numbers) of lists of pre-tokens."""
        known = self.known
        new = list(set().union(*lists) - known.keys())
        if new:
            known.update(zip(new, merge_words([w.encode("utf-8", "surrogatepass") for w in new], self.rules), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in lists]
        for name in new:
            if len(name) > MEMO_BYTES:
                del known[name]
        if len(known) > MEMO:
            known.clear()
        return out

    def segment_ids(self, text: str) -> bytes:
        """Ids of a long text, some pre-tokens at a time."""
        words = (m.group() for m in self.cut.finditer(text))
        return b"".join(iter(lambda: self.words_to_ids([list(itertools.islice(words, WORDS_AT_ONCE))])[0], b""))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces: list[list[bytes | int]] = []  # ids, or the number of a list of pre-tokens
        lists: list[list[str]] = []
        for text in texts:
            own: list[bytes | int] = []
            parts = [] if not text else self.rules.special_pattern.split(text) if self.rules.special_pattern else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    own.append(np.int32(self.rules.special[part]).tobytes())
                elif len(part) > BATCH_BYTES:
                    own.append(self.segment_ids(part))
                elif part:
                    own.append(len(lists))
                    lists.append(self.cut.findall(part))
            pieces.append(own)
        ids = self.words_to_ids(lists)
        return [np.frombuffer(b"".join(x if isinstance(x, bytes) else ids[x] for x in own), np.int32) for own in pieces]

    def decode(self, ids: np.ndarray) -> str:
        found = [self.rules.pieces[k] if 0 <= k < self.rules.base else None for k in ids.tolist()]
        if None in found:
            raise ValueError(f"no piece has the id {ids[found.index(None)]}")
        return b"".join(found).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One per Python process, so that the memo serves all its tasks."""
    return Codec(path)


def source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids of each document's whole text."""

    def make():
        codec = codec_of(vocabulary_path)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), id_lists(codec.encode(batch.column(1).to_pylist()))], ["doc_id", "ids"])

    return map_rows(source(docs), make, "doc_id long, ids array<int>", BATCH_BYTES)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text of each list of ids."""

    def make():
        codec = codec_of(vocabulary_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_rows(rows, make, "doc_id long, text string", BATCH_BYTES)


def digest(codec: Codec, texts: list[str | None]) -> Iterator[tuple[int, int, str, str, bool]]:
    """n_bytes, n_tokens, ids_sha256, decoded_sha256, round_trip of each text."""
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        plain, decoded = (text or "").encode("utf-8", "surrogatepass"), codec.decode(ids).encode("utf-8", "surrogatepass")
        written = ",".join(map(str, ids.tolist())).encode("ascii")
        yield len(plain), len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == plain


def summary(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_sha256, decoded_sha256, round_trip: every text encoded and decoded where it is read."""

    def make():
        codec = codec_of(vocabulary_path)
        names = ["n_bytes", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*digest(codec, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

        return step

    return map_rows(source(docs), make, "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", BATCH_BYTES)
