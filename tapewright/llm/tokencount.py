"""Token counts by the whole-token shortcut (operator 8).

Offline, once per vocabulary file: every vocabulary string that the pre-tokenizer leaves in one piece and
that the merge rules build up to a single token is proven to count as 1. A pre-token of a text in that set is
counted directly; only the others go through the merge rules, with a bounded memo per Python process.

Special strings inside texts follow the library's default: each occurrence is one token and cuts the text.
A null text counts as empty (0 tokens). Repeated rows, null ids and extra columns need no treatment: the
result has one row per input row. ``limit`` is an argument; 512 is the production value.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapewright.llm.common import map_rows

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512
#: Merged pre-tokens that one Python process remembers; a full memo costs time only.
MEMO = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Rules:
    """A vocabulary file: its merge rules, special strings and the strings proven to be one token."""

    def __init__(self, path: str):
        spec = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.merge = spec.model.tokenize
        special = [t.content for t in spec.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.whole = self.prove(spec.get_vocab(with_added_tokens=False))

    def merged(self, word: str) -> int:
        """Number of tokens that the merge rules leave of one pre-token."""
        letters = self.letters
        return len(self.merge("".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])))

    def prove(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that are one pre-token by themselves and merge to one token."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        cut = regex.compile(PATTERN)
        proven = set()
        for piece in vocabulary:
            try:
                text = bytes(byte_of[c] for c in piece).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if (m := cut.match(text)) and m.end() == len(text) and self.merged(text) == 1:
                proven.add(text)
        return frozenset(proven)


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens that had to be merged."""

    def __init__(self, path: str, memo: int = MEMO):
        self.rules = Rules(path)
        self.cut = regex.compile(PATTERN).findall
        self.known = dict.fromkeys(self.rules.whole, 1)
        self.room = memo

    def pieces(self, text: str) -> int:
        known, words = self.known, self.cut(text)
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            total = 0
            for word in words:
                n = known.get(word)
                if n is None:
                    n = self.rules.merged(word)
                    if self.room > 0:
                        known[word] = n
                        self.room -= 1
                total += n
            return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.rules.special is None or not self.rules.special.search(text):
            return self.pieces(text)
        parts = self.rules.special.split(text)
        return len(parts) - 1 + sum(self.pieces(p) for p in parts if p)


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One per Python process, so that the memo serves all its tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document's whole text."""

    def make():
        counter = counter_of(vocabulary_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            counts = [counter.count(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(source, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
