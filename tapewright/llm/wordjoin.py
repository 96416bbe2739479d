"""Word tables joined to whole texts without a row per word.

Texts are dealt to blocks by hash of their id. A block sends each distinct word it has once, packed by word part
(a hash of the word) into one row per (block, part); a part answers with one packed row per block, in the order
asked; the block then reads its texts again with its answers at hand. The exchange of texts by block and that of
requests by part each occur once in the plan and are reused.

Volume: a word crosses the network once per block that has it, whatever its frequency, so hot words cost as much as
others. Blocks and parts grow with the input; one block's texts (BLOCK_BYTES on average) or one part's requests
are what a Python call holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import block_of, trimmed

REQUEST = "part int, block {}, words binary, counts binary"
SEPARATOR = b"\n"
PACKING = "zstd"


def text_blocks(docs: DataFrame, blocks: int, *more) -> DataFrame:
    """block, doc_id, text and further columns, partitioned by block."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(block_of(blocks, "doc_id").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    return source.repartition(blocks, "block")


def by_part(words: Iterable[bytes], parts: int) -> dict[int, list[bytes]]:
    """Words by part, sorted, so that asking and reading agree on the order."""
    found: dict[int, list[bytes]] = {}
    crc = zlib.crc32
    for word in sorted(words):
        found.setdefault(crc(word) % parts, []).append(word)
    return found


def squeezed(raw: bytes) -> bytes:
    """Compressed, with the size unpacked in front."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, PACKING, asbytes=True)


def unsqueezed(pack: bytes) -> bytes:
    return pa.decompress(pack[8:], int.from_bytes(pack[:8], "little"), PACKING, asbytes=True)


def requests(blocked: DataFrame, parts: int, count_words: Callable[[pa.Table], tuple[Iterable[bytes], list[dict[bytes, int]]]], squeeze: bool = False) -> DataFrame:
    """One row per (block, part): the distinct words, joined by line ends (and ``squeezed``), and their counts (int64, one row per table of counts)."""

    def ask(block: pa.Table) -> pa.Table:
        words, tables = count_words(block)
        rows = by_part(words, parts)
        number = block.column("block")[0].as_py()
        joined = map(SEPARATOR.join, rows.values())
        packs = [np.array([np.fromiter(map(t.get, w, repeat(0)), np.int64, len(w)) for t in tables], np.int64).tobytes() for w in rows.values()]
        return pa.table({
            "part": pa.array(list(rows), pa.int32()),
            "block": pa.array([number] * len(rows), block.column("block").type),
            "words": pa.array(map(squeezed, joined) if squeeze else joined, pa.binary()),
            "counts": pa.array(packs, pa.binary()),
        })

    schema = REQUEST.format(blocked.schema["block"].dataType.simpleString())
    return blocked.groupBy("block").applyInArrow(trimmed(ask), schema).repartition(parts, "part")


def unpack(words: bytes) -> list[bytes]:
    return words.split(SEPARATOR) if words else []
