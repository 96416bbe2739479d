"""Repeated-substring removal by prefix-free parsing (operator 4).

Texts are parsed into phrases at triggers of a rolling hash: the trigger of a 100-byte string is the place, among the
48-byte windows inside it, whose rolling hash is smallest (leftmost among equals). It depends on the string alone, so equal
strings have the same trigger at the same distance, and neighbouring strings with the same trigger form one phrase of the
parse. The dictionary holds every distinct phrase once. Where whole phrases repeat, one look-up in the dictionary settles
all their strings (highly repetitive text costs as much as its distinct phrases). Only phrases that share a trigger string
with a different phrase are taken apart into their 100-byte strings, which are looked up in the same way.

Corpus order decides which occurrence is the first. Texts lie in blocks that are ranges of doc_id, so an entry needs no
position: it came from the smallest block that names it, and within a block from the first place. Blocks name each
distinct phrase or string once, so a passage in a third of all texts is named once per block. Removal needs only to
know which strings are equal; the dictionary is ordered by 128-bit hash of its entries where a suffix array orders by
content.

Matches never cross texts. Strings are compared by 128-bit (phrases) and 96-bit (strings) hashes from random tables.

Defined results: a null text counts as empty; equal ids are ordered by text, then arbitrarily (equal rows); null
ids come before all others; extra columns are kept by ``without_repeats``. An empty table gives an empty result. Removal
works on bytes, so a cut may fall inside a character; ``without_repeats`` drops its remaining bytes from the text.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import blocks_for, cut_lineage, private, trimmed
from tapewright.session import checkpoint_dir

LENGTH = 100
TRIGGER = 48
#: Trigger windows inside one string of LENGTH bytes.
PLACES = LENGTH - TRIGGER + 1
BLOCK_BYTES = 8_000_000
_rng = np.random.default_rng(20240607)
BYTE_TABLES = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
FACTORS = _rng.integers(0, 2**64, (2, 12), dtype=np.uint64) | np.uint64(1)
REQUEST = "part int, block int, first binary, second binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(raw: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all TRIGGER-byte and all LENGTH-byte windows of a text of at least LENGTH bytes."""
    ladder, size = {1: BYTE_TABLES[family][raw]}, 1
    while size < 64:
        half = ladder[size]
        ladder[2 * size] = half[:-size] * FACTORS[family, size.bit_length()] + half[size:]
        size *= 2

    def joined(sizes: tuple[int, ...]) -> np.ndarray:
        places, start = len(raw) - sum(sizes) + 1, 0
        total = np.zeros(places, np.uint64)
        for size in sizes:
            total = total * FACTORS[family, 8] + ladder[size][start : start + places] * FACTORS[family, 9]
            start += size
        return mixed(total)

    return joined((32, 16)), joined((64, 32, 4))


def parse(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of one text: first and last string start, trigger hash, two content hashes; and the string hashes."""
    triggers, strings = rolling(raw, 0)
    _, others = rolling(raw, 1)
    least = (triggers & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(triggers), dtype=np.uint64)
    size = 1
    while 2 * size <= PLACES:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - size)], least[PLACES - size :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    end = np.append(begin[1:], len(place)) - 1
    shape = ((place[begin] - begin) * 128 + end - begin).astype(np.uint64)  # where the trigger lies, how many strings
    content = [mixed(h[begin] * FACTORS[f, 10] + h[end] * FACTORS[f, 11] + shape * FACTORS[f, 7]) for f, h in enumerate((strings, others))]
    return {"begin": begin, "end": end, "trigger": triggers[place[begin]], "content": content[0], "content2": content[1], "strings": strings, "strings2": others}


class Block:
    """The texts of one block in corpus order, parsed; phrases numbered over the whole block."""

    def __init__(self, table: pa.Table):
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in table.column(private("text")).to_pylist()]
        ids = table.column(private("id")).to_pylist()
        self.order = sorted(range(len(raws)), key=lambda k: (ids[k] is not None, ids[k] or 0, raws[k]))
        self.raws = raws
        self.texts, parts = [], []
        for k in self.order:
            if len(raws[k]) >= LENGTH:
                self.texts.append(k)
                parts.append(parse(np.frombuffer(raws[k], np.uint8)))
        self.parts = parts
        cat = lambda name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.trigger, self.content, self.content2 = cat("trigger"), cat("content"), cat("content2")
        self.sizes = [len(p["begin"]) for p in parts]
        both = self.content ^ mixed(self.content2)
        _, self.named = np.unique(both, return_index=True)

    def strings_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, hash, second hash) of all strings of the wanted phrases, in corpus order."""
        out, at = [], 0
        for number, part in enumerate(self.parts):
            own = np.flatnonzero(wanted[at : at + self.sizes[number]])
            at += self.sizes[number]
            if len(own):
                n = part["end"][own] - part["begin"][own] + 1
                start = np.repeat(part["begin"][own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                out.append((np.full(len(start), number), start, part["strings"][start], part["strings2"][start]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sent(block: int, key: np.ndarray, first: np.ndarray, second: np.ndarray, parts: int) -> pa.Table:
    """Hashes packed by part of ``key``, in the given order within a part."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else np.zeros(0, np.int64)
    groups = np.split(order, cuts[1:]) if len(part) else []
    return pa.table({
        "part": pa.array([int(part[g[0]]) for g in groups], pa.int32()), "block": pa.array([block] * len(groups), pa.int32()),
        "first": pa.array([first[g].tobytes() for g in groups], pa.binary()), "second": pa.array([second[g].tobytes() for g in groups], pa.binary()),
    })


def received(answers: pa.Table, key: np.ndarray, parts: int) -> np.ndarray:
    """The answer byte of each key, in the order in which ``sent`` had them."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    packs = dict(zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist(), strict=True))
    out = np.zeros(len(key), np.uint8)
    flat = b"".join(packs[p] for p in sorted(packs))
    out[order] = np.frombuffer(flat, np.uint8)
    return out


def earlier_blocks(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a part in block order: (table rows, sizes, first hashes, second hashes)."""
    blocks = np.array(table.column("block").to_pylist())
    rows = np.argsort(blocks, kind="stable").tolist()
    first, second = table.column("first").to_pylist(), table.column("second").to_pylist()
    a = [np.frombuffer(first[k], np.uint64) for k in rows]
    b = [np.frombuffer(second[k], np.uint64 if len(first[k]) == len(second[k]) else np.uint32).astype(np.uint64) for k in rows]
    return rows, np.array([len(x) for x in a]), np.concatenate(a), np.concatenate(b)


def answer_phrases(table: pa.Table) -> pa.Table:
    """0: an earlier block has the phrase; 1: no other phrase has its trigger string; 2: another phrase has it."""
    rows, sizes, trigger, content = earlier_blocks(table)
    order = np.lexsort((np.arange(len(content)), content, trigger))
    t, c = trigger[order], content[order]
    new_trigger = np.append(True, t[1:] != t[:-1])
    new = new_trigger | np.append(True, c[1:] != c[:-1])
    group = np.cumsum(new_trigger) - 1
    several = np.bincount(group, new) > 1
    code = np.where(new, np.where(several[group], 2, 1), 0).astype(np.uint8)
    return packed(table, rows, sizes, order, code)


def answer_strings(table: pa.Table) -> pa.Table:
    """1: an earlier block has the string."""
    rows, sizes, first, second = earlier_blocks(table)
    order = np.lexsort((np.arange(len(first)), second, first))
    a, b = first[order], second[order]
    again = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    return packed(table, rows, sizes, order, again.astype(np.uint8))


def packed(table: pa.Table, rows: list[int], sizes: np.ndarray, order: np.ndarray, code: np.ndarray) -> pa.Table:
    out = np.empty(len(code), np.uint8)
    out[order] = code
    packs = [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pa.table({"of_block": table.column("block").take(rows), "part": table.column("part").take(rows), "answer": pa.array(packs, pa.binary())})


#: Buckets of the table of texts; Spark refuses more than 100,000. Beyond it a bucket holds several blocks.
MOST_BUCKETS = 50_000
ANSWER = "of_block int, part int, answer binary"


def cuts_below(cuts: list[int], value: Column) -> Column:
    """Number of sorted cuts that are <= value, by bisection."""
    if not cuts:
        return F.lit(0)
    strides = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.lit(cuts)
    return F.aggregate(F.lit(strides), F.lit(0), lambda n, step: n + F.when(F.get(table, n + step - 1) <= value, step).otherwise(F.lit(0)))


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """The rows written once as a bucketed table in the shared folder, one bucket per block up to MOST_BUCKETS: later rounds read it without an
    exchange. The session's catalog names the table; its files lie where every executor sees them."""
    key = F.col("doc_id").cast("long")
    cuts = docs.agg(F.percentile_approx(key, [k / blocks for k in range(1, blocks)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts)) if blocks > 1 else []
    marked = docs.withColumns({
        private("id"): key, private("text"): F.coalesce(F.col("text").cast("string"), F.lit("")), private("block"): F.coalesce(cuts_below(cuts, key), F.lit(0)).cast("int"),
    }).drop("text")
    name = f"tw_blocks_{uuid.uuid4().hex}"
    n = len(cuts) + 1
    n = min(n, MOST_BUCKETS)
    path = f"{checkpoint_dir(docs.sparkSession)}/tables/{name}"
    marked.repartition(n, private("block")).write.option("compression", "zstd").option("path", path).bucketBy(n, private("block")).format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name)


def spans(docs: DataFrame, texts: bool = False) -> DataFrame:
    """All columns but text, and the spans (start, size in bytes) to remove from each text, n_bytes, n_removed, kept_sha256.

    With ``texts`` the result has the column ``kept`` too: the remaining text.
    """
    blocks = blocks_for(docs, "text", BLOCK_BYTES)
    table = blocked(docs, blocks)
    number = private("block")

    def name_phrases(rows: pa.Table) -> pa.Table:
        own = Block(rows)
        named = np.sort(own.named)
        return sent(rows.column(number)[0].as_py(), own.trigger[named], own.trigger[named], own.content[named], blocks)

    asked = table.select(number, private("id"), private("text")).groupBy(number).applyInArrow(trimmed(name_phrases), REQUEST)
    phrases = cut_lineage(asked.repartition(blocks, "part").groupBy("part").applyInArrow(trimmed(answer_phrases), ANSWER))

    def settled(own: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(whole phrases that repeat, phrases to take apart), for all phrases of the block."""
        named = np.sort(own.named)
        code = np.zeros(len(own.trigger), np.uint8)  # a later occurrence in this block repeats
        code[named] = received(answers, own.trigger[named], blocks)
        return code == 0, code == 2

    def first_strings(own: Block, apart: np.ndarray):
        number_, start, first, second = own.strings_of(apart)
        both = first ^ mixed(second)
        _, named = np.unique(both, return_index=True)
        return number_, start, first, second, np.sort(named)

    def name_strings(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(rows)
        _, _, first, second, named = first_strings(own, settled(own, answers)[1])
        return sent(rows.column(number)[0].as_py(), first[named], first[named], (second[named] >> np.uint64(32)).astype(np.uint32), blocks)

    narrow = table.select(number, private("id"), private("text"))
    asked_strings = narrow.groupBy(number).cogroup(phrases.groupBy("of_block")).applyInArrow(trimmed(name_strings), REQUEST)
    strings = cut_lineage(asked_strings.repartition(blocks, "part").groupBy("part").applyInArrow(trimmed(answer_strings), ANSWER))
    answers = phrases.withColumn("kind", F.lit(0)).unionByName(strings.withColumn("kind", F.lit(1)))
    others = [f for f in table.schema if not f.name.startswith("__tw_")]

    def remove(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Block(rows)
        kinds = found.column("kind").to_numpy()
        whole, apart = settled(own, found.filter(pa.array(kinds == 0)))
        number_, start, first, second, named = first_strings(own, apart)
        again = np.ones(len(start), bool)
        again[named] = received(found.filter(pa.array(kinds == 1)), first[named], blocks) == 1
        found_in = np.split(start[again], np.searchsorted(number_[again], np.arange(1, len(own.parts)))) if len(own.parts) else []
        n_rows = rows.num_rows
        all_spans: list[list] = [[] for _ in range(n_rows)]
        removed, hashes, kept_texts = [0] * n_rows, [""] * n_rows, [b""] * n_rows
        at = 0
        for k, part in enumerate(own.parts):
            repeats = whole[at : at + own.sizes[k]]
            at += own.sizes[k]
            row, n = own.texts[k], len(own.raws[own.texts[k]])
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, part["begin"][repeats], 1)
            np.add.at(cover, part["end"][repeats] + LENGTH, -1)
            np.add.at(cover, found_in[k], 1)
            np.add.at(cover, found_in[k] + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            all_spans[row] = [{"start": int(s), "size": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            removed[row] = int(gone.sum())
            kept_texts[row] = np.frombuffer(own.raws[row], np.uint8)[~gone].tobytes()
        for k in range(n_rows):
            if not removed[k]:
                kept_texts[k] = own.raws[k]
            hashes[k] = hashlib.sha256(kept_texts[k]).hexdigest()
        out = {f.name: rows.column(f.name) for f in others}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
        out |= {
            private("n_bytes"): pa.array([len(r) for r in own.raws], pa.int64()), private("n_removed"): pa.array(removed, pa.int64()),
            private("spans"): pa.array(all_spans, kind), private("sha256"): pa.array(hashes, pa.string()),
        }
        if texts:
            out[private("kept")] = pa.array([t.decode("utf-8", "ignore") for t in kept_texts], pa.string())
        return pa.table(out)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    fields += [f"{private('n_bytes')} long", f"{private('n_removed')} long", f"{private('spans')} array<struct<start:long,size:long>>", f"{private('sha256')} string"]
    fields += [f"{private('kept')} string"] * texts
    return table.groupBy(number).cogroup(answers.groupBy("of_block")).applyInArrow(trimmed(remove), ", ".join(fields))


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and the spans."""
    found = spans(docs.select("doc_id", "text"))
    own = {name: F.col(private(name)) for name in ("n_bytes", "n_removed", "spans", "sha256")}
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), own["n_bytes"].alias("n_bytes"), own["n_removed"].alias("n_removed"),
        F.size(own["spans"]).cast("long").alias("n_spans"), own["sha256"].alias("kept_sha256"), own["spans"].alias("spans"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated substrings cut out of ``text`` (null texts become empty), same columns and order of columns."""
    found = spans(docs, texts=True)
    return found.select(*[F.col(private("kept")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
