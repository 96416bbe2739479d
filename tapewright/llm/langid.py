"""Languages of a text as a mixture (operator 1).

Training counts hashed byte trigrams and their two-byte contexts per language, over words set between two
spaces, into tables of a fixed size (2**TABLE_BITS slots per language). It sees at most about
``rows_per_language`` rows of each language, chosen by hash. The likelihood of a word under a language is the
product of its conditional trigram probabilities. A text is cut into units of UNIT_WORDS words, each written in
one language. Expectation-maximisation gives the language proportions; the set of languages grows one by one
from the likeliest single language as long as the gain in log-likelihood exceeds the penalty
0.5 * log(units + 1) + FLOOR_GAIN per language.

Defined results: ``und`` with score 0.0 for a null text, a text without a letter, or where nothing was
learned; a null id counts as remainder 0, so it is held out; ties go to the language that sorts first; repeated rows get equal results; null ids are kept; extra
columns are ignored. Training rows have a non-null language and a text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import crc_remainder, map_rows

UNDETERMINED = "und"
TABLE_BITS = 16
SMOOTHING = 0.2
#: Documented bound of the training sample.
ROWS_PER_LANGUAGE = 10_000
UNIT_WORDS = 6
EM_ROUNDS = 12
FLOOR_GAIN = 4.0
#: Distinct words that one Python process remembers between batches; forgetting costs time only.
MEMO = 600_000

LETTER = regex.compile(r"\p{L}")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Numbering(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, trigram slot, context slot) of all trigrams of the words, each between two spaces."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    context = (joined[:-2] << np.uint32(8)) | joined[1:-1]
    packed = ((context.astype(np.uint64) << np.uint64(8)) | joined[2:]) * MULTIPLIER
    inside = joined[1:-1] != 32
    owner = np.cumsum(joined[:-2] == 32) - 1
    slots = (packed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return owner[inside], slots[inside], context[inside].astype(np.int64)


class Model:
    """Log conditional probabilities by language, as trigram minus context values."""

    def __init__(self, languages: list[str], grams: np.ndarray, contexts: np.ndarray):
        self.languages = languages
        self.grams = np.log(grams + SMOOTHING).astype(np.float32)
        self.contexts = np.log(contexts + SMOOTHING * 256).astype(np.float32)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        owner, slot, context = word_grams(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.grams[k, slot] - self.contexts[k, context], len(words))
        return out


class Reader:
    """Likelihoods of the units of texts; remembers words between batches."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbering()
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def units(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(likelihood per unit and language, words per unit, first unit of each text)."""
        if len(self.numbers) > MEMO:
            self.forget()
        old, number = len(self.numbers), self.numbers.__getitem__
        ids = np.concatenate([np.fromiter(map(number, words), np.int64, len(words)) for words in texts])
        if len(self.numbers) > old:
            new = list(self.numbers)[old:]
            self.table = np.concatenate([self.table, self.model.of_words(new)])
        sizes = np.array([len(w) for w in texts])
        units = -(-sizes // UNIT_WORDS)
        first = np.append(0, np.cumsum(units)[:-1])
        begins = np.repeat(np.append(0, np.cumsum(sizes)[:-1]), units) + UNIT_WORDS * (np.arange(units.sum()) - np.repeat(first, units))
        return np.add.reduceat(self.table[ids], begins, axis=0), np.diff(np.append(begins, len(ids))).astype(float), first


def mixture(likely: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once: proportions (by words) and log-likelihood of each, over the allowed languages only."""
    sizes = np.diff(np.append(starts, len(counts)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    top = likely.max(axis=1, keepdims=True)
    chance = np.exp(likely - top)
    total = np.add.reduceat(counts, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(EM_ROUNDS):
        part = chance * share[owner]
        part *= (counts / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    final = np.log((chance * share[owner]).sum(axis=1)) + top[:, 0]
    return share, np.add.reduceat(final, starts)


def languages_of(likely: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions per text over its selected set of languages (others 0)."""
    texts, languages = len(starts), likely.shape[1]
    likely = likely.astype(np.float64)
    single = np.add.reduceat(likely, starts, axis=0)
    best = single.argmax(axis=1)
    rows = np.arange(texts)
    share = np.zeros((texts, languages))
    share[rows, best] = 1.0
    allowed, reached = share.copy(), single[rows, best]
    sizes = np.diff(np.append(starts, len(counts)))
    price = 0.5 * np.log(sizes + 1) + FLOOR_GAIN
    top = likely.max(axis=1)
    chance = np.exp(likely - top[:, None])
    owner = np.repeat(rows, sizes)
    # A language can only help by the units it explains better than the present set; the bound saves most EM.
    open_ = np.ones(texts, bool)
    for _ in range(languages - 1):
        now = np.log((chance * share[owner]).sum(axis=1) + 1e-300) + top
        gain = np.add.reduceat(np.maximum(likely - now[:, None], 0), starts, axis=0)
        gain[allowed > 0] = -1
        add = gain.argmax(axis=1)
        open_ &= gain[rows, add] > price
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        pick = np.flatnonzero(open_[owner])
        trial = allowed[todo]
        trial[np.arange(len(todo)), add[todo]] = 1.0
        new_share, new_reached = mixture(likely[pick], counts[pick], np.append(0, np.cumsum(sizes[todo])[:-1]), trial)
        better = new_reached - reached[todo] > price[todo]
        took = todo[better]
        share[took], allowed[took], reached[took] = new_share[better], trial[better], new_reached[better]
        open_[:] = False
        open_[took] = True
    return share


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Model from rows of ``docs`` with a language and a text (columns text, lang), at most about
    ``rows_per_language`` of each language: all rows of a language below that, a hash sample above.

    The driver gets the count per language and one pair of tables of 2**TABLE_BITS counts each.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, 1 << TABLE_BITS)), np.zeros((0, 1 << TABLE_BITS)))
    draw = F.pmod(F.xxhash64("doc_id", "lang", F.lit(11)), F.lit(1 << 20))
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, rows_per_language / n) * (1 << 20)))])
    rows = rows.filter(draw < rate[F.col("lang")]).select("lang", "text")
    slots = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).extend(fold(text))
            for lang, words in texts.items():
                distinct = Numbering()
                ids = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
                if len(ids):
                    owner, slot, context = word_grams(list(distinct))
                    weight = np.bincount(ids).astype(float)[owner]
                    table = tables.setdefault(lang, np.zeros((2, slots)))
                    table[0] += np.bincount(slot, weight, slots)
                    table[1] += np.bincount(context, weight, slots)
        for lang, table in tables.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [table.tobytes()]})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(raw) for raw in group["counts"])
        return pd.DataFrame({"lang": [key[0]], "counts": [total.tobytes()]})

    schema = "lang string, counts binary"
    # two rounds, so that a group stays small however many tasks there are
    partial = rows.mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    found = partial.groupBy("lang", "salt").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema).collect()
    tables = {r["lang"]: np.frombuffer(r["counts"]).reshape(2, slots) for r in found}
    languages = sorted(tables)
    stacked = np.array([tables[x] for x in languages]).reshape(-1, 2, slots)
    return Model(languages, stacked[:, 0], stacked[:, 1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages: the selected languages with their proportions, largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2**TABLE_BITS floats per language
    languages = model.languages

    def make():
        reader = Reader(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            labels, scores, sets = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            rows = [k for k, text in enumerate(texts) if languages and text and LETTER.search(text)]
            if rows:
                shares = languages_of(*reader.units([fold(texts[k]) for k in rows]))
                order = np.argsort(-shares, axis=1, kind="stable")
                for r, k in enumerate(rows):
                    labels[k] = languages[order[r, 0]]
                    scores[k] = float(min(1.0, shares[r, order[r, 0]]))
                    sets[k] = [{"lang": languages[j], "share": float(shares[r, j])} for j in order[r] if shares[r, j] > 0]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(source, make, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows outside fold 0 of ``folds`` and predict every row."""
    held = crc_remainder(F.col("doc_id"), folds) == 0
    model = train(docs.filter(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
