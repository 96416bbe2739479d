"""Operators that look at one text at a time, against brute force and the tokenizer libraries."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tapewright.llm import catalog, langid, lmscore, pieces, quality, tokencount

from samples import edge_texts, words_of


def plain_statistics(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


def test_statistics_against_brute_force():
    texts = [t for _, t in edge_texts()] + ["a b c a b c", "a b c d a b c", "x\nx\n y\nx \n\n", "one two three one two"]
    for text in texts:
        assert quality.text_statistics(text)[:5] == plain_statistics(text)


def test_quality_verdicts(spark, edge_docs, no_docs):
    good = [(100 + k, words_of(k, 150), "en") for k in range(120)]
    bad = [(300 + k, " ".join(w.upper() + "###" for w in words_of(k, 100).split()), "en") for k in range(12)]
    docs = edge_docs.select("doc_id", "text", "lang", "kept").unionByName(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(k, 1, None) for k in range(100, 180)] + [(k, 0, 1) for k in range(300, 306)] + [(None, 1, 0), (101, None, 0), (101, 0, 0)], "doc_id long, quality int, kept int")
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == docs.count()
    verdict = {r["doc_id"]: r["kept"] for r in found}
    assert sum(verdict[k] for k in range(100, 220)) >= 118 and sum(verdict[k] for k in range(300, 312)) <= 7
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert quality.score_quality(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels).count() == 0
    unlabelled = quality.score_quality(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in unlabelled)


def test_forest_isolates_outliers():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.normal(0.5, 0.01, (2000, 4))
    forest = quality.grow_forest(np.full(2000, 500.0), rows)
    scores = forest.anomaly(np.full(3, 500.0), np.array([[0.5] * 4, [0.9] * 4, [0.0] * 4]))
    assert scores[0] < 0.5 < min(scores[1:])
    assert len(quality.grow_forest(np.zeros(0), np.zeros((0, 4))).anomaly(np.zeros(0), np.zeros((0, 4)))) == 0


def test_token_counts_equal_the_library(edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = catalog.vocabulary(catalog.BYTE_BPE)
    library = Tokenizer.from_file(path)
    want = sorted((str(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in edge_texts())
    found = tokencount.count_tokens(edge_docs, path, limit=40).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 40) for r in found)
    assert tokencount.count_tokens(no_docs, path).count() == 0


def test_whole_tokens_are_proven():
    from tokenizers import Tokenizer

    path = catalog.vocabulary(catalog.BYTE_BPE)
    library, counter = Tokenizer.from_file(path), tokencount.Counter(path, memo=3)
    sample = sorted(counter.rules.whole)[::97]
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sample)
    texts = [words_of(k, 50) for k in range(20)]  # more words than the memo holds
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("blocks", [1, 3])
def test_pieces_equal_the_library(spark, edge_docs, no_docs, monkeypatch, blocks):
    import sentencepiece

    monkeypatch.setattr(pieces, "blocks_for", lambda docs, text, size: blocks)
    path = catalog.vocabulary(catalog.PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((str(k), library.encode(t or "")) for k, t in edge_texts())
    found = pieces.decode(pieces.encode(edge_docs, path), path).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in found) == want
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in found)
    assert pieces.summary(no_docs, path).count() == 0


def test_long_chunks_merge_like_the_lattice(spark):
    path = catalog.vocabulary(catalog.PIECES)
    chunks = sorted({c for k in range(6) for c in pieces.chunks(words_of(k, 60)) if c != "\n"} | {"▁▁▁▁word", "▁" * 37, "▁aaaaaaaaaaaaaaaaaaaaaa", "▁ﬁⅣ中🙂x"})
    solved = pieces.lattice(spark.createDataFrame([(0, c) for c in chunks], "part int, chunk string"), path).collect()
    own = pieces.pieces(path)
    assert {r["chunk"]: list(r["ids"]) for r in solved} == {c: own.merged(c) for c in chunks}


def test_languages_held_out_and_edges(spark, edge_docs, no_docs):
    parts = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["zu", "wi", "xo", "pe"]}
    rows = []
    for k in range(400):
        lang = "aa" if k % 2 else "bb"
        rng = __import__("random").Random(k)
        rows.append((1000 + k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    rows.append((5000, rows[0][1] + " " + rows[1][1], "aa"))
    docs = spark.createDataFrame(rows + [(1, None, "aa"), (2, "123 ... !", "bb"), (3, "", None), (None, "bake lomi", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang in rows[:-1] if found[k]["held_out"])
    assert {x["lang"] for x in found[5000]["languages"]} == {"aa", "bb"} and 0.4 < found[5000]["score"] < 0.6
    assert [(found[k]["lang_pred"], found[k]["score"]) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(r["held_out"] == (k is None or zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    assert langid.identify(no_docs).count() == 0
    assert langid.identify(edge_docs).count() == edge_docs.count()
    unlearned = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["lang_pred"] == "und" for r in unlearned)


@pytest.mark.parametrize("blocks", [1, 3])
def test_language_model_base_and_probability(spark, edge_docs, no_docs, monkeypatch, blocks):
    monkeypatch.setattr(lmscore, "blocks_for", lambda docs, text: blocks)
    more = spark.createDataFrame([(100 + k, words_of(k, 60), "en") for k in range(60)], "doc_id long, text string, lang string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    texts = edge_texts() + [(100 + k, words_of(k, 60)) for k in range(60)]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = collections.Counter()
    for k, t in texts:
        if not held(k):
            counts.update([*lmscore.tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for k, t in texts for x in [[*lmscore.tokens(t), None]])
    found = lmscore.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    assert lmscore.score(no_docs).count() == 0
    seen = [r for r in found if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_spelling_is_a_distribution():
    import numpy as np

    mixer = lmscore.Mixer(np.zeros((len(lmscore.ORDERS), 2, 1 << lmscore.TABLE_BITS), np.float32))
    words = [b"ab", b"ba", b"abba", b""]
    for value, slots in lmscore.Spelling(words).bits():
        for k, slot in enumerate(slots):
            np.add.at(mixer.counts[k], (value, slot), 1)
    mixer.learn(words)
    mixer.freeze()
    spelled = 10 ** mixer.log10(words)
    assert (spelled > 0).all() and spelled.sum() < 1


def test_long_tokens_are_charged_for_every_byte():
    import numpy as np

    mixer = lmscore.Mixer(np.zeros((len(lmscore.ORDERS), 2, 1 << lmscore.TABLE_BITS), np.float32))
    for value, slots in lmscore.Spelling([b"ab", b"ba"]).bits():
        for k, slot in enumerate(slots):
            np.add.at(mixer.counts[k], (value, slot), 1)
    mixer.freeze()
    word = bytes(np.random.default_rng(7).integers(33, 127, 3000, np.uint8))
    plain = 0.0
    for value, slots in lmscore.Spelling([word]).bits():
        odds = np.stack([mixer.odds[k, s] for k, s in enumerate(slots)], axis=1)
        chance = mixer.chance(odds, sum(mixer.seen[k, s].astype(int) for k, s in enumerate(slots)))[1]
        plain += sum(math.log10(p if v else 1 - p) for v, p in zip(value, chance, strict=True))
    assert plain < -2000
    shares = lmscore.Shares(mixer, np.array([60, 40]), np.array([20, 10]), 25)
    logs = shares.logs([word, b"ab"], np.array([[0, 3], [0, 0]]))
    tail = math.log10(lmscore.DISCOUNT * 25 / 100) + plain
    want = [tail, math.log10(lmscore.DISCOUNT * 20 / 60) + tail, math.log10(lmscore.DISCOUNT * 10 / 40) + tail]
    assert np.allclose(logs[:, 0], want, rtol=1e-6)
    one = lmscore.text_score(logs[:, :1], np.array([0]), np.array([0.2, 0.4, 0.4]))
    assert abs(one - math.log10(sum(p * 10 ** (x - tail) for p, x in zip((0.2, 0.4, 0.4), want, strict=True))) - tail) < 1e-3
    bare = lmscore.Shares(mixer, np.zeros(2), np.zeros(2), 0).logs([word], np.zeros((2, 1), int))
    assert np.allclose(bare, plain, rtol=1e-6)


def test_earlier_counts():
    import numpy as np

    assert lmscore.earlier(np.array([3, 1, 3, 3, 2, 1])).tolist() == [0, 0, 1, 2, 0, 1]


def test_digest_of_ids(edge_docs):
    path = catalog.vocabulary(catalog.PIECES)
    row = pieces.summary(edge_docs.filter("doc_id = 4"), path, with_ids=True).first()
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, row["ids"])).encode()).hexdigest()


def test_the_lattice_is_solved_without_a_row_per_substring(spark, edge_docs):
    """Each distinct chunk once per part, its edges in arrays; asked and answered packs are compressed and give their bytes back."""
    path = catalog.vocabulary(catalog.PIECES)
    assert "Generate" not in pieces.summary(edge_docs, path)._jdf.queryExecution().toString()
    raw = "\n".join(f"▁word{k}" for k in range(500)).encode()
    assert pieces.unsqueezed(pieces.squeezed(raw)) == raw and len(pieces.squeezed(raw)) < len(raw) / 2
    assert pieces.unsqueezed(pieces.squeezed(b"")) == b""


def test_lattice_in_arrays_equals_merging_by_heap(monkeypatch):
    import random

    monkeypatch.setattr(pieces, "TOGETHER", 300)
    own, rng = pieces.pieces(catalog.vocabulary(catalog.PIECES)), random.Random(7)
    some = [p for p in own.id_of if 1 < len(p) < 9]
    chunks = ["".join(rng.choice(some) for _ in range(rng.randint(1, 5))) for _ in range(1000)] + ["▁" * 48, "a" * 48, "🙂é中", "x"]
    flat, sizes = own.solve(chunks)
    assert flat.tolist() == [k for c in chunks for k in own.merged(c)]
    assert sizes.tolist() == [len(own.merged(c)) for c in chunks]
    assert [len(x) for x in own.solve([])] == [0, 0]
