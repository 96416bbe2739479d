"""Pair-tree encoding, dual-tree search and whitening, against the library, DuckDB and brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import catalog, dualsearch, pairtree, whitening

from samples import edge_texts, words_of


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.vocabulary(catalog.BYTE_BPE))


def test_pair_tree_equals_the_library(spark, edge_docs, no_docs, library):
    path = catalog.vocabulary(catalog.BYTE_BPE)
    texts = edge_texts()
    expected = [library.encode(t or "", add_special_tokens=False).ids for _, t in texts]
    found = pairtree.summary(edge_docs, path).collect()
    assert len(found) == len(texts)
    rows = [(k, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for (k, _), i in zip(texts, expected, strict=True)]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == collections.Counter(rows)
    assert all(r["round_trip"] for r in found)
    encoded = pairtree.encode(edge_docs, path)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in encoded.collect()) == sorted((k or 0, i) for (k, _), i in zip(texts, expected, strict=True))
    back = pairtree.decode(encoded, path).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((k, t or "") for k, t in texts)
    for made in (pairtree.summary(no_docs, path), pairtree.encode(no_docs, path)):
        assert made.count() == 0


def test_trees_of_all_sizes_agree_with_greedy_merging():
    rules = pairtree.Rules(catalog.vocabulary(catalog.BYTE_BPE))

    def greedy(word):
        ids = rules.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        while True:
            ranks = [rules.rank_of.get(a * rules.base + b, math.inf) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == math.inf:
                return ids
            at = ranks.index(min(ranks))
            ids[at : at + 2] = [int(rules.made[ranks[at]])]

    rng = random.Random(7)
    words = [bytes(rng.choice(b"aaabehinorst \xc3\xa9\xe4") for _ in range(n)) for n in [*range(1, 40), 63, 64, 65, 255, 256, 257, 600] for _ in range(3)]
    for word, ids in zip(words, pairtree.merge_words(words, rules), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == greedy(word) == pairtree.merge_one(word, rules).tolist()


def test_codec_limits(monkeypatch, library, tmp_path):
    codec = pairtree.Codec(catalog.vocabulary(catalog.BYTE_BPE))
    text = words_of(9, 3000) + "<|endoftext|>" + words_of(10, 20)
    whole = codec.encode([text])[0].tolist()
    for name, value in (("BATCH_BYTES", 500), ("WORDS_AT_ONCE", 7), ("MEMO", 5), ("MEMO_BYTES", 4), ("LEAVES", 64)):
        monkeypatch.setattr(pairtree, name, value)
    assert codec.encode([text, None, ""])[0].tolist() == whole == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(np.zeros(0, np.int64)) == ""
    assert codec.decode(np.array([library.token_to_id("Ã")])) == "�"
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]))
    with pytest.raises(ValueError):
        pairtree.Rules(catalog.vocabulary("word_bpe_49k.json"))


def duck(docs, items, top=dualsearch.TOP):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", items.select("item_id", "text").toArrow())
    return collections.Counter(con.sql(dualsearch.oracle(top=top)).fetchall())


def test_search_equals_sql(spark, edge_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    texts = [(k, words_of(k % 90, rng.randint(1, 60))) for k in range(400)] + [(1000 + k, "same words here") for k in range(30)]
    docs = edge_docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True).repartition(5)
    asked = [(k, words_of(200 + k, 25)) for k in range(20)] + [(50, "Same SAME words"), (51, None), (52, ""), (53, "never-seen zzzz"), (None, "a null id"), (54, "é中文文本"), (50, "same"), (55, "ba ke")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    expected = duck(docs, items)
    assert collections.Counter(map(tuple, dualsearch.search(docs, items).collect())) == expected
    for name, value in (("BLOCK_ITEMS", 9), ("TREE_CELLS", 1), ("EXACT", 0.0), ("SHARE", 1)):
        monkeypatch.setattr(dualsearch, name, value)
    assert collections.Counter(map(tuple, dualsearch.search(docs, items, 3).collect())) == duck(docs, items, 3)
    empty = items.filter("false")
    assert dualsearch.search(docs, empty).count() == 0 and dualsearch.search(no_docs, items).count() == 0


def test_tree_search_leaves_pairs_out_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 4, (6, 40)) * (rng.random((6, 40)) < 0.3)
    rows = (centres[rng.integers(0, 6, 3000)] * rng.integers(0, 2, (3000, 40)) * 1000).astype(float)
    values = (centres[rng.integers(0, 6, 64)] * rng.integers(0, 2, (64, 40))).astype(np.int64)
    order = dualsearch.tree_order(values.astype(float))
    tree = dualsearch.levels(values[order].astype(float))
    items = dualsearch.Items(order.tolist(), tree, [[np.flatnonzero(x) for x in level] for level in tree], np.zeros(64, np.int64), 1, 1)
    search = dualsearch.Search(items, 5)
    ids = rng.permutation(3000)
    for start in range(0, 3000, 500):
        search.add(ids[start : start + 500], np.zeros(500, bool), rows[start : start + 500])
    for place, k in enumerate(order):
        scores = (rows @ values[k]).astype(np.int64)
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0)[:5]
        assert [(-s, i) for s, i, _ in zip(*(x.tolist() for x in search.best[place]))] == best
    assert search.bounds < 3000 * 64 / 2


def brute_whitening(vectors, components=4):
    from fractions import Fraction

    kept = [(k, [math.floor(256.0 * float(c)) for c in v]) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    wide = max(len(x) for _, x in kept)
    kept = [(k, x + [0] * (wide - len(x))) for k, x in kept]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * c - s, n) for c, s in zip(x, sums)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(wide)] for i in range(wide)])
    values, axes = np.linalg.eigh(v)
    return kept, n, sums, v, values[::-1][:components], axes[:, ::-1][:, :components]


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(2)
    vectors = [(k, (rng.normal(0, 1, 5) * [3, 2, 1, 0.5, 0.1] + 0.3).tolist()) for k in range(150)]
    vectors += [(200, vectors[0][1]), (None, vectors[1][1]), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, []), (206, [1.0, 2.0]), (207, [-0.0] * 5)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("component", F.lit("c")).repartition(3)
    found = whitening.whiten(table).collect()
    kept, n, sums, v, values, axes = brute_whitening(vectors)
    assert collections.Counter(r["vec_id"] for r in found) == collections.Counter({k: 4 * sum(a == k for a, _ in kept) for k, _ in kept})
    by_id = {k: x for k, x in kept}
    assert {r["component"] for r in found} == {1, 2, 3, 4} and {r["n"] for r in found} == {n}
    sign = {}
    for r in found:
        x = by_id[r["vec_id"]]
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        k = r["component"] - 1
        plain = float((np.array(x) - np.array(sums) / n) @ axes[:, k] / math.sqrt(values[k]))
        if abs(plain) > 1e-6:
            sign.setdefault(k, math.copysign(1, plain * r["whitened"]))
        assert abs(r["whitened"] - sign.get(k, 1) * plain) < 1e-9
        assert abs(r["explained"] - values[k] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-9


def test_exact_sums_of_large_entries(spark):
    rng = random.Random(4)
    fit = [[rng.choice([-1, 1]) * rng.randrange(2**52) for _ in range(3)] for _ in range(40)] + [[2**63 - 1, -(2**63), 0]]
    table = spark.createDataFrame([(x,) for x in fit], "x array<long>").repartition(3)
    n, sums = whitening.totals(table, 3)
    assert n == 41 and sums == [sum(c) for c in zip(*fit)]
    square = whitening.squares(table, 3, [s // n for s in sums])
    y = [[c - s // n for c, s in zip(x, sums)] for x in fit]
    assert square == {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in y) for i in range(3) for j in range(i, 3)}
    base = whitening.basis(n, sums, whitening.covariance(n, sums, square), 4)
    assert base.deviation(np.array([[1, 2, 3], [2**62, 0, 0]])) == [None, None] and len(base.values) == 3


def test_whitening_of_nothing_and_of_constants(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25]) for k in range(9)], schema)).collect()
    assert len(same) == 18 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [k / 256, 2 * k / 256]) for k in range(9)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in line)
    assert whitening.whiten(spark.createDataFrame([(3, [])], schema)).count() == 0
