"""The registered queries of the subpackage, one per operator, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import chroma, dualsearch, langid, lmscore, mixing, neardup, pairtree, phrases, pieces, quality, tokencount, warc, whitening
from tapewright.llm.common import cut_lineage, documents, table

#: Vocabulary files are found through the public package and never copied; each path is a parameter.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir))


def op4_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.removal_report(documents(spark, sf_dir)).drop("spans")


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(documents(spark, sf_dir), vocabulary(PIECES))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(documents(spark, sf_dir)).drop("node").withColumn("label", F.hex("label"))


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a copy with known damage: every differing node, keys with their byte offsets."""
    pages = table(spark, sf_dir, "pages")
    differing = cut_lineage(warc.audit(pages, warc.aged_copy(pages)))
    keys = warc.locate(pages, differing.filter("level = 0"))
    return differing.filter("level > 0").unionByName(keys, allowMissingColumns=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary(BYTE_BPE))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(documents(spark, sf_dir))


def op10_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (each sound with its class), queries (each with its query class) and matches between classes.

    The tables hold no audio: the sounds are notes whose pitches are the values of the stored vectors. Queries
    are second recordings of the sounds with an id divisible by 100.
    """
    sounds = chroma.rendered(table(spark, sf_dir, "embeddings"))
    members, asked, found = chroma.search(sounds, chroma.recorded(sounds.filter(F.col("id") % 100 == 0)))
    parts = [members.withColumn("kind", F.lit("member")), asked.withColumn("kind", F.lit("query")), found.withColumn("kind", F.lit("match"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return rows.select("kind", "id", "class_id", "class_size", "query_id", "offset", "hits", "overlap", "bit_error")


def op11_pair_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairtree.summary(documents(spark, sf_dir), vocabulary(BYTE_BPE))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualsearch.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_quality_forest": op2_quality_forest,
    "op3_poisson_mixture": op3_poisson_mixture,
    "op4_phrase_parsing": op4_phrase_parsing,
    "op5_piece_lattice": op5_piece_lattice,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_merkle_audit": op7_merkle_audit,
    "op8_token_counts": op8_token_counts,
    "op9_context_mixing": op9_context_mixing,
    "op10_chroma_prints": op10_chroma_prints,
    "op11_pair_tree": op11_pair_tree,
    "op12_dual_tree_search": op12_dual_tree_search,
    "op13_polarised_whitening": op13_polarised_whitening,
}
SQL: dict[str, str] = {
    "op3_poisson_mixture": mixing.oracle(),
    "op7_merkle_audit": warc.oracle(),
    "op12_dual_tree_search": dualsearch.oracle(),
}
