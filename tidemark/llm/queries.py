"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, collocations, crf, ctw, kdtree, kmeans_tree, kneser_ney, merkle, mixing, pca_tiles, pieces, simhash, sql, tag_paths
from tidemark.llm.common import read_table

PIECE_MODEL = "piece_bpe_32k.model"


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram baseline and context-tree score of every document."""
    return ctw.score(read_table(spark, sf_dir, "documents"), folds=7, fold=2)


def op2_toxic_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the number of offending tokens."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = crf.score(docs.select("doc_id", "text"), labels, folds=5, fold=0)
    return out.select(
        "row.doc_id", ctw.held_out("row.doc_id", 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests, and whether the spans cover the source."""
    out = pieces.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    covered = (F.element_at("ends", -1) == F.col("source_bytes")) & (F.size("ends") == F.col("n_tokens"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), covered.alias("spans_cover"),
    )


def op4_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes, with its slot in the shard."""
    out = kdtree.shard(read_table(spark, sf_dir, "documents"), leaves=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    return kmeans_tree.search(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return tag_paths.extract(read_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint over 3-word shingles and the component of links of at most 3 bits."""
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, index=simhash.BITS)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, fitted rate and drawn copies of every document."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return mixing.mix(docs.select("doc_id", "text", "lang"), labels).drop("row_key")


def op9_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more among embeddings of a label, and their components."""
    return pca_tiles.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, the threshold of its language, and whether it is kept."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return kneser_ney.classify(docs, labels).drop("row_key")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether its proof still holds for the tampered rows."""
    out = merkle.documents(read_table(spark, sf_dir, "documents"), every=7)
    out = out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        merkle.fold(F.col("tampered"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows of every conversation say when read back, one of control strings included."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.windows(rows.union(planted)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return collocations.mine(read_table(spark, sf_dir, "documents"), least=30, top=2_000, covered=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_toxic_chain": op2_toxic_chain,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_kd_tree": op4_kd_tree,
    "op5_kmeans_tree": op5_kmeans_tree,
    "op6_tag_paths": op6_tag_paths,
    "op7_simhash": op7_simhash,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_pca_tiles": op9_pca_tiles,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_merkle": op11_merkle,
    "op12_chat": op12_chat,
    "op13_collocations": op13_collocations,
}

#: DuckDB statements; the other queries are tested against brute force.
ORACLE: dict[str, str] = {"op9_pca_tiles": sql.TILES, "op11_merkle": sql.MERKLE, "op12_chat": sql.CHAT, "op13_collocations": sql.COLLOCATIONS}
