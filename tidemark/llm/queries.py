"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import canonical_turns, chats, formatted, read_back
from .decontaminate import contamination, matches
from .embedding_dedup import near_vectors
from .line_dedup import remove_common_lines
from .mixing import mix_sources
from .ngram_join import similarity_components
from .oracles import ORACLES  # noqa: F401
from .periodic_runs import collapse_runs, digests
from .prefix_trie import conversation_trie
from .quality import quality_scores
from .sharding import shard_rows
from .substring_dedup import remove_repeats
from .toxicity import toxicity_scores
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), window=35, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_common_lines(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(_table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, part=20)
    its = F.col("items")
    return out.select("doc_id", "n_words", "n_hit", F.size(its).cast("bigint").alias("n_items"), F.sha2(F.array_join(its, ","), 256).alias("items_sha256"), "contaminated")


def near_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold four fifths or more of the words around a rare word of an item, in any order, or a whole window."""
    out = matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, near=0.8)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "phrase").distinct()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(_table(spark, sf_dir, "documents"), least=24, times=3, keep=["doc_id"], planted=True)
    return out.select("doc_id", *digests(out))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), every=100, parts=6)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("completion"))
    records = chats(_table(spark, sf_dir, "conversations")).unionByName(added, allowMissingColumns=True)
    out = read_back(formatted(canonical_turns(records)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars")
    )


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_ngram_jaccard_join, op4_mixing, op5_substring_dedup, op6_line_dedup, op7_embedding_near_dedup, op8_sharding, op9_decontamination, near_benchmark_passages, op10_toxicity, op11_periodic_runs, op12_prefix_trie, op13_chat_formatting)}

