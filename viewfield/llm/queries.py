"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aligned, avi, bpe, contain, dualtree, jaccard, langid, licences, lineruns, quality, sst, suffixes, votes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 5-gram sets are similar to 0.8."""
    return jaccard.join(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents; the source stands for the host, the language's section of it for the path."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score(_documents(spark, sf_dir), labels, "source", "lang")
    return rows.select("doc_id", F.round("score", 6).alias("score"), "keep")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that start anywhere else."""
    rows = suffixes.dedup(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    return contain.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of documents."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rows = licences.scan(docs, licences.learn(docs))
    return rows.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("licences", lambda c: c.paragraph))).cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda c: c.family))), ",").alias("families"),
        F.round(F.array_max(F.transform("licences", lambda c: c.probability)), 6).alias("probability"),
    )


def held_out(docs: DataFrame) -> DataFrame:
    """Add ``held_out``: is the row kept from learning?"""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def language_model(docs: DataFrame) -> langid.Model:
    """Learnt from the rows that are not held out."""
    return langid.learn(held_out(docs).where("not held_out"), langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of whole texts."""
    docs = _documents(spark, sf_dir)
    found = langid.predict(held_out(docs.select("doc_id", "text")), language_model(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return lineruns.dedup(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", kept)


def op9_avi_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as motion-JPEG files, read back, with their shots."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = avi.read(avi.store(docs))
    starts = F.array_join(F.transform("clips", lambda c: c.first_frame.cast("string")), ",")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("shots="), F.size("clips").cast("string"), F.lit(" starts="), starts).alias("feature"),
    )


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts written to sorted-string-table shards and read back."""
    rows = sst.write_and_read(spark, _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that rules, weighed by what they agree on, take for good."""
    rows = votes.score(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item by their terms."""
    return dualtree.rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level vocabulary against those of a sentencepiece model, by byte ranges."""
    return aligned.align(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_licences": op6_licences,
    "op7_language": op7_language,
    "op8_line_dedup": op8_line_dedup,
    "op9_avi_columns": op9_avi_columns,
    "op10_token_shards": op10_token_shards,
    "op11_quality_votes": op11_quality_votes,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op5_decontamination": contain.SQL,
    "op8_line_dedup": lineruns.SQL,
    "op11_quality_votes": votes.SQL,
    "op12_ranked_search": dualtree.SQL,
}
