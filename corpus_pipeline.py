"""A corpus pipeline out of the operators of ``viewfield.llm``.

Each stage gets what the one before kept, written as Parquet and read again, and returns rows with the
columns of ``documents``; the last adds the token ids.

In every stage: extra columns pass unchanged, whatever their names; columns of an operator's own are made
beside them.  Repeated rows are judged alike, so all or none of them stay.  An empty table gives an empty
table.  Null, empty and very long texts are treated whole, as each stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewfield.llm import bpe, contain, jaccard, langid, lineruns
from viewfield.llm.common import drop_stored, stored
from viewfield.llm.queries import language_model

#: A text whose best language has a lower share of the probability is rejected, as one without letters is.
LEAST_SCORE = 0.5
#: Columns that the last stage adds.
ADDED = ["n_tokens", "ids_sha256", "exact"]


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names called otherwise, and columns that give them back."""
    other = {c: f"own {c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found with a score of ``LEAST_SCORE`` at least; others go.

    Null and empty texts, and those without a letter, have no language.  Without labelled rows to learn from
    none has.
    """
    rows, columns = _aside(docs, "lang_pred", "score")
    found = langid.predict(rows, language_model(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without later copies of repeated runs of lines; those of which nothing but white space is left go.

    Rows of which no line goes stay as they are, null and empty texts too; ``n_chars`` is brought up to date.
    """
    rows, columns = _aside(docs, "n_lines", "n_removed")
    cut = lineruns.dedup(rows)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts, that of the lowest id; of rows with one id all or none stay.

    Rows without an id or without words are like no other and stay.
    """
    groups = jaccard.join(docs, links=False).where("doc_id <> component_id").select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found; null and empty texts stay."""
    return contain.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``n_tokens``, ``ids_sha256`` and whether the ids decode to the text.

    A null text counts as empty.  Columns of these three names are replaced.
    """
    rows, columns = _aside(docs.drop(*ADDED), "ids", "decoded")
    rows = bpe.round_trip(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    made = (F.length("ids") / 4).cast("long"), F.sha2("ids", 256), exact
    return rows.select(*columns, *(c.alias(name) for c, name in zip(made, ADDED)))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
#: SQL can't express the first stage and the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = stored(stage(spark, docs, sf_dir), name)
        if docs is not before:
            drop_stored(spark, docs)
        docs = done
    return docs
