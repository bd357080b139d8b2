"""Benchmark decontamination: size-partitioned MinHash containment search, native DataFrame operations only.

An item is found in a document when the document holds at least ``PERCENT`` of the item's distinct word
n-grams.  At most ``(100 - PERCENT)`` percent of an item's n-grams can then be missing, so among the item's
lowest hashes, one more than that, one at least is in the document.  Items are partitioned by size; a
partition's sketches hold as many lowest hashes as its largest item needs, so the search misses none.  All
partitions are searched at once: a document's hashes go through up to the largest hash of any sketch, which
the smallest items fix.  Documents and items that share a hash are candidates; whole n-gram sets verify them
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS, PERCENT = 5, 80
#: An item table whose sketches have at most so many rows is sent to all tasks; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased, without empty ones; separators are 0x20 and 0x09 to 0x0D."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def hashed(rows: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``hashes``: of all n-grams; of fewer words, of the whole sequence; of none, none.

    The words' own hashes are a column first, so that each word is hashed once.  Callers take the rows apart
    with ``explode_outer``: ``explode`` lets the optimizer test the arrays' size below that column, which
    would build the words anew for each n-gram.
    """
    kept = [c for c in rows.columns if c != text]
    words = rows.select(*kept, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    at = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WORDS)))
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0))), at)
    return words.select(*kept, F.when(F.size("w") > 0, many).otherwise(F.array().cast("array<bigint>")).alias("hashes"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, hashes, q, part, sketch): distinct hashes in order, their number, the size partition, the lowest.

    Rows of one item_id are one item, that holds the n-grams of all.
    """
    texts = hashed(benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct())
    rows = texts.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))).alias("hashes")).where("size(hashes) > 0")
    rows = rows.withColumn("q", F.size("hashes")).withColumn("part", F.floor(F.log2("q")).cast("int"))
    # as many of the lowest hashes as the largest item of the partition needs; a smaller item never needs more
    top = F.expr("shiftleft(2, part) - 1")
    return rows.withColumn("sketch", F.slice("hashes", 1, F.floor(top * (100 - PERCENT) / 100).cast("int") + 1))


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def find(docs: DataFrame, benchmark: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) where a document holds at least 80 of 100 of an item's n-grams.

    Counts are of distinct 5-word n-grams, an item of fewer words being one n-gram, which only a document of
    the same words holds.  Null and empty texts and items match nothing, nor do rows without an id.  Repeated
    rows of a ``doc_id`` count as one document whose n-grams are those of all its rows, and repeated rows of an
    ``item_id`` as one item whose n-grams are those of all.  Extra columns are ignored.  An empty table on
    either side gives an empty table.
    """
    docs = docs.select(F.col(identifier).alias("doc_id"), F.col("text")).where("doc_id is not null and text is not null")
    items = stored(items_of(benchmark), "items")
    sketches = items.select("item_id", F.explode("sketch").alias("h"))
    keys = stored(sketches.select("h").distinct(), "keys")
    bound = items.agg(F.max(F.element_at("sketch", -1))).first()[0]
    low = hashed(docs).select("doc_id", F.explode_outer("hashes").alias("h")).where(F.col("h") <= F.lit(bound))
    hit = low.join(F.broadcast(keys) if _few(keys) else keys, "h", "left_semi").distinct()
    candidates = stored(hit.join(sketches, "h").select("doc_id", "item_id").distinct(), "candidates")

    full = items.select("item_id", "q", F.explode("hashes").alias("h"))
    all_keys = stored(full.select("h").distinct(), "keys")
    wanted = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    held = hashed(wanted).select("doc_id", F.explode_outer("hashes").alias("h")).join(F.broadcast(all_keys) if _few(all_keys) else all_keys, "h", "left_semi").distinct()
    shared = candidates.join(full, "item_id").join(held, ["doc_id", "h"]).groupBy("doc_id", "item_id", "q").agg(F.count("*").alias("n_shared"))
    return shared.where(f"100 * n_shared >= {PERCENT} * q").select("doc_id", "item_id", F.col("q").cast("long").alias("n_item"), "n_shared")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents in which no item is found, all columns unchanged.

    Rows of one id stay or go together; rows without an id are judged each by its own text.
    """
    key = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.sha2("text", 256)))
    found = find(docs.select(key.alias("key"), "text"), benchmark, "key").select(F.col("doc_id").alias("found")).distinct()
    return docs.join(found, key == F.col("found"), "left_anti").select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM d WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM b WHERE len(w) > 0),
q AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM dg JOIN bg USING (g) JOIN q USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING 100 * count(*) >= 80 * n_item
"""
