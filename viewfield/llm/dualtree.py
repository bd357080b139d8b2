"""Ranked lexical search of many items over many documents by two trees.

A document is a sparse vector: for each term of some item, how much the term would give at its frequency there.  An
item is the weights of its terms.  Nodes of documents and nodes of items hold the largest value of each coordinate
below them.  The product of a pair of nodes bounds all scores between them, so where it is below the weakest of the
items' k-th scores so far, all pairs of the two nodes go at once; what can't be told so is scored.  All is exact: sums
are of whole numbers below 2**53.

Items come in blocks of a bounded number of terms, each against all documents.  A first pass over a fixed share of the
documents gives each item of a block a k-th score that real documents reach: a floor that all tasks start from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import partitions, stored

#: Fixed by the operator's contract: terms, and best documents of an item.
TERM, BEST = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 50
#: Distinct terms in a block of items, one item at least; places of documents by terms that are worked on at once.
BLOCK_TERMS, PLACES = 20_000, 2 << 20
#: Documents and items of a node, level by level; the last documents' level is scored.
DOCS, ITEMS = (128, 16), (32, 4)
#: One document of so many is in the first pass.
FIRST = 64
_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
VECTOR = "doc_id long, n long, term array<int>, tf array<int>"


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text, with repeats."""
    return text.encode().translate(_TABLE).split()


def vectors(docs: DataFrame, terms: list[bytes], identifier: str, text: str) -> DataFrame:
    """(doc_id, n, term, tf) of documents with a term: how many terms each has, and how often those of ``terms``."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})  # a block's terms

    def run(batches):
        number = numbers.value
        for batch in batches:
            for a, b, texts in in_slices(batch.column(1)):
                out = []
                for doc, value in zip(batch.column(0).slice(a, b - a).to_pylist(), texts):
                    held = terms_of(value or "")
                    if held:
                        asked = sorted((number[t], n) for t, n in Counter(held).items() if t in number)
                        out.append((doc, len(held), [i for i, _ in asked], [n for _, n in asked]))
                columns = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(identifier).cast("long"), text).mapInArrow(run, VECTOR)


@dataclass
class Items:
    """A block of items: weights by item and term, in an order where items with like terms stand together."""

    keys: list[int]
    weights: np.ndarray
    nodes: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        # by the heaviest term, then the next
        order = np.argsort(-self.weights, axis=1, kind="stable")[:, :2] if self.weights.size else np.zeros((len(self.keys), 1), int)
        by = np.lexsort(order.T[::-1])
        self.keys, self.weights = [self.keys[i] for i in by], self.weights[by]
        self.nodes = [np.stack([self.weights[i : i + n].max(0) for i in range(0, len(by), n)]) for n in ITEMS]


class Heaps:
    """Of each item the best documents so far and the k-th score.  A document is two numbers: is its id null, and its id."""

    def __init__(self, floors: np.ndarray, best: int):
        self.floor, self.best = floors.copy(), best
        self.scores, self.docs = [np.zeros(0, np.int64)] * len(floors), [np.zeros((0, 2), np.int64)] * len(floors)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores[item], scores]), np.concatenate([self.docs[item], docs])
        if len(scores) > self.best:
            kth = np.partition(scores, -self.best)[-self.best]
            keep = np.flatnonzero(scores >= kth)
            if len(keep) > self.best:  # ties at the end: those of the lowest ids stay
                order = keep[np.lexsort((docs[keep, 1], docs[keep, 0], -scores[keep]))]
                keep = order[: self.best]
            scores, docs = scores[keep], docs[keep]
            self.floor[item] = max(self.floor[item], kth)
        self.scores[item], self.docs[item] = scores, docs


def scan(values: np.ndarray, docs: np.ndarray, items: Items, heaps: Heaps) -> tuple[int, int]:
    """Score documents (values by document and term) against items where the bounds of nodes leave it open.

    Returns how many pairs of lowest nodes there are and how many of them were scored.
    """
    scored = 0
    # documents with like heavy terms stand together, so that the largest values of a node are tight
    order = np.argsort(values.argmax(1), kind="stable")
    values, docs = values[order], docs[order]
    wide, narrow = DOCS
    for a in range(0, len(docs), wide):
        top = values[a : a + wide]
        some = np.flatnonzero(top.any(0))
        top = top[:, some]
        small = [np.ascontiguousarray(top[i : i + narrow]) for i in range(0, len(top), narrow)]
        largest = np.stack([x.max(0) for x in small])
        upper = items.nodes[0][:, some] @ largest.max(0)
        for group in np.flatnonzero(upper > 0):
            first, last = group * ITEMS[0], min((group + 1) * ITEMS[0], len(items.keys))
            if upper[group] < heaps.floor[first:last].min():
                continue
            low, high = first // ITEMS[1], -(-last // ITEMS[1])
            lower = items.nodes[1][low:high][:, some] @ largest.T
            for node, leaf in zip(*np.nonzero(lower > 0)):
                x, y = (low + node) * ITEMS[1], min((low + node + 1) * ITEMS[1], len(items.keys))
                if lower[node, leaf] < heaps.floor[x:y].min():
                    continue
                scored += 1
                scores = small[leaf] @ items.weights[x:y][:, some].T
                of = docs[a + leaf * narrow : a + leaf * narrow + len(scores)]
                for k in range(x, y):
                    hit = np.flatnonzero((scores[:, k - x] > 0) & (scores[:, k - x] >= heaps.floor[k]))
                    if len(hit):
                        heaps.add(k, scores[hit, k - x].astype(np.int64), of[hit])
    return sum(-(-min(wide, len(docs) - a) // narrow) for a in range(0, len(docs), wide)) * len(items.nodes[1]), scored


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives at its frequency in a document of relative length ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def search(vecs: DataFrame, items: Items, floors: np.ndarray, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """(item, doc_id, score): of each task the best documents of each item, none below its floor."""
    shared = vecs.sparkSession.sparkContext.broadcast((items, floors))  # a block of items
    width = items.weights.shape[1]
    rows = max(1, PLACES // max(1, width))

    def run(batches):
        block, floor = shared.value
        heaps = Heaps(floor, best)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                docs = np.stack([part.column(0).is_null().to_numpy(zero_copy_only=False), part.column(0).fill_null(0).to_numpy()], 1).astype(np.int64)
                m = 50 + (50 * part.column(1).to_numpy() * n_docs) // n_terms
                terms, tf = part.column(2), part.column(3)
                size = np.diff(terms.offsets.to_numpy())
                of = np.repeat(np.arange(len(docs)), size)
                values = np.zeros((len(docs), width))
                values[of, terms.flatten().to_numpy()] = gains(tf.flatten().to_numpy().astype(np.int64), m[of])
                scan(values, docs, block, heaps)
        for item, (scores, docs) in enumerate(zip(heaps.scores, heaps.docs)):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item, np.int32)), pa.array(docs[:, 1], mask=docs[:, 0] == 1), pa.array(scores)], names=["item", "doc_id", "score"])

    return vecs.mapInArrow(run, "item int, doc_id long, score long")


def top(found: DataFrame, best: int, shares: int) -> DataFrame:
    """Add rank, the ``best`` of each item: first of each share of the rows, then of those, so no task ranks all."""
    dealt = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= best)
    return some.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)


def blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Items in blocks of at most ``most`` distinct terms, or one item, with the terms; they come to the driver block by block."""
    held, terms = [], {}
    for key, value in items.select(item, text).distinct().where(F.col(text).isNotNull()).toLocalIterator():
        own = set(terms_of(value))
        if not own:
            continue
        if held and len(terms.keys() | own) > most:
            yield held, list(terms)
            held, terms = [], {}
        terms |= dict.fromkeys(sorted(own))
        held.append((key, own))
    if held:
        yield held, list(terms)


def rank(docs: DataFrame, items: DataFrame, identifier: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` highest-scoring documents with a score above 0 of each item.

    Equal scores rank by ascending identifier, null last.  Each different pair of an item's id and text is an item of
    its own, so repeated items are ranked once; items without terms have no rows.  Documents without terms count
    nowhere.  Repeated documents are ranked as documents of their own.  Texts of any length are searched whole; extra
    columns are left out, so none can clash; no documents or no items give no rows.
    """
    spark, out = docs.sparkSession, []
    for held, terms in blocks(items, item, item_text, block_terms):
        vecs = stored(vectors(docs, terms, identifier, text), "vectors")
        whole = vecs.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not whole.docs:
            break
        df = {r.t: r.n for r in vecs.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a block's terms
        weights = np.zeros((len(held), len(terms)))
        number = {t: i for i, t in enumerate(terms)}
        for row, (_, own) in enumerate(held):
            for t in own:
                if number[t] in df:
                    weights[row, number[t]] = math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * df[number[t]] + 1)))
        block = Items(list(range(len(held))), weights)
        args = (whole.docs, whole.terms, best)
        first = search(vecs.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0), block, np.ones(len(held), np.int64), *args)
        floors = np.ones(len(held), np.int64)
        for r in top(first, best, 1).where(F.col("rank") == best).collect():  # a row an item
            floors[r.item] = r.score
        found = top(search(vecs, block, floors, *args), best, max(1, partitions(spark) // 8))
        keys = spark.createDataFrame([(i, held[k][0]) for i, k in enumerate(block.keys)], f"item int, {item} {items.schema[item].dataType.simpleString()}")
        out.append(stored(found.join(F.broadcast(keys), "item").select(item, "rank", "doc_id", "score"), "ranked"))  # a block of items
    empty = spark.createDataFrame([], f"{item} {items.schema[item].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, out, empty) if not out else reduce(DataFrame.union, out)


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
h AS (SELECT k, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM h),
tf AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM h) q GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM df, s),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
sc AS (SELECT item_id, text, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
    FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN h USING (k), s GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank FROM sc JOIN h USING (k) WHERE score > 0) r WHERE rank <= {BEST}
"""
