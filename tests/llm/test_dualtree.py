import math
import re
from collections import Counter

import numpy as np

from viewfield.llm import dualtree

from .helpers import frame, words

TERM = re.compile(dualtree.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, best=50):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def tables(spark):
    docs = [(r.doc_id, r.text) for r in frame(spark).collect()]
    docs += [(1000 + i, " ".join(words(i % 90, 20 + i % 37))) for i in range(400)]
    docs += [(9000 + i, "the same text again") for i in range(120)] + [(2**63 - 1, "the same text again"), (-(2**63), "the same text"), (None, "the same text again")]
    items = [(i, " ".join(words(i, 12))) for i in range(40)] + [(50, "The SAME text, again"), (50, "the"), (50, "the"), (51, None), (52, "..."), (None, "日本 É one"), (53, "nowhere at all")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = tables(spark)
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS term", "3 AS score").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS doc_id")
    want = brute(docs, items)
    assert result(dualtree.rank(a, b)) == want
    assert max(r for _, r, _, _ in want) == 50 and any(d is None for _, _, d, _ in brute(docs, items, 500))
    assert result(dualtree.rank(a, b, block_terms=30)) == want
    assert result(dualtree.rank(a, b, best=3)) == brute(docs, items, 3)


def test_nothing(spark):
    docs, items = tables(spark)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dualtree.rank(a.limit(0), b).count() == 0
    assert dualtree.rank(a, b.limit(0)).count() == 0
    assert dualtree.rank(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), b).count() == 0


def test_nodes_prune_and_lose_nothing():
    """Documents about one subject each: nodes of other subjects go unscored, and the result is that of the whole product."""
    r = np.random.default_rng(5)
    subjects, terms = 20, 400
    values = np.zeros((2000, terms))
    for d in range(len(values)):
        own = 20 * (d % subjects) + r.integers(0, 20, 8)
        values[d, own] = r.integers(1, 1000, 8)
        values[d, r.integers(0, terms, 2)] = r.integers(1, 30, 2)
    weights = np.zeros((60, terms))
    for i in range(len(weights)):
        weights[i, 20 * (i % subjects) + r.integers(0, 20, 6)] = r.integers(100, 900, 6)
    items = dualtree.Items(list(range(60)), weights)
    heaps = dualtree.Heaps(np.ones(60, np.int64), 10)
    ids = np.stack([np.zeros(2000, np.int64), np.arange(2000)], 1)
    pairs = scored = 0
    for a in range(0, 2000, 500):
        x, y = dualtree.scan(values[a : a + 500], ids[a : a + 500], items, heaps)
        pairs, scored = pairs + x, scored + y
    assert scored < pairs / 2
    for row, item in enumerate(items.keys):
        scores = (values @ weights[item]).astype(np.int64)
        best = np.lexsort((np.arange(2000), -scores))[:10]
        got = heaps.docs[row][np.lexsort((heaps.docs[row][:, 1], -heaps.scores[row]))][:, 1]
        assert got.tolist() == best[scores[best] > 0].tolist()
