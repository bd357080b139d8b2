import math
import re
from collections import Counter

from pyspark.sql import functions as F

from viewfield.llm import votes

from .helpers import frame, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    times = Counter(zip(w, w[1:], w[2:]))
    places = {i + d for i, x in enumerate(zip(w, w[1:], w[2:])) if times[x] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(places), "n_lines": len(lines), "n_letters": sum(c.isalpha() for c in text), "n_shouts": text.count("!")}


def test_counts(spark):
    rows = frame(spark).collect()
    odd = ["a b c a b c", "a b c d a b", "x x x x", "x x x", "a b c a b c a b", "\x0ba\x0bb\rc\n\nd", "# | #\n# | #\n \n \n", "日本 語 é É", "a a\nb\na a\nb\n", "\n".join(["One two."] * 5)]
    docs = [(r.doc_id, r.text) for r in rows] + [(100 + i, x) for i, x in enumerate(odd)]
    found = votes.counted(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(found) == len(docs)
    want = sorted((str(i), *sorted(plain_counts(t).items())) for i, t in docs)
    got = sorted((str(r.doc_id), *sorted((k, r[k]) for k in plain_counts(""))) for r in found)
    assert got == want


def plain_rounds(patterns, rounds):
    """Expectation maximisation as it is written in books."""
    shares, bad = list(votes.START.shares), [list(x) for x in votes.START.bad]
    for _ in range(rounds):
        texts = [0.0] * len(shares)
        no, voted = ([[0.0] * len(votes.RULES) for _ in shares] for _ in range(2))
        for pattern, n in patterns.items():
            likely = [s * math.prod(b if v < 0 else 1 - b if v > 0 else 1 for v, b in zip(pattern, row)) for s, row in zip(shares, bad)]
            for k, x in enumerate(likely):
                q = n * x / sum(likely)
                texts[k] += q
                for j, v in enumerate(pattern):
                    no[k][j] += q * (v < 0)
                    voted[k][j] += q * (v != 0)
        total = sum(texts)
        shares = [(t + votes.EARLIER * f) / (total + votes.EARLIER) for t, f in zip(texts, votes.START.shares)]
        bad = [[(no[k][j] + votes.EARLIER * f) / (voted[k][j] + votes.EARLIER) for j, f in enumerate(row)] for k, row in enumerate(votes.START.bad)]
    return shares, bad


def letters(seed, n):
    """Words without digits."""
    return [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(seed, n)]


def corpus():
    """Sixty good texts, and texts bad in each of three ways."""
    sentence = lambda seed, n: " ".join(letters(seed, n)).capitalize() + "."
    good = ["\n".join(sentence(100 * i + j, 30) for j in range(5)) for i in range(60)]
    noise = [" ".join(w + "###" for w in letters(7000 + i, 120)) + "." for i in range(12)]
    loud = [" ".join(w.upper() + "!!" for w in letters(8000 + i, 120)) for i in range(12)]
    again = ["\n".join([sentence(9000 + i, 12)] * 6 + [sentence(9500 + i, 40)]) for i in range(8)]
    return good, noise + loud + again


def test_verdicts(spark):
    good, bad = corpus()
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = votes.score(docs).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(len(good)))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


def test_rounds(spark):
    good, bad = corpus()
    rows = votes.counted(spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string"))
    model = votes.learn(rows, 6)
    patterns = Counter(tuple(r[x] for x in votes.RULES) for r in votes.with_votes(rows).collect())
    shares, table = plain_rounds(patterns, 6)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(model.shares, shares))
    assert all(math.isclose(a, b, rel_tol=1e-9) for x, y in zip(model.bad, table) for a, b in zip(x, y))
    assert model.accuracies()["symbols"][1]["noise"] > 0.75


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = votes.score(docs).collect()
    assert len(rows) == docs.count()
    nothing = [r for r in rows if r.n_words == 0]
    assert nothing and all(r.base_failed and not r.kept for r in nothing)
    assert votes.score(frame(spark, [])).count() == 0
    assert votes.learn(votes.counted(frame(spark, []))) == votes.START
    plan = votes.score(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert votes.score(docs.where(F.col("doc_id").isNull())).first().doc_id is None
