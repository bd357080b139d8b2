"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, t long, n long"


def words(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.choice('bcdfglmnr')}{r.randrange(90)}" for _ in range(n)]


def awkward():
    base = words(1, 120)
    near = base[:60] + ["other"] + base[61:]
    line = " ".join(words(2, 45))
    texts = [
        " ".join(base), " ".join(near), " ".join(base), None, "", " \n\t ", "one", "one", "one two three", "É ß 日本 🎉 x",
        "\n".join([line, "a b", line, "a b", line]), "\n".join(["x", line, "a b", "tail"]), " ".join(words(3, 9000)), "!" * 3000, "  lead  and trail  ", "\x1c\x85 odd \xa0 spaces",
        " ".join(words(4, 30)), " ".join(words(4, 30)) + " end", "12345 67890", "\n\n\n",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None, "clash", -1, -1) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, " ".join(base), None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)
