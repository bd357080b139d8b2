import public_tokenizers as P

from viewfield.llm import langid, licences, quality

from .helpers import frame

SF = "/root/testdata/sf0.001"


def test_language_of_held_out_texts(spark):
    from viewfield.llm.queries import op7_language

    rows = op7_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bb"]
    p = np.array([[0.1], [0.2], [0.15], [0.05], [0.3], [0.12], [0.08]])
    lattice = langid.Lattice(pieces)
    value = dict(zip(pieces, p[:, 0]))

    def brute(w):
        return 1.0 if not w else sum(value[w[:n]] * brute(w[n:]) for n in range(1, len(w) + 1) if w[:n] in value)

    for word in ("a", "ab", "abab", "bbab"):
        size, ids = lattice.ids([word])
        assert abs(lattice.forward(ids, langid._with_rest(p))[0, size[0], 0] - brute("▁" + word)) < 1e-12


def test_language_edges(spark):
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"), langid.vocabulary(P.path("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in langid.predict(frame(spark).withColumnRenamed("ids", "score"), model).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 13, 18, 19} and len(got) == 21
    assert langid.predict(frame(spark, []), model).count() == 0
    none = langid.learn(frame(spark, []), model.pieces)
    assert {r.lang_pred for r in langid.predict(frame(spark), none).collect()} == {"und"}


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score(docs, labels, "source", "lang").join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.9 * len(rows)


def test_quality_of_held_out_labels(spark):
    """Labels that score() has not seen, half of them by id."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(docs, labels.where("doc_id % 2 = 0"), "source", "lang").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(rows) > 50 and sum(r.keep == (r.quality == 1) for r in rows) >= 0.85 * len(rows)


def test_paths_vary_round_their_hosts(spark):
    """Hosts differ but their paths do not: a path's prior, its host's rate, is strong."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).selectExpr("id % 8 AS host", "id % 80 AS path", "xxhash64(id) % 1000 AS r")
    rows = rows.withColumn("y", (F.abs("r") < F.col("host") * 100 + 100).cast("double"))
    rates = rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k"))
    hosts = rows.groupBy("host").agg(F.avg("y").alias("prior"))
    assert quality._strength(rates.join(hosts, "host")) > 60 > 5 > quality._strength(rates.withColumn("prior", F.lit(0.45)))
    assert quality._strength(rates.where("n < 0").withColumn("prior", F.lit(0.5))) == quality.UNKNOWN_SPREAD


def test_sparse_hosts_shrink(spark):
    rows = [(i, "same text here.", "big" if i < 60 else f"h{i}", "p", None, None, None, None) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, x string, n string, k string, quality string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0 or i >= 60)) for i in range(64)] + [(0, None), (None, 1), (1, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels, "host", "path").collect()}
    assert got[0].host_rate < got[63].host_rate < 0.5  # one good document is no proof


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(frame(spark), labels, "source", "lang").collect()
    assert len(got) == 22 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(frame(spark, []), labels, "source", "lang").count() == 0


def test_host_and_path(spark):
    df = spark.createDataFrame([("http://A.b.com:80/en/825?page=2",), ("https://x.org",), (None,), ("nothing",)], "url string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in df.select(quality.host_of(F.col("url")), quality.path_of(F.col("url"))).collect()] == [("a.b.com", "en"), ("x.org", ""), (None, None), ("", "")]


def test_licences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licences.learn(docs)
    texts = [
        "Some prose.\nReleased under the MIT License.\nMore.", "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.",
        "The license of the driver was released by the city.", "Licensed under CC BY-NC 4.0.", "mit apache gnu version 3 license", None, "", "version 2.0 of this work is under way",
    ]
    got = [[c.family for c in r.licences] for r in licences.scan(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, licences long"), model).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["Apache-2.0", "GPL-3.0"], [], ["CC-BY-NC-4.0"], [], [], [], []]
    assert licences.scan(frame(spark, []), model).count() == 0
    assert licences.learn(frame(spark, [])).find("Released under the MIT License.")[0] == "MIT"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""


def test_wrapped_licences(spark):
    model = licences.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    prose = "The road goes on past the hill and the river to the town.\n" * 40
    marked = lambda text, mark: "\n".join(mark + line for line in text.split("\n"))
    texts = [
        (MIT, ["MIT"]), (BSD, ["BSD-3-Clause"]), (GPL, ["GPL-3.0"]), (APACHE, ["Apache-2.0"]),
        ("/*\n" + marked(GPL, " * ") + "\n */\nint x;", ["GPL-3.0"]), (marked(f"Title\n\n{APACHE}", "# "), ["Apache-2.0"]), (marked(MIT, "// "), ["MIT"]), (prose + BSD + "\n" + prose, ["BSD-3-Clause"]),
        (GPL.replace("version 3", "version 2"), ["GPL-2.0"]), (GPL.replace("GNU General", "GNU Lesser General").replace("program", "library"), ["LGPL-3.0"]), (GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), []),
        (f"{MIT}\n\n{prose}\n{BSD}", ["MIT", "BSD-3-Clause"]), (prose, []), (" ".join(sorted(MIT.split())), []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    rows = licences.scan(docs, model).orderBy("doc_id").collect()
    assert [[c.family for c in r.licences] for r in rows] == [f for _, f in texts]
    assert [c.paragraph for c in rows[5].licences] == [1] and [c.paragraph for c in rows[11].licences] == [0, 2]


def test_short_notices(spark):
    model = licences.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    found = lambda t: [f for f, _ in model.notices(t)]
    assert found("Distributed under the terms of the MIT licence, see LICENSE.txt") == ["MIT"] and found("This project is MIT licensed.") == ["MIT"]
    assert found("Licensed under the GPLv3 license") == ["GPL-3.0"] and found("Released under the Apache 2.0 licence.") == ["Apache-2.0"]
    for text in ("The project is licensed by the town.", "A license under the terms of the contract", "Distributed under the bridge of the city", "This license is released"):
        assert not found(text), text


def test_licences_on_held_out_lines(spark):
    """Recall on forms of the templates that are not learnt from, and precision on lines that speak of licences and on denials."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licences.learn(docs)
    known = licences.templates()
    held = [(f, len(licences.words_of(t)), [" ".join(w) for w in licences._held_variants(licences.words_of(t))]) for f in known for t in known[f]]
    found = lambda t: [x for x, _ in model.notices(t)]
    # other surroundings: all lengths; a word left out: of ten words or more, for a shorter notice then lacks a fifth
    assert sum(f in found(forms[1]) for f, _, forms in held) >= 0.9 * len(held)
    long = [(f, forms[0]) for f, n, forms in held if n >= 10]
    assert len(long) > 8 and sum(f in found(t) for f, t in long) >= 0.9 * len(long)
    denied = [" ".join(w) for w in licences._made(True)]
    assert len(denied) > 100 and sum(bool(found(t)) for t in denied) <= 0.01 * len(denied)
    for text in ("Foo is not released under the MIT License.", "It was never licensed under the Apache 2.0 license.", "Licensed under the Zlib license"):
        assert not found(text), text
    prose = [r.text for r in docs.where("doc_id % 9 = 4").select("text").collect()]
    templates_ = [set(licences.grams_of(licences.words_of(t))) for several in known.values() for t in several]
    lines = [x for t in prose for x in (t or "").split("\n")]
    speaking = [x for x in lines if not any(len(g & licences.grams_of(licences.words_of(x))) >= licences.HELD * len(g) for g in templates_)]
    assert len(speaking) > 300 and not any(model.notices(x) for x in speaking)
    assert all(found(x) for x in lines if x not in speaking)


def test_licences_in_time_with_many_notices(spark):
    """Twice the notices in one paragraph take about twice the time, and each family is found."""
    import time

    model, took = licences.fit(["the road goes on"], []), []
    for n in (500, 4000):
        text = "Released under the MIT License. Licensed under the Apache License, Version 2.0. " * (n // 2)
        start = time.time()
        assert {f for f, _ in model.notices(text)} == {"MIT", "Apache-2.0"}
        took.append(time.time() - start)
    assert took[1] < 30 * took[0]


def test_sparse_rows_multiply():
    import numpy as np

    grams = {"a": 0, "b": 1, "c": 2}
    texts = [{"a", "b"}, {"x"}, set(), {"c", "b", "x", "y"}]
    dense = np.zeros((4, 4))
    dense[0, :2], dense[3, 1:3], dense[:, 3] = 1 / np.sqrt(2), 0.5, 1
    w, d = np.random.default_rng(1).normal(size=(4, 3)), np.random.default_rng(2).normal(size=(4, 3))
    rows = licences.Rows(texts, grams)
    assert np.allclose(rows.times(w), dense @ w) and np.allclose(rows.turned_times(d, 4), dense.T @ d)
