import public_tokenizers

import corpus_pipeline
from viewfield.llm import contain, langid, queries
from viewfield.llm.common import stored

from .helpers import frame
from .test_search import grams, groups, without_runs

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stored(stage(spark, kept, SF), name)
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "language":
            assert set(before) == set(after)  # each has a language
        elif name == "lines":
            rows = sorted(before.items())
            want = {d: t for (d, old), t in zip(rows, without_runs(rows)) if t == old or t.strip()}
            assert after == want
        elif name == "near_copies":
            assert set(after) == {d for d, (_, c) in groups(before.items()).items() if d == c}
        elif name == "benchmark":
            items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {d for d, t in before.items() if not any(i and 100 * len(i & grams(t)) >= 80 * len(i) for i in items)}
        if name != "tokens":
            assert kept.columns == columns
    assert kept.where("not exact").count() == 0 and set(columns) < set(kept.columns)


def clashing(spark, rows=None):
    """The awkward rows with all the columns that the stages' operators make themselves."""
    names = ["lang_pred", "score", "n_lines", "n_removed", "component_id", "n_links", "ids", "decoded", "n_tokens", "ids_sha256", "exact", "n_item", "spare", "shard", "h"]
    return frame(spark, rows).drop("ids").selectExpr("*", *(f"concat('{n} of ', coalesce(doc_id, -1)) AS {n}" for n in names))


def own_model(spark, monkeypatch):
    """A model of English of one source, for tables that have too few labels to learn from."""
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"), langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    monkeypatch.setattr(corpus_pipeline, "language_model", lambda docs: model)


def test_awkward_rows_through_each_stage(spark, monkeypatch):
    """What each stage keeps of nulls, empty and long texts, repeated rows; clashing columns pass as they are."""
    own_model(spark, monkeypatch)
    docs, columns = clashing(spark), clashing(spark).columns
    by_id = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    every = by_id(docs)
    language = corpus_pipeline.language(spark, docs, SF)
    no_language = {3, 4, 5, 13, 18, 19}
    assert language.columns == columns and set(by_id(language)) <= set(every) - no_language and by_id(language).count(0) in (0, 2)
    lines = corpus_pipeline.lines(spark, docs, SF)
    once = sorted({(-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()}, key=lambda x: (x[0], x[1] or ""))
    left = {d for (d, old), t in zip(once, without_runs(once)) if t == old or t.strip()}
    assert lines.columns == columns and by_id(lines) == sorted(d for d in every if d in left) and len(left) < len(once)
    near = corpus_pipeline.near_copies(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {d for d, (_, c) in groups(rows).items() if d == c}
    assert near.columns == columns and by_id(near) == sorted(-1 if d is None else d for d, _ in rows if d is None or d in first)
    assert len(first) < len(every) - 3
    clean = corpus_pipeline.benchmark(spark, docs, SF)
    assert clean.columns == columns and by_id(clean) == every
    tokens = corpus_pipeline.tokens(spark, docs, SF)
    assert by_id(tokens) == every and len(tokens.columns) == len(set(tokens.columns)) and set(tokens.columns) == set(columns)
    assert all(r.exact and r.n_tokens >= 0 for r in tokens.collect())
    for df in (language, lines, near, clean, tokens):
        for r in df.collect():
            tag = -1 if r.doc_id is None else r.doc_id
            assert all(r[n] == f"{n} of {tag}" for n in ("lang_pred", "score", "n_lines", "n_removed", "component_id", "n_links", "ids", "decoded", "spare"))


def test_empty_tables_through_each_stage(spark, monkeypatch):
    own_model(spark, monkeypatch)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing(spark, []), SF).count() == 0


def test_registered():
    import __spark_entry__

    every = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and every["pipeline"] is corpus_pipeline.run
    assert all(every[q] is f for q, f in queries.QUERIES.items()) and __spark_entry__.oracle_sql()["op5_decontamination"] == contain.SQL
