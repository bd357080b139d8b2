import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from viewfield.llm import aligned, queries
from viewfield.llm.sst import byte_letters

from .helpers import frame

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a  b", "tail ", "  ", " ", "\n", "a\nb \n c", "▁x", "<s> <0x41> <|endoftext|> </s>", "ﬁ é 日本語 🎉🎉", "!" * 300 + " " + "=" * 77, "a\0b", "x　y \xa0z", "naïve " * 40, "ab " * 500, "﻿q", "don't we'll  I'm"]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def plain_groups(text, a, b):
    """Groups of one text by walking both token lists, with the libraries on the whole text."""
    if not text:
        return []
    letters = {chr(x): byte for byte, x in byte_letters().items()}
    data = (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(ba) != data or b"".join(bb) != data:
        return []
    ends = lambda x: set(np.cumsum([len(t) for t in x]).tolist())
    cuts = sorted(ends(ba) & ends(bb))
    out, at = [[[], []] for _ in cuts], 0
    for side, (ids, toks) in enumerate(((ia, ba), (ib, bb))):
        at = group = 0
        for i, t in zip(ids, toks):
            at += len(t)
            out[group][side].append(i)
            group += at in cuts
    return out


def brute(docs):
    a, b = libraries()
    groups = [plain_groups(t, a, b) for _, t in docs]
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    count = Counter(p for row in links for p in row)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (doc, _), g, row in zip(docs, groups, links):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        best = sum(n for p, n in row.items() if count[p] == most[p[0]])
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(row.values()), best, sum(n * count[p] for p, n in row.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in frame(spark).collect()] + [(100 + i, x) for i, x in enumerate(ODD)]
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS chunk", "1 AS n", "2 AS pair", "3 AS links")
    assert result(aligned.align(df, A, P.PATTERN, B)) == want
    assert sum(x[4] for x in want) > 0 and any(x[1] == 0 for x in want)


def test_chunks_do_not_change_counts(spark, monkeypatch):
    docs = [(i, " ".join(["some", "words", "come", "again"][: 1 + i % 4] + [f"own{i}"])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert result(aligned.align(df, A, P.PATTERN, B)) == want
    monkeypatch.setattr(aligned, "CHUNK", 40)
    assert aligned.chunks(df, A, P.PATTERN, B, "doc_id", "text").count() > 3
    assert result(aligned.align(df, A, P.PATTERN, B)) == want


def test_nothing(spark):
    assert aligned.align(frame(spark, []), A, P.PATTERN, B).count() == 0
    rows = aligned.align(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), A, P.PATTERN, B).collect()
    assert {(r.doc_id, r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in rows} == {(None, 0, 0, 0, ""), (1, 0, 0, 0, "")}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op13_token_alignment(spark, sf)) == brute(docs)


@pytest.fixture(scope="module")
def aligner():
    return aligned.Aligner(A, P.PATTERN, B)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'stTé1!\x1c\x85\xa0日🎉▁<>")), max_size=40))
def test_any_text(aligner, text):
    from viewfield.llm.bpe import parts_of

    a, b = libraries() if not hasattr(test_any_text, "both") else test_any_text.both
    test_any_text.both = (a, b)
    p = aligner(parts_of(" " + text)) if text else None
    want = plain_groups(text, a, b)
    if want:
        assert p.fits.all()
        assert ";".join(p.groups) == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
    else:
        assert not text or not p.fits.all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=20))
def test_coalesced(spans):
    starts, ends = np.array([a for a, _ in spans], np.int64), np.array([a + n for a, n in spans], np.int64)
    group = aligned.coalesced(starts, ends)
    for i in range(len(spans)):
        for j in range(len(spans)):
            if starts[i] < ends[j] and starts[j] < ends[i]:
                assert group[i] == group[j]
            if group[i] < group[j]:
                assert starts[j] >= ends[i]
