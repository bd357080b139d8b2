"""Each registered query over awkward documents: the columns of its contract, by brute force or its SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from viewfield.llm import queries

from .helpers import awkward, frame, words
from .test_aligned import brute, result
from .test_encode import library  # noqa: F401
from .test_search import groups


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables whose documents are awkward: (path, rows of id and text)."""
    path = tmp_path_factory.mktemp("awkward")
    long = " ".join(words(60, 90))
    texts = [long, long + " more", long[100:420], "é" * 150 + long[:250], "short lines\n" * 40, "<|endoftext|> is text", long]
    rows = [(r[0], r[1], r[2], r[3], None) for r in awkward()[:20]] + [(-5 if i == 3 else 100 * (i + 1), t, "fr", "s1", 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, long[:300]), (2, None), (3, ""), (4, "one two three"), (5, awkward()[0][1]), (6, "e e e E 日本")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [r[:2] for r in rows]


def of(rows, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf):
    assert of(queries.op1_jaccard_join(spark, sf[0]).collect(), "n_shingles", "component_id") == groups(sf[1])


def test_op2(spark, sf, library):
    want = {}
    for d, t in sf[1]:
        ids = library.encode_ordinary(t or "")
        want[d] = len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())
    assert of(queries.op2_byte_bpe(spark, sf[0]).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op4(spark, sf):
    data = {d: (t or "").encode() for d, t in sf[1]}
    seen = Counter(x[i : i + 200] for x in data.values() for i in range(len(x) - 199))
    want = {}
    for d, x in data.items():
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[:-1] & ~gone[1:]).sum())
        want[d] = len(x), int(gone.sum()), spans, sha(bytes(b for b, g in zip(x, gone) if not g))
    assert any(w[1] for w in want.values())
    assert of(queries.op4_suffix_dedup(spark, sf[0]).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op9(spark, sf):
    rows, want = queries.op9_avi_columns(spark, sf[0]).collect(), {}
    for d, t in sf[1]:
        x = (t or "").encode()
        padded = x + b"\xff" * (max(1, -(-len(x) // 576)) * 576 - len(x))
        want[d] = len(x), len(padded), sha(padded), zlib.crc32(padded[-32:])
    assert of(rows, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    forms, texts = of(rows, "media_bytes", "media_sha256", "feature"), {}
    for d, t in sf[1]:
        assert texts.setdefault(t or "", forms[d]) == forms[d]
    assert len({f[1] for f in texts.values()}) == len(texts)


def test_op10(spark, sf):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, {}
    for d, text in sorted(sf[1]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[d] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert of(queries.op10_token_shards(spark, sf[0]).collect(), "start", "n_tokens", "ids_crc32") == want


def test_op13(spark, sf):
    assert result(queries.op13_token_alignment(spark, sf[0])) == brute(sf[1])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf[0]}/{t}.parquet/*.parquet'")
    asked = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf[0]).select(*asked.columns).collect()
    assert got and sorted(map(tuple, got), key=str) == sorted(asked.fetchall(), key=str)
