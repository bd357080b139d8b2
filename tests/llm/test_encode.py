import base64
import hashlib
import zlib
from array import array

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from viewfield.llm import avi, bpe, sst
from viewfield.llm.common import shared_dir

from .helpers import frame

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(spark, library):
    rows = bpe.decode(bpe.encode(frame(spark), RANKS, P.PATTERN), RANKS).collect()
    assert len(rows) == 22
    for r in rows:
        assert list(memoryview(bytes(r.ids)).cast("I")) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.t == -1 or r.doc_id is None
    assert bpe.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'stTé1!\x1c\x85\xa0日🎉")), max_size=60))
def test_any_text(text):
    import tiktoken

    global _LIBRARY
    if "_LIBRARY" not in globals():
        with open(RANKS, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert list(memoryview(bpe._words(RANKS, P.PATTERN).encode([text])[0]).cast("I")) == _LIBRARY.encode_ordinary(text)
    assert "".join(bpe.parts_of(text)) == text


def test_letters_are_matches_of_the_pattern():
    """What Python takes for a letter the pattern does too, so words of letters need no cutting."""
    import sys

    import regex

    letter = regex.compile(r"\p{L}")
    assert all(letter.match(c) for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha())


def test_caches_are_bounded_by_bytes(monkeypatch):
    words = bpe._words(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    texts = ["日本語" * 400 + str(i) for i in range(50)] + [f" w{i} x{i * i}" for i in range(3000)]
    for t in texts:
        assert bytes(words.encode([t])[0]) and not any(len(k) > bpe.LONG for k in words)
    assert words.held <= 20_000 + 1000


def test_round_trip_is_both(spark):
    both = bpe.round_trip(frame(spark), RANKS, P.PATTERN)
    one = bpe.decode(bpe.encode(frame(spark), RANKS, P.PATTERN), RANKS)
    assert both.columns == one.columns and sorted(map(str, both.collect())) == sorted(map(str, one.collect()))


def test_shards(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    manifest = sst.write_shards(frame(spark), JSON, P.PATTERN, shared_dir(spark, "shards"), end_id=2)
    rows = sorted(sst.read_shards(manifest).collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id, r.text) for r in frame(spark).collect()), key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    start = 0
    for r, (key, text) in zip(rows, texts, strict=True):
        ids = array("I", [*t.encode(text or "", add_special_tokens=False).ids, 2])
        assert (r.doc_id, r.start, zlib.crc32(bytes(r.ids))) == (key, start, zlib.crc32(ids.tobytes()))
        start += len(ids)
    wanted = spark.createDataFrame([(0,), (12,), (77,), (None,)], "doc_id long")
    found = sst.lookup(manifest, wanted)
    assert sorted(((-1 if r.doc_id is None else r.doc_id) for r in found.collect())) == [-1, 0, 0, 12]
    assert sst.read_shards(sst.write_shards(frame(spark, []), JSON, P.PATTERN, shared_dir(spark, "shards"), end_id=2)).count() == 0


def test_shards_match_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = ["a<|endoftext|>b", "plain <|endoftext|", "x <|endoftext|>\n<|endoftext|> y", "<|endoftext|>", "after"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(sst.read_shards(sst.write_shards(docs, JSON, P.PATTERN, shared_dir(spark, "shards"), end_id=2)).collect(), key=lambda r: r.start)
    start = 0
    for r, (key, text) in zip(rows, enumerate(texts), strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, list(memoryview(bytes(r.ids)).cast("I"))) == (key, start, ids)
        start += len(ids)
    assert 50256 in memoryview(bytes(rows[0].ids)).cast("I")


def test_shard_of_many_blocks(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sst.ShardWriter(f, 2)
        for i in range(-3000, 3000, 2):
            w.add(sst.key_of(i), array("H", range(i % 90)).tobytes())
        with pytest.raises(ValueError):
            w.add(sst.key_of(-9), b"")
        w.close()
    with open(path, "rb") as f:
        r = sst.ShardReader(f)
        assert len(r.index) > 2 and r.entries == 3000
        assert [k for k, _ in r] == list(range(-3000, 3000, 2))
        assert r.get(-2998) == [array("I", range(-2998 % 90)).tobytes()] and r.get(1) == [] and r.get(None) == []


def test_avi(spark):
    rows = avi.read(avi.store(frame(spark).withColumnRenamed("n", "clips"))).collect()
    texts = {r.doc_id: r.text for r in frame(spark).collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = bytes(r.payload)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        assert r.clips[0].first_frame == 0 and sum(c.frames for c in r.clips) == len(payload) // 576
        assert bytes(r.media)[:4] == b"RIFF" and bytes(r.media)[8:12] == b"AVI "
    same = [hashlib.sha256(bytes(r.media)).hexdigest() for r in rows if r.doc_id in (0, 2)]
    assert len(set(same)) == 1
    assert avi.clip_rows(avi.read(avi.store(frame(spark)))).count() >= len(rows)
    assert avi.read(avi.store(frame(spark, []))).count() == 0


def test_a_cut_is_found():
    import numpy as np

    r = np.random.default_rng(1)
    dark, bright = r.integers(0, 60, (20, 24, 24)), r.integers(180, 250, (15, 24, 24))
    samples = np.concatenate([dark, bright, dark]).astype(np.uint8)
    frames, fps = avi.demux(avi.mux(avi.encode_frames(samples)))
    assert (avi.decode_frames(frames) == samples).all() and fps == 25 and avi.shots(samples) == [0, 20, 35]


def baseline(levels, wide, high):
    """A baseline JPEG image of flat blocks: differences of the blocks' levels, and no other coefficients."""
    flow, last = "", 0
    for level in levels:
        d = (level - 128) - last  # a flat block's first coefficient is 8 times its level; the table divides by 8
        last, n = level - 128, abs(d).bit_length()
        flow += format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
    flow += "1" * (-len(flow) % 8)
    data = int(flow, 2).to_bytes(len(flow) // 8).replace(b"\xff", b"\xff\0")
    segment = lambda m, d: b"\xff" + bytes([m]) + (len(d) + 2).to_bytes(2) + d
    direct = bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])
    others = bytes([16, 1, *[0] * 15, 0])
    frame = bytes([8, *high.to_bytes(2), *wide.to_bytes(2), 1, 1, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0, *[8] * 64])) + segment(0xC4, direct) + segment(0xC4, others) + segment(0xC0, frame) + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_other_makers_and_damaged_files(spark):
    import numpy as np

    image = baseline([10, 200, 77, 128, 255, 0], 20, 16)
    plane = avi.brightness(image)
    assert plane.shape == (16, 20) and [int(plane[0, 0]), int(plane[0, 9]), int(plane[0, 17]), int(plane[9, 0]), int(plane[9, 9]), int(plane[9, 17])] == [10, 200, 77, 128, 255, 0]
    foreign = avi.mux([baseline([34 + k % 3] * 4, 16, 16) for k in range(12)] + [baseline([220 - k % 3] * 4, 16, 16) for k in range(8)])
    own = avi.mux(avi.encode_frames(np.arange(3 * 576, dtype=np.int64).astype(np.uint8).reshape(3, 24, 24)))
    damaged = own.replace(avi.TAIL, b"\0\0" + avi.TAIL, 1)
    wrong = bytearray(own)
    at = own.index(avi.HEAD) + len(avi.HEAD) + 40
    wrong[at : at + 60] = bytes(60)
    unindexed = own[: own.index(b"idx1")]
    files = [own, b"not avi", b"", None, own[:300], foreign, bytes(wrong), unindexed, own, avi.mux([b"\xff\xd8\xff\xc2\0\x04\0\0"])]
    rows = avi.read(spark.createDataFrame(list(enumerate(files)), "k long, media binary").repartition(1)).orderBy("k").collect()
    whole = [r.k for r in rows if r.payload is not None]
    assert whole == [0, 7, 8] and all(bytes(rows[k].payload) == bytes(rows[0].payload) for k in whole) and len(damaged) > len(own)
    assert [r.k for r in rows if r.error] == [1, 2, 4, 6, 9] and rows[3].error is None and rows[3].clips is None
    assert [c.first_frame for c in rows[5].clips] == [0, 12] and rows[5].payload is None


def test_long_texts_in_parts(monkeypatch):
    import numpy as np

    samples = np.random.default_rng(2).integers(0, 256, (50, 24, 24)).astype(np.uint8)
    whole = avi.encode_frames(samples)
    monkeypatch.setattr(avi, "TOGETHER", 7)
    assert avi.encode_frames(samples) == whole and (avi.decode_frames(whole) == samples).all()
