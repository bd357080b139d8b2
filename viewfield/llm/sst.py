"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order: data blocks of prefix-compressed entries, then a
sparse index (last key, place and size of each block), a Bloom filter over the keys and a footer of fixed
size.  A look-up tests the filter, searches the index by halves, and reads one block.

Key: byte 0 for a null identifier, else byte 1 and the identifier as a big-endian 64-bit integer with its
sign bit turned, so that keys sort as identifiers do.  Equal identifiers may repeat; their entries stand
side by side, ordered by text.  Value: the ids as little-endian unsigned 16- or 32-bit integers (``width``).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Words, in_slices
from .common import kept, partitions, shared_dir, stored

BLOCK_BYTES = 64 << 10
MAGIC = b"sstable1"
#: index place and size, filter place and size, entries, ids, bytes an id
FOOTER = struct.Struct("<QQQQQQI8s")
#: bits a key in the Bloom filter, and probes
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + struct.pack(">Q", (identifier + (1 << 63)) % (1 << 64))


def identifier_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Appends entries in key order to a binary file and closes it with index, filter and footer."""

    def __init__(self, file, width: int):
        import zstandard

        self.file, self.width, self.at, self.zip = file, width, 0, zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.index, self.keys, self.ids = bytearray(), b"", [], [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        at, self.at = self.at, self.at + len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            packed = self.zip.compress(bytes(self.block))
            at, size = self._put(struct.pack("<I", zlib.crc32(packed)) + packed)
            self.index.append((self.last, at, size))
            self.block, self.last = bytearray(), b""

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, size) for k, at, size in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        i, b = self._put(zlib.compress(index)), self._put(bytes(bloom))
        self._put(FOOTER.pack(*i, *b, len(self.keys), self.ids, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a random-access file: all entries in order, or one identifier's."""

    def __init__(self, file):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        size = file.tell()
        i_at, i_size, b_at, b_size, self.entries, self.ids, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom, packed, self.index, at = self._at(b_at, b_size), zlib.decompress(self._at(i_at, i_size)), [], 0
        while at < len(packed):
            n = packed[at]
            self.index.append((packed[at + 1 : at + 1 + n], *struct.unpack_from("<QQ", packed, at + 1 + n)))
            at += 17 + n

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, at: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(at, size)
        if zlib.crc32(data[4:]) != struct.unpack_from("<I", data)[0]:
            raise ValueError("a block is damaged")
        data, key, at = self.zip.decompress(data[4:]), b"", 0
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def wide(self, value: bytes) -> bytes:
        """A value as unsigned 32-bit integers."""
        return value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for _, at, size in self.index:
            for key, value in self._block(at, size):
                yield identifier_of(key), self.wide(value)

    def get(self, identifier: int | None) -> list[bytes]:
        """The values of an identifier, none if it is not there."""
        key = key_of(identifier)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        out = []
        for last, at, size in self.index[bisect_left(self.index, key, key=lambda x: x[0]) :]:
            out += [self.wide(v) for k, v in self._block(at, size) if k == key]
            if last > key:
                break
        return out


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(prints)))}


class Added(Words):
    """Words, but texts that hold an added token of the tokenizer go through the library whole."""

    def __init__(self, pieces: Callable[[str], list[str]], ids: Callable[[str], bytes], added: list[str], whole: Callable[[str], bytes]):
        super().__init__(pieces, ids)
        self.added, self.whole = added, whole

    def encode(self, texts: list[str]) -> list[bytes]:
        held = {i for i, text in enumerate(texts) if any(token in text for token in self.added)}
        out = super().encode(["" if i in held else text for i, text in enumerate(texts)] if held else texts)
        for i in held:
            out[i] = self.whole(texts[i])
        return out


def _words(tokenizer: str, pattern: str) -> tuple[Words, int]:
    return kept(("shards", tokenizer, pattern), lambda: _library(tokenizer, pattern))


def _library(tokenizer: str, pattern: str) -> tuple[Words, int]:
    """The tokenizer's ids by text, packed, and the bytes that an id takes.

    Its pre-tokenizer must be the byte-level one that cuts by ``pattern``; the library's model encodes each piece.
    Added tokens in a text are matched as the library does, special ones too.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    said = json.loads(t.to_str())
    if said["normalizer"] or said["pre_tokenizer"]["type"] != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a byte-level tokenizer without normalizer and prefix is needed")
    model, letters = t.model, byte_letters()
    width, kind = (2, "H") if t.get_vocab_size(True) <= 1 << 16 else (4, "I")

    space = chr(letters[32])

    def ids(piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()  # such bytes stand for themselves, but for the space
        text = piece.replace(" ", space) if plain else piece.encode().decode("latin-1").translate(letters)
        return array(kind, [x.id for x in model.tokenize(text)]).tobytes()

    def whole(text: str) -> bytes:
        return array(kind, t.encode(text, add_special_tokens=False).ids).tobytes()

    added = [token.content for token in t.get_added_tokens_decoder().values()]
    return Added(regex.compile(pattern).findall, ids, added, whole), width


def _opened(path: str, how: str):
    """A file of the shared folder, of whatever kind of store."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if how == "r":
        return store.open_input_file(at)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at)


def write_shards(docs: DataFrame, tokenizer: str, pattern: str, folder: str, end_id: int, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, write shards in ascending identifier order, and return the manifest.

    One row a shard: shard, path, n_docs, n_ids, first_id.  Each attempt of a task writes a file of its own
    name and the manifest, stored as a table, lists those of the attempts that counted; so lost executors
    leave no double rows.  Null texts hold ``end_id`` alone; null identifiers come first.
    """
    n = partitions(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        words, width = _words(tokenizer, pattern)
        shard = TaskContext.get().partitionId()
        path, writer, first = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.sst", None, None
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in in_slices(batch.column(1)):
                if writer is None:
                    file = _opened(path, "w")
                    writer, first = ShardWriter(file, width), keys[0]
                for key, ids in zip(keys[a:b], words.encode([t or "" for t in texts])):
                    writer.add(key_of(key), ids + end)
        if writer is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(writer.keys)], "n_ids": [writer.ids], "first_id": pa.array([first], pa.int64())})

    ordered = docs.select(F.col(identifier).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long, first_id long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """All entries as (doc_id, start, ids): start counts the ids of all documents before, over all shards.

    Repeated rows are entries of their own.  Without shards, as of an empty table, there are no rows.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _opened(path, "r") as file:
                    rows, size = [], 0
                    for key, ids in ShardReader(file):
                        rows.append((key, start, ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return files.repartition(max(1, partitions(manifest.sparkSession)), "path").mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    k, s, i = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], names=["doc_id", "start", "ids"])


def lookup(manifest: DataFrame, wanted: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """The ids of wanted identifiers: (doc_id, ids), each found by binary search in the shards it may be in.

    Identifiers that are nowhere give no row, repeated entries a row each, an empty manifest none.  The shards'
    first keys, as many as shuffle partitions at most, are searched by halves in each task.
    """
    shards = sorted((key_of(r.first_id), r.path) for r in manifest.select("first_id", "path").collect())
    firsts, paths = [k for k, _ in shards], [p for _, p in shards]
    keys = wanted.select(F.col(identifier).cast("long").alias("doc_id")).distinct()

    def route(batches):
        for batch in batches:
            found = []
            for doc in batch.column(0).to_pylist():
                key = key_of(doc)
                found += [(paths[k], doc) for k in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))]
            if found:
                path, doc = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(doc, pa.int64())], names=["path", "doc_id"])

    routed = keys.mapInArrow(route, "path string, doc_id long")

    def run(batches):
        path = file = reader = None
        for batch in batches:
            rows = []
            for at, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != path:
                    path, file = at, _opened(at, "r")
                    reader = ShardReader(file)
                rows += [(key, 0, v) for v in reader.get(key)]
            if rows:
                yield _batch(rows).select(["doc_id", "ids"])

    n = partitions(manifest.sparkSession)
    return routed.repartition(n, "path").sortWithinPartitions("path", "doc_id").mapInArrow(run, "doc_id long, ids binary")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, pattern: str, end_id: int) -> DataFrame:
    """Shards in the shared folder, read back whole."""
    return read_shards(write_shards(docs, tokenizer, pattern, shared_dir(spark, "shards"), end_id))
