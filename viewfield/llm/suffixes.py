"""Removal of byte strings that come again, by a logarithmic family of sparse suffix arrays.

Of each ``WINDOW`` bytes, the place of the lowest hash of ``SEED`` bytes is an anchor.  Equal windows have
their anchors at equal places, so suffixes from anchors on find all repeats.  Windows with one anchor form a
chunk: the bytes round an anchor that can belong to its repeats.

Suffixes are dealt over shards by the hash of their first ``SEED`` bytes, so a search for repeats never leaves
a shard.  Documents come in batches.  A batch gets a sparse suffix array in each shard: its distinct chunks
in the order of their seeds.  Suffixes with the same first bytes stand together in this order, which is all
that a search for repeats needs.  The array is scanned by merging against the levels there are, which shows
chunks that are there already: each of their windows comes again.  Levels of one size merge into one of twice
the size before the next batch comes, so a batch meets a logarithmic number of levels.  Levels hold the place
of each suffix; they can be kept as a table and opened again for later batches.

Chunks that share a seed but not all bytes are at last compared window by window, on their bytes.  Chunks
that are equal have been joined before, so a group of copies is one entry here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import partitions, stored
from .jaccard import mixed

WINDOW, SEED = 200, 48
#: The windows of a seed with more chunks are dealt by their hashes.
HOT = 2000
#: Bytes that are worked on at once, and of a piece of a long document; suffixes that a task gathers.
SLICE_BYTES, PIECE, GATHERED = 1 << 20, 1 << 19, 250_000
U = np.uint64
DOC = ["doc_id", "t"]
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: A suffix: hashes of its first bytes and of its chunk, the two that name its document, first window, windows, anchor's distance, and whether it is known to come again.
SUFFIX = np.dtype([("seed", "<u8"), ("chunk", "<u8"), ("doc", "<i8"), ("t", "<i8"), ("a", "<i4"), ("n", "u1"), ("off", "u1"), ("again", "u1")])
NONE = np.zeros(0, SUFFIX)
#: What a scan gives: runs of windows that come again (size 0), chunks that share a seed with others (size: how many), levels.
SCANNED = "doc_id long, t long, a int, n int, off int, seed long, again boolean, size int, shard int, level int, data binary"


class Powers:
    """Powers of the bases and of their inverses, and a random value for each byte; made once for the longest slice."""

    size, of, back, values = 0, (), (), tuple(mixed(np.arange(256, dtype=U) * U(2) + U(b % 1000003)) for b in BASES)

    @classmethod
    def up_to(cls, n: int) -> None:
        if n > cls.size:
            cls.size = max(n, SLICE_BYTES + PIECE)
            cls.of, cls.back = (tuple(cls._row(x, cls.size) for x in row) for row in (BASES, [pow(b, -1, 1 << 64) for b in BASES]))

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, U)
        out[0] = 1
        return np.multiply.accumulate(out, out=out)


class Hashes:
    """Hashes of any slice of some bytes, two polynomials to the power of 2**64 mixed into one."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        Powers.up_to(n)
        self.sums = []
        for powers, values in zip(Powers.of, Powers.values):
            sums = np.zeros(n + 1, U)
            np.cumsum(values[data] * powers[:n], dtype=U, out=sums[1:])
            self.sums.append(sums)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[start]) * p[start] for s, p in zip(self.sums, Powers.back))
        return mixed(a ^ mixed(b))

    def of_length(self, n: int) -> np.ndarray:
        """Of each slice of n bytes."""
        a, b = ((s[n:] - s[:-n]) * p[: len(s) - n] for s, p in zip(self.sums, Powers.back))
        return mixed(a ^ mixed(b))


def chunks(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of joined texts: text, first window, number of windows, anchor's distance, seed, hash."""
    none = {k: np.zeros(0, np.int64) for k in ("doc", "a", "n", "off", "seed", "chunk")}
    starts = np.concatenate([[0], ends[:-1]])
    if len(data) < WINDOW:
        return none
    h = Hashes(data)
    seeds = h.of_length(SEED)
    w = WINDOW - SEED + 1
    value = (seeds & U(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=U)  # of equal ones the first
    rest = -len(value) % w
    block = np.concatenate([value, np.full(rest, ~U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - WINDOW + 1
    anchor = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(ends - starts - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(ends)), windows)
    window = np.arange(len(doc)) + np.repeat(starts - np.cumsum(windows) + windows, windows)  # those within one text
    if not len(window):
        return none
    p = anchor[window]
    cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([cut, [len(p)]]))
    a, p, doc = window[cut], p[cut], doc[cut]
    return {"doc": doc, "a": a - starts[doc], "n": count, "off": p - a, "seed": seeds[p], "chunk": h(a, a + count - 1 + WINDOW)}


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array: one suffix of each chunk, in order; and those that are now known to come again."""
    rows = rows[np.lexsort((rows["chunk"], rows["seed"]))]
    seed, chunk = rows["seed"], rows["chunk"]
    same = (seed[1:] == seed[:-1]) & (chunk[1:] == chunk[:-1])
    if not same.any():
        return rows, NONE
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    found = rows[several & (rows["again"] == 0)]
    rows["again"][several] = 1
    return rows[np.concatenate([[True], ~same])], found


class Family:
    """Levels of suffix arrays (order, rows, their seeds), each twice the size of the one before or more, and no chunk in two of them."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Scan a batch against the levels and make it one; returns the suffixes that this shows to come again."""
        rows, found = distinct(rows)
        found = [found]
        for _, level, seeds in self.levels:
            rows, more = self._scan(level, seeds, rows)
            found.append(more)
        self.put(0, rows)
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (x, a, _), (y, b, _) = self.levels.pop(), self.levels.pop()
            self.put(max(x, y) + 1, self._merged([b, a]))
        return np.concatenate(found)

    def put(self, order: int, rows: np.ndarray) -> None:
        """Have rows, in order, as a level."""
        self.levels.append((order, rows, np.ascontiguousarray(rows["seed"])))

    @staticmethod
    def _merged(levels: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(levels)
        return rows[np.argsort(rows["seed"], kind="stable")]  # runs in order, which this sort merges

    @staticmethod
    def _scan(level: np.ndarray, seeds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The batch's suffixes that the level lacks; those of both that are now known to come again.

        Only the level's suffixes with a seed of the batch are touched.
        """
        if not len(seeds) or not len(rows):
            return rows, NONE
        asked, number = np.unique(np.ascontiguousarray(rows["seed"]), return_inverse=True)
        low, high = np.searchsorted(seeds, asked, "left"), np.searchsorted(seeds, asked, "right")
        size = high - low
        theirs = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        mine = np.flatnonzero(size[number] > 0)
        both = np.concatenate([level[theirs], rows[mine]])
        order = np.lexsort((np.arange(len(both)), both["chunk"], both["seed"]))
        seed, chunk = both["seed"][order], both["chunk"][order]
        same = np.flatnonzero((seed[1:] == seed[:-1]) & (chunk[1:] == chunk[:-1]))  # a level's, then the batch's
        there, here = theirs[order[same]], mine[order[same + 1] - len(theirs)]
        found = np.concatenate([level[there], rows[here]])
        level["again"][there] = 1
        left = np.ones(len(rows), bool)
        left[here] = False
        return rows[left], found[found["again"] == 0]

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of seeds that have several chunks, not all known to come again; and how many of their seed there are."""
        rows = self._merged([level for _, level, _ in self.levels]) if self.levels else NONE
        seed = rows["seed"]
        start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(rows) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([start, [len(rows)]]))
        fresh = np.add.reduceat(rows["again"] == 0, start, dtype=np.int64) if len(rows) else counts
        chosen = np.repeat((counts > 1) & (fresh > 0), counts)
        return rows[chosen], np.repeat(counts, counts)[chosen]


def _dealt(rows: np.ndarray, shards: int, batches: int) -> Iterator[tuple[int, int, bytes]]:
    """Suffixes packed by shard and batch.  Anchors have low hashes, so the lower half of the hash deals."""
    shard = (rows["seed"] & U(0xFFFFFFFF)) % U(shards)
    cell = shard.astype(np.int64) * batches + (mixed(rows["t"].astype(np.int64).view(U)) % U(batches)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    rows, cell = rows[order], cell[order]
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
    for a, b in zip(cuts, [*cuts[1:], len(cell)]):
        yield int(cell[a]) // batches, int(cell[a]) % batches, rows[a:b].tobytes()


def _packs(packs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, batch, data = zip(*packs) if packs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(batch, pa.int32()), pa.array(data, pa.binary())], names=["shard", "batch", "data"])


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as bytes, long ones in pieces that share all but one byte of a window: (text, start, bytes), some at a time."""
    out, size = [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        for start in range(0, len(data) - WINDOW + 1, PIECE):
            out.append((i, start, data[start : start + PIECE + WINDOW - 1]))
            size += len(out[-1][2])
            if size >= SLICE_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def suffixes_of(docs: DataFrame, shards: int, batches: int) -> DataFrame:
    """Packed suffixes (shard, batch, data) of documents (doc_id, t, text).

    Of chunks that come again among those that a task has gathered, one goes on.  Those that go no further are
    known to come again and are packed as rows of batch -1.
    """

    def run(rows):
        held, size = [], 0

        def packed():
            found, again = distinct(np.concatenate(held))
            packs = list(_dealt(found, shards, batches))
            return _packs(packs + [(k, -1, data) for k, _, data in _dealt(again, shards, 1)])

        for batch in rows:
            ids, ts = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 1))
            for x, _, texts in in_slices(batch.column(2), SLICE_BYTES):
                for pieces in _pieces(texts):
                    of, start, data = zip(*pieces)
                    c = chunks(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
                    out = np.zeros(len(c["doc"]), SUFFIX)
                    doc = x + np.array(of)[c["doc"]]
                    out["doc"], out["t"], out["a"] = ids[doc], ts[doc], c["a"] + np.array(start)[c["doc"]]
                    for k in ("seed", "chunk", "n", "off"):
                        out[k] = c[k]
                    held.append(out)
                    size += len(out)
                    if size >= GATHERED:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "shard int, batch int, data binary")


def _rows(found: np.ndarray, sizes: np.ndarray | None = None, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Suffixes as rows of a scan."""
    sizes = np.zeros(len(found), np.int32) if sizes is None else sizes
    for k in range(0, len(found), most):
        x, n = found[k : k + most], len(found[k : k + most])
        columns = [np.ascontiguousarray(x[c]).astype(kind) for c, kind in (("doc", np.int64), ("t", np.int64), ("a", np.int32), ("n", np.int32), ("off", np.int32))]
        rest = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        arrays = [*map(pa.array, columns), pa.array(np.ascontiguousarray(x["seed"]).view(np.int64)), pa.array(x["again"] == 1), pa.array(sizes[k : k + most].astype(np.int32)), *rest]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCANNED.split(", ")])


def _level_row(shard: int, level: int, rows: np.ndarray) -> pa.RecordBatch:
    names, kinds = zip(*((c.split()[0], c.split()[1]) for c in SCANNED.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    values = {"shard": shard, "level": level, "data": rows.tobytes()}
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], types[k]) for c, k in zip(names, kinds)], names=names)


def scan(packs: DataFrame, shards: int, keep: bool = False) -> DataFrame:
    """The rows ``SCANNED`` of packed suffixes (shard, level, batch, data): batches in order go through each shard's family.

    Rows with a level are opened levels and come first.  With ``keep``, the family's levels are rows too.
    """

    def ended(shard, family):
        yield from _rows(*family.shared())
        if keep:
            for level, rows, _ in family.levels:
                yield _level_row(shard, level, rows)

    def run(batches):
        now, family, held = (None, None), Family(), []
        for table in batches:
            for shard, level, batch, data in zip(*(c.to_pylist() for c in table.columns)):
                if now != (shard, batch):
                    if held:
                        yield from _rows(family.add(np.concatenate(held)))
                    if now[0] is not None and now[0] != shard:
                        yield from ended(now[0], family)
                        family = Family()
                    now, held = (shard, batch), []
                rows = np.frombuffer(data, SUFFIX)
                if level is not None:
                    family.put(level, rows.copy())
                    family.levels.sort(key=lambda x: -x[0])
                elif batch < 0:
                    yield from _rows(rows)
                else:
                    held.append(rows)
        if held:
            yield from _rows(family.add(np.concatenate(held)))
        if now[0] is not None:
            yield from ended(now[0], family)

    ordered = packs.select("shard", "level", "batch", "data").repartition(shards, "shard").sortWithinPartitions("shard", F.col("level").isNull(), "batch")
    return ordered.mapInArrow(run, SCANNED)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for joins that move them."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for x, y, texts in in_slices(batch.column(2)):
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([None if t is None else z.compress(t.encode()) for t in texts], pa.binary())], names=["doc_id", "t", "id", "z"])

    return docs.select(*DOC, "text", "id").mapInArrow(run, "doc_id long, t long, id long, z binary")


CUT = pa.schema([("shard", pa.int32()), ("seed", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("again", pa.bool_()), ("data", pa.binary())])


def _cut(rows: DataFrame, shards: int) -> DataFrame:
    """The bytes of chunks of documents (doc_id, t, z, several), dealt by seed; of hot seeds the packed windows, dealt by their hashes."""

    def windows(hot: list[tuple]) -> pa.RecordBatch:
        packs = [(k, None, None, None, None, None, data) for k, _, data in _dealt(_windows(hot), shards, 1)]
        return _batch(packs, CUT)

    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out, hot, size = [], [], [0, 0]
            for doc, t, text, several in zip(*(c.to_pylist() for c in batch.columns)):
                data = z.decompress(text)
                for c in several:
                    of_chunk = data[c["a"] : c["a"] + c["n"] - 1 + WINDOW]
                    if c["size"] > HOT:
                        hot.append((doc, t, c, of_chunk))
                    else:
                        out.append(((c["seed"] & 0xFFFFFFFF) % shards, c["seed"], doc, t, c["a"], c["again"], of_chunk))
                    size[c["size"] > HOT] += len(of_chunk)
                    if size[0] > 4 << 20:
                        yield _batch(out, CUT)
                        out, size[0] = [], 0
                    if size[1] > 1 << 20:
                        yield windows(hot)
                        hot, size[1] = [], 0
            if out:
                yield _batch(out, CUT)
            if hot:
                yield windows(hot)

    return rows.mapInArrow(run, "shard int, seed long, doc_id long, t long, a int, again boolean, data binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _windows(chosen: list[tuple]) -> np.ndarray:
    """Each window of chunks (doc, t, chunk, bytes) as a suffix, known by its seed, its distance before the anchor and its hash."""
    docs, ts, several, data = zip(*chosen)
    of = lambda k, kind: np.array([c[k] for c in several], kind)
    count, lengths = of("n", np.int64), np.array([len(d) for d in data])
    row = np.repeat(np.arange(len(chosen)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(lengths) - lengths)[row] + place
    hashed = Hashes(np.frombuffer(b"".join(data), np.uint8))(at, at + WINDOW)
    out = np.zeros(len(row), SUFFIX)
    seed, distance = of("seed", np.int64).view(U)[row], (of("off", np.int64)[row] - place).view(U)
    out["seed"], out["chunk"] = mixed(hashed ^ mixed(seed + distance)), hashed
    out["doc"], out["t"], out["a"], out["n"], out["again"] = np.array(docs, np.int64)[row], np.array(ts, np.int64)[row], of("a", np.int64)[row] + place, 1, of("again", bool)[row]
    return out


def _compared(rows: list[tuple]) -> np.ndarray:
    """Runs of windows that come again among chunks (doc, t, a, again, bytes) of some seeds, but in those known to."""
    docs, ts, starts, known, data = zip(*rows)
    a, known = np.array(starts, np.int64), np.array(known, bool)
    lengths = np.array([len(d) for d in data])
    count = lengths - WINDOW + 1
    row = np.repeat(np.arange(len(data)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(lengths) - lengths)[row] + place
    value = Hashes(np.frombuffer(b"".join(data), np.uint8))(at, at + WINDOW)
    _, inverse, number = np.unique(value, return_inverse=True, return_counts=True)
    hit = (number[inverse] > 1) & ~known[row]
    row, place = row[hit], place[hit]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
    out = np.zeros(len(cut), SUFFIX)
    r = row[cut]
    out["doc"], out["t"], out["a"], out["n"] = np.array(docs, np.int64)[r], np.array(ts, np.int64)[r], a[r] + place[cut], np.diff(np.concatenate([cut, [len(row)]]))
    return out


def _again(batches) -> Iterator[pa.RecordBatch]:
    """Runs that come again, of rows of ``_cut`` sorted by shard and seed: chunks some seeds at a time, windows of hot seeds as suffixes are.

    Packs of windows are gathered first, so that there are as many levels as the logarithm of the gatherings.
    """
    held, size, last, family, shard_now = [], 0, None, Family(), None
    packs, gathered = [], 0
    for batch in batches:
        for shard, seed, doc, t, a, again, data in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != shard_now or gathered >= GATHERED:
                if packs:
                    yield from _rows(family.add(np.concatenate(packs)))
                packs, gathered = [], 0
            if shard != shard_now:
                shard_now, family = shard, Family()
            if seed is None:
                packs.append(np.frombuffer(data, SUFFIX))
                gathered += len(packs[-1])
                continue
            if seed != last and size > 1 << 20:
                yield from _rows(_compared(held))
                held, size = [], 0
            last = seed
            held.append((doc, t, a, again, data))
            size += len(data)
    if packs:
        yield from _rows(family.add(np.concatenate(packs)))
    if held:
        yield from _rows(_compared(held))


def repeats(docs: DataFrame, levels: DataFrame | None = None, old: DataFrame | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs of windows (doc_id, t, a, n) that start somewhere else too, n windows from place a on; and the levels kept.

    With ``levels`` of earlier documents ``old``, the documents come as further batches: repeats are found
    among them and between them and the old ones, whose own runs are returned too, those known before perhaps again.
    """
    spark = docs.sparkSession
    shards = partitions(spark)
    if levels is not None:
        shards = (levels.agg(F.max("shards")).first()[0]) or shards  # as the levels were dealt
    packs = suffixes_of(docs.select(*DOC, "text"), shards, max(4, int(partitions(spark) ** 0.5))).withColumn("level", F.lit(None).cast("int"))
    if levels is not None:
        packs = packs.unionByName(levels.select("shard", F.lit(0).alias("batch"), "data", "level"))
        docs = docs.union(old)
    scanned = stored(scan(packs, shards, keep), "scanned")
    chunks_left = scanned.where("size > 0").groupBy(*DOC).agg(F.collect_list(F.struct("a", "n", "off", "seed", "again", "size")).alias("several"))
    cut = _cut(_packed(docs).join(chunks_left, DOC).select(*DOC, "z", "several"), shards)
    again = cut.repartition(shards, "shard").sortWithinPartitions("shard", "seed").mapInArrow(_again, SCANNED)
    runs = scanned.where("size = 0").select(*DOC, "a", "n").union(again.select(*DOC, "a", "n"))
    return runs, scanned.where("level is not null").select("shard", "level", "data", F.lit(shards).alias("shards"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text, id): two hashes of 64 bits that name a document by its id, null or not, and its text; and its id."""
    of = [F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text")]
    return docs.select(F.xxhash64(*of).alias("doc_id"), F.xxhash64(F.lit("t"), *reversed(of)).alias("t"), "text", of[0].alias("id"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) of documents (doc_id, text).

    ``kept`` is what is left of the text's bytes, ``spans`` the runs (start, end) that go: bytes covered by a
    ``WINDOW``-byte string that also starts anywhere else, in the input.  Null is as empty.  Repeated rows,
    ids too, are documents of their own; a null id stays one.  Extra columns are ignored.  An empty table
    gives an empty table.
    """
    rows = keyed(docs)
    lists = repeats(rows)[0].groupBy(*DOC).agg(F.collect_list(F.struct("a", "n")).alias("runs"))

    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
        for batch in batches:
            out, size = [], 0
            for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data, spans, kept, at = b"" if text is None else z.decompress(text), [], [], 0
                for a, b in sorted((r["a"], r["a"] + r["n"] - 1 + WINDOW) for r in runs or []):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
                size += len(data)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return _packed(rows).join(lists, DOC, "left").select("id", "z", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>")
