"""N-gram Jaccard join by universe partition and pigeonhole.

A document is the set of its distinct word n-grams, each a 64-bit hash.  Sets are dealt into bands by size;
a band has a number of segments that hashing deals the universe of n-grams into.  Two sets that link differ
in at most ``H`` n-grams, so with more than ``H`` segments some segment is the same in both; the segment's
content hash is the index entry under which both are found.

Empty segments are no entries, for they would be the same in most sets.  A set's first allocation goes by
what its segments hold: exact segments alone, one entry each, where those that are not empty outnumber ``H``;
else also the one-deletion neighbourhoods of its segments of two or more n-grams, under which segments that
differ in one n-gram meet, so each counts twice; and a set for which even this is too little is entered under
each n-gram.  Of a pair it is enough that one set's allocation suffices, or that both are entered the same
way, so no linked pair is missed.

The second allocation goes by cost, the length of the entries' lists.  In a list of up to ``HOT`` sets all
pairs are tried; in a longer one each set is tried with one centre.  A longer list all of whose sets are then
in one component has nothing more to give.  A set shares at least so many entries with each partner as its
segments outnumber ``H``; one with fewer entries than that in the lists that are left is done, for it shares
another with each partner.  Those that are not done are found anew among themselves, with the n-grams as
segments and the cheapest chosen: of a set's n-grams in the order of the number of components that hold them,
as many as may be missing in a partner and one more.  Again short lists are tried whole and long ones by a
centre; for what is left of these the sets are compared in blocks, so that no pair goes untried.

Entries travel as packed arrays, dealt by their hash over shards.  Candidates are verified exactly on packed
n-gram sets, after a bound: the difference of two sets is at least that of their counts by ranges of the
hash.  Links never leave a component, so each set's links are counted there, in blocks, by the products of
their incidence matrices.  No row is made for a pair that is only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import kept, partitions, stored
from .components import components, joined

#: Words an n-gram, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Band k holds sizes from STEP**k on.
STEP = 1.5
#: A bucket of more sets is hot.
HOT = 20
#: Sets in a block, and n-grams in one, about; a larger set is a block of its own.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
#: Entries that a task gathers before it hands on the hot ones.
GATHERED = 4_000_000
#: Bytes of words that a worker keeps with their hashes, and the longest word kept.
CACHE_BYTES, LONG = 48 << 20, 100
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashed(dict):
    """Hashes of words; those of usual length are kept."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            self[word] = h
            self.held += len(word) + 170
        return h


class Grams:
    """Hashed n-gram sets of texts."""

    def __init__(self, words: int = WORDS):
        self.n, self.known = words, Hashed()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; of fewer than n words, one of the whole sequence; of none, none."""
        words = text.encode().translate(LOWER).split() if text else []  # bytes split at 0x20 and 0x09 to 0x0D
        if not words:
            return np.zeros(0, U)
        if self.known.held > CACHE_BYTES:
            self.known = Hashed()
        h = np.fromiter(map(self.known.__getitem__, words), U, len(words))
        size = max(1, len(h) - self.n + 1)
        out = np.full(size, min(len(h), self.n), U)
        for i in range(min(len(h), self.n)):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + size])
        return np.unique(out)


def band_of(size: int) -> int:
    k = int(np.log(size) / np.log(STEP))
    while STEP ** (k + 1) <= size:
        k += 1
    while STEP**k > size:
        k -= 1
    return k


def differ(a: int, b: int) -> int:
    """The most n-grams in which linked sets of these sizes differ."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def segments_of(band: int) -> tuple[int, int]:
    """The largest size in a band, and its number of segments: one more than the differences, and spare ones."""
    top = int(np.ceil(STEP ** (band + 1))) - 1
    most = differ(top, top * 100 // PERCENT)
    return top, most + 1 + max(3, (most + 1) // 4) * (most > 0)


def entries(grams: np.ndarray) -> tuple[np.ndarray, int]:
    """The index entries of a set, as 64-bit hashes, and how many it shares at least with each partner."""
    size, spare = len(grams), 1 << 30
    if not size:
        return grams, 0
    spread, out = mixed(grams), []
    own = band_of(size)
    for band in range(band_of(-(-size * PERCENT // 100)), own + 1):
        top, m = segments_of(band)
        most = differ(size, size * 100 // PERCENT) if band == own else differ(size, top)
        segment = ((grams >> U(32)) * U(m)) >> U(32)  # ascends as the hashes do
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        content = np.add.reduceat(spread, starts)
        salt = segment[starts] * U(0x9E3779B97F4A7C15) + U(band + 1)
        out.append(mixed(content ^ mixed(salt)))
        spare = min(spare, max(0, len(starts) - most))
        if len(starts) > most:
            continue
        counts = np.diff(np.concatenate([starts, [size]]))
        at = np.repeat(np.arange(len(starts)), counts)
        several = counts[at] > 1
        out.append(mixed((content[at] - spread)[several] ^ mixed(salt[at])[several]))
        if 2 * (counts > 1).sum() + (counts == 1).sum() <= most:
            out.append(mixed(spread + U(band + 1) * U(0xD6E8FEB86659FD93)))
    return np.unique(np.concatenate(out)), spare


def sketch(grams: np.ndarray) -> bytes:
    """Counts by equal ranges of the hash, a third as many ranges as n-grams about; 255 stands for more too."""
    bits = max(4, int(len(grams) / 3).bit_length())
    return np.minimum(np.bincount((grams >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def at_least_apart(a: bytes, b: bytes) -> int:
    """In how many n-grams the sets of two sketches differ at least."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (np.minimum(v.reshape(size, -1).sum(1), 255) for v in (x, y))
    return int(np.abs(x - y).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def hash_of(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    spread = mixed(grams + U(len(grams)))
    return int(grams.sum()), int(np.bitwise_xor.reduce(spread * spread)) if len(grams) else 0


def _as_long(x) -> pa.Array:
    return pa.array(np.array(x, U).view(np.int64))


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with one row for each id: of several that of the most n-grams, ties by their hashes."""
    twice = stored(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs

    def run(batches):
        grams = kept(("grams", WORDS), Grams)
        for batch in batches:
            for a, b, texts in in_slices(batch.column(1)):
                sets = [grams(t) for t in texts]
                first, second = zip(*map(hash_of, sets))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array([len(x) for x in sets], pa.int64()), _as_long(first), _as_long(second)], names=["doc_id", "text", "n", "s1", "s2"])

    sized = docs.join(twice, "doc_id", "left_semi").mapInArrow(run, "doc_id long, text string, n long, s1 long, s2 long")
    best = sized.groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2", "text")).alias("s")).select("doc_id", "s.text")
    return docs.join(twice, "doc_id", "left_anti").union(best)


def _index(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of two kinds: of each document (doc_id, n, set hash), and of each shard its packed entries.

    Sets that come again within a task are entered once.
    """

    def run(batches):
        grams, seen = kept(("grams", WORDS), Grams), {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in in_slices(batch.column(1)):
                yield from _rows(ids[a:b], texts, grams, seen, shards)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, spare int, sketch binary, shard int, entries binary, owners binary")


INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("spare", pa.int32()), ("sketch", pa.binary()), ("shard", pa.int32()), ("entries", pa.binary()), ("owners", pa.binary())])


def _rows(ids: list, texts: list, grams: Grams, seen: dict, shards: int) -> Iterator[pa.RecordBatch]:
    sizes, first, second, spare, sketches, found, owners = [], [], [], [], [], [], []
    for i, text in zip(ids, texts):
        own = grams(text)
        s = hash_of(own)
        sizes.append(len(own))
        first.append(s[0])
        second.append(s[1])
        if len(own) and s not in seen:
            if len(seen) > 200_000:
                seen.clear()
            e, least = entries(own)
            key = np.unique((e >> U(32)) % U(shards) << U(32) | e & U(0xFFFFFFFF))  # entries that meet here count once
            seen[s] = max(0, least - (len(e) - len(key)))
            found.append(key)
            owners.append(np.full(len(key), i, np.int64))
        spare.append(seen[s] if len(own) else 0)
        sketches.append(sketch(own))
    n = len(ids)
    nothing = pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _as_long(first), _as_long(second), pa.array(spare, pa.int32()), pa.array(sketches, pa.binary()), *nothing], schema=INDEX)
    if not found:
        return
    e, o = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(e >> U(32), kind="stable")
    e, o = e[order], o[order]
    cuts = np.searchsorted(e >> U(32), np.arange(shards + 1, dtype=U))
    base, e = int(o.min()), e.astype(np.uint32)
    packed = [(k, e[a:b].tobytes(), _pack(o[a:b], base)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    n = len(packed)
    k, e, o = zip(*packed)
    none = pa.nulls(n, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(k, pa.int32()), pa.array(e, pa.binary()), pa.array(o, pa.binary())], schema=INDEX)


def _pack(owners: np.ndarray, base: int) -> bytes:
    """Owners as distances from the first, in four bytes where they fit."""
    far = owners - base
    wide = far.max() >= 1 << 32
    return base.to_bytes(8, "little", signed=True) + (far if wide else far.astype(np.uint32)).tobytes()


def _unpack(owners: bytes, n: int) -> np.ndarray:
    kind = np.int64 if len(owners) - 8 == 8 * n else np.uint32
    return np.frombuffer(owners, kind, offset=8).astype(np.int64) + int.from_bytes(owners[:8], "little", signed=True)


def _bucket_rows(bucket: np.ndarray, doc: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(doc), pa.array(number.astype(np.int64))], names=["bucket", "doc_id", "entries"])


def _starts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(e)]]))


def _buckets(batches) -> Iterator[pa.RecordBatch]:
    """The sets that share entries, (bucket, doc_id, entries), of packed entries (shard, entries, owners).

    A group of sets that shares several entries is one bucket.  When many entries are gathered, the sets of
    hot ones are handed on and each later set of theirs at once, so no list has to be held whole.
    """
    keys, owners, size, hot = [], [], 0, np.zeros(0, U)
    for batch in batches:
        for shard, e, o in zip(*(c.to_pylist() for c in batch.columns)):
            e = np.frombuffer(e, np.uint32).astype(U)
            keys.append(e | U(shard) << U(32))
            owners.append(_unpack(o, len(e)))
            size += len(e)
        if size < GATHERED:
            continue
        e, o = _ordered(keys, owners)
        starts, counts = _starts(e)
        hot = np.union1d(hot, e[starts][counts > HOT])
        out = np.isin(e, hot)
        if out.any():
            yield _bucket_rows(mixed(e[out]), o[out], np.ones(out.sum()))
        keys, owners, size = [e[~out]], [o[~out]], 0
    if not keys:
        return
    e, o = _ordered(keys, owners)
    late = np.isin(e, hot)
    if late.any():
        yield _bucket_rows(mixed(e[late]), o[late], np.ones(late.sum()))
        e, o = e[~late], o[~late]
    starts, counts = _starts(e)
    keep = np.repeat(counts > 1, counts)
    e, o = e[keep], o[keep]
    if not len(e):
        return
    starts, counts = _starts(e)
    content = np.add.reduceat(mixed(o.astype(U)), starts)  # the group's members
    _, one, number = np.unique(content, return_index=True, return_counts=True)
    times = np.zeros(len(starts), np.int64)
    times[one] = number
    member = np.repeat(times > 0, counts)
    yield _bucket_rows(np.repeat(content, counts)[member], o[member], np.repeat(times, counts)[member])


def _ordered(keys: list, owners: list) -> tuple[np.ndarray, np.ndarray]:
    e, o = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((o, e))
    return e[order], o[order]


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sizes and sketches leave a link possible."""
    named = lambda x: sets.selectExpr(f"doc_id as {x}", f"n as n{x}", f"sketch as s{x}")
    both = pairs.join(named("a"), "a").join(named("b"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = [at_least_apart(x, y) <= differ(n, m) for n, m, x, y in zip(na, nb, sa, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, grams): the n-gram sets of the documents of ``ids``, as packed hashes."""

    def run(batches):
        grams = kept(("grams", WORDS), Grams)
        for batch in batches:
            for a, b, texts in in_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([grams(t).tobytes() for t in texts], pa.binary())], names=["doc_id", "grams"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, grams binary")


def _verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link, by their whole sets."""
    named = lambda x: packed.selectExpr(f"doc_id as {x}", f"grams as grams_{x}")

    def run(batches):
        for batch in batches:
            sets = ([np.frombuffer(v, U) for v in batch.column(k).to_pylist()] for k in (2, 3))
            keep = [linked(x, y) for x, y in zip(*sets)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many n-grams each of the first ``split`` sets shares with each of the others, or each two if there are none."""
    k, alone = len(sets), split == len(sets)
    rows, columns = (slice(0, k), slice(0, k)) if alone else (slice(0, split), slice(split, k))
    row = np.repeat(np.arange(k), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    _, counts = _starts(flat)
    column = np.repeat(np.arange(len(counts)), counts)
    often = counts[column]
    r, c = row[(often > 1) & (often <= 8)], column[(often > 1) & (often <= 8)]
    out = np.zeros(k * k)
    for d in range(1, 8):  # of a rare n-gram each two of its sets
        same = c[d:] == c[:-d]
        if not same.any():
            break
        out += np.bincount(r[:-d][same] * k + r[d:][same], minlength=k * k)
    out = out.reshape(k, k)
    out = (out + out.T)[rows, columns]
    r, c = row[often > 8], column[often > 8]
    c = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]])) if len(c) else c
    for first in range(0, int(c[-1]) + 1 if len(c) else 0, 2048):  # of others a product of matrices
        a, b = np.searchsorted(c, (first, first + 2048))
        held = np.zeros((k, 2048), np.float32)
        held[r[a:b], c[a:b] - first] = 1
        out += held[rows] @ held[columns].T
    return out


def _links_in(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Which of the first ``split`` sets link with which of the others, or which two if there are none."""
    both, n = shared(sets, split), np.array([len(x) for x in sets])
    rows, columns = (n, n) if split == len(sets) else (n[:split], n[split:])
    out = (100 * both >= PERCENT * (rows[:, None] + columns[None, :] - both)) & (both > 0)
    if split == len(sets):
        np.fill_diagonal(out, False)
    return out


def _blocks(members: DataFrame, packed: DataFrame) -> DataFrame:
    """The members (g, doc_id, n, label) of groups with their sets, for each two blocks of a group: (g, i, j, own, ...).

    Rows come sorted by blocks within partitions.
    """
    blocks = members.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    rows = members.join(blocks, "g").join(packed, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    each = each.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "label", "grams")
    return each.repartition(partitions(members.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j", "own")


def _grouped(batches) -> Iterator[tuple[list, list, list, int]]:
    """Of rows of ``_blocks``, for each two blocks with members: ids, labels, sets, and how many belong to the first.

    For a block by itself all do.
    """
    last, ids, labels, sets, first = None, [], [], [], 0
    done = lambda: last is not None and (last[1] == last[2] and first > 1 or 0 < first < len(ids))
    for batch in batches:
        for g, i, j, own, doc, label, grams in zip(*(c.to_pylist() for c in batch.columns)):
            if last != (g, i, j):
                if done():
                    yield ids, labels, sets, first
                last, ids, labels, sets, first = (g, i, j), [], [], [], 0
            ids.append(doc)
            labels.append(label)
            sets.append(np.frombuffer(grams, U))
            first += own == i
    if done():
        yield ids, labels, sets, first


def _count_links(batches) -> Iterator[pa.RecordBatch]:
    """(doc_id, others): how many documents each set links with in another block or its own; labels are their copies."""
    for ids, copies, sets, first in _grouped(batches):
        found, weight = _links_in(sets, first), np.array(copies, np.int64)
        others = found @ weight if first == len(ids) else np.concatenate([found @ weight[first:], found.T @ weight[:first]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others.astype(np.int64))], names=["doc_id", "others"])


def _cross_links(batches) -> Iterator[pa.RecordBatch]:
    """(a, b): of each two components, the labels, a pair of sets that links, if two do."""
    for ids, labels, sets, first in _grouped(batches):
        found, ids, labels = _links_in(sets, first), np.array(ids), np.array(labels)
        x, y = np.nonzero(found)
        y = y + (first if first < len(ids) else 0)
        x, y = x[labels[x] != labels[y]], y[labels[x] != labels[y]]
        if len(x):
            low, high = np.minimum(labels[x], labels[y]), np.maximum(labels[x], labels[y])
            _, one = np.unique(np.stack([low, high]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[one]]), pa.array(ids[y[one]])], names=["a", "b"])


def _tried(members: DataFrame, key: str) -> DataFrame:
    """Add to members (key, doc_id, component) the number of sets in the list and a centre; lists within one component go."""
    lists = members.groupBy(key).agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("doc_id"), "doc_id"))["doc_id"].alias("centre"), F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(lists.where("low < high").drop("low", "high"), key)


def _pairs(members: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of different components: all of a short list, those with the centre of a long one."""
    x, y = (members.where(f"size <= {HOT}").select(key, F.col("doc_id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    short = x.join(y, key).where("a < b and of_a <> of_b").select("a", "b")
    long = members.where(f"size > {HOT} and doc_id <> centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
    return short.union(long).distinct()


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """Replace each set's component by the one that it is in now."""
    now = found.withColumnsRenamed({"node": "doc_id", "component": "now"})
    return members.join(now, "doc_id", "left").withColumn("component", F.coalesce("now", "component")).drop("now")


def _left(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, component, n) of the sets that may have partners which none of the lists ``hot`` has shown."""
    counted = hot.groupBy("doc_id", "component").agg(F.sum("entries").alias("left"))
    return counted.join(sets.select("doc_id", "n", "spare"), "doc_id").where("left >= spare").select("doc_id", "component", "n")


def _open(hot: DataFrame) -> DataFrame:
    """The members of lists that hold several components."""
    open_lists = hot.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return hot.join(open_lists, "bucket", "left_semi")


def _cheapest(left: DataFrame, packed: DataFrame) -> DataFrame:
    """(gram, doc_id, component): of each set the n-grams in fewest components, one more than a partner may lack."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(v, np.int64) for v in batch.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], grams], names=["doc_id", "component", "n", "grams"])

    rows = left.join(packed, "doc_id").select("doc_id", "component", "n", "grams").mapInArrow(run, "doc_id long, component long, n long, grams array<long>")
    rows = stored(rows, "left").select("doc_id", "component", "n", F.explode("grams").alias("gram"))
    cost = rows.select("gram", "component").distinct().groupBy("gram").agg(F.count("*").alias("cost")).where("cost > 1")
    ordered = rows.join(cost, "gram", "left").groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("cost", F.lit(1)).alias("cost"), "gram"))).alias("grams"))
    most = F.expr(f"cast(n - ({PERCENT} * n + 99) div 100 + 1 AS int)")
    chosen = ordered.select("doc_id", "component", F.explode(F.slice("grams", 1, most)).alias("s"))
    return chosen.where("s.cost > 1").select(F.col("s.gram").alias("gram"), "doc_id", "component")


def _members(index: DataFrame, copies: DataFrame, shards: int) -> DataFrame:
    """(bucket, doc_id, entries): the sets that share entries, a copy standing for the first of its set, and how many they are.

    Copies in one task's part of a bucket have the same entries there; those of other parts are others.
    """
    packs = index.where("shard is not null").select("shard", "entries", "owners").repartition(shards, "shard")
    found = packs.mapInArrow(_buckets, "bucket long, doc_id long, entries long").withColumn("part", F.spark_partition_id())
    named = found.join(copies, "doc_id", "left").select("bucket", F.coalesce("first", "doc_id").alias("doc_id"), "part", "entries")
    return named.groupBy("bucket", "doc_id", "part").agg(F.max("entries").alias("entries")).groupBy("bucket", "doc_id").agg(F.sum("entries").alias("entries"))


def join(docs: DataFrame, links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of documents (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` that links reach, the document's own included; ``n_links``
    counts the other documents that it links with, copies included, and is left out without ``links``: it takes
    the square of a component of different texts, which components alone do not.  A null or empty text, or one
    of separators only, has an empty set and links with nothing.  Rows with a null ``doc_id`` are left out;
    rows that repeat a ``doc_id`` are treated as one document, that of the largest set.  Extra columns are
    ignored.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = one_row_an_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"))
    shards = 2 * partitions(spark)
    index = stored(_index(docs, shards), "index")
    sets = index.where("shard is null").select("doc_id", "n", "s1", "s2", "spare", "sketch")
    kinds = stored(sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "kinds")
    copies = sets.join(kinds.where("copies > 1"), ["n", "s1", "s2"]).where("first < doc_id").select("doc_id", "first")

    members = stored(_members(index, copies, shards).withColumn("component", F.col("doc_id")), "members")
    members = stored(_tried(members, "bucket"), "members")
    near = stored(_near(_pairs(members, "bucket"), sets), "near")
    hot = members.where(f"size > {HOT}").drop("size", "centre")
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select("b")).union(_left(hot, sets).select("doc_id"))
    packed = stored(_packed(docs, wanted.distinct()), "packed")
    found = stored(components(stored(_verified(near, packed), "links")), "components")

    left = stored(_left(_open(_with_components(hot, found)), sets), "left")
    if not left.isEmpty():
        found = _search_rest(left, sets, packed, found)

    of_kind = kinds.join(found.withColumnRenamed("node", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
    if not links:
        rows = sets.join(of_kind.select("n", "s1", "s2", "component"), ["n", "s1", "s2"], "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    weights = kinds.select(F.col("first").alias("doc_id"), "n", F.col("copies").alias("label"))
    groups = found.select(F.col("component").alias("g"), F.col("node").alias("doc_id")).join(weights, "doc_id").select("g", "doc_id", "n", "label")
    counts = _blocks(groups, packed).mapInArrow(_count_links, "doc_id long, others long").groupBy("doc_id").agg(F.sum("others").alias("others"))
    of_kind = of_kind.join(counts.withColumnRenamed("doc_id", "first"), "first", "left").select("n", "s1", "s2", "component", F.expr("copies - 1 + coalesce(others, 0)").alias("n_links"))
    return sets.join(of_kind, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _search_rest(left: DataFrame, sets: DataFrame, packed: DataFrame, found: DataFrame) -> DataFrame:
    """Components with the links that the sets ``left`` show by their cheapest n-grams."""
    members = stored(_tried(stored(_cheapest(left, packed), "cheapest"), "gram"), "members")
    if members.isEmpty():
        return found
    more = stored(_verified(_near(_pairs(members, "gram"), sets), packed), "links")
    if not more.isEmpty():
        found = stored(joined(found, more), "components")
    hot = _with_components(members.where(f"size > {HOT}").drop("size", "centre"), found)
    lists = hot.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("doc_id").cast("decimal(20)")).alias("content"))
    lists = lists.where("low < high").groupBy("size", "content").agg(F.min("gram").alias("gram")).select("gram")  # lists of the same sets once
    rest = hot.join(lists, "gram", "left_semi").join(sets.select("doc_id", "n"), "doc_id")
    rest = stored(rest.select(F.col("gram").alias("g"), "doc_id", "n", F.col("component").alias("label")), "rest")
    if not rest.isEmpty():
        more = stored(_blocks(rest, packed).mapInArrow(_cross_links, "a long, b long").distinct(), "links")
        if not more.isEmpty():
            found = stored(joined(found, more), "components")
    return found
