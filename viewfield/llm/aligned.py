"""Alignment of two tokenizers' tokens by byte ranges, and how often their ids meet.

Tokens of a byte-level vocabulary (A) and of a sentencepiece model (B) cover the same bytes.  All tokens of both are
sorted by their starts; a group ends where a start reaches the largest end so far, so groups are the runs between
places where tokens of both end.  Within a group each A token is linked with each B token.

Neither vocabulary has an entry that holds a space after something else than a space, so no token reaches over the
start of a space that follows something else: texts are cut there, and a part that comes again in a chunk is encoded once.

How many documents link a pair of ids is counted over all documents.  Documents are worked on in chunks.  A chunk
names each pair of its documents once, so that what is shuffled is a row for each pair and chunk, not one for each
pair and document, and the pair that is in every document is one row for each chunk.  The counts of a chunk's pairs
come back to it as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_BYTES, parts_of
from .common import kept, stored
from .sst import _library, byte_letters

#: Characters of text in a chunk, one document at least; parts that are aligned at once.
CHUNK, BATCH = 4 << 20, 1 << 14
#: The mark that stands for a space in pieces.
MARK = "▁"
DIGEST = "n_a long, n_b long, n_groups long, n_links long"


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which group each token is in; tokens in any order, groups numbered by their starts.

    A group breaks where a start reaches the largest end of all tokens before.
    """
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.concatenate([[0], starts[order][1:] >= reached[:-1]]) if len(order) else order
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(breaks)
    return out


@dataclass
class Parts:
    """Aligned parts of texts: do the bytes fit, counts (tokens of A and B, groups, links), groups as text, and links.

    The links of part i are ``pairs[first[i]:first[i + 1]]``, ids of A in the upper half, linked ``times`` often.
    """

    fits: np.ndarray
    counts: np.ndarray
    groups: list[str]
    first: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers; one for each worker process."""

    def __init__(self, a: str, pattern: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, width = _library(a, pattern)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        back = {chr(letter): byte for byte, letter in byte_letters().items()}
        names = {i: x for x, i in Tokenizer.from_file(a).get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in pieces):
            raise ValueError("a piece reaches over the start of a word")
        self.mark = self.b.piece_to_id(MARK)
        self.bytes = ([bytes(back.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)], [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)])
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in self.bytes]
        # each id with each mark that may follow it
        self.width = max(map(len, self.bytes))
        self.said = [f"{i}{mark}" for mark in ",|;\n" for i in range(self.width)]

    def __call__(self, parts: list[str]) -> Parts:
        """Parts, each with its space in front, aligned."""
        done = [self._aligned(parts[i : i + BATCH]) for i in range(0, len(parts), BATCH)] or [self._aligned([])]
        of = lambda name: np.concatenate([getattr(p, name) for p in done])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in done]))])
        return Parts(of("fits"), of("counts"), [x for p in done for x in p.groups], first, of("pairs"), of("times"))

    def _encoded(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B and how many of each a part has, none where the bytes differ; and the parts' lengths in bytes."""
        packed = list(map(self.a.__getitem__, parts))  # added tokens' strings are plain text there
        if self.a.held > CACHE_BYTES:
            self.a.clear()
            self.a.held = 0
        pieces = [[self.mark] if x == " " else ids for x, ids in zip(parts, self.b.encode([x[1:] for x in parts], num_threads=1))]
        ids = [np.frombuffer(b"".join(packed), self.kind).astype(np.int64), np.array(list(chain.from_iterable(pieces)), np.int64)]
        count = [np.array(list(map(len, packed)), np.int64) // self.kind.itemsize, np.array(list(map(len, pieces)), np.int64)]
        whole = [x.encode() for x in parts]
        sizes, joined = np.array(list(map(len, whole)), np.int64), b"".join(whole)
        sides = list(zip(ids, count, self.bytes, self.lengths))
        if not all(b"".join(map(names.__getitem__, i.tolist())) == joined and (_sums(lengths[i], n) == sizes).all() for i, n, names, lengths in sides):
            fits = np.ones(len(parts), bool)
            for i, n, names, _ in sides:
                end = np.cumsum(n).tolist()
                fits &= [b"".join(map(names.__getitem__, i[e - k : e].tolist())) == w for e, k, w in zip(end, n.tolist(), whole)]
            ids, count = [i[np.repeat(fits, n)] for i, n in zip(ids, count)], [np.where(fits, n, 0) for n in count]
        return ids, count, sizes

    def _aligned(self, parts: list[str]) -> Parts:
        ids, count, sizes = self._encoded(parts)
        begins, starts, ends, owner = np.cumsum(sizes) - sizes, [], [], []
        for flat, n, lengths in zip(ids, count, self.lengths):
            of = np.repeat(np.arange(len(parts)), n)
            end = np.cumsum(lengths[flat])
            end += (begins - np.concatenate([[0], end])[np.cumsum(n) - n])[of]  # parts without tokens leave gaps
            starts.append(end - lengths[flat])
            ends.append(end)
            owner.append(of)
        group = coalesced(np.concatenate(starts), np.concatenate(ends))
        part_of = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
        part_of[group] = np.concatenate(owner)
        pairs, times, of = _links(ids, group[: len(ids[0])], group[len(ids[0]) :], len(part_of))
        # a pair of several groups of a part is one link more often
        part = part_of[of]
        order = np.lexsort((pairs, part))
        pairs, part = pairs[order], part[order]
        new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (part[1:] != part[:-1])])) if len(pairs) else np.zeros(0, np.int64)
        times = np.add.reduceat(times[order], new) if len(new) else times
        first = np.searchsorted(part[new], np.arange(len(parts) + 1))
        counts = np.stack([*count, np.bincount(part_of, minlength=len(parts)), _sums(times, np.diff(first))], 1).astype(np.int64)
        return Parts(count[0] > 0, counts, self._texts(ids, group, part_of, count[0] > 0), first, pairs[new], times)

    def _texts(self, ids: list[np.ndarray], group: np.ndarray, part_of: np.ndarray, some: np.ndarray) -> list[str]:
        """Groups of each part as text: all tokens in order, each with the mark that follows it."""
        side = np.repeat([0, 1], [len(x) for x in ids])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side, flat = group[order], side[order], np.concatenate(ids)[order]
        part = part_of[group]
        mark = np.full(len(flat), 3)
        mark[:-1] = np.where(part[1:] != part[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        said = iter("".join(map(self.said.__getitem__, (mark * self.width + flat).tolist())).split("\n"))
        return [next(said) if x else "" for x in some.tolist()]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many values each."""
    upto = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(sizes)
    return upto[end] - upto[end - sizes]


def _links(ids, ga, gb, groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids (A's in the upper half) of each group, how often each is linked there, and the group, in its order.

    Ids that come again in a group count first, so that a long run of one character is one pair.
    """
    sides = []
    for i, g in zip(ids, (ga, gb)):
        key, n = np.unique(g << 32 | i, return_counts=True)
        sides.append((key & 0xFFFFFFFF, n, np.searchsorted(key >> 32, np.arange(groups + 1))))
    (a, na, fa), (b, nb, fb) = sides
    da, db = np.diff(fa), np.diff(fb)
    sizes = da * db
    of = np.repeat(np.arange(groups), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = fa[of] + place // db[of], fb[of] + place % db[of]
    return a[i] << 32 | b[j], na[i] * nb[j], of


class Numbers(dict):
    """The number of each thing, by when it was first seen."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _expanded(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of parts, and how many each part has."""
    size = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum()), size


CHUNKS = f"chunk string, pairs array<long>, docs array<int>, data array<struct<doc_id: string, {DIGEST.replace(' long', ': long')}, groups_sha256: string, links: binary>>"
_DOC = pa.struct([("doc_id", pa.string()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary())])
NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "links": b""}


def _packed(link: np.ndarray, times: np.ndarray) -> bytes:
    """Link numbers, which ascend, and times; compressed."""
    import zstandard

    return zstandard.compress(np.diff(link, prepend=0).astype("<u4").tobytes() + times.astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    data = zstandard.decompress(data)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64), np.frombuffer(data, "<i8", n, 4 * n)


def _chunk(name: str, aligner: Aligner, ids: list, texts: list) -> pa.RecordBatch:
    """One row: the chunk's pairs, how many of its documents link each, and its documents with their links by number."""
    numbers = Numbers()
    parts = [list(map(numbers.__getitem__, parts_of(" " + t))) if t else [] for t in texts]
    p = aligner(list(numbers))
    pairs, at = np.unique(p.pairs, return_inverse=True)
    docs, rows = np.zeros(len(pairs), np.int32), []
    for doc, of in zip(ids, parts):
        row = {"doc_id": doc} | NOTHING
        own, n = np.unique(np.array(of, np.int64), return_counts=True)
        if len(own) and p.fits[own].all():
            row |= zip(("n_a", "n_b", "n_groups", "n_links"), (p.counts[own] * n[:, None]).sum(0).tolist())
            row["groups_sha256"] = hashlib.sha256(";".join([p.groups[i] for i in of]).encode()).hexdigest()
            place, size = _expanded(p.first, own)
            link, back = np.unique(at[place], return_inverse=True)
            times = np.zeros(len(link), np.int64)
            np.add.at(times, back, p.times[place] * np.repeat(n, size))
            docs[link] += 1
            row["links"] = _packed(link, times)
        rows.append(row)
    whole = [pa.array([name]), pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int32())), pa.array([rows], pa.list_(_DOC))]
    return pa.RecordBatch.from_arrays(whole, names=["chunk", "pairs", "docs", "data"])


def chunks(docs: DataFrame, a: str, pattern: str, b: str, identifier: str, text: str) -> DataFrame:
    """The rows ``CHUNKS`` of documents, some at a time."""

    def run(batches):
        from pyspark import TaskContext

        aligner = kept(("aligned", a, pattern, b), lambda: Aligner(a, pattern, b))
        part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK:
                    yield _chunk(f"{part}-{made}", aligner, ids, texts)
                    made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield _chunk(f"{part}-{made}", aligner, ids, texts)

    return docs.select(F.col(identifier).cast("string"), text).mapInArrow(run, CHUNKS)


def counted(made: DataFrame) -> DataFrame:
    """(pair, n, best) of chunks: how many documents link the pair, and whether that is its A id's highest."""
    each = made.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    each = each.where("n > 0").withColumn("a", F.shiftright("pair", 32))
    return each.join(each.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _finished(batches) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        for data, found in zip(batch.column(0), batch.column(1)):
            rows = data.values
            docs = {rows.type.field(i).name: rows.field(i) for i in range(rows.type.num_fields)}
            values = found.values
            at, n, best = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3)) if values is not None else (np.zeros(0, np.int64),) * 3
            count, highest = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64), np.zeros(int(at.max()) + 1 if len(at) else 0, bool)
            count[at], highest[at] = n, best
            n_best, total = [], []
            for packed in docs["links"].to_pylist():
                link, times = _unpacked(packed) if packed else (np.zeros(0, np.int64),) * 2
                n_best.append(int(times[highest[link]].sum()))
                total.append(int((times * count[link]).sum()))
            own = {**docs, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[x] for x in names], names=names)


def align(docs: DataFrame, a: str, pattern: str, b: str, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(identifier, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    ``a`` is the file of a byte-level tokenizer that cuts by ``pattern``, which gets the text with a space in front, ``b`` that of a
    sentencepiece model, which adds the space; special tokens' strings are plain text.  ``n_best`` counts the links
    whose pair is linked by as many documents as any pair of its A id, ``count_sum`` sums the documents over links.
    Null and empty texts, and those whose tokens' bytes are not the text's, have zeros and no groups.  Repeated rows
    are documents of their own, null identifiers too.  Other columns are left out, so none can clash; texts of any
    length are aligned whole; an empty table gives an empty table.
    """
    made = stored(chunks(docs, a, pattern, b, identifier, text), "aligned")
    named = made.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(counted(made), "pair")
    back = named.groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    rows = made.select("chunk", "data").join(back, "chunk", "left").select("data", "found")
    done = rows.mapInArrow(_finished, f"doc_id string, {DIGEST}, n_best long, count_sum long, groups_sha256 string")
    return done.select(F.col("doc_id").cast(docs.schema[identifier].dataType).alias(identifier), *done.columns[1:])
