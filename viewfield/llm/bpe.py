"""Byte-level BPE encoding and decoding, exact merges in linear time.

The bytes of a piece, seen as Latin-1, run through a pyahocorasick automaton of all vocabulary entries.
From the longest match at each place the search goes to shorter ones and steps back where two neighbours
could not stand side by side in the result of the merges.  Whether two entries may is memoised: they may
iff merging their joined bytes by rank gives exactly the two.  Each prefix of a piece has one encoding
only, so a place that was left once is never tried again and the search is linear.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept

#: Bytes that a worker keeps of words with their ids, twice; the longest word kept, in characters; an entry's bytes beside its text.
CACHE_BYTES, LONG, ENTRY_BYTES = 48 << 20, 100, 200
#: Pairs of entries that a worker keeps.
PAIRS = 250_000
#: Bytes of input after which a batch is handed on.
BATCH_BYTES = 4 << 20


class Merges:
    """A vocabulary of ranks with its automaton; one for each worker process and file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in pairs}
        self.bytes = {b: a.encode("latin-1") for a, b in self.rank.items()}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, Words] = {}  # by pattern
        entries = {x for x in self.rank if self.merged(x) == [x]}  # the others only stand for a whole piece
        self.automaton = ahocorasick.Automaton()
        self.length, self.shorter = {}, {}  # by id; shorter: the longest other entry that an entry starts with
        for entry in entries:
            i = self.rank[entry]
            self.automaton.add_word(entry, (len(entry), i))
            self.length[i] = len(entry)
            self.shorter[i] = next((self.rank[entry[:n]] for n in range(len(entry) - 1, 0, -1) if entry[:n] in entries), -1)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges as defined: join the neighbours of lowest rank, leftmost first, till none can be."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, left: int, right: int) -> bool:
        """Do the merges leave the two as neighbours?  Asked once for each pair."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = (self.bytes[x].decode("latin-1") for x in (left, right))
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        text = piece.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        size, length, pairs = len(text), self.length, self.pairs
        longest = [-1] * size  # by the place where an entry starts; of one start, the longest ends last
        for end, (n, entry) in self.automaton.iter(text):
            longest[end + 1 - n] = entry
        out: list[int] = []
        left = bytearray(size + 1)  # places that no encoding can pass through
        at = 0
        while at < size:
            entry = longest[at]
            while entry >= 0:
                if not left[at + length[entry]]:
                    if not out:
                        break
                    fits = pairs.get(out[-1] << 32 | entry)
                    if self.side_by_side(out[-1], entry) if fits is None else fits:
                        break
                entry = self.shorter[entry]
            if entry >= 0:
                out.append(entry)
                at += length[entry]
            elif out:
                left[at] = 1
                at -= length[out.pop()]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out


#: Marks that are a match of the pattern by themselves.
_ENDS = (".", ",", ";", ":", "!", "?")


class Words(dict):
    """Packed ids by text.  ``encode`` gives the ids of many texts as packed integers.

    A text is cut before each space that follows a non-space: no match of the pattern reaches across such a
    place, so the parts can be encoded one by one, and parts that come again are looked up.  Two generations
    are kept, each up to ``CACHE_BYTES``: what was used since the last change of generation survives the next
    one.  Parts of more than ``LONG`` characters are not kept.
    """

    def __init__(self, pieces: Callable[[str], list[str]], ids: Callable[[str], bytes]):
        self.pieces, self.ids, self.old, self.held = pieces, ids, {}, 0

    def __missing__(self, part: str) -> bytes:
        known = self.old.get(part)
        if known is None:
            word = part[1:] if part[0] == " " else part
            if word.isalpha():  # one match of the pattern
                known = self.ids(part)
            elif word[-1:] in _ENDS and word[:-1].isalpha():  # two
                known = self[part[:-1]] + self[part[-1]]
            else:
                cut = self.pieces(part)
                known = self.ids(part) if len(cut) == 1 else b"".join(map(self.__getitem__, cut))
        if len(part) <= LONG:
            self[part] = known
            self.held += len(part) + len(known) + ENTRY_BYTES
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.held > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            out.append(b"".join(map(self.__getitem__, parts_of(text))))
        return out


#: White space before a space: there the text can't be cut.
_BEFORE = tuple(chr(c) + " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_ASCII = _BEFORE[:10]


def parts_of(text: str) -> list[str]:
    """Cut before each space after a non-space; joined, the parts are the text."""
    if not text:
        return []
    if text[0] != " " and "\0" not in text and not any(x in text for x in (_ASCII if text.isascii() else _BEFORE)):
        return text.replace(" ", "\0 ").split("\0")
    parts = text.split(" ")
    out = [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if before and not before[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


def _merges(path: str) -> Merges:
    return kept(("merges", path), lambda: Merges(path))


def _words(path: str, pattern: str) -> Words:
    import regex

    merges = _merges(path)
    if pattern not in merges.words:
        merges.words[pattern] = Words(regex.compile(pattern).findall, lambda piece: array("I", merges.piece(piece.encode())).tobytes())
    return merges.words[pattern]


def in_slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, list]]:
    """Ranges of rows of about ``most`` bytes, one row at least, with their values."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i == len(sizes) - 1:
            yield first, i + 1, column.slice(first, i + 1 - first).to_pylist()
            first, size = i + 1, 0


def _added(df: DataFrame, of: str, names: list[str], work: Callable[[list], list[list]]) -> DataFrame:
    """``df`` with binary columns ``names`` that ``work`` makes of column ``of``, some rows at a time."""
    df = df.drop(*names)

    def run(batches):
        for batch in batches:
            for a, b, values in in_slices(batch.column(batch.schema.get_field_index(of))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.binary()) for x in work(values))], names=[*part.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, T.BinaryType()) for name in names)]))


def _ids(vocabulary: str, pattern: str, texts: list) -> list[bytes]:
    return _words(vocabulary, pattern).encode([t or "" for t in texts])


def _decoded(vocabulary: str, ids: list) -> list[bytes]:
    get = _merges(vocabulary).bytes.__getitem__
    return [b"".join(map(get, memoryview(v or b"").cast("I"))) for v in ids]


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids.  A column named ``ids`` is replaced; other columns pass unchanged.
    Equal texts get equal ids; an empty table gives an empty table.
    """
    return _added(df, text, [ids], lambda texts: [_ids(vocabulary, pattern, texts)])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that the packed ids stand for; null ids give no bytes."""
    return _added(df, ids, [decoded], lambda values: [_decoded(vocabulary, values)])


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its packed ids, in one pass over the rows; nulls and clashes as there."""

    def work(texts):
        packed = _ids(vocabulary, pattern, texts)
        return [packed, _decoded(vocabulary, packed)]

    return _added(df, text, [ids, decoded], work)
