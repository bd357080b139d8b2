"""Bytes stored as motion-JPEG in AVI containers, read back, and cut into clips.

A payload becomes frames of 24 x 24 grey samples.  Each frame is one JPEG image of the lossless process
(SOF3, first-order prediction from the left), an intra frame, so the samples come back exactly; the baseline
process would round them.  Frames stand in a RIFF AVI file as ``00dc`` chunks with an ``idx1`` index.
Reading parses the RIFF chunks and the index, decodes the frames, and finds shots where the distance between
the histograms of neighbouring frames exceeds a threshold that adapts to the file's own distances.  Frames of
other makers' files, of the baseline process, are decoded as far as their brightness; such files have clips
but no payload.  A file that can't be read has neither, and says why.

Frames of many files are coded at once, sample by sample across frames, so the work is vectorised; of a long
file, some frames at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import in_slices

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Histogram bins, and how many mean absolute deviations above the mean distance a cut lies.
BINS, DEVIATIONS = 16, 3.0
#: Payload bytes that are taken together, and frames that are coded together.
SLICE_BYTES, TOGETHER = 4 << 20, 4096
#: Bits of the Huffman code of a difference by its category 0 to 8, short for those that prose has.
CODE_BITS = np.array([3, 4, 4, 3, 2, 4, 5, 2, 6], np.int64)
PEEK_BITS = int(CODE_BITS.max())


def _codes() -> tuple[np.ndarray, bytes]:
    """Canonical codes by category, and the DHT segment that states them."""
    order = sorted(range(9), key=lambda k: (CODE_BITS[k], k))
    codes, code, before = np.zeros(9, np.int64), 0, int(CODE_BITS[order[0]])
    for k in order:
        code <<= int(CODE_BITS[k]) - before
        before = int(CODE_BITS[k])
        codes[k] = code
        code += 1
    counts = bytes(int((CODE_BITS == n).sum()) for n in range(1, 17))
    return codes, b"\xff\xc4" + struct.pack(">H", 2 + 1 + 16 + 9) + b"\0" + counts + bytes(order)


CODES, DHT = _codes()
HEAD = b"\xff\xd8\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0) + DHT + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
TAIL = b"\xff\xd9"


def _peek() -> np.ndarray:
    """By the next ``PEEK_BITS`` bits: the category and the bits of its code."""
    out = np.tile(np.array([0, PEEK_BITS]), (1 << PEEK_BITS, 1))
    for k, (code, n) in enumerate(zip(CODES.tolist(), CODE_BITS.tolist())):
        out[code << (PEEK_BITS - n) : (code + 1) << (PEEK_BITS - n)] = k, n
    return out


PEEK = _peek()
CATEGORY = np.ceil(np.log2(np.arange(256) + 1)).astype(np.int64)


def _packed(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bytes of words of up to 57 bits, the first bit highest; they sum up in lanes of 32 bits without carry."""
    at = np.cumsum(bits)
    total, at = int(at[-1]), at - bits
    lane, shift = at >> 5, (96 - (at & 31) - bits).astype(np.uint64)
    size, low = (total + 31) // 32 + 3, np.uint64(0xFFFFFFFF)
    parts = []
    for k in (64, 32, 0):
        k = np.uint64(k)
        parts.append(np.where(shift >= k, words << (np.maximum(shift, k) - k), words >> (k - np.minimum(shift, k))) & low)
    lanes = sum(np.bincount(lane + k, weights=x, minlength=size + 3)[:size] for k, x in enumerate(parts))
    return lanes.astype(np.uint32).astype(">u4").view(np.uint8)[: (total + 7) // 8]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames (n, 24, 24) of unsigned 8-bit samples."""
    return [image for a in range(0, len(samples), TOGETHER) for image in _encoded(samples[a : a + TOGETHER])]


def _encoded(samples: np.ndarray) -> list[bytes]:
    n = len(samples)
    x = samples.astype(np.int16)
    d = np.empty((n, SIDE, SIDE), np.int16)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(-1)
    size = CATEGORY[np.abs(d)]
    extra = np.where(d < 0, d - 1, d) & ((1 << size) - 1)
    bits = (CODE_BITS[size] + size).reshape(n, -1)
    words = (CODES[size] << size | extra).reshape(n, -1)
    for _ in range(2):  # four samples a word
        words = words[:, ::2] << bits[:, 1::2] | words[:, 1::2]
        bits = bits[:, ::2] + bits[:, 1::2]
    bits = np.concatenate([bits, -bits.sum(1, keepdims=True) % 8], 1)  # ones up to a whole byte
    words = np.concatenate([words, (1 << bits[:, -1:]) - 1], 1)
    flow = _packed(words.reshape(-1).astype(np.uint64), bits.reshape(-1))
    ends = np.cumsum(bits.sum(1)) // 8
    full = flow == 255  # a zero byte goes after each
    shift = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(len(flow) + int(shift[-1]), np.uint8)
    out[np.arange(len(flow)) + shift[:-1]] = flow
    ends = (ends + shift[ends]).tolist()
    data = out.tobytes()
    return [HEAD + data[a:b] + TAIL for a, b in zip([0, *ends], ends)]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """Samples (n, 24, 24) of JPEG images that ``encode_frames`` made; a ValueError if one is damaged."""
    return np.concatenate([np.empty((0, SIDE, SIDE), np.uint8), *(_decoded(images[a : a + TOGETHER]) for a in range(0, len(images), TOGETHER))])


def _decoded(images: list[bytes]) -> np.ndarray:
    n = len(images)
    for image in images:
        if not image.startswith(HEAD) or not image.endswith(TAIL):
            raise ValueError("a frame has another header")
    flows = [image[len(HEAD) : -len(TAIL)].replace(b"\xff\0", b"\xff") + b"\0\0\0\0" for image in images]
    flow = np.frombuffer(b"".join(flows), np.uint8).astype(np.int64)
    ends = np.cumsum([len(f) for f in flows]) * 8
    at = np.concatenate([[0], ends[:-1]])
    flow = flow[:-2] << 16 | flow[1:-1] << 8 | flow[2:]  # three bytes from each place on
    out = np.empty((SIDE, SIDE, n), np.int64)
    for row in range(SIDE):
        for col in range(SIDE):
            window = flow[np.minimum(at >> 3, len(flow) - 1)] << (at & 7) & 0xFFFFFF
            category, length = PEEK[window >> (24 - PEEK_BITS)].T
            value = window >> (24 - length - category) & ((1 << category) - 1)
            value -= np.where(value < (1 << category >> 1), (1 << category) - 1, 0)
            at += length + category
            out[row, col] = value + (out[row, col - 1] if col else out[row - 1, 0] if row else 128)
    left = ends - 32 - at
    if ((left < 0) | (left > 7)).any() or out.min() < 0 or out.max() > 255:
        raise ValueError("a frame is damaged")
    return out.transpose(2, 0, 1).astype(np.uint8)


#: The order in which a block's coefficients are stored, by rows and columns.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))]
#: Rows are frequencies, columns places.
COSINES = np.array([[(0.125**0.5 if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


def _table(counts: bytes, values: bytes) -> np.ndarray:
    """By the next 16 bits: a Huffman code's value and its length."""
    out, code, k = np.zeros((1 << 16, 2), np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = values[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0" * 8, 0, len(data) * 8

    def peek(self, n: int) -> int:
        if self.at > self.size:
            raise ValueError("a frame ends too early")
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4]) << (self.at & 7) >> (32 - n) & ((1 << n) - 1)

    def value(self, table: np.ndarray) -> int:
        value, n = table[self.peek(16)]
        if not n:
            raise ValueError("a frame has an unknown code")
        self.at += int(n)
        return int(value)

    def signed(self, n: int) -> int:
        if not n:
            return 0
        x = self.peek(n)
        self.at += n
        return x if x >> (n - 1) else x - (1 << n) + 1


def brightness(image: bytes) -> np.ndarray:
    """The first component's samples (rows, columns) of an image of the baseline process.

    Images of other processes, without tables of their own, or damaged, raise a ValueError.
    """
    if image[:2] != b"\xff\xd8":
        raise ValueError("a frame is no JPEG image")
    at, quant, codes, parts, restart = 2, {}, {}, [], 0
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4])
        data, at = image[at + 4 : at + 2 + size], at + 2 + size
        if size < 2 or at > len(image):
            raise ValueError("a frame's header is damaged")
        if marker == 0xDB:
            while data:
                wide = data[0] >> 4
                quant[data[0] & 15] = np.frombuffer(data[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(float)
                data = data[65 + 64 * wide :]
        elif marker == 0xC4:
            while data:
                n = sum(data[1:17])
                codes[data[0]] = _table(data[1:17], data[17 : 17 + n])
                data = data[17 + n :]
        elif marker in (0xC0, 0xC1):
            high, wide, parts = int.from_bytes(data[1:3]), int.from_bytes(data[3:5]), [[*data[6 + 3 * k : 9 + 3 * k]] for k in range(data[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("a frame is of another process")
        elif marker == 0xDD:
            restart = int.from_bytes(data[:2])
        elif marker == 0xDA:
            break
    scan = {data[1 + 2 * k]: data[2 + 2 * k] for k in range(data[0])}
    if not parts or set(scan) != {p[0] for p in parts} or not all(p[2] in quant and scan[p[0]] >> 4 in codes and scan[p[0]] & 15 | 16 in codes for p in parts):
        raise ValueError("a frame lacks tables")
    across = [(p[1] >> 4, p[1] & 15) for p in parts] if len(parts) > 1 else [(1, 1)]
    units = -(-wide // (8 * max(h for h, _ in across))) * -(-high // (8 * max(v for _, v in across)))
    columns = -(-wide // (8 * max(h for h, _ in across)))
    h, v = across[0]
    blocks = np.zeros((units // columns * v, columns * h, 64))
    flows = iter([_Bits(x.replace(b"\xff\0", b"\xff")) for x in _between(image[at:])])
    bits, last = next(flows), [0] * len(parts)
    for unit in range(units):
        if restart and unit and unit % restart == 0:
            bits, last = next(flows, _Bits(b"")), [0] * len(parts)
        for k, (part, (x, y)) in enumerate(zip(parts, across)):
            direct, others = codes[scan[part[0]] >> 4], codes[scan[part[0]] & 15 | 16]
            for i in range(x * y):
                last[k] += bits.signed(bits.value(direct))
                block, n = [(0, last[k])], 1
                while n < 64:
                    run = bits.value(others)
                    if run & 15 == 0 and run != 0xF0:
                        break
                    n += run >> 4
                    if n > 63:
                        raise ValueError("a frame is damaged")
                    block.append((n, bits.signed(run & 15)))
                    n += 1
                if k == 0:
                    to = blocks[unit // columns * v + i // h, unit % columns * h + i % h]
                    for n, value in block:
                        to[ZIGZAG[n]] = value * quant[part[2]][n]
    rows, cols = blocks.shape[:2]
    plane = np.einsum("ku,rckl,lv->rucv", COSINES, blocks.reshape(rows, cols, 8, 8), COSINES).reshape(rows * 8, cols * 8)
    return np.clip(np.rint(plane[:high, :wide] + 128), 0, 255).astype(np.uint8)


def _between(data: bytes) -> list[bytes]:
    """The coded parts between restart markers, up to the next other marker."""
    out, first, at = [], 0, data.find(b"\xff")
    while 0 <= at < len(data) - 1:
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return [*out, data[first:at]]
        if data[at + 1]:
            out.append(data[first:at])
            first = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[first:]]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def mux(images: list[bytes]) -> bytes:
    """An AVI file of motion-JPEG frames with its index."""
    top = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, top * FPS, 0, 0x10, len(images), 0, 1, top, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(images), top, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for image in images:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movi.append(_chunk(b"00dc", image))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def demux(data: bytes) -> tuple[list[bytes], float]:
    """The frames that a file's index lists, or without an index those of its ``movi`` list, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, end, index, fps = 12, None, 0, b"", FPS
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi, end = at + 8, at + 8 + size
        elif name == b"LIST" and (head := data.find(b"avih", at, at + 8 + size)) >= 0 and head + 12 <= len(data):
            fps = 1_000_000 / (struct.unpack_from("<I", data, head + 8)[0] or 1_000_000 // FPS)
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size - size % 16]
        at += 8 + size + size % 2
    if movi is None or end > len(data):
        raise ValueError("the file has no frames or is cut off")
    if not index:
        at = movi + 4
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            index += struct.pack("<4sIII", name, 0, at - movi, size)
            at += 8 + size + size % 2
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            at = offset if data[offset : offset + 4] == name and data[movi + offset : movi + offset + 4] != name else movi + offset  # some count from the file's start
            if at + 8 + size > len(data):
                raise ValueError("a frame lies outside the file")
            frames.append(data[at + 8 : at + 8 + size])
    if not frames:
        raise ValueError("the file has no frames or is cut off")
    return frames, fps


def _cuts(h: np.ndarray) -> list[int]:
    """First frames of shots, of histograms by frame."""
    distance = np.abs(np.diff(h, axis=0)).sum(1)
    if not len(distance):
        return [0]
    mean = distance.mean()
    limit = mean + DEVIATIONS * np.abs(distance - mean).mean()
    return [0, *(np.flatnonzero(distance > limit) + 1).tolist()]


def shots(samples: np.ndarray) -> list[int]:
    """First frames of shots: 0, and each whose histogram is further from the one before than usual here."""
    n = len(samples)
    at = np.arange(n).repeat(FRAME) * BINS + (samples.reshape(-1) >> 4)
    return _cuts(np.bincount(at, minlength=n * BINS).reshape(n, BINS))


def opened(files: list[bytes | None]) -> list[tuple]:
    """(payload, first frames of shots, frames, frames a second, error) of each file; null gives nulls."""
    parts = []
    for f in files:
        try:
            parts.append(None if f is None else demux(f))
        except (ValueError, struct.error) as e:
            parts.append(str(e))
    own = [isinstance(p, tuple) and all(i.startswith(HEAD) for i in p[0]) for p in parts]
    try:
        samples = decode_frames([i for p, mine in zip(parts, own) if mine for i in p[0]])
    except ValueError:
        samples = None  # some frame is damaged: one file at a time
    out, first = [], 0
    for p, mine in zip(parts, own):
        if not isinstance(p, tuple):
            out.append((None, None, 0, 0.0, p))
            continue
        try:
            if mine:
                x = decode_frames(p[0]) if samples is None else samples[first : first + len(p[0])]
                first += len(p[0])
                out.append((x.tobytes(), shots(x), len(p[0]), p[1], None))
            else:
                h = np.array([np.bincount((x := brightness(i)).reshape(-1) >> 4, minlength=BINS) / x.size for i in p[0]])
                out.append((None, _cuts(h), len(p[0]), p[1], None))
        except (ValueError, IndexError, KeyError) as e:
            out.append((None, None, 0, 0.0, str(e) or "a frame is damaged"))
    return out


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replace column ``text`` by ``media``: an AVI file for each whole text.

    Null is as empty: one frame of bytes 255.  Texts in UTF-8 are padded with bytes 255, never valid there, to
    a positive multiple of 576.  A column named ``media`` is replaced, others pass.
    """
    kept = [c for c in df.columns if c not in (text, media)]

    def run(batches):
        for batch in batches:
            for a, b, texts in in_slices(batch.column(len(kept)), SLICE_BYTES):
                payloads = [padded((t or "").encode()) for t in texts]
                images = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE))
                files, first = [], 0
                for p in payloads:
                    files.append(mux(images[first : first + len(p) // FRAME]))
                    first += len(p) // FRAME
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(files, pa.binary())], names=[*kept, media])

    return df.select(*kept, text).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(media, T.BinaryType())]))


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``payload`` (the stored bytes), ``clips`` (timed shots) and ``error`` of each AVI file.

    Null media gives nulls.  A file of baseline frames has no payload, one that can't be read has an error and
    no more.  Columns of these names are replaced; equal files give equal values; an empty table an empty one.
    """
    added = ["payload", "clips", "error"]
    kept = [c for c in df.columns if c not in added]
    clip = pa.list_(pa.struct([("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches):
        for batch in batches:
            for a, b, files in in_slices(batch.column(kept.index(media)), SLICE_BYTES):
                payloads, clips, errors = [], [], []
                for payload, cuts, n, fps, error in opened(files):
                    payloads.append(payload)
                    clips.append(None if cuts is None else [{"first_frame": x, "frames": y - x, "start_s": x / fps, "end_s": y / fps} for x, y in zip(cuts, [*cuts[1:], n])])
                    errors.append(error)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(clips, clip), pa.array(errors, pa.string())], names=[*kept, *added])

    schema = T.StructType([*(df.schema[c] for c in kept)]).add("payload", "binary").add("clips", T.DataType.fromDDL("array<struct<first_frame:int,frames:int,start_s:double,end_s:double>>")).add("error", "string")
    return df.select(*kept).mapInArrow(run, schema)


def clip_rows(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a clip: key, clip, first_frame, frames, start_s, end_s."""
    return stored.selectExpr(key, "posexplode(clips) as (clip, c)").select(key, "clip", "c.*")
