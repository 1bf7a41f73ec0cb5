"""Media columns: payloads as AVI motion JPEG, and timed clip rows read back from it.

Each payload byte is one 8x8 block of constant brightness, stored by its DC coefficient alone (the
quantiser is 8, so DC = sample - 128 and nothing is lost). The Huffman table gives category s a code of
9 - s bits, so a DC difference with its s extra bits always takes 9 bits, and the end-of-block code one
more: frames are ordinary baseline JPEG, yet whole frames are coded as arrays. Frames are decoded by the tables that they carry: as
arrays where these make all blocks equally long, code by code with all coefficients otherwise, so that files of other encoders can be read. Files are RIFF AVI
with an idx1 index; the payload length stands in the INFO list, as frames have one size.

Shots: the brightness histograms of neighbouring frames are compared; a cut lies where the difference
exceeds the mean of the differences around it by `cut_sigmas` of their standard deviations.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 32
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")

#: Frames that are coded or decoded at once.
SLICE = 256

#: Category s of a DC difference: prefix of 8 - s ones and a zero, then s bits.
_CATEGORY = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])
_CODE = np.array([((((1 << (8 - s)) - 1) << 1) << s) | (d if d >= 0 else d + (1 << s) - 1) for d, s in zip(range(-255, 256), _CATEGORY, strict=True)], dtype=np.uint16) << 1
#: The order in which a JPEG block lists its coefficients, as places in the 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_header() -> bytes:
    quantiser = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quantiser + frame + dc + ac + scan


HEADER, END = _jpeg_header(), b"\xff\xd9"


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """One JPEG for each row of `frames` (n x FRAME bytes)."""
    dc = frames.astype(np.int16) - 128
    code = _CODE[np.diff(dc, axis=1, prepend=np.int16(0)) + 255]
    # Four 10-bit codes make five bytes.
    c = code.reshape(len(frames), FRAME // 4, 4).astype(np.uint64)
    word = (c[..., 0] << np.uint64(54)) | (c[..., 1] << np.uint64(44)) | (c[..., 2] << np.uint64(34)) | (c[..., 3] << np.uint64(24))
    packed = np.ascontiguousarray(word.astype(">u8").view(np.uint8).reshape(len(frames), -1, 8)[..., :5]).reshape(len(frames), -1)
    return [HEADER + p.tobytes().replace(b"\xff", b"\xff\x00") + END for p in packed]


@dataclass
class Tables:
    """What the segments before a frame's scan say."""

    scan: int  # where the coded bits begin
    height: int
    width: int
    parts: list[tuple[int, int, int]]  # of each component: samples across, samples down, quantiser
    coded: list[tuple[int, int]]  # of each component: DC and AC table
    quantisers: dict[int, np.ndarray]
    codes: dict[int, dict[tuple[int, int], int]]  # table (AC: 16 more) -> (length, code) -> symbol
    restart: int


def read_tables(image: bytes) -> Tables:
    """The tables of a baseline JPEG frame of one interleaved scan."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quantisers, codes, restart = 2, {}, {}, 0
    height = width = 0
    names: list[int] = []
    parts: list[tuple[int, int, int]] = []
    while True:
        while image[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                quantisers[number] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                code, place, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                codes[body[0]], body = table, body[place:]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            names = [body[6 + 3 * i] for i in range(body[5])]
            parts = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if list(chosen) != names:
                raise ValueError("only frames of one interleaved scan are decoded")
            return Tables(at, height, width, parts, list(chosen.values()), quantisers, codes, restart)


def even_codes(t: Tables) -> tuple[int, np.ndarray] | None:
    """(bits of a block, DC difference of each such code), if by the frame's tables every block of its one component takes the same bits: a DC difference and the end of block."""
    if len(t.parts) != 1 or t.restart:
        return None
    dc, ac = t.codes[t.coded[0][0]], t.codes[16 | t.coded[0][1]]
    bits = {length + symbol for (length, _), symbol in dc.items()}
    if len(bits) != 1 or set(ac.values()) != {0}:
        return None
    ((tail, end),) = ac
    size = bits.pop() + tail
    if size > 16:
        return None
    out = np.full(1 << size, np.iinfo(np.int32).min, dtype=np.int32)
    for (_, code), s in dc.items():
        raw = np.arange(1 << s)
        out[(((code << s) | raw) << tail) | end] = np.where(raw >> max(s - 1, 0) > 0, raw, raw - (1 << s) + 1) if s else 0
    return size, out


def decode_frame(image: bytes, t: Tables | None = None) -> list[np.ndarray]:
    """The samples of every component of a baseline frame, decoded by its own tables."""
    t = t or read_tables(image)
    across, down = max(h for h, _, _ in t.parts), max(v for _, v, _ in t.parts)
    if len(t.parts) == 1:
        across, down, parts = 1, 1, [(1, 1, t.parts[0][2])]
    else:
        parts = t.parts
    units = -(-t.width // (8 * across)), -(-t.height // (8 * down))
    planes = [np.zeros((units[1] * v * 8, units[0] * h * 8)) for h, v, _ in parts]
    cosines = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
    stretches = _RESTART.split(image[t.scan : image.rindex(b"\xff\xd9")])
    every = t.restart or units[0] * units[1]
    for s, stretch in enumerate(stretches):
        data = stretch.replace(b"\xff\x00", b"\xff")
        bits, left, at, before = int.from_bytes(data, "big"), 8 * len(data), 0, [0] * len(parts)

        def take(n: int) -> int:
            nonlocal at
            at += n
            return bits >> (left - at) & ((1 << n) - 1)  # noqa: B023

        def symbol(table: dict[tuple[int, int], int]) -> int:
            code = length = 0
            while (length, code) not in table:
                code, length = code << 1 | take(1), length + 1
                if length > 16:
                    raise ValueError("a code that no table has")
            return table[length, code]

        def value(n: int) -> int:
            raw = take(n)
            return raw if n and raw >> (n - 1) else raw - (1 << n) + 1

        for unit in range(s * every, min((s + 1) * every, units[0] * units[1])):
            y, x = divmod(unit, units[0])
            for c, (h, v, quantiser) in enumerate(parts):
                dc, ac = t.codes[t.coded[c][0]], t.codes[16 | t.coded[c][1]]
                for block in range(h * v):
                    listed = np.zeros(64)
                    n = symbol(dc)
                    before[c] += value(n) if n else 0
                    listed[0], place = before[c], 1
                    while place < 64:
                        run = symbol(ac)
                        if run == 0:
                            break
                        place += run >> 4
                        if run & 15:
                            listed[place] = value(run & 15)
                        place += 1
                    cells = np.zeros(64)
                    cells[ZIGZAG] = listed * t.quantisers[quantiser]
                    top, start = (y * v + block // h) * 8, (x * h + block % h) * 8
                    planes[c][top : top + 8, start : start + 8] = cosines.T @ cells.reshape(8, 8) @ cosines
    return [np.clip(np.rint(p + 128), 0, 255).astype(np.uint8) for p in planes]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The mean brightness of each 8 x 8 block of each frame: n x blocks. Frames of one header are decoded at once where its tables allow that."""
    out: list[np.ndarray] = []
    known: dict[bytes, tuple] = {}
    for image in images:
        head = image[: image.rindex(b"\xff\xda") + 4] if len(known) != 1 or not image.startswith(next(iter(known))) else next(iter(known))
        if head not in known:
            t = read_tables(image)
            known = {image[: t.scan]: (t, even_codes(t))}
            head = image[: t.scan]
        t, even = known[head]
        if even is None:
            plane = decode_frame(image, t)[0]
            out.append(np.rint(plane.reshape(plane.shape[0] // 8, 8, -1, 8).mean(axis=(1, 3))).astype(np.uint8).ravel())
            continue
        size, difference = even
        blocks = -(-t.width // 8) * -(-t.height // 8)
        data = np.frombuffer(image[t.scan : -2].replace(b"\xff\x00", b"\xff"), np.uint8)
        bit = np.arange(blocks) * size
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        word = wide[bit >> 3] << 16 | wide[(bit >> 3) + 1] << 8 | wide[(bit >> 3) + 2]
        step = difference[word >> (24 - size - (bit & 7)).astype(np.uint32) & ((1 << size) - 1)]
        if step.min() == np.iinfo(np.int32).min:
            raise ValueError("a code that no table has")
        out.append(np.clip(np.rint(np.cumsum(step) * t.quantisers[t.parts[0][2]][0] / 8 + 128), 0, 255).astype(np.uint8))
    return np.stack(out)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of one motion-JPEG stream that holds `payload` (at least one byte)."""
    n = -(-len(payload) // FRAME)
    images = []
    for at in range(0, n, SLICE):
        part = payload[at * FRAME : (at + SLICE) * FRAME]
        rows = -(-len(part) // FRAME)
        images += encode_frames(np.frombuffer(part.ljust(rows * FRAME, b"\0"), np.uint8).reshape(rows, FRAME))
    width = SIDE * 8
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, max(map(len, images)), width, width, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, n, max(map(len, images)), -1, 0, 0, 0, width, width)
    form = struct.pack("<IiiHH4sIiiII", 40, width, width, 1, 8, b"MJPG", width * width, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"%d" % len(payload)))
    movie, index, at = [b"movi"], [], 4
    for image in images:
        body = _chunk(b"00dc", image)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movie.append(body)
        at += len(body)
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[bytes, np.ndarray]:
    """(payload, block brightness of each frame) of an AVI file, found by its chunk tree and its index.

    The payload is what write_avi stored; files without its length give all samples. Index offsets count from the list's name or from the file's start; both are met.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, length, index = 12, 0, -1, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movie = at + 8
        elif name == b"LIST" and kind == b"INFO" and media[at + 12 : at + 16] == b"ICMT":
            length = int(media[at + 20 : at + 20 + int.from_bytes(media[at + 16 : at + 20], "little")])
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    entries = [(o, n) for name, _, o, n in struct.iter_unpack("<4sIII", index) if name[2:] in (b"dc", b"db") and n]
    if entries and media[movie + entries[0][0] : movie + entries[0][0] + 4][2:] not in (b"dc", b"db"):
        movie = 0
    frames = [decode_frames([media[movie + o + 8 : movie + o + 8 + n] for o, n in entries[at : at + SLICE]]) for at in range(0, len(entries), SLICE)]
    frames = np.concatenate(frames) if frames else np.empty((0, 0), np.uint8)
    return frames.tobytes()[: length if length >= 0 else None], frames


def clips(frames: np.ndarray, bins: int = BINS, around: int = 8, cut_sigmas: float = 2.0) -> list[tuple[int, int]]:
    """[first, last) frame numbers of each shot."""
    n = len(frames)
    if n < 3:
        return [(0, n)] if n else []
    counted = lambda x: np.bincount((np.arange(len(x))[:, None] * bins + x // (256 // bins)).ravel(), minlength=len(x) * bins).reshape(-1, bins)
    histogram = np.concatenate([counted(frames[at : at + SLICE]) for at in range(0, n, SLICE)])
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    total = np.concatenate([[0], np.cumsum(change)])
    square = np.concatenate([[0], np.cumsum(change**2)])
    low, high = np.maximum(np.arange(n - 1) - around, 0), np.minimum(np.arange(n - 1) + around + 1, n - 1)
    m = high - low
    mean = (total[high] - total[low]) / m
    deviation = np.sqrt(np.maximum(0, (square[high] - square[low]) / m - mean**2))
    cuts = [0, *(np.flatnonzero((change > mean + cut_sigmas * deviation) & (change > 0.02)) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes, those bytes followed by zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as AVI, read the stored bytes back, and describe what was read.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips).
    A null text counts as empty and is stored as 64 zero bytes. Repeated rows give repeated results. Long texts are coded and decoded
    by slices of frames; a task holds a few times the bytes of one text. Other columns are not read. An empty table gives an empty result.
    `clips` lists the shots with their times in milliseconds; `feature` sums them up.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("brightness", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                n_bytes, payload = payload_of(batch.column(1)[i].as_py())
                media = write_avi(payload)
                back, frames = read_avi(media)
                shots = clips(frames)
                rows = [{"clip": j, "start_ms": a * 1000 // FPS, "end_ms": b * 1000 // FPS, "brightness": round(float(frames[a:b].mean()), 3)} for j, (a, b) in enumerate(shots)]
                feature = f"mjpeg {len(frames)} frames, {len(shots)} clips, longest {max(b - a for a, b in shots)}, brightness {frames.mean():.3f}"
                values = (batch.column(0)[i].as_py(), n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, rows)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "clips array<struct<clip: int, start_ms: long, end_ms: long, brightness: double>>",
    )
