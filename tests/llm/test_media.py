import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media, registry

from .helpers import DOCS, FOLDER, sf_documents, tricky


def slow_jpeg(image):
    """A bit-by-bit baseline decoder of one component: the mean brightness of each 8x8 block."""
    at, tables, quantiser = 2, {}, None
    while True:
        marker, size = image[at + 1], struct.unpack(">H", image[at + 2 : at + 4])[0]
        body = image[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quantiser = body[1]
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            code, values, table = 0, iter(body[17:]), {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = next(values)
                    code += 1
                code <<= 1
            tables[body[0]] = table
        at += 2 + size
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in image[at:-2].replace(b"\xff\x00", b"\xff"))
    place = 0

    def symbol(table):
        nonlocal place
        code = length = 0
        while (length, code) not in table:
            code, length, place = code << 1 | int(bits[place]), length + 1, place + 1
        return table[length, code]

    out, dc = [], 0
    for _ in range(height * width // 64):
        n = symbol(tables[0x00])
        if n:
            raw = int(bits[place : place + n], 2)
            place += n
            dc += raw if raw >> (n - 1) else raw - (1 << n) + 1
        assert symbol(tables[0x10]) == 0
        out.append(dc * quantiser / 8 + 128)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_round_trip(payload):
    back, frames = media.read_avi(media.write_avi(payload))
    assert back == payload and len(frames) == -(-len(payload) // media.FRAME)


def test_frames_are_baseline_jpeg():
    rng = np.random.default_rng(1)
    for frame in (rng.integers(0, 256, media.FRAME, dtype=np.uint8), np.tile([0, 255], media.FRAME // 2).astype(np.uint8), np.zeros(media.FRAME, np.uint8)):
        image = media.encode_frames(frame[None])[0]
        assert slow_jpeg(image) == frame.tolist()
        assert b"\xff" not in image[len(media.HEADER) : -2].replace(b"\xff\x00", b"")


def test_index_points_at_frames():
    data = media.write_avi(bytes(range(256)) * 9)
    at = data.index(b"idx1")
    movie = data.index(b"movi")
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[at + 8 :]):
        assert data[movie + offset : movie + offset + 4] == name == b"00dc"
        assert struct.unpack("<I", data[movie + offset + 4 : movie + offset + 8])[0] == size
    assert struct.unpack("<I", data[4:8])[0] == len(data) - 8


def foreign_jpeg(planes, sampling, restart=0):
    """A slow encoder of another layout: three components, all coefficients, uneven code lengths, comments, restarts. Returns (image, planes as they come back)."""
    cosines = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    quantiser = np.arange(1, 65) // 4 + 3
    height, width = planes[0].shape
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    units = [(y, x) for y in range(height // (8 * down)) for x in range(width // (8 * across))]
    listed, back = [], [np.zeros(p.shape) for p in planes]
    for y, x in units:
        for c, (h, v) in enumerate(sampling):
            for b in range(h * v):
                at = np.s_[(y * v + b // h) * 8 : (y * v + b // h) * 8 + 8, (x * h + b % h) * 8 : (x * h + b % h) * 8 + 8]
                q = np.rint((cosines @ (planes[c][at] - 128.0) @ cosines.T).ravel()[media.ZIGZAG] / quantiser).astype(int)
                cells = np.zeros(64)
                cells[media.ZIGZAG] = q * quantiser
                back[c][at] = cosines.T @ cells.reshape(8, 8) @ cosines
                listed.append((c, q.tolist()))
    per_unit, stream, before, symbols = sum(h * v for h, v in sampling), [], [0] * len(planes), [set(), set()]
    for i, (c, q) in enumerate(listed):
        if restart and i and i % (restart * per_unit) == 0:
            before = [0] * len(planes)
            stream.append(None)
        number = lambda x: (abs(x).bit_length(), x if x >= 0 else x + (1 << abs(x).bit_length()) - 1)
        n, raw = number(q[0] - before[c])
        before[c], run = q[0], 0
        stream.append((0, n, n, raw))
        last = max((k for k in range(64) if q[k]), default=0)
        for x in q[1 : last + 1] if last else []:
            if x == 0:
                run += 1
                continue
            while run > 15:
                stream.append((1, 0xF0, 0, 0))
                run -= 16
            n, raw = number(x)
            stream.append((1, run << 4 | n, n, raw))
            run = 0
        if last < 63:
            stream.append((1, 0, 0, 0))
    for item in stream:
        if item:
            symbols[item[0]].add(item[1])
    tables, heads = [], b""
    for kind in (0, 1):  # lengths 2, 4, 8, ... : a prefix code of very uneven lengths
        ordered = sorted(symbols[kind])
        table, code, counts = {}, 0, [0] * 16
        for i, s in enumerate(ordered):
            length = 3 if i < 3 else 9 if i < 60 else 14
            code <<= length - (table[ordered[i - 1]][0] if i else length)
            table[s], counts[length - 1] = (length, code), counts[length - 1] + 1
            code += 1
        tables.append(table)
        heads += segment(0xC4, bytes([kind << 4, *counts, *ordered]))
    bits, coded, stops = "", b"", 0
    flush = lambda b: int((b + "1" * (-len(b) % 8)) or "0", 2).to_bytes(-(-len(b) // 8), "big").replace(b"\xff", b"\xff\x00")
    for item in stream:
        if item is None:
            coded += flush(bits) + bytes([0xFF, 0xD0 + stops % 8])
            bits, stops = "", stops + 1
            continue
        kind, s, n, raw = item
        length, code = tables[kind][s]
        bits += f"{code:0{length}b}" + (f"{raw:0{n}b}" if n else "")
    frame = segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 1]) for i, (h, v) in enumerate(sampling)))
    scan = segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    head = segment(0xE0, b"JFIF\0") + segment(0xFE, b"note") + segment(0xDB, bytes([1, *quantiser.tolist()])) + heads
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    return b"\xff\xd8" + head + frame + scan + coded + flush(bits) + b"\xff\xd9", [np.clip(np.rint(p + 128), 0, 255) for p in back]


def test_frames_of_another_encoder():
    rng = np.random.default_rng(5)
    smooth = lambda shape: np.clip(np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) + rng.integers(-20, 20, shape), 0, 255)
    for sampling, shapes, restart in (([(1, 1)], [(16, 24)], 0), ([(2, 2), (1, 1), (1, 1)], [(32, 48), (16, 24), (16, 24)], 0), ([(2, 1), (1, 1), (1, 1)], [(16, 32), (16, 16), (16, 16)], 1)):
        image, want = foreign_jpeg([smooth(s) for s in shapes], sampling, restart)
        got = media.decode_frame(image)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        blocks = np.rint(got[0].reshape(shapes[0][0] // 8, 8, -1, 8).mean(axis=(1, 3))).astype(int)
        assert media.decode_frames([image, image])[1].tolist() == blocks.ravel().tolist()


def test_zigzag_is_the_known_order():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64)) and media.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_file_of_another_layout():
    """Offsets from the start of the file, junk chunks, no length, frames of two encoders."""
    images = [foreign_jpeg([np.full((16, 16), b)], [(1, 1)])[0] for b in (30, 31, 30, 220, 221)]
    chunk = media._chunk
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56))) + chunk(b"JUNK", b"x" * 7)
    movie, index, at = b"movi", b"", 12 + len(head) + 12
    for image in images:
        index += struct.pack("<4sIII", b"00dc", 0x10, at, len(image))
        movie += chunk(b"00dc", image) + chunk(b"01wb", b"abc")
        at += len(chunk(b"00dc", image)) + len(chunk(b"01wb", b"abc"))
    data = chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", movie) + chunk(b"idx1", index))
    _, frames = media.read_avi(data)
    assert frames.shape == (5, 4) and media.clips(frames, around=1, cut_sigmas=0.5)[0] == (0, 3)


def test_long_text(spark):
    text = "long é " * 400_000
    r = media.media_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    raw = text.encode()
    payload = raw.ljust(-(-len(raw) // 64) * 64, b"\0")
    assert (r["n_bytes"], r["payload_sha256"]) == (len(raw), hashlib.sha256(payload).hexdigest())


def test_shots_at_changes():
    frames = np.concatenate([np.full((10, media.FRAME), 20), np.full((7, media.FRAME), 200)]).astype(np.uint8)
    assert media.clips(frames) == [(0, 10), (10, 17)]
    assert media.clips(frames[:1]) == [(0, 1)]


def test_whole_table(spark):
    texts = {i: t.encode() for i, t, _ in sf_documents()}
    rows = registry.op7_media(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = media.write_avi(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_edges(spark):
    rows = media.media_rows(tricky(spark)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and got[1]["payload_bytes"] == got[2]["payload_bytes"] == 64 and got[1]["n_bytes"] == 0
    assert got[4]["feature"] == got[5]["feature"] and got[6]["clips"][0]["start_ms"] == 0
    assert media.media_rows(spark.createDataFrame([], DOCS)).count() == 0
