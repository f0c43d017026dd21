import random
import zlib

import numpy as np
import pytest

from tidemark.llm import gif

SCHEMA = "doc_id long, text string, media string, error string"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 40, 200])
def test_round_trip(n):
    random.seed(n)
    for data in (bytes(gif.BLOCK * n), bytes(random.randrange(256) for _ in range(gif.BLOCK * n)), (b"ab" * gif.BLOCK * n)[: gif.BLOCK * n]):
        width, height, frames, samples, error = gif.read_gif(gif.write_gif(data), True)
        assert error is None and samples == data and width == gif.SIDE
        assert all(sum(f["histogram"][: gif.BINS]) == width * height for f in frames)
        assert [f["time_ms"] for f in frames] == [10 * gif.DELAY_CS * i for i in range(len(frames))]


def image(index, w, h, *, left=0, top=0, disposal=0, clear=None, delay=5, interlaced=False):
    flags = disposal << 2 | (clear is not None)
    order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)] if interlaced else range(h)
    body = b"".join(bytes(index[r * w : (r + 1) * w]) for r in order)
    sizes = b"".join(x.to_bytes(2, "little") for x in (left, top, w, h))
    return b"\x21\xf9\x04" + bytes([flags]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0]) + b"\x2c" + sizes + bytes([0x40 * interlaced, 8]) + gif.sub_blocks(gif.lzw_pack(gif.lzw_codes(body)))


def file_of(images, w, h):
    palette = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\xf7\0\0" + palette + b"".join(images) + b"\x3b"


def shown(frame, w):
    return np.frombuffer(frame["rgb"], np.uint8).reshape(-1, w, 3)[..., 0].tolist()


def test_disposal_transparency_and_interlacing():
    base = image([1] * 16, 4, 4, disposal=1)
    patch = dict(w=2, h=2, left=1, top=1)
    kept = gif.read_gif(file_of([base, image([9, 0, 0, 9], **patch, disposal=1, clear=0), image([5], 1, 1)], 4, 4), True)[2]
    assert shown(kept[1], 4) == [[1, 1, 1, 1], [1, 9, 1, 1], [1, 1, 9, 1], [1, 1, 1, 1]]
    assert shown(kept[2], 4)[1] == [1, 9, 1, 1] and shown(kept[2], 4)[0][0] == 5
    wiped = gif.read_gif(file_of([base, image([9] * 4, **patch, disposal=2), image([5], 1, 1)], 4, 4), True)[2]
    assert shown(wiped[2], 4) == [[5, 1, 1, 1], [1, 0, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]]
    back = gif.read_gif(file_of([base, image([9] * 4, **patch, disposal=3), image([5], 1, 1)], 4, 4), True)[2]
    assert shown(back[2], 4) == [[5, 1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 1]]
    lines = list(range(20))
    woven = gif.read_gif(file_of([image(lines, 2, 10, interlaced=True)], 2, 10), True)[2]
    assert shown(woven[0], 2) == [[2 * i, 2 * i + 1] for i in range(10)]


def test_damage_is_reported():
    good = gif.write_gif(bytes(gif.BLOCK))
    assert gif.read_gif(b"", False)[4] == "not a GIF"
    for cut in range(7, len(good) - 1, 37):
        assert gif.read_gif(good[:cut], False)[4]


def test_documents(spark):
    texts = [None, "", "x", "é" * 287, "é" * 288, "long " * 30_000, "x"]
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)] + [(None, "x", None, None)], SCHEMA)
    rows = gif.decode(gif.encode(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        data = ((texts[r.id] if r.id is not None else "x") or "").encode()
        assert r.error is None and r.samples == data.ljust(max(576, -(-len(data) // 576) * 576), b"\xff")
        assert zlib.crc32(r.samples[-32:]) >= 0
    assert gif.decode(gif.encode(docs.limit(0))).collect() == []
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id long, media binary")
    assert {r.id: r.error for r in gif.decode(bad).collect()} == {1: "not a GIF", 2: "null"}


# --- a second decoder, bit by bit, and files written by hand ---


def slow_codes(stream, root):
    """The indices of an LZW code stream, one code at a time."""
    clear, end = 1 << root, (1 << root) + 1
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    at, width, table, prev, out = 0, root + 1, {}, None, []

    def fresh():
        return {i: [i] for i in range(clear)} | {clear: None, end: None}

    table = fresh()
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, prev = fresh(), root + 1, None
            continue
        if code == end:
            break
        if prev is None:
            out += table[code]
        else:
            now = table[code] if code in table else prev + prev[:1]
            out += now
            if len(table) < 4096:
                table[len(table)] = prev + now[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
        prev = table[code]
    return out


def slow_gif(data):
    """(width, height, canvases as lists of rows of colours) of a sound file."""
    le = lambda i: data[i] | data[i + 1] << 8
    width, height, flags, at = le(6), le(8), data[10], 13

    def palette(at, flags):
        n = 2 << (flags & 7)
        return [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)] + [(0, 0, 0)] * (256 - n), at + 3 * n

    common = None
    if flags & 0x80:
        common, at = palette(at, flags)
    canvas = [[(0, 0, 0)] * width for _ in range(height)]
    out, disposal, clear, undo = [], 0, None, lambda c: c
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                disposal, clear = data[at + 3] >> 2 & 7, data[at + 6] if data[at + 3] & 1 else None
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        left, top, w, h, flags, at = le(at + 1), le(at + 3), le(at + 5), le(at + 7), data[at + 9], at + 10
        colours = common
        if flags & 0x80:
            colours, at = palette(at, flags)
        root, stream, at = data[at], b"", at + 1
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        index = slow_codes(stream, root)
        lines = list(range(h))
        if flags & 0x40:
            lines = [y for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, b)]
        canvas = undo(canvas)
        before = [r[:] for r in canvas]
        canvas = [r[:] for r in canvas]
        inside = [(y, x) for y in range(h) for x in range(w) if top + y < height and left + x < width]
        for n, y in enumerate(lines):
            for x in range(w):
                if (y, x) in set(inside) and index[n * w + x] != clear:
                    canvas[top + y][left + x] = colours[index[n * w + x]]
        out.append([r[:] for r in canvas])

        def wiped(c, inside=inside, top=top, left=left):
            c = [r[:] for r in c]
            for y, x in inside:
                c[top + y][left + x] = (0, 0, 0)
            return c

        undo = wiped if disposal == 2 else (lambda c, b=before: b) if disposal == 3 else (lambda c: c)
        disposal, clear = 0, None
    return width, height, out


# A public sample of two code sizes: ten by ten pixels of four colours, and one pixel.
SAMPLE = bytes.fromhex("47494638396 10a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b".replace(" ", ""))
DOT = bytes.fromhex("47494638396101000100800000ffffff0000002c00000000010001000002024401003b")


@pytest.mark.parametrize("data", [SAMPLE, DOT])
def test_files_from_elsewhere(data):
    width, height, frames, samples, error = gif.read_gif(data, True)
    assert error is None and len(frames) == 1
    want = slow_gif(data)
    assert (width, height) == want[:2] and frames[0]["rgb"] == bytes(c for row in want[2][0] for p in row for c in p)
    if data is SAMPLE:
        red, blue, white = (255, 0, 0), (0, 0, 255), (255, 255, 255)
        assert want[2][0][0] == [red] * 5 + [blue] * 5 and want[2][0][4][3:7] == [white] * 4 and want[2][0][9] == [blue] * 5 + [red] * 5


def packed(codes, root):
    """Codes as a bit stream by the rule of growing widths, one at a time."""
    bits, width, size = "", root + 1, None
    for c in codes:
        bits += f"{c:0{width}b}"[::-1]
        if c == 1 << root:
            width, size = root + 1, None
        elif size is None:
            size = (1 << root) + 2
        elif size < 4096:
            size += 1
            if size == 1 << width and width < 12:
                width += 1
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def random_file(rng):
    """Frames of all kinds: local palettes, few colours, interlaced, transparent, beyond the canvas, tables left full."""
    w, h = rng.randint(1, 12), rng.randint(1, 12)
    size = rng.randrange(8)
    out = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x80 | size, 0, 0]) + bytes(rng.randrange(256) for _ in range(3 * (2 << size)))
    for _ in range(rng.randint(1, 5)):
        clear = rng.random() < 0.4
        if rng.random() < 0.3:
            out += b"\x21\xfe\x03abc\0"
        out += b"\x21\xf9\x04" + bytes([rng.choice([0, 1, 2, 3]) << 2 | clear, rng.randrange(9), 0, rng.randrange(4), 0])
        left, top, fw, fh = rng.randrange(w), rng.randrange(h), rng.randint(1, 14), rng.randint(1, 14)
        local, interlaced, root = rng.random() < 0.3, rng.random() < 0.3, rng.randint(2, 8)
        flags = 0x80 * local | 0x40 * interlaced | (rng.randrange(8) if local else 0)
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, fw, fh)) + bytes([flags])
        if local:
            out += bytes(rng.randrange(256) for _ in range(3 * (2 << (flags & 7))))
        codes, since = [1 << root], 0
        for _ in range(fw * fh):
            codes.append(rng.randrange(min(1 << root, 6)))
            since += 1
            if rng.random() < 0.02:
                codes.append(1 << root)
        out += bytes([root]) + gif.sub_blocks(packed([*codes, (1 << root) + 1], root))
    return out + b"\x3b"


def test_against_a_slow_decoder():
    rng = random.Random(11)
    for _ in range(150):
        data = random_file(rng)
        width, height, frames, _, error = gif.read_gif(data, True)
        want = slow_gif(data)
        assert error is None and (width, height) == want[:2]
        assert [f["rgb"] for f in frames] == [bytes(c for row in canvas for p in row for c in p) for canvas in want[2]]


def slow_samples(data):
    """Grey samples of every frame in order, by the slow reading of codes alone."""
    at, out = 13 + 768, b""
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 8
            continue
        at += 11
        stream = b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        out += bytes(slow_codes(stream, 8))
    return out


def test_written_files_against_a_slow_decoder():
    random.seed(2)
    for data in (bytes(gif.BLOCK), bytes(random.choice(b"abc") for _ in range(gif.BLOCK * 17)), bytes(random.randrange(256) for _ in range(gif.BLOCK * 18))):
        assert slow_samples(gif.write_gif(data)) == data


def test_one_long_code_stream_takes_linear_time():
    """A million pixels in one frame: many clear codes, each of which once cost all the pixels before it."""
    import time

    took = []
    for n in (1 << 18, 1 << 20):
        raw = np.random.default_rng(1).integers(0, 256, n, dtype=np.uint8).tobytes()
        stream = gif.lzw_pack(gif.lzw_codes(raw))
        began = time.process_time()
        assert gif.lzw_expand(stream, 8, n) == raw
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.05)


def test_streams_whose_table_stays_full():
    """No clear code when the table is full; codes at random, some of which name the entry that they make."""
    rng = random.Random(3)
    for count in (1, 300, 3838, 3839, 4098, 4099, 9000):
        codes = [rng.randrange(256)]
        while len(codes) < count:
            top = min(gif.FULL - 1, gif.END + len(codes))
            code = rng.choice([rng.randrange(256), top, rng.randint(min(gif.FIRST, top), top)])
            codes.append(code if code not in (gif.CLEAR, gif.END) else 0)
        table, prev, want = [bytes([i]) for i in range(256)] + [b"", b""], b"", []
        for code in codes:
            now = table[code] if code < len(table) else prev + prev[:1]
            if prev and len(table) < gif.FULL:
                table.append(prev + now[:1])
            want.append(prev := now)
        stream = gif.lzw_pack(np.array([gif.CLEAR, *codes, gif.END], dtype=np.int32))
        whole = b"".join(want)
        for most in (len(whole), len(whole) // 2 + 1, len(whole) + 5):
            assert gif.lzw_expand(stream, 8, most) == whole[:most]
        assert len(gif.lzw_phrases(np.array(codes[:4098]), 256, 10)[0]) < 10 + gif.FULL


def test_no_call_per_code():
    import sys

    frame = bytes(random.Random(4).choices(b"abcd ", k=9216))
    codes, calls = gif.lzw_codes(frame), []
    sys.setprofile(lambda _, event, __: calls.append(event) if event == "c_call" else None)
    try:
        back = gif.lzw_expand(gif.lzw_pack(codes), 8, len(frame))
    finally:
        sys.setprofile(None)
    assert back == frame and len(calls) < len(codes) / 4
