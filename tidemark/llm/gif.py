"""GIF media: write samples as frames, and decode any GIF to timed frames with colour histograms.

Decoding reads the LZW code stream of each image, applies the local or global palette, transparency, interlacing
and the disposal rule of the frame before, and gives each frame its start and delay. What lies beyond the canvas is cut off,
as viewers do. A null or malformed file has no frames (``error`` says why); frames before the damage stay. Rows are
independent: nothing is shuffled, repeated rows repeat their result, and equal texts are equal files. Null and empty texts
are one block of padding. A text of any length is one file, read and written whole in one task, in memory and time in
proportion to it (with ``keep_rgb`` to its frames' canvases). An empty table gives an empty result. Only the columns named are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.llm.common import documents, flat_bytes, text_chunks

#: Payloads are padded with byte 255 to a positive multiple of this.
BLOCK = 576

#: A frame written by encode() is at most SIDE x SIDE; BLOCK is a whole number of its lines.
SIDE = 96

#: Hundredths of a second between written frames.
DELAY_CS = 10

#: Histogram bins of each colour channel.
BINS = 16

CLEAR, END, FIRST, FULL = 256, 257, 258, 4096

FRAME = "struct<time_ms:bigint,delay_ms:bigint,left:int,top:int,width:int,height:int,disposal:int,transparent:int,histogram:array<bigint>,rgb:binary>"
DECODED = f"width int, height int, frames array<{FRAME}>, samples binary, error string"


@cache
def code_widths(count: int, root: int = 8) -> np.ndarray:
    """Bits of the codes after a clear code: one more whenever the table outgrows the width, 12 at most."""
    entries = (1 << root) + 1 + np.arange(count)
    return np.clip(np.frexp(entries.astype(np.float64))[1], root + 1, 12).astype(np.int64)


def lzw_codes(data: bytes) -> np.ndarray:
    """The LZW codes of ``data`` (not empty), between a clear code and an end code."""
    out = [CLEAR << 8]  # codes stand eight bits higher while they are made, so that a code and a byte are a key
    table: dict[int, int] = {}
    emit, enter, size, prefix = out.append, table.setdefault, FIRST << 8, data[0] << 8
    for byte in data[1:]:
        longer = enter(prefix | byte, size)
        if longer is not size:  # it was there
            prefix = longer
            continue
        emit(prefix)
        size += 256
        prefix = byte << 8
        if size == FULL << 8:
            emit(CLEAR << 8)
            table.clear()
            size = FIRST << 8
    out += [prefix, END << 8]
    return np.array(out, dtype=np.int32) >> 8


def lzw_pack(code: np.ndarray) -> bytes:
    """Codes as a bit stream, lowest bit first."""
    clears = np.flatnonzero(code == CLEAR)
    after = np.arange(len(code)) - np.repeat(clears, np.diff(np.append(clears, len(code)))) - 1
    widths = code_widths(FULL + 2)[np.minimum(np.maximum(after, 0), FULL + 1)]
    widths[clears[1:]] = 12  # a later clear code comes when the table is full
    bits = np.unpackbits(code.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def write_gif(payload: bytes) -> bytes:
    """A GIF of grey frames whose palette indices are the payload (a positive multiple of BLOCK)."""
    lines = len(payload) // SIDE
    head = [b"GIF89a", SIDE.to_bytes(2, "little"), min(lines, SIDE).to_bytes(2, "little"), b"\xf7\0\0", np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    for top in range(0, lines, SIDE):
        rows = min(SIDE, lines - top)
        head.append(b"\x21\xf9\x04" + bytes([1 << 2]) + DELAY_CS.to_bytes(2, "little") + b"\0\0")
        head.append(b"\x2c\0\0\0\0" + SIDE.to_bytes(2, "little") + rows.to_bytes(2, "little") + b"\0\x08")
        head.append(sub_blocks(lzw_pack(lzw_codes(payload[top * SIDE : (top + rows) * SIDE]))))
    return b"".join(head) + b"\x3b"


def reaching(lengths: np.ndarray, most: int) -> int:
    """How many of the lengths come to ``most`` bytes, or all."""
    return int(np.searchsorted(np.cumsum(lengths), most)) + 1


def copied(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``source``, one after another."""
    ends = np.cumsum(lengths)
    return source[np.arange(int(ends[-1]), dtype=np.int32) + np.repeat((starts - ends + lengths).astype(np.int32), lengths)]


def lzw_phrases(codes: np.ndarray, clear: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the codes after a clear code (those that reach ``most``), and how many each stands for.

    Entry j of the table is what code j stands for and the byte after it, so a code repeats a stretch that was written before.
    Each byte points to the one it repeats; pointers are followed in doubling steps, down to the literals.
    """
    n, entry = len(codes), codes - clear - 2
    if codes[0] >= clear:
        raise ValueError("the first code is not a literal")
    if (entry >= np.arange(n)).any():
        raise ValueError("a code beyond the table")
    literal = entry < 0
    up = np.append(np.where(literal, n, entry), n)
    lengths = np.append(~literal, False).astype(np.int64)
    while (up < n).any():
        lengths += lengths[up]
        up = up[up]
    n = reaching(lengths := lengths[:n] + 1, most)
    codes, entry, literal, lengths = codes[:n], entry[:n], literal[:n], lengths[:n]
    begins = np.cumsum(lengths) - lengths
    at = np.arange(int(begins[-1] + lengths[-1]), dtype=np.int32)
    at -= np.repeat(np.where(literal, 0, begins - begins[np.where(literal, 0, entry)]).astype(np.int32), lengths)
    while not np.array_equal(at, further := at[at]):
        at = further
    out = np.zeros(len(at), np.uint8)
    out[begins[literal]] = codes[literal]
    return out[at], lengths


def lzw_expand(stream: bytes, root: int, most: int) -> bytes:
    """The bytes of an LZW code stream, ``most`` at most."""
    clear, end = 1 << root, (1 << root) + 1
    bits_all = len(stream) * 8
    data = np.concatenate([np.frombuffer(stream, dtype=np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    widths = code_widths(FULL + 2, root)
    out: list[bytes] = []
    size, at, seen = 0, 0, 0
    while at < bits_all and size < most:
        left = widths[: bits_all - at] if not seen else np.full(FULL, 12, np.int64)
        begins = at + np.cumsum(left) - left
        fit = int(np.searchsorted(begins + left, bits_all, "right"))
        left, begins = left[:fit], begins[:fit]
        if not fit:
            break
        byte = begins >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (begins & 7)) & ((1 << left) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        run = codes[:n]
        if n and not seen:
            part, lengths = lzw_phrases(run, clear, most - size)
            if n > FULL and size + len(part) < most:  # the table is full and stays
                known = np.concatenate([np.arange(clear, dtype=np.uint8), part])
                starts = np.concatenate([np.arange(clear + 2), clear + (np.cumsum(lengths) - lengths)[: FULL - clear - 2]])
                sizes = np.concatenate([np.ones(clear + 2, np.int64), lengths[: FULL - clear - 2] + 1])
        elif n:
            run = run[: reaching(sizes[run], most - size)]
            part = copied(known, starts[run], sizes[run])
        if n:
            out.append(part.tobytes())
            size += len(part)
        seen += n
        if not len(stops):
            at = int(begins[-1] + left[-1])
        elif codes[n] == end:
            break
        else:
            at, seen = int(begins[n] + left[n]), 0
    return b"".join(out)[:most]


def read_gif(data: bytes, keep_rgb: bool) -> tuple[int, int, list[dict], bytes, str | None]:
    """Width, height, frames, the grey samples of each frame's own rectangle, and what was wrong."""
    frames: list[dict] = []
    samples: list[bytes] = []
    width = height = 0
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
        at = 13
        shared = None

        def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
            n = 2 << (flags & 7)
            colours = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8)
            if len(colours) != 3 * n:
                raise ValueError("the palette is cut off")
            return np.vstack([colours.reshape(n, 3), np.zeros((256 - n, 3), np.uint8)]), at + 3 * n

        def blocks(at: int) -> tuple[bytes, int]:
            parts = []
            while n := data[at]:
                parts.append(data[at + 1 : at + 1 + n])
                at += 1 + n
            return b"".join(parts), at + 1

        if flags & 0x80:
            shared, at = palette(at, flags)
        canvas = np.zeros((height, width, 3), np.uint8)
        disposal, delay, clear, clock = 0, 0, -1, 0
        undo = None
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                label = data[at + 1]
                body, at = blocks(at + 2)
                if label == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                    clear = body[3] if body[0] & 1 else -1
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            flags, at = data[at + 9], at + 10
            colours = shared
            if flags & 0x80:
                colours, at = palette(at, flags)
            if colours is None:
                raise ValueError("no palette")
            root = data[at]
            if not 1 <= root <= 8:
                raise ValueError("a code size that is not allowed")
            stream, at = blocks(at + 1)
            index = np.frombuffer(lzw_expand(stream, root, w * h), dtype=np.uint8)
            if len(index) != w * h:
                raise ValueError("the code stream is cut off")
            index = index.reshape(h, w)
            if flags & 0x40:  # four passes of lines
                rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(rows)]
            if undo is not None:
                canvas = undo()
            before, box = canvas, (slice(top, min(top + h, height)), slice(left, min(left + w, width)))
            index = index[: max(0, height - top), : max(0, width - left)]
            canvas = canvas.copy()
            canvas[box] = colours[index] if clear < 0 else np.where((index == clear)[..., None], canvas[box], colours[index])
            shown = canvas
            counts = [np.bincount(shown[..., c].ravel() // (256 // BINS), minlength=BINS) for c in range(3)]
            frames.append({"time_ms": clock, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "transparent": clear, "histogram": np.concatenate(counts).tolist(), "rgb": shown.tobytes() if keep_rgb else None})
            samples.append(shown[box][..., 0].tobytes())
            clock += delay
            if disposal == 2:

                def undo(shown=shown, box=box):
                    wiped = shown.copy()
                    wiped[box] = 0
                    return wiped
            elif disposal == 3:

                def undo(before=before):
                    return before
            else:
                undo = None
            disposal, delay, clear = 0, 0, -1
        return width, height, frames, b"".join(samples), None
    except IndexError:
        return width, height, frames, b"".join(samples), "the file is cut off"
    except ValueError as e:
        return width, height, frames, b"".join(samples), str(e)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``media``: each whole text's UTF-8 bytes (null: none), padded with 255, as the samples of a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = flat_bytes(chunk.column("text"))
            whole = data.tobytes()
            out = []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                size = max(BLOCK, -(-(b - a) // BLOCK) * BLOCK)
                out.append(write_gif(whole[a:b].ljust(size, b"\xff")))
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(out, pa.binary())], names=["id", "media"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, media binary")


def decode(media: DataFrame, *, id_col: str = "id", media_col: str = "media", keep_rgb: bool = True) -> DataFrame:
    """``id``, ``media``, and each file's size, timed frames (``rgb`` is the whole canvas as shown, or null) and samples."""
    rows = media.select(media[id_col].alias("id"), media[media_col].alias("media"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, media binary, {DECODED}"

    frame = to_arrow_type(StructType.fromDDL(DECODED)["frames"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "media"):
            found = [read_gif(x, keep_rgb) if x is not None else (None, None, None, None, "null") for x in chunk.column("media").to_pylist()]
            columns = list(zip(*found, strict=True))
            kinds = [pa.int32(), pa.int32(), frame, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), chunk.column("media"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "media", "width", "height", "frames", "samples", "error"])

    return rows.mapInArrow(run, schema)


def frames(decoded: DataFrame) -> DataFrame:
    """One row per frame: ``id``, ``frame`` (from 0) and the frame's columns."""
    return decoded.select("id", F.posexplode("frames").alias("frame", "f")).select("id", "frame", "f.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a GIF: digests of the payload read back and of the file, and its colour histogram."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = encode(docs.select(F.struct("doc_id", F.octet_length("text").alias("n")).alias("key"), "text"), id_col="key")
    back = decode(stored, keep_rgb=False)
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 3 * BINS)
    histogram = F.aggregate("frames", zeros, lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    return back.select(
        F.col("id.doc_id").alias("doc_id"),
        F.col("id.n").cast("long").alias("n_bytes"),
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(histogram.cast("array<string>"), ",").alias("feature"),
        F.size("frames").cast("long").alias("n_frames"),
        F.expr("cast(element_at(frames, -1).time_ms + element_at(frames, -1).delay_ms as bigint)").alias("duration_ms"),
    )
