"""GIF as a media column: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

`encode` stores bytes as the samples of 8-bit frames. `parse` reads any GIF87a or GIF89a file; code streams are
decoded with numpy: an LZW entry is the output of an earlier code and one byte more, so that lengths and then bytes
follow by pointer doubling, without a loop over codes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FRAME_ROWS, DELAY_CS = 192, 64, 10
#: Codes after a clear code; the code table (12 bits) is then full.
SEGMENT = 3837
HIST_BINS = 8
#: Bytes of decoded media that a task hands on at once.
BATCH_BYTES = 16 << 20


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray  # (n, 3)
    samples: np.ndarray  # (height, width), palette indices


@dataclass
class Gif:
    width: int
    height: int
    loops: int | None
    frames: list[Frame]


def _widths(n: int, min_code: int) -> np.ndarray:
    """Bits of the codes after a clear code: a code is as wide as the number of entries known before it asks for."""
    known = np.maximum((1 << min_code) + 1, np.minimum((1 << min_code) + 1 + np.arange(n), 4095))
    return np.floor(np.log2(known)).astype(np.int64) + 1


_WIDTHS = {k: _widths(SEGMENT + 2, k) for k in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """Greedy LZW code stream of 8-bit samples; a clear code where the table is full."""
    codes, bits = [256], [9]
    known: dict[int, int] = {}
    get, emit, start, last = known.get, codes.append, 1, -1
    following = 258
    for byte in data:
        if last < 0:
            last = byte
            continue
        key = last << 8 | byte
        code = get(key)
        if code is not None:
            last = code
            continue
        emit(last)
        last = byte
        if following - 258 == SEGMENT - 1:
            emit(256)
            known.clear()
            following = 258
        else:
            known[key] = following
            following += 1
    if last >= 0:
        emit(last)
    emit(257)
    values = np.array(codes, np.uint32)
    starts = np.nonzero(values == 256)[0]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values) - 1]):
        bits.extend(_WIDTHS[8][: b - a].tolist())
    wide = np.array(bits, np.int64)
    each = (values[:, None] >> np.arange(12, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(each[np.arange(12) < wide[:, None]], bitorder="little").tobytes()


def _segment(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    n, at = len(codes), np.arange(len(codes))
    entry = codes > clear + 1
    jump = np.where(entry, codes - clear - 2, at)
    if (jump[entry] >= at[entry]).any() or (codes == clear + 1).any():
        raise ValueError("LZW code before its entry")
    parent, hops = jump, entry.astype(np.int64)
    while hops[jump].any():
        hops, jump = hops + hops[jump], jump[jump]
    length = hops + 1
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1]) if n else 0
    source = np.arange(total)
    if entry.any():
        source += np.repeat(np.where(entry, start[parent] - start, 0), length)
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
    first = np.zeros(total, np.uint8)
    first[start[~entry]] = codes[~entry]
    return first[source]


def lzw_decode(data: bytes, min_code: int, n: int) -> np.ndarray:
    """`n` samples of a code stream; ValueError if it is broken or ends before."""
    if not 2 <= min_code <= 8:
        raise ValueError("LZW minimum code size")
    clear, raw = 1 << min_code, np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    at, have, parts, end = 0, 0, [], 8 * len(data)
    step = SEGMENT + 2
    while have < n:
        wide = _WIDTHS[min_code] if step <= SEGMENT + 2 else np.concatenate([_WIDTHS[min_code], np.full(step - SEGMENT - 2, 12)])
        offset = at + np.cumsum(wide) - wide
        fits = int(np.searchsorted(offset + wide, end, "right"))
        wide, offset = wide[:fits], offset[:fits]
        byte = offset >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7) & (1 << wide) - 1
        stop = np.nonzero((codes == clear) | (codes == clear + 1))[0]
        if not len(stop) and fits == len(_WIDTHS[min_code]) + max(0, step - SEGMENT - 2):
            step *= 2  # no clear code although the table is full: it stays as it is
            continue
        used = int(stop[0]) if len(stop) else fits
        if used:
            parts.append(_segment(codes[:used], clear))
            have += len(parts[-1])
        if not len(stop) or codes[used] == clear + 1:
            break
        at, step = int(offset[used] + wide[used]), SEGMENT + 2
    out = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    if len(out) < n:
        raise ValueError("LZW stream ends early")
    return out[:n]


def encode(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames, in turn, hold `samples` (a multiple of `width`) as indices of a grey palette."""
    lines = len(samples) // width
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, lines), 0xF7, 0, 0), grey, b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, lines, rows):
        part = samples[top * width : (top + rows) * width]
        stream = lzw_encode(part)
        out += [b"!\xf9\x04", struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [x for k in range(0, len(stream), 255) for x in (bytes([len(stream[k : k + 255])]), stream[k : k + 255])]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def parse(data: bytes) -> Gif:
    """All frames of a GIF file; ValueError if it is no GIF or broken. A missing trailer is accepted."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF signature")
        width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at, table, gif = 13, None, Gif(width, height, None, [])
        if flags & 0x80:
            size = 3 << (flags & 7) + 1
            table = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)
            at += size
        delay = disposal = 0
        transparent = None
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                label, (body, at) = data[at + 1], _blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    packed, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
                elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    gif.loops = struct.unpack_from("<H", body, 12)[0]
            elif data[at] == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at, palette = at + 10, table
                if flags & 0x80:
                    size = 3 << (flags & 7) + 1
                    palette = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)
                    at += size
                if palette is None:
                    raise ValueError("no palette")
                min_code = data[at]
                stream, at = _blocks(data, at + 1)
                samples = lzw_decode(stream, min_code, w * h).reshape(h, w)
                if samples.size and samples.max() >= len(palette):
                    raise ValueError("sample beyond the palette")
                if flags & 0x40:  # interlaced: lines come in four passes
                    order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                    lines = np.empty_like(samples)
                    lines[order] = samples
                    samples = lines
                gif.frames.append(Frame(left, top, w, h, 10 * delay, disposal, transparent, palette, samples))
                delay = disposal = 0
                transparent = None
            else:
                raise ValueError("unknown block")
        return gif
    except (IndexError, struct.error) as broken:
        raise ValueError(f"truncated: {broken}") from broken


def canvases(gif: Gif) -> Iterator[np.ndarray]:
    """RGBA canvas (height, width, 4) as shown at each frame: palettes, transparency and disposal applied."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        box = slice(f.top, min(f.top + f.height, gif.height)), slice(f.left, min(f.left + f.width, gif.width))
        seen = f.samples[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        colours = np.empty((len(f.palette), 4), np.uint8)
        colours[:, :3], colours[:, 3] = f.palette, 255
        drawn = colours[seen]
        if f.transparent is not None:
            drawn = np.where((seen == f.transparent)[..., None], canvas[box], drawn)
        canvas[box] = drawn
        yield canvas.copy()
        if f.disposal == 2:
            canvas[box] = 0
        elif before is not None:
            canvas = before


def histograms(canvas: np.ndarray, bins: int = HIST_BINS) -> list[list[int]]:
    """Counts of red, green and blue values in `bins` equal ranges, over pixels that aren't transparent."""
    seen = canvas[canvas[..., 3] > 0]
    return [np.bincount(seen[:, c].astype(np.int64) * bins >> 8, minlength=bins).tolist() for c in range(3)]


FRAME = ("struct<frame:int,start_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,"
         "disposal:int,hist_r:array<long>,hist_g:array<long>,hist_b:array<long>>")
_FRAME = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), *((n, pa.int32()) for n in ("left", "top", "width", "height", "disposal")),
                    *((n, pa.list_(pa.int64())) for n in ("hist_r", "hist_g", "hist_b"))])


def _described(data: bytes | None) -> tuple[list[dict] | None, bytes | None, str | None]:
    if data is None:
        return None, None, None
    try:
        gif = parse(data)
    except ValueError as broken:
        return None, None, str(broken)
    rows, at = [], 0
    for k, (f, canvas) in enumerate(zip(gif.frames, canvases(gif))):
        r, g, b = histograms(canvas)
        rows.append({"frame": k, "start_ms": at, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height,
                     "disposal": f.disposal, "hist_r": r, "hist_g": g, "hist_b": b})
        at += f.delay_ms
    return rows, b"".join(f.samples.tobytes() for f in gif.frames), None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, size, rows = 0, 0, []
        for k, data in enumerate(batch.column(0)):
            rows.append(_described(data.as_py()))
            size += len(rows[-1][1] or b"")
            if size > BATCH_BYTES or k == batch.num_rows - 1:
                frames, samples, errors = zip(*rows)
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(rows)).columns, pa.array(frames, pa.list_(_FRAME)), pa.array(samples, pa.binary()), pa.array(errors, pa.string())],
                                                 [*batch.schema.names, "frames", "samples", "error"])
                begin, size, rows = k + 1, 0, []


def _typed(df: DataFrame, names: list[str]) -> str:
    return "".join(f", `{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def gif_frames(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """One row (media, *keep, frames, samples, error) per row of `media`.

    `frames` holds the timed frames with the colour histograms of the canvas they show; `samples` the palette indices
    of all frames in turn. Null media give nulls; media that are no GIF or broken give nulls and the reason in `error`.
    Repeated rows stay; columns not in `keep` are dropped, those in it can't bear the names given here; an empty table
    gives an empty result. Rows don't meet: no shuffle.
    """
    return (media.select(F.col(media_col).cast("binary").alias("media"), *keep)
            .mapInArrow(_decode, f"media binary{_typed(media, keep)}, frames array<{FRAME}>, samples binary, error string"))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [None if x.as_py() is None else encode(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), *batch.columns[1:]], ["media", *batch.schema.names[1:]])


def as_gifs(docs: DataFrame, keep: list[str], payload_col: str = "payload") -> DataFrame:
    """One row (media, *keep): the bytes of `payload_col`, a positive multiple of 192, as the samples of a GIF; null stays null."""
    return (docs.select(F.col(payload_col).cast("binary").alias("payload"), *keep)
            .mapInArrow(_encode, f"media binary{_typed(docs, keep)}"))


def text_payload(text: str = "text") -> F.Column:
    """UTF-8 bytes of a text (null: none) filled with spaces up to a positive multiple of 192."""
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.octet_length(text_col)
    full = F.greatest(F.lit(1), F.ceil(size / WIDTH)) * WIDTH
    return F.concat(F.encode(text_col, "UTF-8"), F.encode(F.repeat(F.lit(" "), (full - size).cast("int")), "UTF-8"))
