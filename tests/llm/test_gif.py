"""GIF: exact round trips, and files written by hand."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from mosaicell.llm import gif, queries

from tests.conftest import SF


def slow_lzw(data: bytes, min_code: int) -> bytes:
    """Textbook LZW decoder."""
    clear, bits, have, at, out = 1 << min_code, 0, 0, 0, bytearray()
    table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], min_code + 1, b""
    while True:
        while have < width:
            bits |= data[at] << have
            have, at = have + 8, at + 1
        code, bits, have = bits & (1 << width) - 1, bits >> width, have - width
        if code == clear:
            table, width, last = table[: clear + 2], min_code + 1, b""
            continue
        if code == clear + 1:
            return bytes(out)
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry


@pytest.mark.parametrize("seed", range(4))
def test_lzw(seed):
    rng = random.Random(seed)
    alphabet = bytes(range(256)) if seed % 2 else b"ab "
    for n in (1, 2, 192, 5000, 60_000):
        data = bytes(rng.choice(alphabet) for _ in range(n))
        stream = gif.lzw_encode(data)
        assert slow_lzw(stream, 8) == data
        assert gif.lzw_decode(stream, 8, n).tobytes() == data
    with pytest.raises(ValueError):
        gif.lzw_decode(stream[: len(stream) // 2], 8, n)


def test_file_is_read_by_the_book():
    data = bytes(random.Random(9).choice(b"abc") for _ in range(192 * 150))
    found = gif.parse(gif.encode(data))
    assert (found.width, found.height, found.loops, len(found.frames)) == (192, 64, 0, 3)
    assert b"".join(f.samples.tobytes() for f in found.frames) == data
    for broken in (b"", b"GIF89a", b"PNG", gif.encode(data)[:700], b"GIF89a" + bytes(7) + b"?"):
        with pytest.raises(ValueError):
            gif.parse(broken)


def by_hand(frames: list[tuple[int, int, list[int], int | None]]) -> bytes:
    """A 2 x 2 GIF with four colours: frames as (disposal, left, samples of a row, transparent)."""
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    out = [b"GIF89a", struct.pack("<HHBBB", 2, 2, 0x81, 0, 0), palette]
    for disposal, left, samples, transparent in frames:
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), 5, transparent or 0, 0))
        codes = [4, *[c for s in samples for c in (s, 4)][:-1], 5]
        number = sum(c << 3 * k for k, c in enumerate(codes))
        stream = number.to_bytes(-(-3 * len(codes) // 8), "little")
        out.append(struct.pack("<BHHHHB", 0x2C, left, 0, len(samples), 1, 0) + b"\x02" + bytes([len(stream)]) + stream + b"\0")
    return b"".join([*out, b";"])


def test_disposal_and_transparency():
    shown = list(gif.canvases(gif.parse(by_hand([(1, 0, [0, 1], None), (2, 0, [2, 3], 3), (3, 1, [2], None), (1, 0, [1], None)]))))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown[0][0].tolist() == [red, green]
    assert shown[1][0].tolist() == [blue, green]  # 3 is transparent
    assert shown[2][0].tolist() == [[0] * 4, blue]  # what the frame before covered was cleared
    assert shown[3][0].tolist() == [green, [0] * 4]  # and what this one drew was taken back
    assert gif.histograms(shown[0])[0] == [1, 0, 0, 0, 0, 0, 0, 1]


def test_awkward_media(spark):
    good = gif.encode(bytes(192))
    rows = [(1, good, "x"), (2, None, None), (3, b"no gif", "y"), (4, b"", ""), (1, good, "x")]
    media = spark.createDataFrame(rows, "doc_id long, media binary, label string")
    found = sorted(gif.gif_frames(media, ["doc_id", "label"]).collect(), key=lambda r: r["doc_id"])
    assert [r["error"] is None for r in found] == [True, True, True, False, False]
    assert [len(r["frames"] or []) for r in found] == [1, 1, 0, 0, 0] and found[2]["samples"] is None
    assert gif.gif_frames(media.limit(0), ["doc_id"]).collect() == []


def test_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_gif(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = gif.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        counts = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
        assert r["feature"].split(";")[2].count(",") == 7 and int(r["feature"].split(";")[0]) == -(-len(payload) // (192 * 64)) and counts.sum() == len(payload)
