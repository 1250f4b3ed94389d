import os
import struct

import numpy as np
import pytest

from tidemark.llm import jpeg
from tidemark.llm.media import read_media, store_texts


@pytest.mark.parametrize("rows", [1, 2, 9, 500])
def test_round_trip(rows):
    payload = os.urandom(64 * rows)
    ((width, height, image),) = jpeg.thumbnails(jpeg.encode([payload]))[0]
    assert (width, height, image.tobytes()) == (512, 8 * rows, payload)


def test_many_at_once_and_very_long():
    payloads = [b"\xff\x00" * 32, b"\0" * 64, os.urandom(64 * 8200), b"\xff" * 640]
    assert [b"".join(i.tobytes() for _, _, i in own) for own in jpeg.thumbnails(jpeg.encode(payloads))] == payloads


class Writer:
    """A plain encoder for the test: DC and AC terms, several components, optional restarts."""

    AC = [0x00, 0x01, 0x02, 0x11, 0x21, 0xF0]  # symbols with codes of 3 bits

    def __init__(self):
        self.bits = ""

    def block(self, dc_step, ac):
        size = abs(dc_step).bit_length()
        code, n = jpeg._codes(jpeg.DC_COUNTS)[size]
        self.bits += f"{code:0{n}b}"
        if size:
            self.bits += f"{dc_step if dc_step > 0 else dc_step + (1 << size) - 1:0{size}b}"
        run = 0
        for v in ac:
            if v == 0:
                run += 1
                continue
            while run > 15:
                self.bits += f"{self.AC.index(0xF0):03b}"
                run -= 16
            size = abs(v).bit_length()
            self.bits += f"{self.AC.index(run << 4 | size):03b}" + f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"
            run = 0
        if run:
            self.bits += f"{self.AC.index(0):03b}"

    def flush(self):
        raw = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return int(raw or "0", 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00")


def picture(width, height, samplings, interval, rng):
    h, v = max(s[0] for s in samplings), max(s[1] for s in samplings)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    luma = np.zeros((down * samplings[0][1], across * samplings[0][0]), int)
    writer, before, scan, n = Writer(), [0] * len(samplings), b"", 0
    for y in range(down):
        for x in range(across):
            if interval and n and n % interval == 0:
                scan += writer.flush() + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
                before = [0] * len(samplings)
            for c, (ch, cv) in enumerate(samplings):
                for j in range(cv):
                    for i in range(ch):
                        dc = int(rng.integers(-60, 60))
                        ac = [0] * 63
                        ac[0], ac[int(rng.integers(18, 19))] = int(rng.integers(-3, 4)), int(rng.integers(0, 2))
                        writer.block(dc - before[c], ac if rng.integers(2) else [0] * 63)
                        before[c] = dc
                        if c == 0:
                            luma[y * cv + j, x * ch + i] = dc
            n += 1
    scan += writer.flush()
    seg = jpeg._segment
    parts = b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(samplings))
    data = jpeg.SOI + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, struct.pack(">BHHB", 8, height, width, len(samplings)) + parts)
    data += seg(0xC4, bytes([0, *jpeg.DC_COUNTS, *range(12)])) + seg(0xC4, bytes([0x10, 0, 0, 6, *[0] * 13, *Writer.AC]))
    data += seg(0xDD, struct.pack(">H", interval)) if interval else b""
    data += seg(0xDA, bytes([len(samplings)]) + b"".join(bytes([i + 1, 0]) for i in range(len(samplings))) + bytes([0, 63, 0])) + scan + jpeg.EOI
    return data, np.clip(np.round(luma * 2.0) + 128, 0, 255).astype(np.uint8)[: -(-height * samplings[0][1] // (8 * v)), : -(-width * samplings[0][0] // (8 * h))]


@pytest.mark.parametrize("samplings", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
@pytest.mark.parametrize("interval", [0, 3])
def test_other_encoders(samplings, interval):
    data, wanted = picture(50, 37, samplings, interval, np.random.default_rng(3))
    width, height, image = jpeg.thumbnails([data])[0][0]
    assert (width, height) == (50, 37) and np.array_equal(image, wanted)


@pytest.mark.parametrize("data", [b"GIF89a", jpeg.SOI, jpeg.encode([b"\0" * 64])[0][:40], jpeg.SOI + jpeg.EOI])
def test_no_jpeg(data):
    with pytest.raises((ValueError, IndexError, struct.error)):
        jpeg.thumbnails([data])


def test_odd_rows(odd):
    found = read_media(store_texts(odd)).collect()
    by = {r["id"]: r for r in found}
    assert len(found) == odd.count()
    for r in found:
        assert r["thumbnail"][r["n_bytes"] :].strip(b"\0") == b"" and len(r["thumbnail"]) % 64 == 0
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        assert by[r["doc_id"]]["thumbnail"][: len(raw)] == raw and by[r["doc_id"]]["n_bytes"] == len(raw)
    assert by[2]["media"] == by[3]["media"] and by[2]["n_bytes"] == 0 and by[1]["thumb_hash"] == by[5]["thumb_hash"]


def test_media_that_is_none(spark):
    good = jpeg.encode([b"a" * 64])[0]
    stored = spark.createDataFrame([(1, bytearray(good), "w"), (2, None, "w"), (3, bytearray(b"no picture"), "w")], "id long, media binary, width string")
    found = {r["id"]: r for r in read_media(stored).collect()}
    assert found[1]["width"] == 512 and found[2]["thumbnail"] is None and found[3]["thumb_hash"] is None


def test_empty(empty):
    assert read_media(store_texts(empty)).count() == 0
