"""Containers put together byte by byte, and what their heads say; heads are read by range."""

import io
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.sources import media_heads as heads


def png_chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(width, height, bits, color, delays=()):
    out = b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, 0))
    if delays:
        out += png_chunk(b"acTL", struct.pack(">II", len(delays), 0))
    for i, (num, den) in enumerate(delays):
        out += png_chunk(b"fcTL", struct.pack(">IIIIIHHBB", i, width, height, 0, 0, num, den, 0, 0)) + png_chunk(b"IDAT" if i == 0 else b"fdAT", b"x" * 999)
    return out + (b"" if delays else png_chunk(b"IDAT", b"x" * 50)) + png_chunk(b"IEND", b"")


def gif(width, height, delays, tables=True):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81 if tables else 0, 0, 0) + (b"\0" * 12 if tables else b"") + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    for d in delays:
        out += b"\x21\xf9\x04\0" + struct.pack("<H", d) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x80) + b"\0" * 6 + b"\x02" + b"\xff" + b"d" * 255 + b"\x03abc\0"
    return out + b"\x3b"


def riff(kind, *parts):
    body = b"".join(n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for n, d in parts)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + kind + body


def webp_animation(width, height, ms):
    frames = [(b"ANMF", b"\0" * 6 + b"\0" * 6 + m.to_bytes(3, "little") + b"\0" + b"z" * 333) for m in ms]
    return riff(b"WEBP", (b"VP8X", b"\x12\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")), (b"ANIM", b"\0" * 6), *frames)


def tiff(end, pages):
    out = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8)
    for i, (w, h, bits) in enumerate(pages):
        tags, at = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, len(bits), None), (277, 3, 1, len(bits))], len(out)
        body, extra = struct.pack(end + "H", len(tags)), at + 2 + 12 * len(tags) + 4
        for tag, kind, n, value in tags:
            inside = struct.pack(end + "HH", bits[0], 0) if tag == 258 and n < 3 else struct.pack(end + "I", extra) if tag == 258 else struct.pack(end + "I", value) if kind == 4 else struct.pack(end + "HH", value, 0)
            body += struct.pack(end + "HHI", tag, kind, n) + inside
        tail = struct.pack(end + f"{len(bits)}H", *bits)
        out += body + struct.pack(end + "I", extra + len(tail) if i + 1 < len(pages) else 0) + tail
    return out


def box(name, *data):
    body = b"".join(data)
    return struct.pack(">I", 8 + len(body)) + name + body


def track(kind, unit, length, samples, width=0, height=0, channels=0, bits=0):
    entry = box(b"mp4a", b"\0" * 16, struct.pack(">HH", channels, bits), b"\0" * 8) if kind == b"soun" else box(b"avc1", b"\0" * 70)
    table = box(b"stbl", box(b"stsd", b"\0" * 4, struct.pack(">I", 1), entry), box(b"stsz", b"\0" * 4, struct.pack(">II", 1, samples)))
    return box(b"trak", box(b"tkhd", b"\0" * 76, struct.pack(">II", width << 16, height << 16)), box(b"mdia", box(b"mdhd", b"\0" * 12, struct.pack(">II", unit, length), b"\0" * 4), box(b"hdlr", b"\0" * 8, kind, b"\0" * 12), box(b"minf", table)))


def movie(*tracks, unit=1000, length=0):
    return box(b"moov", box(b"mvhd", b"\0" * 12, struct.pack(">II", unit, length), b"\0" * 80), *tracks)


def element(name, data, size=None):
    n = (len(data) if size is None else size) | 1 << 56
    return bytes.fromhex(name) + n.to_bytes(8, "big") + data


def matroska(*tracks, ms=0.0, unknown=False):
    info = element("1549A966", element("2AD7B1", (1_000_000).to_bytes(3, "big")) + element("4489", struct.pack(">d", ms)))
    body = info + element("1654AE6B", b"".join(element("AE", t) for t in tracks)) + element("1F43B675", b"c" * 5000)
    return element("1A45DFA3", element("4282", b"webm")) + (bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + body if unknown else element("18538067", body))


def number(name, n):
    return element(name, n.to_bytes(2, "big"))


def mp3(version, bits, frames=None, tag=b"Xing", id3=0, mono=False):
    head = 0xFFE00000 | version << 19 | 1 << 17 | bits << 12 | (3 << 6 if mono else 0)
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    body = struct.pack(">I", head)
    if frames is None:
        body += b"\0" * 996
    else:
        body += b"\0" * side + tag + struct.pack(">II", 1, frames) + b"\0" * 900 if tag != b"VBRI" else b"\0" * 32 + b"VBRI" + b"\0" * 10 + struct.pack(">I", frames) + b"\0" * 900
    return (b"ID3\4\0\0" + bytes((0, 0, id3 >> 7, id3 & 127)) + b"i" * id3 if id3 else b"") + body


def ogg(head, granule):
    page = lambda data, g: b"OggS\0\0" + struct.pack("<q", g) + b"\0" * 12 + b"\x01" + bytes((len(data),)) + data
    return page(head, 0) + page(b"d" * 200, 5) + page(b"e" * 99, granule)


wav = lambda rate, channels, bits, n: riff(b"WAVE", (b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)), (b"odd ", b"abc"), (b"data", b"\0" * n))
aiff = b"FORM\0\0\0\0AIFF" + b"COMM" + struct.pack(">IHIHHQ", 18, 2, 22050, 24, 0x400E, 0xAC44 << 48)
flac = b"fLaC\0\0\0\x22" + b"\0" * 10 + ((96000 << 44) | (5 << 41) | (23 << 36) | 192000).to_bytes(8, "big") + b"\0" * 16
avi = riff(b"AVI ", (b"LIST", b"hdrl" + b"avih" + struct.pack("<I14I", 56, 40000, 0, 0, 0, 75, 0, 2, 0, 320, 240, 0, 0, 0, 0) + b"LIST" + struct.pack("<I", 20) + b"strlstrh" + struct.pack("<I", 8) + b"auds\0\0\0\0"), (b"LIST", b"movi" + b"0" * 99))
jpeg = b"\xff\xd8\xff\xe0\0\x10" + b"J" * 14 + b"\xff\xff\xdb\0\x04ab" + b"\xff\xc2\0\x11" + struct.pack(">BHHB", 12, 480, 640, 3) + b"\0" * 9
avc = track(b"vide", 30000, 90090, 90, 1920, 1080)
aac = track(b"soun", 44100, 132300, 130, channels=2, bits=16)

STILL = (None, None, 0.0, False)
CASES = {
    "a.png": (png(30, 20, 8, 6), (30, 20, 4, 8, *STILL)), "b.png": (png(3, 2, 16, 0), (3, 2, 1, 16, *STILL)), "c.png": (png(3, 2, 4, 3), (3, 2, 1, 8, *STILL)), "d.png": (png(3, 2, 1, 0), (3, 2, 1, 1, *STILL)),
    "e.png": (png(9, 9, 8, 2, [(1, 4), (50, 0), (250, 1000)]), (9, 9, 3, 8, 1000, 3, 3.0, False)),
    "a.gif": (gif(7, 5, [10, 20, 30]), (7, 5, 1, 8, 600, 3, 5.0, False)), "b.gif": (gif(7, 5, [10], tables=False), (7, 5, 1, 8, *STILL)), "c.gif": (gif(1, 1, [0, 0]), (1, 1, 1, 8, 0, 2, 0.0, False)),
    "a.webp": (webp_animation(400, 300, [40, 60]), (400, 300, 4, 8, 100, 2, 20.0, False)), "b.webp": (riff(b"WEBP", (b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28) + b"q" * 20)), (100, 50, 4, 8, *STILL)), "c.webp": (riff(b"WEBP", (b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 64 | 1 << 14, 48) + b"q" * 9)), (64, 48, 3, 8, *STILL)),
    "a.jpg": (jpeg, (640, 480, 3, 12, *STILL)), "a.tif": (tiff("<", [(5, 4, (16,))]), (5, 4, 1, 16, *STILL)), "b.tiff": (tiff(">", [(5, 4, (8, 8, 8)), (5, 4, (8, 8, 8))]), (5, 4, 3, 8, 0, 2, 0.0, False)), "a.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 11, -12, 1, 24) + b"\0" * 24, (11, 12, 3, 8, *STILL)),
    "a.wav": (wav(8000, 2, 24, 6 * 4000), (0, 0, 2, 24, 500, 4000, 8000.0, True)), "a.aiff": (aiff, (0, 0, 2, 24, 500, 22050, 44100.0, True)), "a.flac": (flac, (0, 0, 6, 24, 2000, 192000, 96000.0, True)),
    "a.ogg": (ogg(b"\x01vorbis\0\0\0\0\x02" + struct.pack("<I", 44100) + b"\0" * 14, 88200), (0, 0, 2, 16, 2000, 88200, 44100.0, True)), "b.ogg": (ogg(b"OpusHead\x01\x01" + struct.pack("<H", 312) + b"\0" * 7, 48312), (0, 0, 1, 16, 1000, 48000, 48000.0, True)),
    "a.mp3": (mp3(3, 9, 100), (0, 0, 2, 16, 2612, 115200, 44100.0, True)), "b.mp3": (mp3(2, 8, 50, b"Info", id3=300, mono=True), (0, 0, 1, 16, 1306, 28800, 22050.0, True)), "c.mp3": (mp3(0, 1, 7, b"VBRI"), (0, 0, 2, 16, 365, 4032, 11025.0, True)), "d.mp3": (mp3(3, 5), (0, 0, 2, 16, 125, 5512, 44100.0, True)),
    "a.mp4": (box(b"ftyp", b"isom") + box(b"mdat", b"m" * 4000) + movie(aac, avc, length=3003), (1920, 1080, 3, 8, 3003, 90, 29.97003, True)), "b.mov": (movie(track(b"vide", 600, 0, 0, 16, 16), length=10), (16, 16, 3, 8, 10, 0, 0.0, False)), "a.m4a": (box(b"ftyp", b"M4A ") + movie(aac, length=3000), (0, 0, 2, 16, 3000, 132300, 44100.0, True)),
    "c.mp4": (box(b"ftyp", b"isom") + b"\0\0\0\1mdat" + struct.pack(">Q", 16 + 500) + b"m" * 500 + movie(avc, length=3003), (1920, 1080, 3, 8, 3003, 90, 29.97003, False)),
    "a.mkv": (matroska(number("D7", 1) + element("23E383", (40_000_000).to_bytes(4, "big")) + element("E0", number("B0", 720) + number("BA", 576)), element("E1", element("B5", struct.pack(">f", 48000.0)) + number("9F", 2)), ms=2500.0), (720, 576, 3, 8, 2500, 62, 25.0, True)),
    "b.webm": (matroska(element("E0", number("B0", 10) + number("BA", 20)), ms=100.0, unknown=True), (10, 20, 3, 8, 100, 0, 0.0, False)), "a.mka": (matroska(element("E1", element("B5", struct.pack(">d", 16000.0)) + number("9F", 1) + number("6264", 24)), ms=500.0), (0, 0, 1, 24, 500, 8000, 16000.0, True)),
    "a.avi": (avi, (320, 240, 3, 8, 3000, 75, 25.0, True)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_heads(name):
    raw, want = CASES[name]
    got = heads.metadata(name, io.BytesIO(raw), len(raw))
    assert got is not None and got[:6] == want[:6] and abs(got[6] - want[6]) < 1e-4 and got[7] == want[7]
    for n in range(0, len(raw), max(1, len(raw) // 40)):  # files that end early have no metadata or less, and never an error
        heads.metadata(name, io.BytesIO(raw[:n]), n)
    assert heads.metadata(name, io.BytesIO(b""), 0) is None


def test_files_of_all_kinds(spark, tmp_path):
    for name, (raw, _) in CASES.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "broken.mp4").write_bytes(CASES["a.mp4"][0][:4100])
    (tmp_path / "text.txt").write_text("no media")
    with open(tmp_path / "large.mp4", "wb") as f:  # a box of data that is never read
        f.write(box(b"ftyp", b"isom") + b"\0\0\0\1mdat" + struct.pack(">Q", 3 << 30))
        f.truncate(16 + 4 - 4 + 8 - 12 + (3 << 30))
        f.seek(12 + (3 << 30))
        f.write(movie(avc, length=3003))
    size = os.path.getsize(tmp_path / "large.mp4")
    with open(tmp_path / "large.mp4", "rb") as f:
        read = heads.Ranges(f, size)
        assert heads.mp4(read)[:2] == (1920, 1080) and read.bytes_read < 1 << 18 < size
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", F.col("length").alias("size"))
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in heads.probed(files).collect()}
    assert set(got) == {*CASES, "large.mp4"}
    for name, (_, want) in CASES.items():
        assert got[name][:6] == want[:6] and abs(got[name][6] - want[6]) < 1e-3 and got[name][7] == want[7]
