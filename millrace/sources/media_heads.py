"""Metadata of images, audio and video from the heads of their containers.

Files are listed without their content; tasks open them through pyarrow's file systems and read what a walk over a
container's chunks, boxes or elements needs, by range: sample data are passed over. A probe is a small function over a
`Ranges`; what no probe reads, or reads wrongly, is no asset and gives no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema

#: Chunks that a walk looks at, and bytes of a box that is read whole: a container beyond them counts as broken.
MOST_CHUNKS, MOST_BYTES = 1_000_000, 64 << 20
KIND = "path string, width int, height int, channels int, depth int, duration int, num_frames int, frame_rate float, has_audio boolean"


class Ranges:
    """A file read by range; ranges near each other come from one read."""

    def __init__(self, file, size: int, ahead: int = 1 << 16):
        self.file, self.size, self.ahead, self.at, self.held, self.bytes_read = file, size, ahead, 0, b"", 0

    def __call__(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size or n > MOST_BYTES:
            raise ValueError("the file ends early")
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, self.ahead), self.size - at))
            self.bytes_read += len(self.held)
        return self.held[at - self.at : at - self.at + n]

    def number(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self(at, struct.calcsize(form)))


def chunks(read: Ranges, at: int, end: int, form: str, pad: int = 1, after: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of chunks with a name and a size, in the order of `form`."""
    for _ in range(MOST_CHUNKS):
        if at + 8 > end:
            return
        a, b = read.number(form, at)
        name, n = (a, b) if isinstance(a, bytes) else (b, a)
        yield name, at + 8, min(at + 8 + n, end)
        at += 8 + n + (-n % pad) + after
    raise ValueError("too many chunks")


def _image(width: int, height: int, channels: int, depth: int, frames: int = 1, ms: float = 0) -> tuple:
    """Still images have no duration and no frames; the rate comes from both."""
    many = frames > 1
    return width, height, channels, depth, int(ms) if many else None, frames if many else None, 1000 * frames / ms if many and ms > 0 else 0.0, False


def png(read: Ranges) -> tuple:
    width, height, bits, color = read.number(">IIBB", 16)
    frames, ms = 1, 0.0
    for name, at, _ in chunks(read, 8, read.size, ">I4s", after=4):
        if name == b"acTL":
            (frames,) = read.number(">I", at)
        elif name == b"fcTL":
            num, den = read.number(">HH", at + 20)
            ms += 1000 * num / (den or 100)
        elif name == b"IEND" or name == b"IDAT" and frames == 1:
            break
    return _image(width, height, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color], bits if color == 0 and bits in (1, 16) else 8, frames, ms)


def gif(read: Ranges) -> tuple:
    width, height, flags = read.number("<HHB", 6)
    at, frames, ms = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0, 0

    def blocks(at: int) -> int:
        while n := read(at, 1)[0]:
            at += n + 1
        return at + 1

    while at < read.size and (kind := read(at, 1)[0]) != 0x3B:
        if kind == 0x21:
            if read(at + 1, 1)[0] == 0xF9:
                ms += 10 * read.number("<H", at + 4)[0]
            at = blocks(at + 2)
        elif kind == 0x2C:
            (own,) = read.number("B", at + 9)
            at, frames = blocks(at + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0)), frames + 1
        else:
            raise ValueError("no block")
    return _image(width, height, 1, 8, frames, ms)


def webp(read: Ranges) -> tuple:
    size, alpha, frames, ms = None, False, 0, 0
    for name, at, _ in chunks(read, 12, read.size, "<4sI", 2):
        if name == b"VP8X":
            flags, box = read(at, 1)[0], read(at + 4, 6)
            size, alpha = (1 + int.from_bytes(box[:3], "little"), 1 + int.from_bytes(box[3:], "little")), bool(flags & 0x10)
        elif name == b"VP8L" and size is None:
            (bits,) = read.number("<I", at + 1)
            size, alpha = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)), bool(bits >> 28 & 1)
        elif name == b"VP8 " and size is None:
            size = tuple(x & 0x3FFF for x in read.number("<HH", at + 6))
        elif name == b"ANMF":
            frames, ms = frames + 1, ms + int.from_bytes(read(at + 12, 3), "little")
    return _image(*size, 4 if alpha else 3, 8, max(frames, 1), ms)


def jpeg(read: Ranges) -> tuple:
    at = 2
    while True:
        mark, kind = read(at, 2)
        if mark != 0xFF:
            raise ValueError("no marker")
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        (n,) = read.number(">H", at + 2)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            bits, height, width, parts = read.number(">BHHB", at + 4)
            return _image(width, height, parts, bits)
        at += 2 + n


def tiff(read: Ranges) -> tuple:
    end = "<" if read(0, 2) == b"II" else ">"
    (at,), pages, first = read.number(end + "I", 4), 0, None
    while at and pages < MOST_CHUNKS:
        (n,), tags = read.number(end + "H", at), {}
        for k in range(n):
            tag, kind, count = read.number(end + "HHI", at + 2 + 12 * k)
            if kind in (3, 4):
                form, size = ("H", 2) if kind == 3 else ("I", 4)
                place = at + 10 + 12 * k if count * size <= 4 else read.number(end + "I", at + 10 + 12 * k)[0]
                tags[tag] = read.number(end + form, place)[0]
        first, pages = first or tags, pages + 1
        (at,) = read.number(end + "I", at + 2 + 12 * n)
    return _image(first[256], first[257], first.get(277, 1), first.get(258, 1), pages, 0)


def bmp(read: Ranges) -> tuple:
    width, height, _, bits = read.number("<iiHH", 18)
    return _image(width, abs(height), {1: 1, 4: 1, 8: 1, 32: 4}.get(bits, 3), 1 if bits == 1 else 8)


def _sound(rate: float, frames: float, channels: int, depth: int) -> tuple:
    seconds = frames / rate
    return 0, 0, channels, depth, int(seconds * 1000), int(frames), float(rate), True


def wav(read: Ranges) -> tuple:
    form, data = None, 0
    for name, at, end in chunks(read, 12, read.size, "<4sI", 2):
        if name == b"fmt ":
            _, channels, rate, _, block, bits = form = read.number("<HHIIHH", at)
        elif name == b"data":
            data = end - at
    _, channels, rate, _, block, bits = form
    return _sound(rate, data // block, channels, bits)


def aiff(read: Ranges) -> tuple:
    for name, at, _ in chunks(read, 12, read.size, ">4sI", 2):
        if name == b"COMM":
            channels, frames, bits, power, mantissa = read.number(">HIHHQ", at)
            return _sound(mantissa * 2.0 ** ((power & 0x7FFF) - 16446), frames, channels, bits)
    raise ValueError("no COMM")


def flac(read: Ranges) -> tuple:
    packed = int.from_bytes(read(18, 8), "big")  # 20 bits of rate, 3 of channels, 5 of depth, 36 of samples
    return _sound(packed >> 44, packed & (1 << 36) - 1, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1)


def ogg(read: Ranges) -> tuple:
    at = 27 + read(26, 1)[0]
    if read(at, 8) == b"OpusHead":
        channels, skip, rate = read(at + 9, 1)[0], read.number("<H", at + 10)[0], 48000
    elif read(at, 7) == b"\x01vorbis":
        channels, rate, skip = read(at + 11, 1)[0], read.number("<I", at + 12)[0], 0
    else:
        raise ValueError("unknown codec")
    n = min(read.size, 1 << 16)
    tail = read(read.size - n, n)  # pages are no longer than that
    last = tail.rindex(b"OggS")
    return _sound(rate, max(0, struct.unpack("<q", tail[last + 6 : last + 14])[0] - skip), channels, 16)


# Kilobits a second of MPEG 1 and 2 audio, layer III, by index; samples a second of MPEG 1.
_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_SAMPLES = (44100, 48000, 32000)


def mp3(read: Ranges) -> tuple:
    at = 0
    if read(0, 3) == b"ID3":
        a, b, c, d = read(6, 4)
        at = 10 + (a << 21 | b << 14 | c << 7 | d)
    (head,) = read.number(">I", at)
    version, layer, rate, sample, mono = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3, head >> 6 & 3 == 3
    if head >> 21 != 0x7FF or layer != 1 or version == 1 or rate in (0, 15) or sample == 3:
        raise ValueError("no layer III")
    hertz, own = _SAMPLES[sample] >> (0, 0, 1, 0)[version] >> (version == 0) * 2, 1152 if version == 3 else 576
    tag = at + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    if read(tag, 4) in (b"Xing", b"Info") and read.number(">I", tag + 4)[0] & 1:
        frames = own * read.number(">I", tag + 8)[0]
    elif read(at + 36, 4) == b"VBRI":
        frames = own * read.number(">I", at + 50)[0]
    else:
        frames = (read.size - at) * 8 / (1000 * _RATES[1 if version == 3 else 2][rate]) * hertz
    return _sound(hertz, frames, 1 if mono else 2, 16)


def _video(width: int, height: int, ms: float, frames: int, rate: float, sound: bool) -> tuple:
    """Without a count of frames they follow from rate and length. Colours are taken to be three of 8 bits."""
    return width, height, 3, 8, int(ms), frames or int(rate * int(ms) / 1000), rate, sound


def boxes(read: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the boxes between two places."""
    while at + 8 <= end:
        n, name = read.number(">I4s", at)
        head = 8
        if n == 1:
            (n,), head = read.number(">Q", at + 8), 16
        n = n or end - at
        if n < head or at + n > end:
            raise ValueError("no box")
        yield name, at + head, at + n
        at += n


def _found(read: Ranges, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for name, a, b in boxes(read, at, end):
        if name == path[0]:
            return (a, b) if len(path) == 1 else _found(read, a, b, *path[1:])
    return None


def mp4(read: Ranges) -> tuple:
    def times(at: int) -> tuple[int, int]:  # of mvhd and mdhd: units a second, and units
        return read.number(">IQ", at + 20) if read(at, 1) == b"\x01" else read.number(">II", at + 12)

    movie = _found(read, 0, read.size, b"moov")
    unit, length = times(_found(read, *movie, b"mvhd")[0])
    video = sound = None
    for name, at, end in boxes(read, *movie):
        if name == b"trak":
            media = _found(read, at, end, b"mdia")
            kind, own = read(_found(read, *media, b"hdlr")[0] + 8, 4), times(_found(read, *media, b"mdhd")[0])
            table = _found(read, *media, b"minf", b"stbl")
            if kind == b"vide" and video is None:
                head = _found(read, at, end, b"tkhd")[1]
                width, height = (x >> 16 for x in read.number(">II", head - 8))
                video = width, height, read.number(">I", _found(read, *table, b"stsz")[0] + 8)[0], own
            elif kind == b"soun" and sound is None:
                entry = _found(read, *table, b"stsd")[0] + 8
                sound = *read.number(">HH", entry + 24), own
    if video is None:
        channels, depth, (rate, samples) = sound
        return _sound(rate, samples, channels, depth)
    width, height, frames, (own_unit, own_length) = video
    return _video(width, height, 1000 * length / unit, frames, frames * own_unit / own_length if own_length else 0.0, sound is not None)


def matroska(read: Ranges) -> tuple:
    def coded(at: int, keep: bool) -> tuple[int, int]:  # a number by its own length; `keep` leaves the mark of the length in
        first = read(at, 1)[0]
        n = 9 - first.bit_length()
        if n > 8:
            raise ValueError("no element")
        value = int.from_bytes(read(at, n), "big")
        return (value if keep else value & (1 << 7 * n) - 1), at + n

    def elements(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        while at < end:
            name, at = coded(at, True)
            n, own = coded(at, False)
            unknown = n == (1 << 7 * (own - at)) - 1
            yield name, own, end if unknown else min(own + n, end)
            at = end if unknown else own + n

    whole = lambda a, b: int.from_bytes(read(a, b - a), "big")
    real = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", read(a, b - a))[0]
    scale, length, video, sound = 1_000_000, 0.0, None, None
    segment = next((a, b) for name, a, b in elements(0, read.size) if name == 0x18538067)
    for name, a, b in elements(*segment):
        if name == 0x1549A966:
            for n, x, y in elements(a, b):
                scale, length = whole(x, y) if n == 0x2AD7B1 else scale, real(x, y) if n == 0x4489 else length
        elif name == 0x1654AE6B:
            for _, x, y in (e for e in elements(a, b) if e[0] == 0xAE):
                track = {n: (p, q) for n, p, q in elements(x, y)}
                if 0xE0 in track and video is None:
                    own = {n: whole(p, q) for n, p, q in elements(*track[0xE0]) if n in (0xB0, 0xBA)}
                    video = own[0xB0], own[0xBA], 1e9 / whole(*track[0x23E383]) if 0x23E383 in track else 0.0
                elif 0xE1 in track and sound is None:
                    own = {n: (p, q) for n, p, q in elements(*track[0xE1])}
                    sound = real(*own[0xB5]) if 0xB5 in own else 8000.0, whole(*own[0x9F]) if 0x9F in own else 1, whole(*own[0x6264]) if 0x6264 in own else 16
        elif name == 0x1F43B675:  # clusters: what comes after is data
            break
    ms = length * scale / 1e6
    if video is None:
        return _sound(sound[0], ms / 1000 * sound[0], sound[1], sound[2])
    return _video(video[0], video[1], ms, 0, video[2], sound is not None)


def avi(read: Ranges) -> tuple:
    header, sound = None, False
    for name, at, end in chunks(read, 12, read.size, "<4sI", 2):
        if name == b"LIST" and read(at, 4) == b"hdrl":
            for n, x, y in chunks(read, at + 4, end, "<4sI", 2):
                if n == b"avih":
                    header = read.number("<I12xI12xII", x)
                elif n == b"LIST" and read(x, 4) == b"strl":
                    sound |= any(k == b"strh" and read(p, 4) == b"auds" for k, p, _ in chunks(read, x + 4, y, "<4sI", 2))
            break
    micros, frames, width, height = header
    rate = 1e6 / micros if micros else 0.0
    return _video(width, height, frames * micros / 1000, frames, rate, sound)


def probe_of(read: Ranges):
    """The probe that a file's first bytes ask for."""
    head = read(0, min(16, read.size))
    if head[:4] == b"RIFF":
        return {b"WEBP": webp, b"WAVE": wav, b"AVI ": avi}.get(head[8:12])
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        return aiff
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        return mp4
    known = {b"\x89PNG\r\n\x1a\n": png, b"GIF87a": gif, b"GIF89a": gif, b"\xff\xd8\xff": jpeg, b"II*\0": tiff, b"MM\0*": tiff, b"BM": bmp, b"fLaC": flac, b"OggS": ogg, b"ID3": mp3, b"\x1a\x45\xdf\xa3": matroska}
    return next((probe for mark, probe in known.items() if head.startswith(mark)), mp3 if head[:1] == b"\xff" and len(head) > 1 and head[1] & 0xE0 == 0xE0 else None)


def metadata(path: str, file, size: int) -> tuple | None:
    """What a file's head says, or None: (width, height, channels, depth, ms, frames, rate, has_audio)."""
    read = Ranges(file, size)
    try:
        probe = probe_of(read)
        return probe(read) if probe else None
    except (ValueError, TypeError, KeyError, IndexError, struct.error, StopIteration, ZeroDivisionError, OverflowError, RecursionError, OSError):
        return None


def probed(files: DataFrame) -> DataFrame:
    """`KIND` for files (path, size) of images, audio and video; what cannot be read is left out. Heads are read by range."""
    import contextlib

    from millrace.sources.sinks import located

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with contextlib.suppress(OSError):
                    system, own = located(path)
                    with system.open_input_file(own) as file:
                        if (found := metadata(path, file, size)) is not None:
                            rows.append((path, *found))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = (pa.string(), *[pa.int32()] * 6, pa.float32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "width", "height", "channels", "depth", "duration", "num_frames", "frame_rate", "has_audio"])

    return files.where(schema.family(F.col("path")).isin("image", "animation", "video", "audio")).select("path", F.col("size").cast("long").alias("size")).mapInArrow(run, KIND)
