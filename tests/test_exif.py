"""Capture metadata from hand-made headers: both byte orders, four containers, and broken ones."""

import random
import struct

import pytest

from tessera.sources import exif, files


def tiff(order, main=(), detail=(), gps=()):
    """A TIFF block. Entries: (tag, type, value): text, or a list of numbers or of pairs."""
    o = "<" if order == b"II" else ">"
    parts, at = [], 8
    places = {}
    for name, entries in (("gps", gps), ("detail", detail), ("main", None)):
        if entries is None:
            entries = [*main, *([(0x8769, 4, [places["detail"]])] if detail else []), *([(0x8825, 4, [places["gps"]])] if gps else [])]
        size = 2 + 12 * len(entries) + 4
        places[name], extra, body = at, b"", struct.pack(o + "H", len(entries))
        for tag, kind, value in entries:
            raw = value.encode() + b"\0" if kind == 2 else b"".join(struct.pack(o + {3: "H", 4: "I"}[kind], v) if kind in (3, 4) else struct.pack(o + "II", *v) for v in value)
            n = len(raw) if kind == 2 else len(value)
            if len(raw) <= 4:
                body += struct.pack(o + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
            else:
                body += struct.pack(o + "HHII", tag, kind, n, at + size + len(extra))
                extra += raw
        parts.append(body + struct.pack(o + "I", 0) + extra)
        at += len(parts[-1])
    return order + struct.pack(o + "HI", 42, places["main"]) + b"".join(parts)


def jpeg(block):
    app = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda\x00\x02" + b"\xff\xd9"


def png(block):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"eXIf", block) + chunk(b"IEND", b"")


def webp(block):
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF\0\0\0\0WEBP" + chunk(b"VP8 ", b"odd") + chunk(b"EXIF", block)


MAIN = [(0x010F, 2, "Maker"), (0x0110, 2, "Model 7"), (0x0132, 2, "2025:05:20 20:30:00")]
DETAIL = [(0x9003, 2, "2025:05:19 10:11:12"), (0x9011, 2, "+08:00")]
GPS = [(1, 2, "S"), (2, 5, [(30, 1), (15, 1), (0, 1)]), (3, 2, "W"), (4, 5, [(120, 1), (0, 1), (3600, 100)])]


@pytest.mark.parametrize("order", [b"II", b"MM"])
@pytest.mark.parametrize("wrap", [bytes, jpeg, png, webp])
def test_time_place_and_device(order, wrap):
    taken, offset, device, lat, lon = exif.capture(wrap(tiff(order, MAIN, DETAIL, GPS)))
    assert (taken, offset, device) == ("2025:05:19 10:11:12", "+08:00", "Model 7")
    assert lat == pytest.approx(-30.25) and lon == pytest.approx(-120.01)


def test_what_is_missing_or_broken():
    assert exif.capture(jpeg(tiff(b"II", MAIN[:1]))) == (None, None, "Maker", None, None)
    assert exif.capture(jpeg(tiff(b"II", MAIN))) == ("2025:05:20 20:30:00", None, "Model 7", None, None)
    assert exif.capture(tiff(b"MM", (), (), GPS[:2])) == (None,) * 5  # one coordinate is none
    assert exif.capture(tiff(b"MM", (), (), [(2, 5, [(30, 0)]), (4, 5, [(1, 1)])])) == (None,) * 5
    for junk in (None, b"", b"not an image", b"II", b"II*\0", b"\xff\xd8\xff", b"RIFF\0\0\0\0WEBP", b"\x89PNG\r\n\x1a\n"):
        assert exif.capture(junk) == (None,) * 5
    loop = bytearray(tiff(b"II", MAIN, DETAIL, GPS))
    loop[8:10] = b"\xff\xff"  # a directory of 65535 entries
    exif.capture(bytes(loop))


def test_damaged_blocks_never_raise():
    rng = random.Random(1)
    good = jpeg(tiff(b"MM", MAIN, DETAIL, GPS))
    for _ in range(3000):
        bad = bytearray(good[: rng.randrange(len(good) + 1)])
        for _ in range(rng.randrange(4)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert len(exif.capture(bytes(bad))) == 5


def test_ingest_reads_it(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(tiff(b"II", MAIN, DETAIL, GPS)))
    (tmp_path / "b.heic").write_bytes(b"nothing to read")
    (tmp_path / "c.xyz").write_bytes(b"x")
    got = {r.path.split("/")[-1]: r for r in files.ingest(spark, str(tmp_path)).collect()}
    a = got["a.jpg"]
    assert (a.captured_at, a.device, a.mime_type, a.media_type) == ("2025-05-19T10:11:12+08:00", "Model 7", "image/jpeg", "image") and a.gps.lat == pytest.approx(-30.25)
    assert (got["b.heic"].media_type, got["b.heic"].captured_at, got["b.heic"].gps) == ("image", None, None)
    assert (got["c.xyz"].media_type, got["c.xyz"].mime_type) == ("text", None)
    said = spark.createDataFrame([("x.bin", "video/mp4; q=1"), ("x.heic", "application/octet-stream"), ("x", None)], "p string, t string")
    assert [r[0] for r in said.select(files.media_type(files.F.col("p"), files.F.col("t"))).collect()] == ["video", "image", "text"]
