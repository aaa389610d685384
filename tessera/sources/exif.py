"""Capture time, place and device of image files, from the directories of their EXIF block.

Only the head of a file is looked at: a JPEG's segments up to the image data (EXIF lies in an APP1 segment of at most 64 KB), a
TIFF's own directories, a PNG's eXIf chunk, a WebP's EXIF chunk. Every offset and count is checked against the block's length,
and directories are followed a bounded number of times, so a broken or hostile file gives nothing instead of an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import parse_latlon
from tessera.functions.time import normalise_exif

# Tags by number, sizes of value types, and the markers of blocks.
_MAKE, _MODEL, _DATETIME, _EXIF_IFD, _GPS_IFD = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825
_ORIGINAL, _OFFSET, _OFFSET_ORIGINAL = 0x9003, 0x9010, 0x9011
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 9: "i"}
#: Entries of a directory that are read, and bytes of a file that are searched for the block.
MAX_ENTRIES = 512
HEAD_BYTES = 1 << 20

SCHEMA = "taken string, taken_offset string, device string, lat double, lon double"


class _Block:
    """A TIFF block: values of directory entries by tag."""

    def __init__(self, data: bytes):
        self.data, self.order = data, {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if self.order and self._int(2, "H") != 42:
            self.order = ""

    def _int(self, at: int, form: str) -> int | None:
        size = struct.calcsize(form)
        return struct.unpack_from(self.order + form, self.data, at)[0] if 0 <= at <= len(self.data) - size else None

    def first(self) -> int | None:
        return self._int(4, "I") if self.order else None

    def entries(self, at: int | None) -> dict[int, object]:
        """Tag and value of a directory: text, numbers, or (numerator, denominator) pairs. Unreadable entries are left out."""
        count = self._int(at, "H") if at else None
        out: dict[int, object] = {}
        for n in range(min(count or 0, MAX_ENTRIES)):
            entry = at + 2 + 12 * n
            tag, kind, values = self._int(entry, "H"), self._int(entry + 2, "H"), self._int(entry + 4, "I")
            if tag is None or kind not in _SIZES or not values:
                continue
            size = _SIZES[kind] * values
            place = entry + 8 if size <= 4 else self._int(entry + 8, "I")
            if place is None or place + size > len(self.data):
                continue
            raw = self.data[place : place + size]
            if kind == 2:
                out.setdefault(tag, raw.split(b"\0")[0].decode("utf-8", "replace").strip())
            elif kind in (5, 10):
                numbers = struct.unpack(f"{self.order}{2 * values}{'I' if kind == 5 else 'i'}", raw)
                out.setdefault(tag, list(zip(numbers[::2], numbers[1::2])))
            elif kind in _FORMATS:
                out.setdefault(tag, list(struct.unpack(f"{self.order}{values}{_FORMATS[kind]}", raw)))
        return out


def block_of(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG, TIFF, PNG or WebP file; None without one."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xFF:  # filling
                at += 1
                continue
            if marker in (0xD9, 0xDA) or size < 2:
                return None
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _chunk(data, 8, b"eXIf", "big", 4, 12)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = _chunk(data, 12, b"EXIF", "little", 0, 8)
        return found[6:] if found and found[:6] == b"Exif\0\0" else found
    return None


def _chunk(data: bytes, at: int, name: bytes, order: str, name_at: int, around: int) -> bytes | None:
    """The content of the first chunk of a name. PNG: size, name, content, checksum; WebP: name, size, content, padded to even."""
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 - name_at : at + 8 - name_at], order)
        if data[at + name_at : at + name_at + 4] == name:
            return data[at + 8 : at + 8 + size]
        at += around + size + (size % 2 if order == "little" else 0)
    return None


def _degrees(values, hemisphere, negative: str) -> float | None:
    """Degrees, minutes and seconds as one number."""
    if not isinstance(values, list) or not values or not all(isinstance(v, tuple) for v in values) or any(d == 0 for _, d in values):
        return None
    out = sum(n / d / 60**i for i, (n, d) in enumerate(values[:3]))
    return -out if str(hemisphere or "").upper().startswith(negative) else out


def capture(data: bytes | None) -> tuple[str | None, str | None, str | None, float | None, float | None]:
    """taken (as written in the file), its offset, device, latitude and longitude."""
    block = _Block(block_of(data) or b"") if data else _Block(b"")
    main = block.entries(block.first())
    link = lambda tag: (main.get(tag) or [None])[0] if isinstance(main.get(tag), list) else None
    detail, gps = block.entries(link(_EXIF_IFD)), block.entries(link(_GPS_IFD))
    text = lambda x: x if isinstance(x, str) and x else None
    lat, lon = _degrees(gps.get(2), gps.get(1), "S"), _degrees(gps.get(4), gps.get(3), "W")
    both = lat is not None and lon is not None
    return text(detail.get(_ORIGINAL)) or text(main.get(_DATETIME)), text(detail.get(_OFFSET_ORIGINAL)) or text(detail.get(_OFFSET)), text(main.get(_MODEL)) or text(main.get(_MAKE)), lat if both else None, lon if both else None


def with_capture(files: DataFrame) -> DataFrame:
    """files (with content) with captured_at (`Y-M-D h:m:s`, with the offset if there is one), device, and gps (struct<lat, lon>).

    A position out of range, or of (0, 0), is none. Content is streamed through in Arrow batches, a file's head at a time.
    """

    @F.pandas_udf(SCHEMA)
    def read(heads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in heads:
            yield pd.DataFrame([capture(bytes(x) if x is not None else None) for x in batch], columns=["taken", "taken_offset", "device", "lat", "lon"])

    rows = files.withColumn("__c", read(F.substring("content", 1, HEAD_BYTES)))
    offset = F.when(F.col("__c.taken_offset").rlike("^[+-]"), F.col("__c.taken_offset"))
    gps = parse_latlon(F.concat_ws(",", F.col("__c.lat").cast("string"), F.col("__c.lon").cast("string")))
    return rows.select(*files.columns, normalise_exif(F.col("__c.taken"), offset).alias("captured_at"), F.col("__c.device").alias("device"), gps.alias("gps"))
