"""EXIF from an image's bytes: the TIFF directories of a JPEG's APP1 segment, or of a TIFF file, in either byte order.

Bytes come in Arrow batches to a small walker. Offsets and counts are held against the bytes that there are, and no directory is
entered twice; whatever is wrong gives no field at all, as does a file of another kind. A rational over 0 is no number.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import exif_date, exposure_text

FIELDS = "original string, digitized string, make string, model string, f_number double, exposure double, iso double, lens string, lat double, lon double, orientation double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
#: Tags of the fields in the main, the camera's and the place's directory, and of the pointers to the latter two.
MAIN = {0x010F: "make", 0x0110: "model", 0x0112: "orientation"}
CAMERA = {0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "original", 0x9004: "digitized", 0xA434: "lens"}
PLACE = {0x0001: "lat_ref", 0x0002: "lat", 0x0003: "lon_ref", 0x0004: "lon"}
TO_CAMERA, TO_PLACE = 0x8769, 0x8825
#: Bytes of a value of each type, and the format of numbers.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 5: "II", 10: "ii"}


class Broken(ValueError):
    """Bytes that aren't what they say."""


def tiff_part(data: bytes) -> bytes | None:
    """The TIFF structure inside the bytes, if there is one."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # fill bytes, and markers without a length
            at += 1 if kind == 0xFF else 2
            continue
        if kind in (0xD9, 0xDA):  # the image itself begins, or all ends
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise Broken("a segment reaches beyond the file")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


class Directories:
    """Reads directories of a TIFF structure."""

    def __init__(self, tiff: bytes) -> None:
        self.tiff, self.order, self.seen = tiff, "<" if tiff[:2] == b"II" else ">", set()

    def number(self, kind: str, at: int) -> int:
        try:
            return struct.unpack_from(self.order + kind, self.tiff, at)[0]
        except struct.error as short:
            raise Broken("an offset beyond the bytes") from short

    def entries(self, at: int) -> dict[int, tuple[int, int, int]]:
        """Type, count and place of each tag's value."""
        if at in self.seen:
            raise Broken("a directory leads to itself")
        self.seen.add(at)
        found = {}
        for k in range(self.number("H", at)):
            here = at + 2 + 12 * k
            tag, kind, count = self.number("H", here), self.number("H", here + 2), self.number("I", here + 4)
            size = SIZES.get(kind, 0) * count
            place = here + 8 if size <= 4 else self.number("I", here + 8)
            if place + max(size, 4 if size <= 4 else size) > len(self.tiff):
                raise Broken("a value beyond the bytes")
            found.setdefault(tag, (kind, count, place))
        return found

    def value(self, kind: int, count: int, place: int) -> str | list[float] | None:
        """A text, or the numbers that are finite (None in the place of others)."""
        if kind == 2:
            return self.tiff[place : place + count].split(b"\0", 1)[0].decode("utf-8", "replace")
        if kind not in FORMATS or count > 16:
            return None
        raw = struct.unpack_from(self.order + FORMATS[kind] * count, self.tiff, place)
        if kind in (5, 10):
            raw = [a / b if b else math.inf for a, b in zip(raw[::2], raw[1::2])]
        return [float(x) if math.isfinite(x) else None for x in raw]

    def fields(self) -> dict[str, str | list[float] | None]:
        main = self.entries(self.number("I", 4))
        found = {name: self.value(*main[tag]) for tag, name in MAIN.items() if tag in main}
        for pointer, tags in ((TO_CAMERA, CAMERA), (TO_PLACE, PLACE)):
            if pointer in main:
                inner = self.entries(self.number("I", main[pointer][2]))
                found |= {name: self.value(*inner[tag]) for tag, name in tags.items() if tag in inner}
        return found


def degrees(parts: object, ref: object) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    return (parts[0] + parts[1] / 60 + parts[2] / 3600) * (-1 if ref in ("S", "W") else 1)


def walked(data: bytes | None) -> dict[str, object]:
    """The fields of a file's bytes; none on any failure."""
    try:
        tiff = tiff_part(data) if data else None
        found = Directories(tiff).fields() if tiff else {}
    except Broken:
        found = {}
    out: dict[str, object] = {"lat": degrees(found.pop("lat", None), found.pop("lat_ref", None)), "lon": degrees(found.pop("lon", None), found.pop("lon_ref", None))}
    for name, value in found.items():
        text = FIELDS.split(f"{name} ")[1].startswith("string")
        out[name] = value if text and isinstance(value, str) and value else value[0] if not text and isinstance(value, list) and value else None
    return out


def exif_fields(content: Column) -> Column:
    """The raw fields of a binary column, as a struct of nullable ones (``FIELDS``)."""

    @F.pandas_udf(FIELDS)
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = [walked(None if c is None else bytes(c)) for c in contents]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="object") for n in NAMES})

    return read(content)


def exif_columns(raw: Column) -> dict[str, Column]:
    """What is kept of the raw fields, by name: the original date, else that of digitizing; the exposure as it is shown."""
    date = F.when(raw["original"].isNotNull(), exif_date(raw["original"])).otherwise(exif_date(raw["digitized"]))
    return {
        "captured_at": date,
        "camera_make": raw["make"],
        "camera_model": raw["model"],
        "f_number": raw["f_number"],
        "exposure_time": exposure_text(raw["exposure"]),
        "iso": raw["iso"],
        "lens_model": raw["lens"],
        "gps_lat": raw["lat"],
        "gps_lon": raw["lon"],
        "orientation": raw["orientation"],
    }


def in_order(number: Column, size: int, little: Column) -> Column:
    """A number's bytes as hex digits."""
    big = F.lpad(F.hex(number.cast("long")), 2 * size, "0")
    return F.when(little, F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(size))])).otherwise(big)


def tiff_bytes(little: Column, make: Column, model: Column, lens: Column, date: Column, orientation: Column, exposure: tuple[Column, Column], f_number: tuple[Column, Column], iso: Column, lat: list[Column], lat_ref: Column, lon: list[Column], lon_ref: Column) -> Column:
    """A TIFF structure with these fields, as test data is made of: texts of four bytes or more, lat and lon as whole degrees, minutes and seconds."""
    n = lambda x, size: in_order(x if isinstance(x, Column) else F.lit(x), size, little)
    entry = lambda tag, kind, count, value: F.concat(n(tag, 2), n(kind, 2), n(count, 4), value)
    short = lambda x: F.when(little, F.concat(n(x, 2), F.lit("0000"))).otherwise(F.concat(n(x, 2), F.lit("0000")))
    letter = lambda x: F.concat(F.hex(F.encode(x, "UTF-8")), F.lit("000000"))
    text = lambda x: F.concat(F.hex(F.encode(x, "UTF-8")), F.lit("00"))
    length = lambda x: F.octet_length(x) + 1
    camera, place, data = 8 + 66, 8 + 66 + 66, 8 + 66 + 66 + 54
    after = F.lit(data + 84)
    at_make, at_model, at_lens = after, after + length(make), after + length(make) + length(model)
    end = n(0, 4)
    directories = [
        n(5, 2), entry(0x010F, 2, length(make), n(at_make, 4)), entry(0x0110, 2, length(model), n(at_model, 4)), entry(0x0112, 3, 1, short(orientation)), entry(TO_CAMERA, 4, 1, n(camera, 4)), entry(TO_PLACE, 4, 1, n(place, 4)), end,
        n(5, 2), entry(0x829A, 5, 1, n(data, 4)), entry(0x829D, 5, 1, n(data + 8, 4)), entry(0x8827, 3, 1, short(iso)), entry(0x9003, 2, 20, n(data + 64, 4)), entry(0xA434, 2, length(lens), n(at_lens, 4)), end,
        n(4, 2), entry(1, 2, 2, letter(lat_ref)), entry(2, 5, 3, n(data + 16, 4)), entry(3, 2, 2, letter(lon_ref)), entry(4, 5, 3, n(data + 40, 4)), end,
    ]
    values = [n(x, 4) for pair in (exposure, f_number) for x in pair] + [x for parts in (lat, lon) for p in parts for x in (n(p, 4), n(1, 4))]
    head = F.when(little, F.lit("49492A0008000000")).otherwise("4D4D002A00000008")
    return F.unhex(F.concat(head, *directories, *values, text(date), text(make), text(model), text(lens)))


def in_jpeg(tiff: Column) -> Column:
    """The bytes of a JPEG file's head with the TIFF structure in its APP1 segment, after an APP0 one."""
    size = F.lpad(F.hex((F.octet_length(tiff) + 8).cast("long")), 4, "0")
    return F.unhex(F.concat(F.lit("FFD8FFE000044A46FFE1"), size, F.lit("457869660000"), F.hex(tiff), F.lit("FFD9")))
