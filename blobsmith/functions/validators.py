"""Whether a blob can be of a type: its first bytes, its least length, and what its header must say.

Detection trusts first bytes for most types, so these are asked separately. All are plain expressions; a null blob is not
valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from blobsmith.functions import binary as B
from blobsmith.functions.blobs import has_magic, looks_like_tga

LARGEST_SIDE = 8192


def _packed(data: Column) -> Column:
    head = B.byte_at(data, 8)
    return (B.unsigned_le(data, 4, 4) > 0) & (head % 16 == 8) & ((head * 256 + B.byte_at(data, 9)) % 31 == 0)


def _settings(data: Column) -> Column:
    return (B.unsigned_le(data, 4, 4) + B.unsigned_le(data, 8, 4) <= F.octet_length(data)) & (B.unsigned_le(data, 16, 4) > 0)


def _surface(data: Column) -> Column:
    return (B.signed_le(data, 4, 4) == 124) & (B.signed_le(data, 12, 4) > 0) & (B.signed_le(data, 16, 4) > 0)


def _pack(data: Column) -> Column:
    textures = B.signed_le(data, 60, 4)
    return (textures > 0) & (textures < F.octet_length(data))


def _scan_lines(data: Column) -> Column:
    x0, y0, x1, y1 = (B.unsigned_le(data, at, 2) for at in (4, 6, 8, 10))
    return B.byte_at(data, 3).isin(1, 8) & (x1 >= x0) & (y1 >= y0)


def _heights(data: Column) -> Column:
    width = B.signed_le(data, 4, 4)
    return width.between(1, LARGEST_SIDE) & (F.octet_length(data) - 4 >= 2 * width)


def _texts(data: Column) -> Column:
    return B.signed_le(data, 4, 4).between(0, F.octet_length(data)) & (B.signed_le(data, 12, 4) >= 0)


def _bitmap(data: Column) -> Column:
    return B.unsigned_le(data, 14, 4).isin(12, 40)


def _sound(data: Column) -> Column:
    return B.matches_at(data, 8, b"WAVE")


def _anything(data: Column) -> Column:
    return F.lit(True)


#: Type -> least length and what the header must say beyond the first bytes.
CHECKS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "BFC": (14, _packed), "BMP": (54, _bitmap), "CBIN": (24, _settings), "DDS": (130, _surface), "FNT": (8, _anything), "JPG": (18, _anything),
    "PAK": (64, _pack), "PCX": (130, _scan_lines), "PNG": (35, _anything), "R16": (10, _heights), "RTXT": (18, _texts), "SCR": (5, _anything),
    "WAV": (46, _sound),
}


def is_valid(data: Column, kind: str) -> Column:
    """A blob passes the check of a type; TGA and TXT have no first bytes and go by their content."""
    if kind == "TGA":
        return looks_like_tga(data)
    if kind == "TXT":
        return F.coalesce(B.is_text(data), F.lit(False))
    least, check = CHECKS[kind]
    return F.coalesce(has_magic(data, kind) & (F.octet_length(data) >= least) & check(data), F.lit(False))


def valid_types(data: Column) -> Column:
    """Every type whose check a blob passes, by name."""
    each = [F.when(is_valid(data, kind), F.lit(kind)) for kind in sorted([*CHECKS, "TGA", "TXT"])]
    return F.array_compact(F.array(*each))
