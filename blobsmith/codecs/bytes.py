"""Helpers of the codecs that run inside tasks: checksums, ciphers, the code page, numbers as text."""

from __future__ import annotations

import codecs
import math
import struct
import zlib

import numpy as np

M32 = 0xFFFFFFFF
CHUNK = 0x20000
#: Keys of encrypted scripts in the order they are tried, and the key of the headerless kind.
SCRIPT_KEYS = (0x2A5A8EAD, 0xA55B1EED, 0x01234567, 0xABEEFACE)
HEADERLESS_KEY = 0x04960552
#: Fixed value: the key of encrypted settings.
SETTINGS_KEY = 0x01E177CE


class FormatError(ValueError):
    """Bytes that are not what they should be."""


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & M32 if crc >> 31 else crc << 1
        table.append(crc)
    return table


_TABLE = _crc_table()
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc32_msb(data: bytes) -> int:
    """The archive checksum. It is the common CRC-32 with every byte, and the result, mirrored."""
    return int(f"{zlib.crc32(data.translate(_MIRROR)):032b}"[::-1], 2)


def crc32_quarter(data: bytes) -> int:
    """The newest archives' checksum: of each chunk it takes the first quarter of bytes, four times each, and len % 4 more."""
    out = bytearray()
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        n = len(part) >> 2
        out += np.repeat(np.frombuffer(part[:n], np.uint8), 4).tobytes() + part[n : n + (len(part) & 3)]
    return crc32_msb(bytes(out))


def rotate(value: int, by: int) -> int:
    """A 32-bit rotation to the left."""
    return (value << by | value >> 32 - by) & M32


def _stream(key: int, n: int, step) -> tuple[int, np.ndarray]:  # noqa: ANN001
    """The key after n steps, and the low byte after each."""
    out = bytearray(n)
    for i in range(n):
        key = step(key)
        out[i] = key & 0xFF
    return key, np.frombuffer(bytes(out), np.uint8)


#: Streams are kept by key, the last KEPT_KEYS of them, up to KEPT_BYTES each: that of a key is the same for every script.
KEPT_KEYS, KEPT_BYTES = 8, 4 << 20
_kept: dict[int, tuple[int, np.ndarray]] = {}


def _script_step(k: int) -> int:
    k += (k << 11 | k >> 21) & M32
    k &= M32
    return ((k << 4 | k >> 28) & M32) ^ 1


def script_stream(key: int, n: int) -> np.ndarray:
    """The bytes a script is XORed with."""
    last, known = _kept.pop(key, (key, np.zeros(0, np.uint8)))
    # twice as far as before, so that scripts of growing length do not copy it each time
    wanted = max(n, min(2 * len(known), KEPT_BYTES)) if n > len(known) else len(known)
    if wanted > len(known):
        last, more = _stream(last, wanted - len(known), _script_step)
        out = np.concatenate([known, more])
    else:
        out = known
    if len(out) <= KEPT_BYTES:
        _kept[key] = last, out
        if len(_kept) > KEPT_KEYS:
            _kept.pop(next(iter(_kept)))
    return out[:n]


def settings_stream(key: int, n: int) -> np.ndarray:
    """The bytes settings are XORed with: it repeats after 32, as seven steps do not divide the word."""
    _, first = _stream(key, min(n, 32), lambda k: rotate(k, 7))
    return np.resize(first, n)


def xor(data: bytes, stream: np.ndarray) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


#: Windows-1252 with its five holes as the control characters of the same number.
CODE_PAGE = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
_CODES = codecs.charmap_build(CODE_PAGE)


def from_1252(data: bytes) -> str:
    return codecs.charmap_decode(data, "strict", CODE_PAGE)[0]


def to_1252(text: str) -> bytes:
    """A character the page lacks becomes a question mark."""
    return codecs.charmap_encode(text, "replace", _CODES)[0]


def float_text(bits: int) -> str:
    """A 32-bit float as text that gives the same bits back: seven digits if they do, else nine."""
    value = struct.unpack("<f", struct.pack("<I", bits))[0]
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    for digits in (7, 9):
        text = f"{value:.{digits}g}"
        if struct.pack("<f", float(text)) == struct.pack("<f", value):
            break
    if "e" in text:
        mantissa, power = text.split("e")
        text = f"{mantissa}E{int(power):+03d}"
    return text if any(c in text for c in ".E") else text + ".0"


def float_bits(text: str) -> int | None:
    """The bits of a number that is written as a float; None for anything else."""
    if text == "NaN":
        return 0xFFC00000
    if text in ("Infinity", "-Infinity") or any(c in text for c in ".eE"):
        try:
            return struct.unpack("<I", struct.pack("<f", float(text)))[0]
        except (ValueError, OverflowError):
            return None
    return None
