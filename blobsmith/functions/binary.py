"""Byte expressions: little-endian numbers, bits, checksums and hexadecimal, all in the JVM.

Arithmetic on 32-bit values runs in longs under a mask, as ANSI mode refuses to wrap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: The bytes that no text holds.
NOT_TEXT = r"0[0-8]|0B|0C|0E|0F|1[0-9]|1[B-F]|81|8D|8F|90|9D"
TEXT_SCAN = 4096
#: Fixed values of the archive checksum.
CRC_POLYNOMIAL, CRC_START = 0x04C11DB7, 0xFFFFFFFF


def byte_at(data: Column, position: int | Column) -> Column:
    """The byte at a position (from 0) as a long; null past the end."""
    at = position if isinstance(position, Column) else F.lit(position)
    return F.conv(F.hex(F.call_function("substring", data, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("long")


def byte_array(data: Column) -> Column:
    """The bytes as an array of longs."""
    wide = F.octet_length(data)
    return F.when(wide == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), wide - 1), lambda i: byte_at(data, i)))


def unsigned_le(data: Column, position: int, size: int) -> Column:
    """A little-endian unsigned number of up to 7 bytes."""
    total = F.lit(0).cast("long")
    for i in range(size):
        total = total + byte_at(data, position + i) * (1 << 8 * i)
    return total


def signed_le(data: Column, position: int, size: int) -> Column:
    """A little-endian signed number of up to 4 bytes."""
    raw = unsigned_le(data, position, size)
    return F.when(raw >= 1 << (8 * size - 1), raw - (1 << 8 * size)).otherwise(raw)


def unsigned_le64(data: Column, position: int) -> Column:
    """A little-endian unsigned number of 8 bytes, as a decimal."""
    low, high = (unsigned_le(data, position + i, 4).cast("decimal(20,0)") for i in (0, 4))
    return (high * F.lit(1 << 32).cast("decimal(20,0)") + low).cast("decimal(20,0)")


def signed_le64(data: Column, position: int) -> Column:
    """A little-endian signed number of 8 bytes."""
    return F.shiftleft(signed_le(data, position + 4, 4), 32).bitwiseOR(unsigned_le(data, position, 4))


def _real(sign: Column, exponent: Column, share: Column, bias: int) -> Column:
    """A binary float from its parts; share is the mantissa over its range."""
    one = F.when(exponent == 0, share * F.pow(F.lit(2.0), F.lit(1.0 - bias))).otherwise((1 + share) * F.pow(F.lit(2.0), exponent - bias))
    odd = F.when(share == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(exponent == 2 * bias + 1, odd).otherwise(one) * F.when(sign == 1, -1.0).otherwise(1.0)


def float_le(data: Column, position: int) -> Column:
    """A little-endian 32-bit float, as a double."""
    raw = unsigned_le(data, position, 4)
    return _real(F.shiftright(raw, 31), F.shiftright(raw, 23).bitwiseAND(F.lit(0xFF)), raw.bitwiseAND(F.lit(0x7FFFFF)) / F.lit(float(1 << 23)), 127)


def double_le(data: Column, position: int) -> Column:
    """A little-endian 64-bit float."""
    low, high = unsigned_le(data, position, 4), unsigned_le(data, position + 4, 4)
    share = high.bitwiseAND(F.lit(0xFFFFF)) / F.lit(float(1 << 20)) + low / F.lit(float(1 << 52))
    return _real(F.shiftright(high, 31), F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF)), share, 1023)


def rotate_left(value: Column, by: int) -> Column:
    """A 32-bit value, in a long, rotated."""
    return F.shiftleft(value, by).bitwiseOR(F.shiftright(value, 32 - by)).bitwiseAND(F.lit(MASK))


def rotate_right(value: Column, by: int) -> Column:
    """A 32-bit value, in a long, rotated the other way."""
    return rotate_left(value, 32 - by)


def swap32(value: Column) -> Column:
    """A 32-bit value with its bytes in the other order."""
    out = F.lit(0).cast("long")
    for i in range(4):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, 8 * i).bitwiseAND(F.lit(0xFF)), 24 - 8 * i))
    return out


def swap16(value: Column) -> Column:
    """A 16-bit value with its bytes in the other order."""
    return F.shiftleft(value.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(value, 8).bitwiseAND(F.lit(0xFF)))


def bit_is_set(value: Column, bit: int) -> Column:
    """A bit is 1."""
    return value.bitwiseAND(F.lit(1 << bit)) != 0


def with_bit(value: Column, bit: int, on: bool = True) -> Column:
    """A bit set or cleared."""
    return value.bitwiseOR(F.lit(1 << bit)) if on else value.bitwiseAND(F.lit(~(1 << bit)))


def toggled(value: Column, bit: int) -> Column:
    """A bit turned over."""
    return value.bitwiseXOR(F.lit(1 << bit))


def aligned(value: Column, boundary: int) -> Column:
    """The next multiple of a boundary."""
    return value + F.pmod(-value, F.lit(boundary))


def is_light(red: Column, green: Column, blue: Column) -> Column:
    """A colour looks lighter than mid grey."""
    return red * 0.299 + green * 0.587 + blue * 0.114 > 128


def is_text(data: Column) -> Column:
    """None of the first bytes is one that texts do not hold."""
    return ~F.hex(F.call_function("substring", data, F.lit(1), F.lit(TEXT_SCAN))).rlike(f"^(..)*?({NOT_TEXT})")


def matches_at(data: Column, position: int, pattern: bytes) -> Column:
    """The bytes at a position (from 0) are these; false past the end and for null."""
    return F.coalesce(F.call_function("substring", data, F.lit(position + 1), F.lit(len(pattern))) == F.lit(pattern), F.lit(False))


def starts_with(data: Column, pattern: bytes) -> Column:
    """The first bytes are these."""
    return matches_at(data, 0, pattern)


def find_matches(data: Column, pattern: bytes, start: int = 0, end: int | None = None) -> Column:
    """Every position (from 0) in start..end where the bytes stand, overlaps too; end is a position, not a length."""
    size = F.octet_length(data) if end is None else F.least(F.octet_length(data), F.lit(end))
    last, first, none = size - len(pattern), max(0, start), F.array().cast("array<int>")
    places = F.filter(F.sequence(F.lit(first), last), lambda i: F.call_function("substring", data, i + 1, F.lit(len(pattern))) == F.lit(pattern))
    return F.when(F.lit(not pattern) | (last < first) | data.isNull(), none).otherwise(places)


def index_of(data: Column, pattern: bytes, start: int = 0) -> Column:
    """The first such position, -1 without one."""
    return F.coalesce(F.array_min(find_matches(data, pattern, start)), F.lit(-1))


def reversed_bytes(data: Column) -> Column:
    """The bytes in the other order; reverse() would turn characters."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))), ""))


def tail(data: Column, size: int) -> Column:
    """The last bytes, all of a shorter blob."""
    return F.call_function("substring", data, F.lit(-size), F.lit(size))


def padded(data: Column, size: int) -> Column:
    """The bytes filled up with zeros to a size; longer ones are an error."""
    long = F.raise_error(F.concat(F.octet_length(data).cast("string"), F.lit(f" bytes do not fit into {size}")))
    return F.when(F.octet_length(data) > size, long.cast("binary")).otherwise(padded_or_cut(data, size))


def padded_or_cut(data: Column, size: int) -> Column:
    """The bytes filled up with zeros, or cut, to a size."""
    return F.call_function("substring", F.concat(data, F.lit(bytes(size))), F.lit(1), F.lit(size))


def is_printable(data: Column, chars_only: bool = False) -> Column:
    """Only bytes of printable ASCII, and tabs and line ends unless chars_only."""
    more = "" if chars_only else "|09|0A|0D"
    return F.hex(data).rlike(f"^([2-6].|7[0-9A-E]{more})*+$")


def hex_dump(data: Column) -> Column:
    """Bytes as pairs of hexadecimal digits with blanks between."""
    return F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def crc32_msb(data: Column) -> Column:
    """The archive checksum, most significant bit first. For short blobs: it folds bit by bit in plain expressions."""

    def step(crc: Column, byte: Column) -> Column:
        crc = crc.bitwiseXOR(F.shiftleft(byte, 24))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc, lambda c, _: F.shiftleft(c, 1).bitwiseAND(F.lit(MASK)).bitwiseXOR(
            F.when(c >= 0x80000000, F.lit(CRC_POLYNOMIAL)).otherwise(F.lit(0)).cast("long")))

    return F.aggregate(byte_array(data), F.lit(CRC_START).cast("long"), step).bitwiseXOR(F.lit(MASK))


def adler32(data: Column) -> Column:
    """Adler-32. For short blobs, as crc32_msb."""
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc: Column, byte: Column) -> Column:
        a = (acc["a"] + byte) % 65521
        return F.struct(a.alias("a"), ((acc["b"] + a) % 65521).alias("b"))

    return F.aggregate(byte_array(data), start, step, lambda acc: acc["b"] * 65536 + acc["a"])
