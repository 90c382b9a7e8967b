"""Pictures to (width, height, BGRA bytes), sounds to 16-bit PCM, and packs of models and textures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .bytes import FormatError, from_1252

LARGEST = 8192
Image = tuple[int, int, bytes]


def _image(bgra: np.ndarray) -> Image:
    return bgra.shape[1], bgra.shape[0], np.ascontiguousarray(bgra, np.uint8).tobytes()


def _sized(width: int, height: int) -> None:
    if not (0 < width <= LARGEST and 0 < height <= LARGEST):
        raise FormatError(f"{width} x {height} is no size of a picture")


# PCX


def rle_decode(data: bytes, size: int) -> bytes:
    """PCX runs: a byte over 191 says how often the next one stands."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        b = data[at]
        at += 1
        if b >= 0xC0 and at < len(data):
            out += data[at : at + 1] * (b & 0x3F)
            at += 1
        else:
            out.append(b)
    return bytes(out[:size]).ljust(size, b"\0")


def rle_encode(row: bytes) -> bytes:
    """The inverse for a scan line: runs of at most 63."""
    codes, out = np.frombuffer(row, np.uint8), bytearray()
    edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    for a, b in zip(edges, edges[1:], strict=False):
        value, n = row[a], b - a
        while n > 0:
            k = min(63, n)
            out += bytes([0xC0 | k, value]) if k > 1 or value >= 0xC0 else bytes([value])
            n -= k
    return bytes(out)


def pcx_image(data: bytes, transparent: bool = False) -> Image:
    """1, 4 or 8 bits a pixel with a palette, or 24; transparent leaves colour 0 out."""
    if len(data) < 128 or data[0] != 10:
        raise FormatError("not a PCX picture")
    bits = data[3]
    x0, y0, x1, y1 = struct.unpack_from("<HHHH", data, 4)
    planes, wide = data[65], struct.unpack_from("<H", data, 66)[0]
    width, height = x1 - x0 + 1, y1 - y0 + 1
    _sized(width, height)
    lines = np.frombuffer(rle_decode(data[128:], height * planes * wide), np.uint8).reshape(height, planes, wide)
    out = np.full((height, width, 4), 255, np.uint8)
    if bits == 8 and planes == 3:
        out[:, :, :3] = lines[:, ::-1, :width].transpose(0, 2, 1)
        return _image(out)
    if bits == 8 and planes == 1:
        index = lines[:, 0, :width]
        tail = data[-769:]
        palette = np.frombuffer(tail[1:], np.uint8).reshape(256, 3) if tail[0] == 12 and len(tail) == 769 else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
    elif bits == 1 and planes in (1, 4):
        index = (np.unpackbits(lines, axis=2)[:, :, :width] << np.arange(planes, dtype=np.uint8)[None, :, None]).sum(1)
        palette = np.frombuffer(data[16:64], np.uint8).reshape(16, 3) if planes == 4 else np.array([[0] * 3, [255] * 3], np.uint8)
    else:
        raise FormatError(f"PCX with {bits} bits in {planes} planes")
    out[:, :, :3] = palette[index][:, :, ::-1]
    if transparent:
        out[index == 0, 3] = 0
    return _image(out)


def pcx_bytes(image: Image, palette: bytes | None = None) -> bytes:
    """A PCX of 256 colours if the picture has no more, else of 24 bits."""
    width, height, raw = image
    _sized(width, height)
    bgr = np.frombuffer(raw, np.uint8).reshape(height, width, 4)[:, :, :3]
    # red, green and blue as one number, which orders as the three do
    codes, index = np.unique(bgr.reshape(-1, 3).astype(np.int32) @ np.array([1, 1 << 8, 1 << 16], np.int32), return_inverse=True)
    colours = codes[:, None] >> np.array([16, 8, 0], np.int32) & 255
    wide, small = width + width % 2, len(colours) <= 256
    head = struct.pack("<BBBBHHHHHH48sBBHH58s", 10, 5, 1, 8, 0, 0, width - 1, height - 1, 72, 72, b"", 0, 1 if small else 3, wide, 1, b"")
    if small:
        planes = index.reshape(height, 1, width).astype(np.uint8)
    else:
        planes = bgr[:, :, ::-1].transpose(0, 2, 1)
    rows = np.zeros((height, planes.shape[1], wide), np.uint8)
    rows[:, :, :width] = planes
    body = b"".join(rle_encode(r.tobytes()) for line in rows for r in line)
    return head + body + (b"\x0c" + colours.astype(np.uint8).tobytes().ljust(768, b"\0") if small else b"")


# DDS, TGA and the plain ones


def dds_image(data: bytes) -> Image:
    """DXT1, DXT3, DXT5 blocks, or 32-bit pixels."""
    if data[:4] != b"DDS " or len(data) < 128:
        raise FormatError("not a DDS picture")
    height, width = struct.unpack_from("<II", data, 12)
    _sized(width, height)
    flags, code, bits = struct.unpack_from("<I4sI", data, 80)
    if not flags & 4:
        if bits != 32 or len(data) < 128 + 4 * width * height:
            raise FormatError(f"DDS with {bits} bits a pixel")
        red, green, blue, alpha = struct.unpack_from("<IIII", data, 92)
        raw = np.frombuffer(data, "<u4", width * height, 128).reshape(height, width)
        out = np.full((height, width, 4), 255, np.uint8)
        for i, m in enumerate((blue, green, red, alpha)):
            if m:
                out[:, :, i] = (raw & m) >> ((m & -m).bit_length() - 1)
        return _image(out)
    across, down = (width + 3) // 4, (height + 3) // 4
    size = 8 if code == b"DXT1" else 16
    if code not in (b"DXT1", b"DXT3", b"DXT5") or len(data) < 128 + across * down * size:
        raise FormatError(f"DDS of kind {code!r}")
    blocks = np.frombuffer(data, np.uint8, across * down * size, 128).reshape(-1, size)
    colour = blocks[:, size - 8 :]
    ends = colour[:, :4].copy().view("<u2").astype(np.int64)
    rgb = np.stack([(ends >> 11 & 31) * 255 // 31, (ends >> 5 & 63) * 255 // 63, (ends & 31) * 255 // 31], 2)
    a, b = rgb[:, 0], rgb[:, 1]
    four = ((ends[:, 0] > ends[:, 1]) | (code != b"DXT1"))[:, None]
    table = np.stack([a, b, np.where(four, (2 * a + b) // 3, (a + b) // 2), np.where(four, (a + 2 * b) // 3, 0)], 1)
    pick = (colour[:, 4:].copy().view("<u4").astype(np.int64) >> np.arange(0, 32, 2)) & 3
    pixels = np.full((len(blocks), 16, 4), 255, np.int64)
    pixels[:, :, :3] = np.take_along_axis(table, pick[:, :, None], 1)[:, :, ::-1]
    if code == b"DXT1":
        pixels[:, :, 3] = np.where(~four & (pick == 3), 0, 255)
    elif code == b"DXT3":
        pixels[:, :, 3] = ((blocks[:, :8].copy().view("<u8") >> np.arange(0, 64, 4, dtype=np.uint64)) & np.uint64(15)).astype(np.int64) * 17
    else:
        lo, hi = blocks[:, 0].astype(np.int64)[:, None], blocks[:, 1].astype(np.int64)[:, None]
        k = np.arange(1, 7)
        eight = (lo * (7 - k) + hi * k) // 7
        k = np.arange(1, 5)
        six = np.concatenate([(lo * (5 - k) + hi * k) // 5, np.zeros_like(lo), np.full_like(lo, 255)], 1)
        alphas = np.concatenate([lo, hi, np.where(lo > hi, eight, six)], 1)
        packed = np.concatenate([blocks[:, 2:8], np.zeros((len(blocks), 2), np.uint8)], 1).view("<u8")
        pixels[:, :, 3] = np.take_along_axis(alphas, ((packed >> np.arange(0, 48, 3, dtype=np.uint64)) & np.uint64(7)).astype(np.int64), 1)
    out = pixels.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(4 * down, 4 * across, 4)
    return _image(out[:height, :width])


def tga_image(data: bytes) -> Image:
    """Types 1, 2, 9 and 10: palette or true colour, plain or in runs. The right-to-left flag is not looked at."""
    if not is_tga(data):
        raise FormatError("not a TGA picture")
    skip, _, kind, _, count, depth = struct.unpack_from("<BBBHHB", data)
    width, height, bits, look = struct.unpack_from("<HHBB", data, 12)
    at, size = 18 + skip, bits // 8
    step = (depth + 7) // 8
    palette = data[at : at + count * step] if data[1] else b""
    at += len(palette)
    if kind >= 9:
        body = bytearray()
        while len(body) < width * height * size and at < len(data):
            n, run = (data[at] & 127) + 1, data[at] >> 7
            body += data[at + 1 : at + 1 + size] * n if run else data[at + 1 : at + 1 + size * n]
            at += 1 + (size if run else size * n)
    else:
        body = data[at : at + width * height * size]
    if len(body) < width * height * size:
        raise FormatError("the picture ends early")
    raw = np.frombuffer(bytes(body[: width * height * size]), np.uint8).reshape(-1, size)
    if kind in (1, 9):
        raw = np.frombuffer(palette, np.uint8).reshape(count, step)[raw[:, 0]]
    out = np.full((len(raw), 4), 255, np.uint8)
    if raw.shape[1] == 2:
        word = raw.copy().view("<u2")[:, 0].astype(np.int64)
        out[:, 0], out[:, 1], out[:, 2] = (word & 31) << 3, (word >> 5 & 31) << 3, (word >> 10 & 31) << 3
        out[:, 3] = np.where(word & 0x8000, 255, 0)
    else:
        out[:, : raw.shape[1]] = raw
    out = out.reshape(height, width, 4)
    return _image(out if look & 0x20 else out[::-1])


def is_tga(data: bytes) -> bool:
    """The header makes sense as one of the kinds that are read."""
    if len(data) < 18:
        return False
    kind, has_map = data[2], data[1]
    width, height, bits = struct.unpack_from("<HHB", data, 12)
    if kind in (1, 9):
        return has_map == 1 and bits == 8 and data[7] in (15, 16, 24, 32) and 0 < width <= LARGEST and 0 < height <= LARGEST
    return kind in (2, 10) and has_map == 0 and bits in (15, 16, 24, 32) and 0 < width <= LARGEST and 0 < height <= LARGEST


def is_bmp(data: bytes) -> bool:
    """A BM header of a known size whose pixels start inside the file."""
    return len(data) >= 54 and data[:2] == b"BM" and data[14:18] in (b"\x28\0\0\0", b"\x0c\0\0\0") and 26 <= struct.unpack_from("<I", data, 10)[0] <= len(data)


def r16_image(data: bytes) -> Image:
    """Heights of 16 bits, shown by their high byte. The width field stands where the pixels start, and counts as pixels."""
    if data[:4] != b"R16a" or len(data) < 8:
        raise FormatError("not a height map")
    (width,) = struct.unpack_from("<i", data, 4)
    _sized(width, 1)
    height = (len(data) - 4) // 2 // width
    _sized(width, height)
    grey = np.frombuffer(data, "<u2", width * height, 4).reshape(height, width) >> 8
    return _image(np.dstack([grey, grey, grey, np.full_like(grey, 255)]))


def fnt_image(data: bytes) -> Image:
    """The first page of the atlas at the end of a font file, of the shape that leaves the least before it, on dark grey."""
    if data[:4] != b"FNT0":
        raise FormatError("not a font")
    shapes = [(len(data) - h * w * 1024, -h, w) for h in (768, 512, 256) for w in range(1, 17) if len(data) - h * w * 1024 >= 8]
    if not shapes:
        raise FormatError("no atlas fits")
    before, low, pages = min(shapes)
    atlas = np.frombuffer(data, np.uint8, -low * pages * 1024, before).reshape(-low, pages * 256, 4)[:, :256].astype(np.int64)
    alpha = atlas[:, :, 3:]
    flat = np.full(atlas.shape, 255, np.int64)
    flat[:, :, :3] = (atlas[:, :, :3] * alpha + 32 * (255 - alpha)) // 255
    return _image(flat)


def bmp_image(data: bytes) -> Image:
    """Uncompressed 8-, 24- or 32-bit bitmaps."""
    if not is_bmp(data):
        raise FormatError("not a bitmap")
    (at,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    _sized(width, abs(height))
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise FormatError(f"bitmap of {bits} bits, packed {packed}")
    wide = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, wide * abs(height), at).reshape(abs(height), wide)[:, : width * bits // 8]
    out = np.full((abs(height), width, 4), 255, np.uint8)
    if bits == 8:
        palette = np.frombuffer(data[14 + size : at], np.uint8).reshape(-1, 4)
        out[:, :, :3] = palette[rows][:, :, :3]
    else:
        out[:, :, :3] = rows.reshape(abs(height), width, bits // 8)[:, :, :3]
    return _image(out[::-1] if height > 0 else out)


def png_bytes(image: Image) -> bytes:
    """A PNG of 8-bit RGBA."""
    width, height, raw = image
    rgba = np.frombuffer(raw, np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], 1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def without_alpha(image: Image) -> Image:
    """Every pixel opaque."""
    width, height, raw = image
    out = np.frombuffer(raw, np.uint8).reshape(height, width, 4).copy()
    out[:, :, 3] = 255
    return _image(out)


IMAGES = {"PCX": pcx_image, "DDS": dds_image, "TGA": tga_image, "R16": r16_image, "FNT": fnt_image, "BMP": bmp_image}

# sounds

PCM, IMA, FLOATS = 1, 0x11, 3
#: The changes of the step index; the 89 steps follow the rule of a tenth more each time.
_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def riff_chunks(data: bytes) -> list[tuple[bytes, int, bytes]]:
    """(name, position, content) of each chunk; odd ones are followed by a byte that belongs to none."""
    at, out = 12, []
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        out.append((name, at + 8, data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def wav_pcm(data: bytes) -> tuple[int, int, bytes]:
    """(channels, rate, 16-bit samples) of PCM of 8 to 32 bits, floats, or IMA ADPCM. The last fmt and data chunks count."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise FormatError("not a sound")
    found = {name: content for name, _, content in riff_chunks(data)}
    fmt, body = found.get(b"fmt "), found.get(b"data")
    if fmt is None or body is None or len(fmt) < 16:
        raise FormatError("no samples")
    kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", fmt)
    if kind == PCM and bits in (8, 16, 24, 32):
        if bits == 16:
            return channels, rate, body
        raw = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], np.uint8).reshape(-1, bits // 8)
        if bits == 8:
            return channels, rate, ((raw[:, 0].astype(np.int32) - 128) << 8).astype("<i2").tobytes()
        return channels, rate, np.ascontiguousarray(raw[:, -2:]).tobytes()
    if kind == FLOATS and bits == 32:
        x = np.clip(np.nan_to_num(np.frombuffer(body[: len(body) // 4 * 4], "<f4")), -1, 1)
        return channels, rate, (x * 32767).astype("<i2").tobytes()
    if kind == IMA and bits == 4 and channels and align:
        per = struct.unpack_from("<H", fmt, 18)[0] if len(fmt) >= 20 else 0
        return channels, rate, _adpcm(body, channels, align, per or (align - 4 * channels) * 2 // channels + 1)
    raise FormatError(f"sound of kind {kind} with {bits} bits")


def _adpcm(body: bytes, channels: int, align: int, per_block: int) -> bytes:
    """IMA ADPCM; the channels take turns nibble by nibble. All blocks are decoded side by side."""
    blocks = np.frombuffer(body[: len(body) // align * align], np.uint8).reshape(-1, align)
    if not len(blocks):
        raise FormatError("no whole block")
    heads = blocks[:, : 4 * channels].reshape(len(blocks), channels, 4)
    value = np.ascontiguousarray(heads[:, :, :2]).view("<i2")[:, :, 0].astype(np.int64)
    index = np.minimum(heads[:, :, 2].astype(np.int64), 88)
    rest = blocks[:, 4 * channels :]
    codes = np.stack([rest & 15, rest >> 4], 2).reshape(len(blocks), -1).astype(np.int64)
    frames = min(codes.shape[1], (per_block - 1) * channels) // channels
    steps, moves = np.array(STEPS), np.array(_INDEX)
    out = np.empty((len(blocks), frames + 1, channels), np.int64)
    out[:, 0] = value
    for f in range(frames):
        code, step = codes[:, f * channels : (f + 1) * channels], steps[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + moves[code & 7], 0, 88)
        out[:, f + 1] = value
    return out.astype("<i2").tobytes()


def wav_bytes(channels: int, rate: int, pcm: bytes) -> bytes:
    """A sound file of 16-bit samples."""
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(pcm), b"WAVE", b"fmt ", 16, PCM, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(pcm)) + pcm


# packs of models and textures


def pak_entries(data: bytes, palette: bytes | None = None) -> list[dict]:
    """Models, then textures as PCX pictures; of one name the first counts (verdict: kept, same or different).

    A texture takes its own palette, else the one given, else greys.
    """
    if data[:4] != b"3DPK" or len(data) < 68:
        raise FormatError("not a pack")
    start, end = struct.unpack_from("<ii", data, 60)
    if not 0 <= start <= len(data) or end > len(data):
        raise FormatError("the texture table is past the end")
    at, models = data.find(b"3DO1", 68, start), []
    while at >= 0:
        models.append(at)
        at = data.find(b"3DO1", at + 1, start)
    if not models:
        raise FormatError("no models")
    out = []
    for a, b in zip(models, [*models[1:], start], strict=True):
        out.append({"kind": "model", "name": from_1252(data[a + 8 : a + 16].split(b"\0")[0]), "width": None, "height": None, "palette_count": None, "content": data[a:b]})
    (count,) = struct.unpack_from("<i", data, start)
    at = start + 4
    for _ in range(count):
        name = from_1252(data[at : at + 11].split(b"\0")[0])
        colours, width, height, size = *struct.unpack_from("<H", data, at + 12), *struct.unpack_from("<IIi", data, at + 16)
        at += 28
        body, at = data[at : at + size], at + size
        own = None
        if colours == 256:
            own, at = data[at : at + 768], at + 768
        greys = bytes(v for i in range(256) for v in (i, i, i))
        head = struct.pack("<BBBBHHHHHH48sBBHH58s", 10, 5, 1, 8, 0, 0, width - 1, height - 1, 72, 72, b"", 0, 1, width, 1, b"")
        out.append({"kind": "texture", "name": name, "width": width, "height": height, "palette_count": colours, "content": head + body + b"\x0c" + (own or palette or greys)})
    first: dict[str, bytes] = {}
    for i, e in enumerate(out):
        key = e["name"].upper()
        e["seq"], e["verdict"] = i, "kept" if key not in first else "same" if first[key] == e["content"] else "different"
        first.setdefault(key, e["content"])
    return out
