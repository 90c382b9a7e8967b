"""Known answers and round trips of the codecs."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blobsmith.codecs import bytes as b
from blobsmith.codecs import media, text


@pytest.mark.parametrize(("key", "head"), [
    (0x2A5A8EAD, "fe5fe5ae9789061f"), (0xA55B1EED, "76f3dfa959f7ff68"), (0x01234567, "007ed3b78783740e"), (0xABEEFACE, "d35e40aa4166b234"),
    (0x04960552, "6aa8ad412fb8d67a")])
def test_script_keystream(key, head):
    assert b.script_stream(key, 8).tobytes().hex() == head


def test_checksums():
    assert b.crc32_msb(b"123456789") == 0xFC891918 and b.crc32_quarter(b"123456789") == 0x7DD1E6FD
    assert b.settings_stream(0x01E177CE, 8).tobytes().hex() == "00782e7c7007c277"
    assert zlib.adler32(b"Wikipedia") == 0x11E60398


@given(st.binary(max_size=300))
def test_code_page_round_trip(data):
    assert b.to_1252(b.from_1252(data)) == data


@given(st.integers(0, 2**32 - 1))
def test_float_text_gives_the_bits_back(bits):
    back = b.float_bits(b.float_text(bits))
    nan = bits & 0x7F800000 == 0x7F800000 and bits & 0x7FFFFF
    assert back == (0xFFC00000 if nan else bits)


plain = st.text(st.sampled_from("abcXYZ 019.,;-_\n\t"), min_size=2, max_size=200).map(lambda s: s.replace("\n", "\r\n"))


@given(plain, st.sampled_from([*b.SCRIPT_KEYS, b.HEADERLESS_KEY]))
def test_script_round_trip(body, key):
    data = text.script_bytes(body, key)
    assert text.script_text(data, key) == f"// KEY:0x{key:08X}\r\n" + body
    assert text.script_bytes(text.script_text(data, key)) == data


def test_script_key_is_found():
    for key in b.SCRIPT_KEYS:
        assert text.script_key(text.script_bytes("some script of printable text, long enough", key)) == key
    with pytest.raises(b.FormatError):
        text.script_bytes("no key")


@given(st.binary(max_size=500))
def test_packed_files(data):
    assert text.unpack_bfc(text.pack_bfc(data)) == data


def test_damaged_packed_file():
    with pytest.raises(b.FormatError):
        text.unpack_bfc(b"BFC1\0\0\0\0nonsense")


name = st.text(st.sampled_from("abcdef_09"), min_size=1, max_size=8)
value = st.one_of(
    st.integers(-(2**31), 2**31 - 1).map(lambda i: (text.INT, str(i))), st.integers(0, 2**32 - 1).map(lambda i: (text.FLOAT, b.float_text(i))),
    st.text(st.sampled_from("ab \"'é,=[]"), max_size=10).map(lambda s: (text.STRING, s)))
groups = st.lists(st.fixed_dictionaries({"section": name, "entries": st.lists(
    st.fixed_dictionaries({"key": name, "values": st.lists(value, max_size=4)}), max_size=4)}), min_size=1, max_size=4)


@settings(max_examples=200)
@given(groups, st.integers(1, 2**32 - 1))
def test_settings_round_trip(doc, key):
    assert text.cbin_rows(text.cbin_bytes(doc, key)) == (key, doc)
    assert text.cbin_from_json(text.cbin_json(key, doc))[1] == [
        {"section": g["section"], "entries": [{"key": e["key"], "values": [list(v) for v in e["values"]] and [tuple(v) for v in e["values"]]} for e in g["entries"]]} for g in doc]
    assert text.cbin_parse(text.cbin_text(key, doc)) == (key, doc)


def test_slashes_in_a_value_become_values():
    key, doc = text.cbin_parse('[a]\nb = "http://x"\n')
    assert doc[0]["entries"][0]["values"] == [(text.STRING, "http:,//,x")]
    _, doc = text.cbin_parse("[a]\nb = 5 // five\n")
    assert doc[0]["entries"][0]["values"] == [(text.INT, "5"), (text.STRING, "//"), (text.STRING, "five")]


entry = st.fixed_dictionaries({"key": name, "value": st.text(st.sampled_from("ab \"\\é\n="), max_size=12), "x": st.integers(-99, 99), "y": st.integers(-99, 99)})


@settings(max_examples=200)
@given(st.lists(st.fixed_dictionaries({"section": name, "entries": st.lists(entry, max_size=4)}), min_size=1, max_size=4))
def test_text_table_round_trip(doc):
    assert text.rtxt_rows(text.rtxt_bytes(doc)) == doc
    assert text.rtxt_parse(text.rtxt_text(doc)) == doc


def test_text_table_of_values_alone():
    doc = [{"section": None, "entries": [{"key": None, "value": v, "x": 0, "y": 0} for v in ("one", "", "three")]}]
    assert text.rtxt_rows(text.rtxt_bytes(doc)) == doc and text.rtxt_parse(text.rtxt_text(doc)) == doc


pixels = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))


@given(pixels)
def test_pcx_round_trip(shape):
    w, h, seed = shape
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 256 if seed % 2 else 3, (h, w, 4)).astype(np.uint8)
    raw[:, :, 3] = 255
    image = (w, h, raw.tobytes())
    assert media.pcx_image(media.pcx_bytes(image)) == image
    assert media.pcx_image(media.pcx_bytes(image), transparent=True)[:2] == (w, h)


@given(st.binary(min_size=1, max_size=300))
def test_runs(row):
    assert media.rle_decode(media.rle_encode(row), len(row)) == row


def dds(code, block, w=4, h=4):
    return struct.pack("<4sII II", b"DDS ", 124, 0x1007, h, w).ljust(76, b"\0") + struct.pack("<II4sI", 32, 4, code, 0).ljust(52, b"\0") + block


def test_dds_blocks():
    colour = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)  # red, blue, two between
    w, h, raw = media.dds_image(dds(b"DXT1", colour))
    first = np.frombuffer(raw, np.uint8).reshape(4, 4, 4)[0]
    assert (w, h) == (4, 4) and first.tolist() == [[0, 0, 255, 255], [255, 0, 0, 255], [85, 0, 170, 255], [170, 0, 85, 255]]
    colour = struct.pack("<HHI", 0x001F, 0xF800, 0b11100100)
    first = np.frombuffer(media.dds_image(dds(b"DXT1", colour))[2], np.uint8).reshape(4, 4, 4)[0]
    assert first[3].tolist() == [0, 0, 0, 0] and first[2].tolist() == [127, 0, 127, 255]
    alpha3 = struct.pack("<Q", 0xFEDCBA9876543210)
    out = np.frombuffer(media.dds_image(dds(b"DXT3", alpha3 + colour))[2], np.uint8).reshape(16, 4)
    assert out[:, 3].tolist() == [17 * i for i in range(16)]
    alpha5 = bytes([255, 0]) + (0b111_110_101_100_011_010_001_000).to_bytes(3, "little") * 2
    out = np.frombuffer(media.dds_image(dds(b"DXT5", alpha5 + colour))[2], np.uint8).reshape(16, 4)
    assert out[:8, 3].tolist() == [255, 0, 218, 182, 145, 109, 72, 36]


def test_tga_kinds():
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 2, 2, 24, 0)
    body = bytes(range(12))
    w, h, raw = media.tga_image(head + body)
    assert (w, h) == (2, 2) and raw == bytes([6, 7, 8, 255, 9, 10, 11, 255, 0, 1, 2, 255, 3, 4, 5, 255])
    runs = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 2, 2, 24, 0x20) + bytes([0x82, 1, 2, 3, 0, 9, 8, 7])
    assert media.tga_image(runs)[2] == bytes([1, 2, 3, 255] * 3 + [9, 8, 7, 255])
    mapped = struct.pack("<BBBHHBHHHHBB", 0, 1, 1, 0, 2, 24, 0, 0, 2, 1, 8, 0x20) + bytes([1, 2, 3, 4, 5, 6]) + bytes([1, 0])
    assert media.tga_image(mapped)[2] == bytes([4, 5, 6, 255, 1, 2, 3, 255])


def test_height_map_and_font():
    data = b"R16a" + struct.pack("<i", 2) + struct.pack("<4H", 0x1100, 0x2200, 0x3300, 0x4400)
    w, h, raw = media.r16_image(data)
    assert (w, h) == (2, 3) and raw[8:12] == bytes([0x11, 0x11, 0x11, 255])
    atlas = np.zeros((256, 256, 4), np.uint8)
    atlas[0, 0] = [10, 20, 30, 255]
    w, h, raw = media.fnt_image(b"FNT0meta" + atlas.tobytes())
    assert (w, h) == (256, 256) and raw[:8] == bytes([10, 20, 30, 255, 32, 32, 32, 255])


def test_png_is_read_elsewhere():
    raw = media.png_bytes((2, 1, bytes([1, 2, 3, 255, 4, 5, 6, 128])))
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16]) == bytes([0, 3, 2, 1, 255, 6, 5, 4, 128])


def riff(kind, channels, bits, body, align=0, extra=b""):
    fmt = struct.pack("<HHIIHH", kind, channels, 8000, 0, align, bits) + extra
    chunks = b"junk" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_sounds():
    def samples(data):
        return np.frombuffer(media.wav_pcm(data)[2], "<i2").tolist()

    assert samples(riff(1, 1, 8, bytes([0, 128, 255]))) == [-32768, 0, 127 << 8]
    assert samples(riff(1, 1, 24, bytes([9, 1, 0, 9, 0xFF, 0xFF]))) == [1, -1]
    assert samples(riff(1, 1, 32, struct.pack("<i", 5 << 16))) == [5]
    assert samples(riff(3, 1, 32, struct.pack("<3f", 0.5, -2, 1))) == [16383, -32767, 32767]
    block = struct.pack("<hBB", 100, 0, 0) + bytes([0x71, 0x08])
    # step 7: code 1 adds 0 + 1, code 7 adds 0 + 1 + 3 + 7; then the index is 8
    assert samples(riff(0x11, 1, 4, block, align=6))[:3] == [100, 101, 112]
    stereo = struct.pack("<hBBhBB", 10, 0, 0, 20, 0, 0) + bytes([0x10])
    assert samples(riff(0x11, 2, 4, stereo, align=9)) == [10, 20, 10, 21]
    channels, rate, pcm = media.wav_pcm(media.wav_bytes(2, 22050, b"\1\0\2\0"))
    assert (channels, rate, pcm) == (2, 22050, b"\1\0\2\0")


def pack(textures):
    models = [b"3DO1" + b"\0" * 4 + n.ljust(8, b"\0") + n for n in (b"ONE", b"TWO", b"ONE")]
    body = b"".join(models)
    table = struct.pack("<i", len(textures))
    for n, w, h, rle, palette in textures:
        table += n.ljust(12, b"\0") + struct.pack("<HBBIIi", 256 if palette else 0, 0, 0, w, h, len(rle)) + rle + (palette or b"")
    start = 68 + len(body)
    return b"3DPK".ljust(60, b"\0") + struct.pack("<ii", start, start + len(table)) + body + table


def test_packs():
    own = bytes(range(256)) * 3
    rows = media.pak_entries(pack([(b"A.PCX", 2, 1, bytes([1, 2]), own), (b"B.PCX", 2, 1, bytes([7, 8]), None)]))
    assert [(r["kind"], r["name"], r["verdict"]) for r in rows] == [
        ("model", "ONE", "kept"), ("model", "TWO", "kept"), ("model", "ONE", "same"), ("texture", "A.PCX", "kept"), ("texture", "B.PCX", "kept")]
    assert media.pcx_image(rows[4]["content"])[2] == bytes([7, 7, 7, 255, 8, 8, 8, 255])
    assert media.pcx_image(rows[3]["content"])[2][:3] == own[3:6][::-1]
    with pytest.raises(b.FormatError):
        media.pak_entries(b"3DPK".ljust(60, b"\0") + struct.pack("<ii", 68, 68) + b"\0" * 8)


def test_batches_are_small(spark, tmp_path):
    """A worker gets 8 MB or 1,000 rows at a time, however many rows a table has."""
    import pandas as pd
    from pyspark.sql import functions as F

    from blobsmith.plans import catalog

    @F.pandas_udf("struct<n: long, size: long>")
    def batch(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(data)] * len(data), "size": [int(data.map(len).sum())] * len(data)})

    def most(rows, length):
        spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), length).alias("text")).write.parquet(path := str(tmp_path / f"{rows}" / "documents.parquet"))
        found = catalog.table(spark, path.rsplit("/", 1)[0], "documents").select(batch(F.col("text").cast("binary")).alias("b"))
        return found.agg(F.max("b.n"), F.max("b.size")).first()

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert most(5000, 1)[0] == 1000 and most(300, 100_000)[1] <= 9 << 20


def test_streams_and_code_page_equal_the_plain_ones():
    """Kept streams are those made byte by byte, in any order of lengths and keys; the code page as character by character."""
    import random

    from blobsmith.codecs import bytes as b

    def plain(key, n):
        out = bytearray()
        for _ in range(n):
            key = b.rotate(key + b.rotate(key, 11) & b.M32, 4) ^ 1
            out.append(key & 255)
        return bytes(out)

    draw = random.Random(7)
    for _ in range(60):
        key, n = draw.choice([*b.SCRIPT_KEYS, *range(6)]), draw.randrange(3000)
        assert b.script_stream(key, n).tobytes() == plain(key, n)
        assert len(b._kept) <= b.KEPT_KEYS
    codes = {c: i for i, c in enumerate(b.CODE_PAGE)}
    odd = "".join(map(chr, [*range(0x3000), 0xD800, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600])) + b.CODE_PAGE
    assert b.to_1252(odd) == bytes(codes.get(c, 63) for c in odd) and b.from_1252(bytes(range(256))) == b.CODE_PAGE


def test_a_long_script_takes_its_stream_once():
    """A thousand scripts of one key step through the cipher once, not a thousand times."""
    from blobsmith.codecs import bytes as b
    from blobsmith.codecs import text

    b._kept.clear()
    steps, real = [0], b._script_step

    def counted(k):
        steps[0] += 1
        return real(k)

    b._script_step = counted
    try:
        for i in range(1000):
            data = text.script_bytes("x" * (1000 + i), b.SCRIPT_KEYS[0])
            assert text.script_text(data) == f"// KEY:0x{b.SCRIPT_KEYS[0]:08X}\r\n" + "x" * (1000 + i)
    finally:
        b._script_step = real
    assert steps[0] < 5000


def test_pictures_are_spread_and_decoded_once(spark):
    """A small file of many pictures is dealt to all tasks, and each picture is decoded once."""
    from blobsmith.plans import catalog

    df = catalog.QUERIES["image_pixels"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and plan.count("Relation") == 1 and plan.count("decode_image(") <= 4


def test_palettes_are_in_order_of_their_colours():
    import numpy as np

    from blobsmith.codecs import media

    raw = np.random.default_rng(3).integers(0, 256, (13, 17, 4), np.uint8)
    raw[:, :, 3] = 255
    data = media.pcx_bytes((17, 13, raw.tobytes()))
    colours = np.unique(raw[:, :, 2::-1].reshape(-1, 3), axis=0)
    assert data[-768:] == colours.tobytes().ljust(768, b"\0") and media.pcx_image(data) == (17, 13, raw.tobytes())


def test_differing_bytes_are_found_once(spark):
    """All, or the first few, differing bytes of blobs longer than a block, null and empty ones too; pairs are joined and compared once."""
    import random

    from pyspark.sql import functions as F

    from blobsmith.operators import relations
    from blobsmith.plans import catalog

    draw = random.Random(5)
    rows = [(0, b"abc", b"abc"), (1, b"", b"x"), (2, None, b"x"), (3, b"ab", b"axc")]
    for i in range(4, 12):
        a = bytearray(draw.randbytes(draw.randrange(1, 200_000)))
        b = bytearray(a[: draw.randrange(len(a))] + draw.randbytes(3))
        for at in draw.sample(range(len(b)), min(len(b), draw.randrange(30))):
            b[at] ^= 1 + at % 255
        rows.append((i, bytes(a), bytes(b)))
    pairs = spark.createDataFrame(rows, "k int, a binary, b binary")
    wanted = {k: [(i, x, y) for i, (x, y) in enumerate(zip(a or b"", b or b"")) if x != y] for k, a, b in rows}
    for limit in (None, 10):
        got = relations.byte_differences(pairs, ["k"], "a", "b", limit).collect()
        assert sorted(map(tuple, got)) == sorted((k, *d) for k, ds in wanted.items() for d in ds[:limit])
    report = [(k, "byte", *d) for k, ds in wanted.items() for d in ds[:10]] + [(k, "stopped", ds[9][0], None, None) for k, ds in wanted.items() if len(ds) >= 10]
    report += [(k, "size", -1, len(a), len(b)) for k, a, b in rows if a is not None and len(a) != len(b)]
    assert sorted(map(str, map(tuple, relations.byte_report(pairs, ["k"], "a", "b").collect()))) == sorted(map(str, report))
    plan = catalog.QUERIES["byte_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "sequence(" not in plan


def test_places_are_searched_not_listed(spark):
    """Positions are found by search, with overlaps; no list of all positions is made and filtered."""
    from pyspark.sql import functions as F

    from blobsmith.functions import binary, blobs
    from blobsmith.plans import catalog

    rows = spark.createDataFrame([(b"aaaa",), (b"",), (None,), (b"xaaxa",), (b"aa" * 3000,)], "d binary")
    for pattern in (b"aa", b"a", b"q", b""):
        for r in rows.select(blobs.places_of("d", F.lit(pattern)).alias("a"), binary.find_matches(F.col("d"), pattern).alias("b")).collect():
            assert r["a"] == r["b"]
    plan = catalog.QUERIES["find_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("places_of(") == 1


def test_settings_bytes_take_linear_time():
    """Four times the values take about four times as long, not sixteen."""
    import time

    from blobsmith.codecs import text

    def seconds(n):
        groups = [{"section": "s", "entries": [{"key": "k", "values": [(1, str(i)) for i in range(n)]}]}]
        start = time.process_time()
        data = text.cbin_bytes(groups)
        return time.process_time() - start, data, groups

    seconds(1000)
    (short, *_), (long, data, groups) = seconds(100_000), seconds(400_000)
    assert long < 9 * short and text.cbin_rows(data)[1] == groups
