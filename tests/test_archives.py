"""Archives read, written, and read again, and the functions of blobs."""

import struct

import pytest
from pyspark.sql import functions as F

from blobsmith import schema
from blobsmith.codecs import media, text
from blobsmith.codecs.bytes import FormatError
from blobsmith.functions import blobs
from blobsmith.functions import binary as B
from blobsmith.sources import archive, datasource

ENTRIES = [
    {"name": "A.TXT", "content": b"hello world", "timestamp_s": 100, "dead_space_flags": 0},
    {"name": "EMPTY.PCX", "content": b"", "timestamp_s": 200, "dead_space_flags": 0},
    {"name": "<DEAD SPACE>", "content": b"gone", "timestamp_s": 300, "dead_space_flags": 1},
    {"name": "B.SCR", "content": text.script_bytes("some script text here", 0x01234567), "timestamp_s": 400, "dead_space_flags": 0},
]


@pytest.mark.parametrize(("version", "record"), list(archive.LAYOUTS))
def test_round_trip(spark, tmp_path, version, record):
    (tmp_path / "x.pff").write_bytes(archive.build(ENTRIES, version, record))
    rows = archive.read_entries(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["name"], bytes(r["content"]), r["timestamp_s"]) for r in rows] == [(e["name"], e["content"], e["timestamp_s"]) for e in ENTRIES]
    assert all(r["crc_read"] is None or r["crc_read"] == r["crc_computed"] for r in rows)
    assert (rows[0]["crc_computed"] is not None) == (archive.LAYOUTS[version, record].entry_crc != "none")
    head = archive.read_headers(spark, str(tmp_path)).first()
    assert (head["version"], head["entry_count"], head["table_crc_read"] == head["table_crc_computed"]) == (version, 4, True)
    assert (head["signature"] is None) == (version in (0, 2))
    again = archive.pack_archives(archive.read_entries(spark, str(tmp_path)), version, record).first()
    assert bytes(again["content"]) == (tmp_path / "x.pff").read_bytes()


def test_malformed(spark):
    good = archive.build(ENTRIES)
    assert archive.layout_of(schema.MARK_OF_3, 36).version == 3
    for bad in (good[:19], good[:60], good[:16] + struct.pack("<I", len(good)) + good[20:], good[:4] + b"PFF9" + good[8:], good[:12] + struct.pack("<I", 40) + good[16:]):
        with pytest.raises(FormatError):
            list(archive.Archive(bad).entries("x", True))
    moved = bytearray(good)
    struct.pack_into("<I", moved, archive.Archive(good).offset + 8, 10_000)
    with pytest.raises(FormatError, match="past the end"):
        list(archive.Archive(bytes(moved)).entries("x", True))
    with pytest.raises(FormatError, match="too long"):
        archive.build([{"name": "x" * 16, "content": b""}])


def test_format_by_name(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in.pff").write_bytes(archive.build(ENTRIES))
    rows = spark.read.format("pff").load(str(tmp_path / "in.pff"))
    assert rows.count() == 4 and rows.where("id = 0").first()["name"] == "A.TXT"
    slim = spark.read.format("pff").option("content", "false").load(str(tmp_path / "in.pff"))
    assert slim.where("content is not null").count() == 0 and slim.where("crc_read = crc_computed").count() == 3
    target = str(tmp_path / "out.pff")
    rows.repartition(3).write.format("pff").option("keep_dead", "false").mode("append").save(target)
    assert [r["name"] for r in spark.read.format("pff").load(target).orderBy("id").collect()] == ["A.TXT", "B.SCR"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in.pff", "out.pff"]
    assert spark.read.format("pff").option("header", "true").load(target).first()["entry_count"] == 2


def test_write_and_export(spark, tmp_path):
    source, out = tmp_path / "a", tmp_path / "b"
    source.mkdir(), out.mkdir()
    for n in ("one.pff", "two.pff"):
        (source / n).write_bytes(archive.build(ENTRIES))
    entries = archive.read_entries(spark, str(source))
    written = archive.write_archives(archive.pack_archives(entries, keep_dead=False), str(out)).collect()
    assert len(written) == 2 and archive.read_entries(spark, str(out)).count() == 4
    existing = spark.createDataFrame([("a.txt",)], "name string")
    done = archive.export_entries(entries.where(F.col("archive").endswith("one.pff")), str(tmp_path), existing).collect()
    assert [(r["name"], r["error"]) for r in done] == [("B.SCR", None)] and (tmp_path / "B.SCR").stat().st_mtime == 400


BLOBS = [
    ("x.bfc", text.pack_bfc(b"abc" * 9), "BFC"), ("x.pcx", media.pcx_bytes((2, 2, b"\1\2\3\xff" * 4)), "PCX"), ("x.txt", b"plain text", "TXT"), ("x.3di", b"3DI3....", "Unknown"),
    ("y.dat", b"3DI3....", "TDI"), ("ITEMS.DEF", b"\1\2\3\4", "SCR"), ("items.def", b"\1\2\3\4", "Unknown"), ("s", b"abc", "Unknown"), ("x.raw", b"plain text", "Unknown"),
    ("t.tga", struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 1, 1, 24, 0) + b"\1\2\3", "TGA"), ("b.bmp", b"BM but only text", "TXT"),
    ("c.def", text.cbin_bytes([{"section": "a", "entries": [{"key": "k", "values": [(1, "5"), (4, "x")]}]}]), "CBIN"),
    ("r.bin", text.rtxt_bytes([{"section": "a", "entries": [{"key": "k", "value": "v", "x": 1, "y": 2}]}]), "RTXT"),
    ("w.wav", media.wav_bytes(1, 8000, b"\1\0"), "WAV"),
]


@pytest.fixture(scope="module")
def blob_table(spark):
    return spark.createDataFrame([*BLOBS, ("null", None, "Unknown")], "name string, content binary, kind string")


def test_detection(blob_table):
    wrong = blob_table.where(blobs.detect_type(F.col("content"), F.col("name")) != F.col("kind"))
    assert wrong.collect() == []
    assert blob_table.where(blobs.has_magic(F.col("content"), "BMP")).count() == 1


def test_blob_functions(spark, blob_table):
    blobs.register(spark)
    form = F.when(F.col("kind").isin("CBIN", "RTXT"), "INI").otherwise("TXT")
    texts = {r["name"]: r["t"] for r in blob_table.select("name", blobs.to_text("content", "kind", form).alias("t")).collect()}
    assert texts["x.txt"]["text"] == "plain text" and "k = 5,\"x\"" in texts["c.def"]["text"] and texts["x.pcx"]["error"]
    back = blob_table.where("kind in ('CBIN', 'RTXT')").select("content", blobs.from_text(blobs.to_text("content", "kind", form)["text"], "kind", form).alias("b"))
    assert back.where("b.content = content").count() == 2
    image = blob_table.select("name", blobs.decode_image("content", "kind").alias("i")).where("i.width is not null")
    assert {r["name"] for r in image.collect()} == {"x.pcx", "t.tga"}
    assert image.where(F.hex(blobs.to_png("i.width", "i.height", "i.bgra")).startswith("89504E47")).count() == 2
    assert blob_table.where("kind = 'BFC'").select(blobs.bfc_unpack("content")["content"].alias("c")).first()["c"] == b"abc" * 9
    assert blob_table.where("kind = 'WAV'").select(blobs.to_pcm16("content")["rate"].alias("r")).first()["r"] == 8000
    blob_table.createOrReplaceTempView("blob_table")
    rows = spark.sql("SELECT name, r.* FROM blob_table, LATERAL cbin_rows(content) r WHERE kind = 'CBIN'")
    assert [(r["section"], r["key"], r["value"]) for r in rows.orderBy("value_no").collect()] == [("a", "k", "5"), ("a", "k", "x")]
    packed = blobs.pack_cbin(rows.withColumnRenamed("name", "doc")).first()
    assert bytes(packed["content"]) == dict((n, c) for n, c, _ in BLOBS)["c.def"]
    assert spark.sql("SELECT r.value, r.x FROM blob_table, LATERAL rtxt_rows(content) r WHERE kind = 'RTXT'").collect() == [("v", 1)]


def test_checksum_expressions_equal_the_codecs(spark):
    rows = spark.createDataFrame([(bytes(range(i)),) for i in range(0, 40)], "data binary")
    assert rows.where(B.crc32_msb(F.col("data")) != blobs.crc32_msb_fast("data")).count() == 0
    assert rows.where(B.adler32(F.col("data")) == 1).count() == 1
    word = spark.createDataFrame([(bytearray(b"Wikipedia"),)], "data binary").select(B.adler32(F.col("data")).alias("a")).first()["a"]
    assert word == 0x11E60398


def test_dimensions(spark):
    assert schema.games(spark).count() == 17 and schema.versions(spark).count() == 6
    assert schema.games(spark).join(schema.versions(spark), ["version", "record_length"]).count() == 17
    assert schema.formats(spark).where("magic = ''").count() == 2


def test_stream(spark, tmp_path):
    from blobsmith.streaming.drops import arrivals, stream_entries

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pff").write_bytes(archive.build(ENTRIES))
    query = arrivals(stream_entries(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("came").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n, sum(bytes) AS b FROM came").first()[:] == (4, sum(len(e["content"]) for e in ENTRIES))


def test_import_follows_the_rules(spark):
    """Bad files stay out, an overwritten entry becomes dead, times in the future become now."""
    from blobsmith.operators import changes

    old = [("a.pff", i, n, 0, 20, 3, 100, None, None, b"old") for i, n in enumerate(("One.txt", "two.txt"))]
    entries = spark.createDataFrame(old, schema.ENTRY)
    files = spark.createDataFrame(
        [("ONE.TXT", 4, 50, b"new1"), ("con.txt", 4, 50, b"new2"), ("empty.txt", 0, 50, b""), ("much too long name.txt", 4, 50, b"new3"), ("three.txt", 4, 1 << 33, b"new4")],
        "name string, data_size long, timestamp_s long, content binary")
    status = {r["name"]: r["status"] for r in changes.import_status(files, entries, overwrite=False).collect()}
    assert status == {"ONE.TXT": "Exists", "con.txt": "WindowsReservedName", "empty.txt": "Empty", "much too long name.txt": "TooLong", "three.txt": "Ok"}
    got = sorted((r["id"], r["name"], r["archive"], bytes(r["content"])) for r in changes.imported(entries, files, overwrite=True).collect())
    assert [x[:1] + x[2:] for x in got] == [(0, "a.pff", b"old"), (1, "a.pff", b"old"), (2, "a.pff", got[2][3]), (3, "a.pff", got[3][3])]
    assert {x[1] for x in got} == {"<DEAD SPACE>", "two.txt", "ONE.TXT", "three.txt"}
    late = changes.imported(entries, files).where("name = 'three.txt'").collect()
    assert len(late) == 1 and late[0]["timestamp_s"] < 1 << 32


def test_rows_of_texts_and_sounds(spark):
    """Text forms as rows, rows as blobs and text, and the chunks of a sound."""
    groups = [{"section": "a", "entries": [{"key": "k", "values": [(1, "5"), (4, 'x"y'), (4, "//"), (4, "note")]}, {"key": "none", "values": []}]}, {"section": "empty", "entries": []}]
    data = text.cbin_bytes(groups, 77)
    blobs.register(spark)
    docs = spark.createDataFrame([("d", text.cbin_text(77, groups), data)], "doc string, shown string, data binary")
    docs.createOrReplaceTempView("docs")
    columns = "group_no, section, key_no, key, value_no, value_type, value, doc_key"
    parsed = spark.sql(f"SELECT doc, {columns} FROM docs, LATERAL cbin_parsed(shown)")
    rows = spark.sql(f"SELECT doc, {columns} FROM docs, LATERAL cbin_rows(data)")
    assert sorted(map(str, parsed.collect())) == sorted(map(str, rows.collect()))
    assert blobs.settings_lines(rows).collect()[0]["text"] == text.cbin_text(77, groups)
    table = [{"section": "s", "entries": [{"key": "k", "value": "v", "x": 1, "y": -2}, {"key": "l", "value": "", "x": 0, "y": 0}]}]
    spark.createDataFrame([("t", text.rtxt_text(table))], "doc string, shown string").createOrReplaceTempView("tables")
    made = spark.sql("SELECT doc, group_no, section, entry_no, key, value, x, y FROM tables, LATERAL rtxt_parsed(shown)")
    assert text.rtxt_rows(bytes(blobs.pack_rtxt(made).collect()[0]["content"])) == table
    sound = media.wav_bytes(1, 8000, b"\1\0\2\0")
    spark.createDataFrame([(sound,), (b"other",)], "data binary").createOrReplaceTempView("sounds")
    chunks = spark.sql("SELECT chunk_no, name, size FROM sounds, LATERAL wav_chunks(data)").collect()
    assert [tuple(r) for r in chunks] == [(0, "fmt ", 16), (1, "data", 4)]


def test_checks_of_types(spark):
    """Good blobs pass their own check alone; cut ones pass none."""
    from blobsmith.functions import validators

    picture = (2, 1, bytes([1, 2, 3, 255, 4, 5, 6, 255]))
    good = {
        "BFC": text.pack_bfc(b"abc" * 50), "CBIN": text.cbin_bytes([{"section": "a", "entries": []}], 9), "PCX": media.pcx_bytes(picture), "PNG": media.png_bytes(picture),
        "RTXT": text.rtxt_bytes([{"section": "s", "entries": [{"key": "k", "value": "v", "x": 0, "y": 0}]}]), "WAV": media.wav_bytes(1, 8000, bytes(8)), "SCR": b"SCR\1\x9d\x81",
        "R16": b"R16a" + (2).to_bytes(4, "little") + bytes(8), "FNT": b"FNT0" + bytes(8),
    }
    df = spark.createDataFrame([(k, v, v[:4]) for k, v in good.items()], "kind string, data binary, cut binary")
    for r in df.select("kind", validators.valid_types(F.col("data")).alias("types"), validators.valid_types(F.col("cut")).alias("none")).collect():
        assert [t for t in r["types"] if t != "TXT"] == [r["kind"]], r
        assert [t for t in r["none"] if t != "TXT"] == [], r
    assert spark.sql("SELECT CAST(NULL AS BINARY) AS data").select(validators.is_valid(F.col("data"), "PNG").alias("ok")).first()["ok"] is False


def test_padding_and_registers_complain(spark):
    from blobsmith.functions import binary
    from blobsmith.operators import relations

    rows = spark.createDataFrame([(1, b"abc"), (9, b"abcd")], "k int, data binary")
    assert [bytes(r[0]) for r in rows.select(binary.padded(F.col("data"), 4)).collect()] == [b"abc\0", b"abcd"]
    with pytest.raises(Exception, match="do not fit"):
        rows.select(binary.padded(F.col("data"), 3)).collect()
    register = spark.createDataFrame([(1, "one")], "id int, label string")
    with pytest.raises(Exception, match="not registered: 9"):
        relations.registered(rows, "k", register, "id", ["label"]).collect()


def test_replaced_blobs_are_recomputed(spark):
    """Size, checksums, type, offset and time follow the new bytes, so the entry is exported and saved again."""
    from blobsmith.codecs.bytes import crc32_msb
    from blobsmith.operators import changes

    data = archive.build([{"name": "A.TXT", "content": b"", "timestamp_s": 1}, {"name": "B.TXT", "content": b"kept", "timestamp_s": 2}])
    entries = archive.entries_of(spark.createDataFrame([("x", data)], "path string, content binary"))
    new = spark.createDataFrame([(0, b"fresh text")], "id long, content binary")
    got = {r["id"]: r for r in changes.replaced(entries, new, "id", entry_crc="crc").collect()}
    assert (got[0]["data_size"], got[0]["crc_read"], got[0]["crc_computed"], got[0]["data_offset"]) == (10, crc32_msb(b"fresh text"), crc32_msb(b"fresh text"), 0)
    assert got[0]["timestamp_s"] > 1_600_000_000 and got[1]["timestamp_s"] == 2 and bytes(got[1]["content"]) == b"kept"
    saved = archive.pack_archives(changes.replaced(entries, new, "id"), keep_dead=False)
    assert archive.entries_of(saved).count() == 2
    assert {r["name"] for r in archive.export_plan(changes.replaced(entries, new, "id")).collect()} == {"A.TXT", "B.TXT"}
    for empty in (b"", None):
        with pytest.raises(Exception, match="empty content for 1"):
            changes.replaced(entries, spark.createDataFrame([(1, empty)], "id long, content binary"), "id").collect()


def test_import_in_order(spark):
    """Files of one name, in the order of their list, and a total that only some of them fit."""
    from blobsmith.operators import changes

    entries = spark.createDataFrame([(4, "old.txt", 0, 2_000_000_000)], "id long, name string, dead_space_flags long, data_size long")
    files = spark.createDataFrame(
        [(3, "c.txt", 100_000_000), (1, "a.txt", 100_000_000), (2, "A.TXT", 5), (4, "OLD.TXT", 5), (5, "d.txt", 40_000_000), (6, None, 5), (7, "e.txt", None)], "seq long, name string, data_size long")
    status = lambda **more: {r["seq"]: r["status"] for r in changes.import_status(files, entries, order="seq", **more).collect()}
    assert status(overwrite=False) == {1: "Ok", 2: "Exists", 3: "TotalTooLarge", 4: "Exists", 5: "Ok", 6: "NullOrWhiteSpace", 7: "Empty"}
    assert status(overwrite=True) == {1: "Ok", 2: "Ok", 3: "TotalTooLarge", 4: "Ok", 5: "Ok", 6: "NullOrWhiteSpace", 7: "Empty"}
    assert changes.import_status(files.limit(0), entries, overwrite=False).count() == 0
    rows = files.where("seq in (1, 2, 4)").withColumn("dead_space_flags", F.lit(0))
    got = {r["id"]: (r["name"], r["dead_space_flags"]) for r in changes.overwritten(entries, rows, order="seq").collect()}
    assert got == {4: ("<DEAD SPACE>", 1), 5: ("<DEAD SPACE>", 1), 6: ("A.TXT", 0), 7: ("OLD.TXT", 0)}


def test_new_archives_texts_and_tallies(spark, tmp_path):
    wanted = spark.createDataFrame([("n.pff", "Comanche 4")], "archive string, game string")
    assert archive.write_archives(archive.new_archives(wanted), str(tmp_path)).first()["size"] == 20 + 12
    assert archive.read_entries(spark, str(tmp_path)).count() == 0 and archive.read_headers(spark, str(tmp_path)).first()["record_length"] == 36
    with pytest.raises(Exception, match="not registered: Chess"):
        archive.new_archives(wanted.withColumn("game", F.lit("Chess"))).collect()
    out = tmp_path / "out"
    out.mkdir()
    archive.write_texts(spark.createDataFrame([("t.txt", "caf\u00e9 \u2013 \u4e00")], "name string, text string"), str(out)).collect()
    assert (out / "t.txt").read_bytes() == b"caf\xe9 \x96 ?"
    (out / "A.TXT").write_bytes(b"mine")
    (tmp_path / "in.pff").write_bytes(archive.build([*ENTRIES, {"name": "FAR.TXT", "content": b"x", "timestamp_s": 2**32 - 1}]))
    entries = archive.read_entries(spark, str(tmp_path / "in.pff"))
    done = spark.createDataFrame(archive.export_entries(entries, str(out), overwrite=False).collect(), "name string, path string, error string")
    assert archive.export_tally(entries, done).first() == (5, 2, 0) and (out / "A.TXT").read_bytes() == b"mine"
    assert sorted(p.name for p in out.iterdir()) == ["A.TXT", "B.SCR", "FAR.TXT", "t.txt"]
    failed = archive.export_entries(entries, str(tmp_path / "missing")).where("error is not null")
    assert failed.count() == 3


def test_the_named_format_replaces_only_when_asked(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in.pff").write_bytes(archive.build(ENTRIES))
    rows, target = spark.read.format("pff").load(str(tmp_path / "in.pff")), str(tmp_path / "out.pff")
    rows.write.format("pff").mode("append").save(target)
    with pytest.raises(Exception, match="write with mode overwrite"):
        rows.write.format("pff").mode("append").save(target)
    rows.where("id = 0").write.format("pff").mode("overwrite").save(target)
    assert spark.read.format("pff").load(target).count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["in.pff", "out.pff"]


def test_numbers_and_places(spark):
    from blobsmith.functions import text as X

    values = [1.5, -0.0, 1e-310, float("inf"), float("nan"), -123456.789, 5e-45]
    rows = spark.createDataFrame([(i, struct.pack("<fd", min(v, 3e38) if v == v else v, v)) for i, v in enumerate(values) if v != 5e-45], "i int, data binary")
    for r in rows.select("i", B.float_le(F.col("data"), 0).alias("f"), B.double_le(F.col("data"), 4).alias("d")).collect():
        want = struct.unpack("<fd", struct.pack("<fd", min(values[r["i"]], 3e38) if values[r["i"]] == values[r["i"]] else float("nan"), values[r["i"]]))
        assert repr((r["f"], r["d"])) == repr(want)
    lists = spark.createDataFrame([(["a", "b"], 1), (["a"], 1), ([], 0), (None, 0), (["a"], -1)], "v array<string>, i int")
    assert [tuple(r["p"]) for r in lists.select(X.at_index(F.col("v"), F.col("i")).alias("p")).collect()] == [(True, "b"), *[(False, None)] * 4]
    assert lists.where(X.index_exists(F.col("v"), F.col("i"))).count() == 1



def test_entries_come_in_small_batches(spark):
    """A large archive is put together from Arrow's columns and read in batches of 1,000 entries, in order, nulls included."""
    from pyspark.sql import functions as F

    rows = spark.range(2500, 0, -1, 3).select(
        F.lit("a").alias("archive"), "id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.lit(2).cast("long")).alias("dead_space_flags"),
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("timestamp_s"), F.when(F.col("id") % 5 > 0, F.repeat(F.lit("y"), (F.col("id") % 7).cast("int")).cast("binary")).alias("content"))
    made = archive.pack_archives(rows)
    data = bytes(made.first()["content"])
    wanted = [{"name": f"n{i}", "dead_space_flags": 2 * (i % 2 == 0), "timestamp_s": i if i % 3 else 0, "content": b"y" * (i % 7) if i % 5 else b""} for i in range(1, 2501)]
    assert data == archive.build(wanted)
    parts = list(archive._parts(archive.Archive(data).entries("a", True)))
    assert [len(p) for p in parts] == [1000, 1000, 500] and len(list(archive._parts(iter([("", b"x" * (5 << 20))] * 4)))) == 2
    got = archive.entries_of(made).orderBy("id").collect()
    assert [(r["name"], r["dead_space_flags"], r["timestamp_s"], bytes(r["content"])) for r in got] == [tuple(e.values()) for e in wanted]
