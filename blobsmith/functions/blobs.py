"""Functions of blobs: what they are, and what is in them.

detect_type is a plain expression. The codecs run in Arrow batches; each gives null and an error text rather than failing
the query, as blobs in the wild are often damaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blobsmith.codecs import bytes as codec_bytes
from blobsmith.codecs import media, text
from blobsmith.functions import binary as B
from blobsmith.functions.text import escape_quotes, extension
from blobsmith.schema import FORMATS, SKIPPED

#: Rows and bytes after which an Arrow batch ends, so that what a worker holds does not grow with the table.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of two blobs that are compared at a time.
DIFF_BYTES = 1 << 16
#: Scripts known by their names alone.
SCRIPT_NAMES = ("ITEMS.DEF", "LOOP.DEF")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that the codecs get to BATCH_ROWS rows and BATCH_BYTES in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as a shuffle has: small rows of much work, which a small file would give to a single task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def looks_like_tga(data: Column) -> Column:
    """The header makes sense as a kind that is read; media.is_tga as an expression."""
    kind, colours, depth, bits = (B.byte_at(data, i) for i in (2, 1, 7, 16))
    sized = B.unsigned_le(data, 12, 2).between(1, media.LARGEST) & B.unsigned_le(data, 14, 2).between(1, media.LARGEST)
    mapped = kind.isin(1, 9) & (colours == 1) & (bits == 8) & depth.isin(15, 16, 24, 32)
    true_colour = kind.isin(2, 10) & (colours == 0) & bits.isin(15, 16, 24, 32)
    return F.coalesce((F.octet_length(data) >= 18) & (mapped | true_colour) & sized, F.lit(False))


def detect_type(data: Column, name: Column | None = None) -> Column:
    """The type of a blob: skipped extensions, names, then first bytes of 4, 3 and 2, then what passes as TGA or text."""
    head = F.hex(F.call_function("substring", data, F.lit(1), F.lit(4)))
    out = F.when(data.isNull() | (F.octet_length(data) < 4), "Unknown")
    ext = F.coalesce(F.upper(extension(name)), F.lit("")) if name is not None else F.lit("")
    if name is not None:
        out = out.when(ext.isin(SKIPPED), "Unknown").when(name.isin(*SCRIPT_NAMES), "SCR")
    for size in (8, 6, 4):
        for kind, magic, _, _ in FORMATS:
            if len(magic) == size:
                fits = F.substring(head, 1, size) == magic
                if kind == "BMP":
                    fits = fits & (F.octet_length(data) >= 54) & B.unsigned_le(data, 14, 4).isin(12, 40)
                out = out.when(fits, kind)
    return out.when(looks_like_tga(data), "TGA").when((ext != ".RAW") & B.is_text(data), "TXT").otherwise("Unknown")


def is_type(data: Column, name: Column | None, kind: str) -> Column:
    """A blob is of a type."""
    return detect_type(data, name) == kind


def has_magic(data: Column, kind: str) -> Column:
    """A blob starts as its type must, whatever else it might be."""
    out = F.lit(False)
    for k, magic, _, _ in FORMATS:
        if k == kind and magic:
            out = out | (F.hex(F.call_function("substring", data, F.lit(1), F.lit(len(magic) // 2))) == magic)
    return F.coalesce(out, F.lit(False))


def unpacked(rows: DataFrame, content: str = "content", name: str | None = None) -> DataFrame:
    """rows with kind, container, error and the content: that of the blob, or of what is packed in it where it is a BFC."""
    named = None if name is None else F.col(name)
    rows = rows.withColumn("container", F.when(detect_type(F.col(content), named) == "BFC", "BFC"))
    rows = rows.withColumn("_packed", bfc_unpack(F.when(F.col("container").isNotNull(), F.col(content))))
    rows = rows.withColumn(content, F.when(F.col("container").isNull(), F.col(content)).otherwise(F.col("_packed.content")))
    # within the lambda the content is worked out once, not for each of the types
    kind = F.when(F.col(content).isNotNull(), F.transform(F.array(content), lambda c: detect_type(c, named))[0])
    return rows.withColumn("kind", kind).withColumn("error", F.col("_packed.error")).drop("_packed")


def _each(f: Callable, *columns: pd.Series) -> Iterator[tuple]:
    for args in zip(*columns, strict=True):
        if args[0] is None:
            yield None, None
            continue
        try:
            yield f(*args), None
        except (ValueError, IndexError, KeyError, ArithmeticError, MemoryError) as e:
            yield None, f"{type(e).__name__}: {e}"
        except Exception as e:  # noqa: BLE001  struct.error and the like: a blob that ends early
            yield None, f"{type(e).__name__}: {e}"


def _frame(rows: Iterator[tuple], names: list[str]) -> pd.DataFrame:
    wide = len(names) - 1
    return pd.DataFrame([(*(value if wide > 1 and value is not None else (value,) * wide), error) for value, error in rows], columns=names)


@F.pandas_udf(_struct(content=T.BinaryType(), error=T.StringType()))
def bfc_unpack(data: pd.Series) -> pd.DataFrame:
    """The content of packed blobs."""
    return _frame(_each(text.unpack_bfc, data), ["content", "error"])


@F.pandas_udf(T.BinaryType())
def bfc_pack(data: pd.Series) -> pd.Series:
    """Blobs packed."""
    return data.map(lambda d: None if d is None else text.pack_bfc(d))


@F.pandas_udf(_struct(text=T.StringType(), error=T.StringType()))
def to_text(data: pd.Series, kind: pd.Series, form: pd.Series) -> pd.DataFrame:
    """Scripts, settings, text tables and plain texts as text (form INI, JSON or TXT, as the type has)."""

    def one(d: bytes, k: str, f: str) -> str:
        if k == "SCR" and f == "TXT":
            return text.script_text(d)
        if k == "CBIN" and f in ("INI", "JSON"):
            return (text.cbin_text if f == "INI" else text.cbin_json)(*text.cbin_rows(d))
        if k == "RTXT" and f == "INI":
            return text.rtxt_text(text.rtxt_rows(d))
        if k == "RTXT" and f == "JSON":
            import json

            return json.dumps(text.rtxt_rows(d))
        if k == "TXT" and f == "TXT":
            return codec_bytes.from_1252(d)
        raise codec_bytes.FormatError(f"{k} has no form {f}")

    return _frame(_each(one, data, kind, form), ["text", "error"])


@F.pandas_udf(_struct(content=T.BinaryType(), error=T.StringType()))
def from_text(source: pd.Series, kind: pd.Series, form: pd.Series) -> pd.DataFrame:
    """The inverse of to_text."""

    def one(t: str, k: str, f: str) -> bytes:
        if k == "SCR" and f == "TXT":
            return text.script_bytes(t)
        if k == "CBIN" and f in ("INI", "JSON"):
            key, groups = (text.cbin_parse if f == "INI" else text.cbin_from_json)(t)
            return text.cbin_bytes(groups, key)
        if k == "RTXT" and f == "INI":
            return text.rtxt_bytes(text.rtxt_parse(t))
        if k == "RTXT" and f == "JSON":
            import json

            return text.rtxt_bytes(json.loads(t))
        if k == "TXT" and f == "TXT":
            return codec_bytes.to_1252(t)
        raise codec_bytes.FormatError(f"{k} has no form {f}")

    return _frame(_each(one, source, kind, form), ["content", "error"])


@F.pandas_udf(_struct(width=T.IntegerType(), height=T.IntegerType(), bgra=T.BinaryType(), error=T.StringType()))
def decode_image(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """The pixels of PCX, DDS, TGA, R16, FNT and BMP pictures."""

    def one(d: bytes, k: str) -> media.Image:
        if k not in media.IMAGES:
            raise codec_bytes.FormatError(f"no picture decoder for {k}")
        return media.IMAGES[k](d)

    return _frame(_each(one, data, kind), ["width", "height", "bgra", "error"])


@F.pandas_udf(T.BinaryType())
def to_png(width: pd.Series, height: pd.Series, bgra: pd.Series) -> pd.Series:
    """Pixels as PNG files."""
    return pd.Series([None if b is None else media.png_bytes((int(w), int(h), b)) for w, h, b in zip(width, height, bgra, strict=True)])


@F.pandas_udf(T.BinaryType())
def to_pcx(width: pd.Series, height: pd.Series, bgra: pd.Series) -> pd.Series:
    """Pixels as PCX files."""
    return pd.Series([None if b is None else media.pcx_bytes((int(w), int(h), b)) for w, h, b in zip(width, height, bgra, strict=True)])


@F.pandas_udf(_struct(channels=T.IntegerType(), rate=T.IntegerType(), pcm=T.BinaryType(), error=T.StringType()))
def to_pcm16(data: pd.Series) -> pd.DataFrame:
    """The samples of sounds as 16-bit PCM."""
    return _frame(_each(media.wav_pcm, data), ["channels", "rate", "pcm", "error"])


@F.pandas_udf(T.LongType())
def crc32_msb_fast(data: pd.Series) -> pd.Series:
    """The archive checksum of long blobs; binary.crc32_msb is the plain expression for short ones."""
    return data.map(lambda d: None if d is None else codec_bytes.crc32_msb(d)).astype("Int64")


@F.pandas_udf(T.LongType())
def adler32_fast(data: pd.Series) -> pd.Series:
    """Adler-32 of long blobs; binary.adler32 is the plain expression for short ones."""
    return data.map(lambda d: None if d is None else zlib.adler32(d)).astype("Int64")


@F.pandas_udf(T.LongType())
def crc32_quarter(data: pd.Series) -> pd.Series:
    """The newest archives' checksum."""
    return data.map(lambda d: None if d is None else codec_bytes.crc32_quarter(d)).astype("Int64")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def places_of(data: pd.Series, pattern: pd.Series) -> pd.Series:
    """Every position (from 0) where a pattern stands in a long blob, overlaps too; binary.find_matches is the plain expression for short ones."""

    def one(d: bytes | None, p: bytes) -> np.ndarray:
        found, at = [], d.find(p) if d and p else -1
        while at >= 0:
            found.append(at)
            at = d.find(p, at + 1)
        return np.array(found, np.int32)

    return pd.Series([one(d, p) for d, p in zip(data, pattern, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def differing_places(left: pd.Series, right: pd.Series, limit: pd.Series) -> pd.Series:
    """The first `limit` positions (from 0; all for null) at which two blobs differ, up to the shorter one's end."""

    def one(a: bytes | None, b: bytes | None, most: float) -> np.ndarray:
        n = min(len(a or b""), len(b or b""))
        found, at, count = [np.zeros(0, np.int32)], 0, 0
        while at < n and (pd.isna(most) or count < most):
            x, y = (np.frombuffer(d, np.uint8, min(DIFF_BYTES, n - at), at) for d in (a, b))
            found.append(np.flatnonzero(x != y).astype(np.int32) + np.int32(at))
            at, count = at + DIFF_BYTES, count + len(found[-1])
        return np.concatenate(found)[: None if pd.isna(most) else int(most)]

    return pd.Series([one(*args) for args in zip(left, right, limit, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def decode_1252(data: pd.Series) -> pd.Series:
    """Bytes of the code page as text."""
    return data.map(lambda d: None if d is None else codec_bytes.from_1252(d))


@F.pandas_udf(T.BinaryType())
def encode_1252(source: pd.Series) -> pd.Series:
    """Text as bytes of the code page."""
    return source.map(lambda t: None if t is None else codec_bytes.to_1252(t))


@F.pandas_udf(T.StringType())
def float_text(bits: pd.Series) -> pd.Series:
    """32-bit floats, given as their bits, as text that gives the bits back."""
    return bits.map(lambda b: None if pd.isna(b) else codec_bytes.float_text(int(b)))


def _settings_rows(data: bytes) -> Iterator[tuple]:
    doc_key, groups = text.cbin_rows(data)
    for g, group in enumerate(groups):
        if not group["entries"]:
            yield g, group["section"], None, None, None, None, None, doc_key
        for k, entry in enumerate(group["entries"]):
            if not entry["values"]:
                yield g, group["section"], k, entry["key"], None, None, None, doc_key
            for v, (kind, value) in enumerate(entry["values"]):
                yield g, group["section"], k, entry["key"], v, kind, value, doc_key


@F.udtf(returnType=_struct(group_no=T.IntegerType(), section=T.StringType(), key_no=T.IntegerType(), key=T.StringType(), value_no=T.IntegerType(), value_type=T.IntegerType(), value=T.StringType(), doc_key=T.LongType()))
class CbinRows:
    """Settings as rows, one for each value; empty groups and keys without values give a row of nulls, blobs of other types none."""

    def eval(self, data: bytes):  # noqa: ANN201
        if data is not None and data[:4] == b"CBIN":
            yield from _settings_rows(bytes(data))


@F.udtf(returnType=_struct(group_no=T.IntegerType(), section=T.StringType(), entry_no=T.IntegerType(), key=T.StringType(), value=T.StringType(), x=T.IntegerType(), y=T.IntegerType()))
class RtxtRows:
    """Text tables as rows."""

    def eval(self, data: bytes):  # noqa: ANN201
        if data is None or data[:4] != b"RTXT":
            return
        for g, group in enumerate(text.rtxt_rows(bytes(data))):
            for i, e in enumerate(group["entries"]):
                yield g, group["section"], i, e["key"], e["value"], e["x"], e["y"]


@F.udtf(returnType=_struct(seq=T.IntegerType(), kind=T.StringType(), name=T.StringType(), width=T.IntegerType(), height=T.IntegerType(), palette_count=T.IntegerType(), verdict=T.StringType(), content=T.BinaryType()))
class PakEntries:
    """Models and textures of packs as rows."""

    def eval(self, data: bytes, palette: bytes | None = None):  # noqa: ANN201
        if data is None or data[:4] != b"3DPK":
            return
        for e in media.pak_entries(bytes(data), None if palette is None else bytes(palette)):
            yield e["seq"], e["kind"], e["name"], e["width"], e["height"], e["palette_count"], e["verdict"], e["content"]


@F.udtf(returnType=_struct(group_no=T.IntegerType(), section=T.StringType(), key_no=T.IntegerType(), key=T.StringType(), value_no=T.IntegerType(), value_type=T.IntegerType(), value=T.StringType(), doc_key=T.LongType()))
class CbinParsed:
    """Settings in their text form as rows, like CbinRows."""

    def eval(self, source: str):  # noqa: ANN201
        if source is not None:
            key, groups = text.cbin_parse(source)
            yield from _settings_rows(text.cbin_bytes(groups, key))


@F.udtf(returnType=_struct(group_no=T.IntegerType(), section=T.StringType(), entry_no=T.IntegerType(), key=T.StringType(), value=T.StringType(), x=T.IntegerType(), y=T.IntegerType()))
class RtxtParsed:
    """Text tables in their text form as rows, like RtxtRows. A line that is neither is an error that names its number."""

    def eval(self, source: str):  # noqa: ANN201
        for g, group in enumerate(text.rtxt_parse(source) if source is not None else ()):
            for i, e in enumerate(group["entries"]):
                yield g, group["section"], i, e["key"], e["value"], e["x"], e["y"]


@F.udtf(returnType=_struct(chunk_no=T.IntegerType(), name=T.StringType(), position=T.LongType(), size=T.LongType(), content=T.BinaryType()))
class WavChunks:
    """The chunks of sound files as rows; blobs of other types give none."""

    def eval(self, data: bytes):  # noqa: ANN201
        if data is not None and data[:4] == b"RIFF":
            for i, (name, at, body) in enumerate(media.riff_chunks(bytes(data))):
                yield i, name.decode("latin-1"), at, len(body), body


def pack_rtxt(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, content): text tables from the rows of RtxtRows, a document in one task."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        groups = []
        for _, part in group.sort_values(["group_no", "entry_no"]).groupby("group_no", sort=False):
            entries = [
                {"key": None if pd.isna(k) else k, "value": None if pd.isna(v) else v, "x": int(x), "y": int(y)}
                for k, v, x, y in zip(part["key"], part["value"], part["x"], part["y"], strict=True)
            ]
            section = part["section"].iat[0]
            groups.append({"section": None if pd.isna(section) else section, "entries": entries})
        return pd.DataFrame({doc: [group[doc].iat[0]], "content": [text.rtxt_bytes(groups)]})

    kind = rows.schema[doc].dataType.simpleString()
    return rows.groupBy(doc).applyInPandas(one, f"{doc} {kind}, content binary")


def settings_lines(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, text): rows of CbinRows as section and key lines, in plain expressions."""
    shown = F.when((F.col("value_type") == text.STRING) & (F.col("value") != "//"), F.concat(F.lit('"'), escape_quotes(F.col("value")), F.lit('"'))).otherwise(F.col("value"))
    values = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value_no", shown.alias("v")))))
    keys = rows.groupBy(doc, "group_no", "section", "key_no", "key", "doc_key").agg(F.array_join(F.transform(values, lambda s: s["v"]), ",").alias("vs"))
    vs = F.replace("vs", F.lit(",//,"), F.lit("\t//"))
    line = F.when(F.col("key").isNotNull(), F.rtrim(F.concat(F.col("key"), F.lit(" = "), vs)))
    groups = keys.groupBy(doc, "group_no", "section", "doc_key").agg(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("key_no", line.alias("line"))))).alias("lines"))
    block = F.concat(F.array("_blank", "_head"), F.transform("lines", lambda s: s["line"]))
    groups = groups.withColumn("_blank", F.lit("")).withColumn("_head", F.concat(F.lit("["), "section", F.lit("]"))).withColumn("block", F.array_join(block, text.LINE))
    whole = groups.groupBy(doc).agg(F.first("doc_key").alias("doc_key"), F.sort_array(F.collect_list(F.struct("group_no", "block"))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda s: s["block"]), text.LINE)
    return whole.select(doc, F.concat(F.format_string("// KEY:0x%08X", "doc_key"), F.lit(text.LINE), body, F.lit(text.LINE)).alias("text"))


def pack_cbin(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, content): settings from the rows of CbinRows, a document in one task."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        ordered = group.sort_values(["group_no", "key_no", "value_no"], na_position="first")
        for (_, section), part in ordered.groupby(["group_no", "section"], sort=False):
            entries = [
                {"key": key, "values": [(int(t), v) for t, v in zip(own["value_type"], own["value"], strict=True) if not pd.isna(t)]}
                for (_, key), own in part.groupby(["key_no", "key"], sort=False)
            ]
            groups.append({"section": section, "entries": entries})
        return pd.DataFrame({doc: [group[doc].iat[0]], "content": [text.cbin_bytes(groups, int(group["doc_key"].iat[0]))]})

    kind = rows.schema[doc].dataType.simpleString()
    return rows.groupBy(doc).applyInPandas(one, f"{doc} {kind}, content binary")


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    small_batches(spark)
    for name, f in {
        "bfc_unpack": bfc_unpack, "bfc_pack": bfc_pack, "to_text": to_text, "from_text": from_text, "decode_image": decode_image, "to_png": to_png,
        "to_pcx": to_pcx, "to_pcm16": to_pcm16, "crc32_msb": crc32_msb_fast, "crc32_quarter": crc32_quarter, "decode_1252": decode_1252,
        "encode_1252": encode_1252, "float_text": float_text,
    }.items():
        spark.udf.register(name, f)
    for name, f in {
        "cbin_rows": CbinRows, "rtxt_rows": RtxtRows, "pak_entries": PakEntries, "cbin_parsed": CbinParsed, "rtxt_parsed": RtxtParsed, "wav_chunks": WavChunks,
    }.items():
        spark.udtf.register(name, f)
