"""The listing of an archive: filter, order, count, and the sets offered as filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsmith.functions.text import checksum_text, human_size, local_time, text_filter

DEAD_NAME = "<DEAD SPACE>"


def is_dead(flags: Column, name: Column) -> Column:
    """Soft-deleted: bit 0 of the flags, or the marker as name."""
    return (flags.bitwiseAND(F.lit(1)) != 0) | (F.upper(F.trim(name)) == DEAD_NAME)


def visible(entries: DataFrame, *, dead: Column | None = None, kind: tuple[Column, str] | None = None,
            ext: tuple[Column, str] | None = None, name: Column | None = None, text: str | None = None) -> DataFrame:
    """The rows that pass each filter that is given; extensions compare without case."""
    if dead is not None:
        entries = entries.where(~dead)
    if kind:
        entries = entries.where(kind[0] == kind[1])
    if ext:
        entries = entries.where(F.upper(ext[0]) == ext[1].upper())
    return entries.where(text_filter(name, text)) if name is not None else entries


def shown(entries: DataFrame, *, size_in_bytes: bool = False, epoch_times: bool = False, zone: str = "UTC") -> DataFrame:
    """The columns of the grid from rows of ENTRY: sizes as numbers or readable, times as seconds or as local text."""
    dead = is_dead(F.coalesce("dead_space_flags", F.lit(0)), F.col("name"))
    time = F.col("timestamp_s") if epoch_times else F.date_format(local_time(F.col("timestamp_s"), zone), "yyyy/MM/dd hh:mm a")
    return entries.select(
        "id", dead.alias("dead"), "name", (F.col("data_size") if size_in_bytes else human_size(F.col("data_size"))).alias("size"), time.alias("time"),
        "data_offset", checksum_text(F.col("crc_read"), F.col("crc_computed"), dead).alias("crc"))


def targets(entries: DataFrame, dead: Column, selected: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The live rows an action works on: those of selected keys, or all."""
    rows = entries.where(~dead)
    return rows if selected is None else rows.join(selected.select(key).distinct(), key, "left_semi").select(*entries.columns)


def looked_for(entries: DataFrame, name: str, wanted: DataFrame, key: str) -> DataFrame:
    """The first entry, by key, of a name in the one-row table `wanted`, without case; none if the name is not there."""
    keys = wanted.select(F.upper(name).alias("_key")).limit(1)
    found = entries.withColumn("_key", F.upper(name)).join(F.broadcast(keys), "_key", "left_semi").drop("_key")  # one row
    return found.orderBy(key).limit(1)


def ordered(entries: DataFrame, by: Column, *, pinned: Column | None = None, key: Column, descending: bool = False) -> DataFrame:
    """Pinned rows first in either direction, then by a column, nulls as the least, ties by the key."""
    first = [pinned.desc()] if pinned is not None else []
    order = [by.desc_nulls_last(), key.desc()] if descending else [by.asc_nulls_first(), key.asc()]
    return entries.orderBy(*first, *order)


def totals(entries: DataFrame, size: Column, dead: Column, key: Column, wrap: bool = False) -> DataFrame:
    """One row: rows, dead rows, bytes, dead bytes, and the next free id. With wrap, bytes are kept within 32 bits."""
    if wrap:
        rows = totals(entries, size, dead, key)
        return rows.withColumns({c: F.pmod(c, F.lit(1 << 32)) for c in ("total_size", "dead_size")})
    return entries.agg(
        F.count("*").alias("n_rows"), F.count_if(dead).alias("n_dead"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"),
        F.coalesce(F.sum(F.when(dead, size)), F.lit(0)).cast("long").alias("dead_size"), F.coalesce(F.max(key) + 1, F.lit(1)).cast("long").alias("next_id"))


def distinct_extensions(entries: DataFrame, ext: Column, key: Column) -> DataFrame:
    """(ext_key, ext): extensions that differ without case, in their first spelling."""
    rows = entries.select(ext.alias("ext"), key.alias("key")).where("ext <> ''")
    return rows.groupBy(F.upper("ext").alias("ext_key")).agg(F.min_by("ext", "key").alias("ext"))


def content_class(kind: Column, ext: Column | None = None) -> Column:
    """archive, image, text, audio or binary; a packed file goes by what its extension says it holds."""
    out = (
        F.when(kind.isin("BFC", "PAK"), "archive").when(kind.isin("BMP", "DDS", "FNT", "JPG", "PCX", "PNG", "R16", "TGA"), "image")
        .when(kind.isin("TXT", "RTXT", "CBIN", "SCR"), "text").when(kind.isin("WAV", "MP3"), "audio").otherwise("binary")
    )
    if ext is None:
        return out
    upper = F.upper(ext)
    return F.when((kind == "BFC") & upper.isin(".DDS", ".MDT", ".TGA"), "image").when((kind == "BFC") & (upper == ".WAV"), "audio").otherwise(out)
