"""Changes to a listing. A DataFrame is not changed: each gives the listing after it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blobsmith.functions import blobs
from blobsmith.functions.text import name_status, trimmed

from .listing import DEAD_NAME, is_dead
from .relations import flagged, ranked

#: What an archive, and the name of an entry, hold at most.
MOST_BYTES = 2**31 - 1
NAME_LENGTH = 15


def purged(entries: DataFrame, dead: Column, size: Column) -> DataFrame:
    """Without soft-deleted and empty entries."""
    return entries.where(~(dead | (size == 0)))


def soft_deleted(entries: DataFrame, keys: DataFrame, key: str, flags: str = "dead_space_flags", name: str = "name") -> DataFrame:
    """The entries of keys flagged and renamed to the marker; size and content stay."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    rows = entries.join(hit, key, "left")
    return rows.withColumn(flags, F.when(F.col("_hit"), F.coalesce(F.col(flags), F.lit(0)).bitwiseOR(F.lit(1))).otherwise(F.col(flags))).withColumn(
        name, F.when(F.col("_hit"), DEAD_NAME).otherwise(F.col(name))).select(*entries.columns)


def renamed(entries: DataFrame, names: DataFrame, key: str, status: Column, name: str = "name") -> DataFrame:
    """New names (key, new_name), trimmed, where their status is Ok; others stay."""
    good = names.where(status == "Ok").select(key, trimmed(F.col("new_name")).alias("_new"))
    return entries.join(good, key, "left").withColumn(name, F.coalesce("_new", name)).select(*entries.columns)


def recomputed(content: Column, name: Column, dead: Column, entry_crc: str = "none") -> dict[str, Column]:
    """What follows from an entry's bytes: data_size, crc_computed (entry_crc: none, crc or crc4) and file_type.

    Empty bytes have no checksum and no known type, nor have dead entries and single bytes a type.
    """
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    sums = {"none": None, "crc": blobs.crc32_msb_fast, "crc4": blobs.crc32_quarter}[entry_crc]
    crc = F.lit(None).cast("long") if sums is None else F.when(size > 0, sums(content))
    kind = F.when((size < 2) | F.coalesce(dead, F.lit(False)), "Unknown").otherwise(blobs.detect_type(content, name))
    return {"data_size": size, "crc_computed": crc, "file_type": kind}


def replaced(entries: DataFrame, contents: DataFrame, key: str, content: str = "content", name: str = "name", entry_crc: str = "none") -> DataFrame:
    """New contents (key, content, perhaps timestamp_s) in place of the old; empty ones are an error.

    Of data_size, crc_computed, crc_read, file_type, data_offset and timestamp_s those that entries have follow the new bytes: the checksum
    read is the one computed, the offset is 0 until the archive is written, the time is the one given or now.
    """
    empty = F.raise_error(F.concat(F.lit("empty content for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    fresh = F.when(F.octet_length(content) > 0, F.col(content)).otherwise(empty.cast(entries.schema[content].dataType))
    stamp = F.col("timestamp_s") if "timestamp_s" in contents.columns else F.lit(None)
    new = contents.select(key, fresh.alias("_new"), stamp.cast("long").alias("_stamp"), F.lit(True).alias("_hit"))
    rows = entries.join(new, key, "left")
    own_name = F.col(name) if name in entries.columns else F.lit(None).cast("string")
    dead = is_dead(F.coalesce(F.col("dead_space_flags"), F.lit(0)), own_name) if "dead_space_flags" in entries.columns else F.lit(False)
    facts = recomputed(F.col("_new").cast("binary"), own_name, dead, entry_crc)
    facts |= {content: F.col("_new"), "crc_read": facts["crc_computed"], "data_offset": F.lit(0).cast("long"), "timestamp_s": F.coalesce("_stamp", F.unix_timestamp())}
    for column in [c for c in facts if c in entries.columns and c != content] + [content]:
        rows = rows.withColumn(column, F.when(F.col("_hit"), facts[column]).otherwise(F.col(column)))
    return rows.select(*entries.columns)


def overwritten(
    entries: DataFrame, incoming: DataFrame, name: str = "name", key: str = "id", flags: str = "dead_space_flags", order: str | None = None,
) -> DataFrame:
    """Incoming rows appended with new ids; entries of the same names, without case, are soft-deleted.

    incoming has the columns of entries but for the key, and may have a numeric column `order` of different values, the order of the list; without one
    the rows are taken as they come. Ids go on from the highest. Of incoming rows of one name all but the last are soft-deleted themselves.
    """
    names = incoming.select(F.upper(name).alias("_key")).distinct()
    old = soft_deleted(entries, entries.withColumn("_key", F.upper(name)).join(names, "_key", "left_semi").select(key), key, flags, name)
    last = entries.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    rows = incoming.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
    later = F.max("_at").over(Window.partitionBy(F.upper(name))) > F.col("_at")
    rows = rows.withColumn("_later", later)
    rows = rows.withColumn(flags, F.when(F.col("_later"), F.coalesce(F.col(flags), F.lit(0)).bitwiseOR(F.lit(1))).otherwise(F.col(flags)))
    rows = rows.withColumn(name, F.when(F.col("_later"), DEAD_NAME).otherwise(F.col(name)))
    new = ranked(rows, "_at", "_place").crossJoin(F.broadcast(last))  # one row
    return old.unionByName(new.withColumn(key, F.col("_last") + F.col("_place")).select(*entries.columns))


def added(entries: DataFrame, more: DataFrame) -> DataFrame:
    """Rows appended as they are."""
    return entries.unionByName(more)


def removed(entries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Without the rows of keys."""
    return entries.join(keys.select(key).distinct(), key, "left_anti").select(*entries.columns)


def import_status(
    files: DataFrame, entries: DataFrame, overwrite: bool, name: str = "name", size: str = "data_size", order: str | None = None,
) -> DataFrame:
    """files with status: why each cannot come in, or Ok.

    The first rule counts: empty, over 2 GB, over 2 GB together with what is there and came before, a bad name, or a name that is present or came before
    (unless overwritten). The files are taken in the order of a column, or as they come; one archive's files are tallied in one
    task, by their sizes alone.
    """
    present = flagged(files.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id()), entries, name, "_present")
    used = entries.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("_used"))
    rows = present.withColumn("_named", name_status(F.col(name), longest=NAME_LENGTH)).crossJoin(F.broadcast(used))  # one row
    narrow = rows.select("_at", F.upper(name).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), "_named", "_present", "_used")

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = None, set()
        for frame in frames:
            out = []
            for key, one, named, there, before in zip(frame["_key"], frame["_size"], frame["_named"], frame["_present"], frame["_used"], strict=True):
                total = before if total is None else total
                taken = (there or key in met) and not overwrite
                verdict = (
                    "Empty" if one <= 0 else "TooLarge" if one > MOST_BYTES else "TotalTooLarge" if total + one > MOST_BYTES
                    else named if named != "Ok" else "Exists" if taken else "Ok"
                )
                if verdict == "Ok":
                    total, met = total + one, met | {key} if not overwrite else met
                out.append(verdict)
            yield pd.DataFrame({"_at": frame["_at"], "status": out})

    kind = rows.schema["_at"].dataType.simpleString()
    verdicts = narrow.repartition(1).sortWithinPartitions("_at").mapInPandas(tally, f"_at {kind}, status string")
    return rows.drop("_present", "_named", "_used").join(verdicts, "_at").drop("_at")


def imported(entries: DataFrame, files: DataFrame, overwrite: bool = False, entry_crc: str = "none", order: str | None = None) -> DataFrame:
    """The listing with the files that may come in, under new ids; times in the future become now.

    entries: rows of one archive (ENTRY, perhaps with file_type); files: (name, data_size, timestamp_s, content). Checksums, type and offset are those of new bytes.
    """
    good = import_status(files, entries, overwrite, order=order).where("status = 'Ok'").drop("status")
    facts = recomputed(F.col("content"), F.col("name"), F.lit(False), entry_crc)
    facts |= {"crc_read": facts["crc_computed"], "data_offset": F.lit(0).cast("long"), "timestamp_s": F.least("timestamp_s", F.unix_timestamp())}
    facts["dead_space_flags"] = F.lit(0).cast("long")
    good = good.withColumns({c: x for c, x in facts.items() if c in entries.columns})
    rest = {f.name: F.lit(None).cast(f.dataType) for f in entries.schema.fields if f.name not in good.columns and f.name != "id"}
    good = good.withColumns(rest)
    if "archive" in rest:
        good = good.drop("archive").crossJoin(F.broadcast(entries.agg(F.first("archive").alias("archive"))))  # one row
    return overwritten(entries, good, order=order)
