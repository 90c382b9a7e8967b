"""Schemas and fixed tables of the archive format.

Spark has no unsigned integers: u32 fields are longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("dead_space_flags", T.LongType()), T.StructField("data_offset", T.LongType()), T.StructField("data_size", T.LongType()),
    T.StructField("timestamp_s", T.LongType()), T.StructField("crc_read", T.LongType()), T.StructField("crc_computed", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
HEADER = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("read_length", T.LongType()), T.StructField("version", T.IntegerType()),
    T.StructField("version_bytes", T.BinaryType()), T.StructField("entry_count", T.LongType()), T.StructField("record_length", T.LongType()),
    T.StructField("table_offset", T.LongType()), T.StructField("table_crc_read", T.LongType()), T.StructField("table_crc_computed", T.LongType()),
    T.StructField("ip", T.BinaryType()), T.StructField("zero", T.BinaryType()), T.StructField("signature", T.BinaryType()),
    T.StructField("signature_ext", T.BinaryType()),
])

#: Version, record length, checksum of entries, checksum of the table, footer of 12 bytes.
VERSIONS = [
    (0, 32, "none", False, False),
    (2, 32, "crc", True, False),
    (3, 32, "none", False, True),
    (3, 36, "crc", False, True),
    (4, 32, "none", False, True),
    (4, 36, "crc4", False, True),
]
#: Version bytes that look like 4 and mean 3.
MARK_OF_3 = b"\x01\x00F4"
#: Games by title, version and record length.
GAMES = [
    ("F-22 Raptor", 0, 32),
    ("Comanche 3 Gold", 2, 32),
    ("Armored Fist", 3, 32),
    ("Delta Force", 3, 32),
    ("Delta Force 2", 3, 32),
    ("F-16 Multirole Fighter", 3, 32),
    ("F-22 Lightning 3", 3, 32),
    ("F-22 Raptor IBS", 3, 32),
    ("MiG-29 Fulcrum", 3, 32),
    ("Delta Force: Black Hawk Down", 3, 36),
    ("Comanche 4", 3, 36),
    ("Delta Force: Xtreme", 3, 36),
    ("Joint Operations: Typhoon Rising", 3, 36),
    ("Delta Force: Land Warrior", 3, 36),
    ("Tachyon: The Fringe", 3, 36),
    ("Delta Force: Task Force Dagger", 3, 36),
    ("Delta Force: Xtreme 2", 4, 36),
]
#: Type, first bytes in hexadecimal, extensions, text formats. Types without first bytes are told by their validators.
FORMATS = [
    ("BFC", "42464331", [".dds", ".mdt", ".wav"], []),
    ("BMS", "424D53", [".bms"], []),
    ("CBIN", "4342494E", [".anm", ".bas", ".bdf", ".box", ".cfg", ".def", ".des", ".hud", ".ics", ".itm", ".job", ".kda", ".mnu", ".mpc", ".nws", ".ocf", ".scr", ".sen", ".txt", ".wng"], ["INI", "JSON"]),
    ("DDS", "44445320", [".dds"], []),
    ("FNT", "464E5430", [".fnt"], []),
    ("JPG", "FFD8FFE0", [".jpg", ".jpeg"], []),
    ("MP3", "FFF360C4", [".mp3"], []),
    ("MP3", "FFFB30C4", [".mp3"], []),
    ("PAK", "3344504B", [".pak"], []),
    ("PCX", "0A0501", [".pcx", ".pal"], []),
    ("PNG", "89504E47", [".png"], []),
    ("R16", "52313661", [".r16"], []),
    ("RTXT", "52545854", [".bin"], ["INI", "JSON"]),
    ("SCR", "53435201", [".aca", ".adm", ".aip", ".anm", ".bin", ".end", ".def", ".fx", ".ldo", ".csv", ".ptg", ".ptl", ".ptu", ".txt"], ["TXT"]),
    ("WAV", "52494646", [".wav"], []),
    ("TDI", "334449", [".3di"], []),
    ("TDI", "475050", [".3di"], []),
    ("TDI", "47504D", [".3di"], []),
    ("TDO", "33444F31", [".3do"], []),
    ("TGA", "", [".tga", ".mdt"], []),
    ("TXT", "", [".cfg", ".conf", ".env", ".grm", ".inf", ".ini", ".mnu", ".trn", ".txt"], ["TXT"]),
    ("BMP", "424D", [".bmp"], []),
]
#: Extensions that are never looked into.
SKIPPED = [".3DI", ".3DO", ".AIN", ".BAD", ".CPT", ".CR1", ".CR2", ".CRT", ".DBF", ".LEV", ".LWF", ".MIB", ".OBJ", ".ORF", ".PIB", ".PRJ", ".PWF", ".RAW", ".REF", ".SAF", ".SPX", ".TIL"]


def versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VERSIONS, "version int, record_length int, entry_crc string, table_crc boolean, footer boolean")


def games(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAMES, "game string, version int, record_length int")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "type string, magic string, extensions array<string>, text_formats array<string>")
