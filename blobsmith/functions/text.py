"""Text and name expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names the host keeps for devices.
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL")
#: Characters no file name may hold, beside those below 32.
BAD_CHARS = '"<>|:*?\\/'
#: What counts as blank at the ends of a name.
BLANK = r"[\t-\r\x85\p{Z}]+"


def text_filter(name: Column, text: str | None) -> Column:
    """Name filter: blank lets all pass, plain text is looked for anywhere, * stands for anything. Case does not count."""
    if not text or not text.strip():
        return F.lit(True)
    if "*" not in text:
        return F.contains(F.upper(name), F.lit(text.upper()))
    return name.rlike("(?i)" + ".*".join(f"\\Q{part}\\E" if part else "" for part in text.split("*")))


def extension(name: Column) -> Column:
    """From the last dot on; empty without one."""
    return F.regexp_extract(name, r"\.[^.]*$", 0)


def human_size(size: Column) -> Column:
    """A size in B, KB or MB with at most one decimal, cut off, and left out when it is 0."""
    size = size.cast("long")

    def scaled(unit: int, name: str) -> Column:
        whole, tenth = F.floor(size / unit), F.floor((size % unit) * 10 / unit)
        return F.concat(F.format_number(whole, 0), F.when(tenth > 0, F.concat(F.lit("."), tenth.cast("string"))).otherwise(""), F.lit(name))

    return F.when(size < 1024, F.concat(F.format_number(size, 0), F.lit("B"))).when(size < 1 << 20, scaled(1 << 10, "KB")).otherwise(scaled(1 << 20, "MB"))


def is_reserved_name(name: Column) -> Column:
    """A device name, whatever the extension."""
    stem = F.rtrim(F.regexp_replace(F.regexp_extract(name, r"[^\\/]*$", 0), r"\.[^.]*$", ""))
    return F.coalesce(F.regexp_replace(stem, r"[ .]+$", "").rlike(f"(?i)^({'|'.join(DEVICE_NAMES)}|(COM|LPT)[1-9])$"), F.lit(False))


def trimmed(name: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(name, f"^{BLANK}|{BLANK}$", "")


def name_status(
    name: Column, longest: int = 15, ascii_only: bool = True, banned: tuple[str, ...] = (), shortest: int = 1, banned_chars: str = "",
) -> Column:
    """The first rule a file name, trimmed, breaks, or Ok."""
    plain = trimmed(name)
    banned_here, has_char = F.lit(False), F.lit(False)
    for word in banned:
        banned_here = banned_here | F.contains(F.upper(plain), F.lit(word.upper()))
    for char in banned_chars:
        has_char = has_char | F.contains(plain, F.lit(char))
    return (
        F.when(name.isNull() | (plain == ""), "NullOrWhiteSpace")
        .when(plain.isin(".", ".."), "ContainsInvalidString")
        .when(plain.rlike(r"[\x00-\x1f" + re.escape(BAD_CHARS) + "]"), "ContainsInvalidFileSystemChar")
        .when(has_char, "ContainsInvalidChar")
        .when(is_reserved_name(plain), "WindowsReservedName")
        .when(F.char_length(plain) < shortest, "TooShort")
        .when(F.char_length(plain) > longest, "TooLong")
        .when(banned_here, "ContainsInvalidString")
        .when(F.lit(ascii_only) & plain.rlike(r"[^\x20-\x7e]"), "ContainsNonAscii")
        .otherwise("Ok")
    )


def group_name(text: Column) -> Column:
    """What a group name may hold: letters, digits and underscores, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "")


def key_name(text: Column) -> Column:
    """What a key may hold: beside these / : and blanks."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9/_: ]+", "")


def sanitize_name(name: Column, longest: int = 15) -> Column:
    """A name of printable ASCII that the file system takes, the extension kept when it is cut.

    Where nothing usable is left the name is file_ and a digest of the original, so that a query gives the same twice.
    """
    clean = F.trim(F.regexp_replace(name, r"[^\x20-\x7e]|[" + re.escape(BAD_CHARS) + "]", "_"))
    ext = extension(clean)
    keeps = (F.char_length(ext) > 0) & (F.char_length(ext) < longest) & (F.char_length(ext) < F.char_length(clean))
    cut = F.when(keeps, F.concat(F.substring(clean, F.lit(1), F.lit(longest) - F.char_length(ext)), ext)).otherwise(F.substring(clean, 1, longest))
    short = F.when(F.char_length(clean) <= longest, clean).otherwise(cut)
    spare = F.concat(F.lit("file_"), F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, 8))
    return F.when(name.isNull() | (short == "") | is_reserved_name(short), spare).otherwise(short)


def lines(text: Column) -> Column:
    """The lines of a text, whatever ends them."""
    return F.split(text, "\r\n|\r|\n", -1)


def line_of(text: Column, position: Column) -> Column:
    """The number, from 1, of the line that holds a position (from 1)."""
    before = F.substring(text, F.lit(1), position - 1)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def find_wrapped(text: Column, needle: str, start: Column) -> Column:
    """Where needle is next found from start on, from the beginning if not there; 0 if nowhere. Case does not count."""
    low = F.lower(text)
    ahead = F.call_function("locate", F.lit(needle.lower()), low, start.cast("int"))
    return F.when(ahead > 0, ahead).otherwise(F.locate(needle.lower(), low))


def replace_ignoring_case(text: Column, old: str, new: str) -> Column:
    """Every `old` in any case replaced."""
    return F.regexp_replace(text, f"(?i)\\Q{old}\\E", new.replace("\\", "\\\\").replace("$", "\\$"))


def escape_quotes(text: Column) -> Column:
    """Double quotes get a backslash."""
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def unescape_quotes(text: Column) -> Column:
    """The inverse of escape_quotes."""
    return F.replace(text, F.lit('\\"'), F.lit('"'))


def stored_length(text: Column) -> Column:
    """Bytes a string takes with its terminating NUL; 1 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)) + 1


def contains_ignoring_case(values: Column, wanted: str) -> Column:
    """An array holds a string in any case."""
    return F.exists(values, lambda x: F.upper(x) == wanted.upper())


def index_exists(values: Column, index: Column) -> Column:
    """An array has a place of that number, from 0."""
    return F.coalesce((index >= 0) & (index < F.size(values)), F.lit(False))


def at_index(values: Column, index: Column) -> Column:
    """struct(found, value): the value at a place, from 0; null where there is none."""
    return F.struct(index_exists(values, index).alias("found"), F.when(index_exists(values, index), F.get(values, index.cast("int"))).alias("value"))


def token_kind(token: Column) -> Column:
    """What a value of a settings file is: string, comment, float, int or error."""
    return (
        F.when(token.rlike(r'^".*"$'), "string").when(token.startswith("//"), "comment")
        .when(token.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$") & token.rlike("[.eE]"), "float")
        .when(token.rlike(r"^(NaN|-?Infinity)$"), "float").when(token.rlike(r"^[+-]?[0-9]+$"), "int").otherwise("error")
    )


def value_tokens(text: Column) -> Column:
    """The values of a line: quoted, or free of commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'("[^"\\]*(?:\\.[^"\\]*)*+"|[^,]+)'), F.lit(1)), lambda v: F.trim(v))


def printable(text: Column, chars_only: bool = False) -> Column:
    """Only printable ASCII, and tabs and line ends unless chars_only."""
    return text.rlike(r"\A[\x20-\x7e]*\z" if chars_only else r"\A[\x20-\x7e\t\r\n]*\z")


def key_comment(text: Column) -> Column:
    """The hexadecimal key of a leading key comment; empty without one."""
    return F.regexp_extract(text, r"(?i)\A// ?KEY:0x([0-9a-f]+)", 1)


def strip_key_comment(text: Column) -> Column:
    """The text without its leading key comment."""
    return F.regexp_replace(text, r"(?i)\A// ?KEY:0x[0-9a-f]+[^\S\r\n]*(?:\r\n|\r|\n)?", "")


def with_key_comment(text: Column, key: Column) -> Column:
    """The text below a comment that names a key, in place of any that it had."""
    return F.concat(F.format_string("// KEY:0x%08X\r\n", key), strip_key_comment(text))


def key_value(line: Column) -> Column:
    """struct(key, value) of a line with an equals sign, both trimmed; null without one."""
    pattern = r"^\s*([^=]*?)\s*=\s*(.*?)\s*$"
    return F.when(F.contains(line, F.lit("=")), F.struct(F.regexp_extract(line, pattern, 1).alias("key"), F.regexp_extract(line, pattern, 2).alias("value")))


def place(text: Column) -> Column:
    """struct(x, y, text): the position written before a text, 0 and 0 without one, and what follows it."""
    pattern = r"^\[x=(-?\d+),y=(-?\d+)\]"

    def number(group: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int"), F.lit(0))

    return F.struct(number(1).alias("x"), number(2).alias("y"), F.regexp_replace(text, pattern, "").alias("text"))


def version_label(version: Column, record: Column) -> Column:
    """The name of an archive layout."""
    return F.concat(F.lit("PFF"), version.cast("string"), F.lit("-"), record.cast("string"))


def checksums_match(read: Column, computed: Column) -> Column:
    """Equal, or one of them missing."""
    return F.coalesce(read == computed, F.lit(True))


def checksum_text(read: Column, computed: Column, dead: Column | None = None) -> Column:
    """A checksum as shown: N/A for dead entries and where there is none, a star where the two differ."""
    shown = F.format_string("%08X", F.coalesce(computed, read))
    none = read.isNull() & computed.isNull()
    none = none if dead is None else none | dead
    return F.when(none, "N/A").when(checksums_match(read, computed), shown).otherwise(F.concat(shown, F.lit("*")))


def epoch(moment: Column) -> Column:
    """Seconds since 1970, kept within 32 bits."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.unix_seconds(moment.cast("timestamp")), F.lit(0xFFFFFFFF)))


def local_time(seconds: Column, zone: str) -> Column:
    """Seconds since 1970 as a time of a zone."""
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)


def json_error(message: Column) -> Column:
    """struct(message, line) of a parser's message that ends in a line number in brackets; line -1 without one."""
    pattern = r"(?s)^(.*)\s\((\d+)\):"
    line = F.nullif(F.regexp_extract(message, pattern, 2), F.lit("")).cast("int")
    return F.struct(F.when(line.isNull(), message).otherwise(F.trim(F.regexp_extract(message, pattern, 1))).alias("message"), F.coalesce(line, F.lit(-1)).alias("line"))
