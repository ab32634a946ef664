"""Scalar rules as Spark column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.sources.listmode_format import RAW_DATA_FOLDERS

FILE_NUMBER_WIDTH = 5

# cp1252 differs from latin-1 only in 0x80..0x9F. The bytes, and what they stand for.
# The five unassigned bytes decode to U+FFFD, as "replace" error handling does.
_CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0))
_CP1252_CHARS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")

# Spellings that a delimited reader takes for a missing value. Fixed values.
NA_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def base_name(path: Column) -> Column:
    """Last component of a path or URI."""
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - F.lit(1))


def decode_file_url(url: Column) -> Column:
    """``_metadata.file_path`` is percent-encoded; give the plain path (``+`` is not a blank here)."""
    return F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def normalized_file_name(path: Column) -> Column:
    """Stem with its trailing number padded to five digits, or ``_00000`` appended when it has none."""
    stem = file_stem(path)
    number = F.regexp_extract(stem, r"^(.*_)(\d+)$", 2)
    start = F.regexp_extract(stem, r"^(.*_)(\d+)$", 1)
    padded = F.when(
        F.length(number) < FILE_NUMBER_WIDTH, F.lpad(number, FILE_NUMBER_WIDTH, "0")
    ).otherwise(number)
    return (
        F.when(stem.rlike(rf"^.+_\d{{{FILE_NUMBER_WIDTH}}}"), stem)
        .when(number != "", F.concat(start, padded))
        .otherwise(F.concat(stem, F.lit("_" + "0" * FILE_NUMBER_WIDTH)))
    )


def is_unnumbered(path: Column) -> Column:
    """True for the file of a folder that carries the header line."""
    return ~file_stem(path).rlike(r"^.*_\d+$")


def int_from_text(text: Column) -> Column:
    """Whole number from text; a decimal spelling is truncated toward zero; null if neither."""
    bare = F.trim(text, F.lit(" \t\r\n"))
    as_double = bare.try_cast("double")
    return F.coalesce(bare.try_cast("bigint"), as_double.try_cast("bigint"))


def null_if_na(text: Column) -> Column:
    return F.when(text.isin(*NA_SPELLINGS), F.lit(None).cast("string")).otherwise(text)


def has_flag(header: Column, mask: int) -> Column:
    return header.bitwiseAND(F.lit(mask)) == F.lit(mask)


def uint64_from_hex(hex_text: Column) -> Column:
    """Unsigned 64-bit number from big-endian hex digits, without wrapping."""
    return F.conv(hex_text, 16, 10).cast("decimal(20,0)")


def uint32_from_hex(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def low_byte(number: Column) -> Column:
    """Narrowing store of a 16-bit number in 8 bits."""
    return number.bitwiseAND(F.lit(255)).cast("smallint")


def run_start(text: Column) -> Column:
    """Instant of a run start such as ``2023/01/05 23:30:00.123-0600``; null when malformed.

    The offset arrives without a colon; the fraction may have three or six digits, and the date
    may use dashes.
    """
    dashed = F.replace(text, F.lit("/"), F.lit("-"))
    head = dashed.substr(F.lit(1), F.length(dashed) - F.lit(2))
    with_colon = F.concat(head, F.lit(":"), F.right(dashed, F.lit(2)))
    shape = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?[+-]\d{2}:\d{2}$"
    return F.when(with_colon.rlike(shape), with_colon.try_cast("timestamp"))


def date_stamp(start_text: Column) -> Column:
    """``yyyyMMdd`` of the wall date written in the text (not of the converted instant)."""
    return F.regexp_replace(start_text.substr(1, 10), "[/-]", "")


def member_part(name: Column, part: int) -> Column:
    """Part 1 = device parameter, part 2 = sequence number of a telemetry member's base name."""
    return F.regexp_extract(name, r"^(?:ID|TB)-\S+ (.+) (\d+).csv", part)


def decode_cp1252(raw: Column) -> Column:
    """windows-1252 bytes to text, unassigned bytes replaced; built from latin-1 plus a translation."""
    return F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), _CP1252_BYTES, _CP1252_CHARS)


def decode_latin1(raw: Column) -> Column:
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def local_to_utc(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local, zone)


def is_dst_gap(local: Column, zone: str) -> Column:
    """The wall time never happened: going to UTC and back gives another wall time."""
    return F.from_utc_timestamp(F.to_utc_timestamp(local, zone), zone) != local


def is_dst_ambiguous(local: Column, zone: str) -> Column:
    """The wall time happened twice: a neighbouring instant shows the same wall time."""
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("interval 1 hour")
    return (F.from_utc_timestamp(utc - hour, zone) == local) | (
        F.from_utc_timestamp(utc + hour, zone) == local
    )


def date_and_time(date: Column, time: Column, fmt: str) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(fmt))


def ms_to_timestamp(mtime_ms: Column) -> Column:
    return F.timestamp_micros((mtime_ms * F.lit(1000)).cast("bigint"))


def timestamp_to_ms(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1000.0)


def is_dose_meter_log(first_line: Column) -> Column:
    return F.substring(first_line, 1, 5) == F.lit("FH40G")


def prefixed_id(name: Column, prefix: str = "TB-") -> Column:
    """Ids that already hold ``ID-`` or ``TB-`` anywhere are left alone."""
    return F.when(name.contains("ID-") | name.contains("TB-"), name).otherwise(
        F.concat(F.lit(prefix), name)
    )


def experiment_id_from_source(path: Column, is_file: Column) -> Column:
    """A folder source is its own experiment; a file source belongs to the folder holding it."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.when(is_file, F.get(parts, F.size(parts) - F.lit(2))).otherwise(
        F.element_at(parts, -1)
    )




def experiment_id_of_file(path: Column) -> Column:
    """Folder name of a data file, looking through a raw-data folder such as ``UNFILTERED``."""
    def above(levels):
        return F.substring_index(F.substring_index(path, "/", -levels - 1), "/", 1)

    parent = F.when(path.contains("/"), above(1))
    return F.when(parent.isin(*RAW_DATA_FOLDERS), above(2)).otherwise(parent)
