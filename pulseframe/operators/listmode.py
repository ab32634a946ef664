"""List-mode rows: delimited files, the PSD / waveform split and its inverse."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.functions import scalars as fx
from pulseframe.operators.joins import join_summary, measured
from pulseframe.operators.positions import with_record_idx
from pulseframe.session import materialize, ship_package, tasks_for
from pulseframe.sources import listmode_csv as csv
from pulseframe.sources.files import list_files
from pulseframe.sources.lines import cut_spans, over_spans, place_spans, sized

SAMPLES_COLUMN = "SAMPLES"
DELIMITER = ";"
CSV_GLOB = "*.[cC][sS][vV]"
SINGLE_CHANNEL_PREFIX = "SData"
DUAL_CHANNEL_PREFIX = "Data_CH"

# Header names of the delimited format and the list-mode column each one fills. Fixed values.
CSV_COLUMNS = {
    "BOARD": "BOARD", "CHANNEL": "CHANNEL", "TIMETAG": "TIMESTAMP", "TIMESTAMP": "TIMESTAMP",
    "ENERGY": "ENERGY", "CALIB_ENERGY": "CALIB_ENERGY", "ENERGYSHORT": "ENERGYSHORT",
    "FLAGS": "FLAGS", "PROBE_CODE": "WAVEFORM_CODE", "WAVEFORM_CODE": "WAVEFORM_CODE",
}


def _pieces(value: Column, delimiter: str) -> Column:
    # A plain or backslashed single character is split without a regular expression.
    pattern = delimiter if delimiter.isalnum() else "".join("\\" + c for c in delimiter)
    return F.split(value, pattern, -1)


def _n_pieces(value: Column, delimiter: str) -> Column:
    removed = F.length(value) - F.length(F.replace(value, F.lit(delimiter), F.lit("")))
    return (removed / F.lit(len(delimiter))).cast("int") + F.lit(1)


def csv_folder_headers(lines: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """``(folder, names, width, place)`` of each folder: header names, width of the first data line,
    and where each list-mode column stands among the fields.

    They come from the unnumbered file of the folder (lowest file name when there are several).
    """
    name = fx.base_name(F.col("source_file"))
    first_two = lines.where((F.col("line_no") <= 1) & fx.is_unnumbered(F.col("source_file")))
    strip = F.trim(F.col("value"), F.lit(" \t\r\n"))
    heads = first_two.select(
        fx.folder_of(F.col("source_file")).alias("folder"), name.alias("name"), "line_no",
        _pieces(strip, delimiter).alias("parts"),
    )
    return (
        heads.groupBy("folder")
        .agg(
            F.min_by("parts", F.when(F.col("line_no") == 0, F.col("name"))).alias("names"),
            F.min_by(F.size("parts"), F.when(F.col("line_no") == 1, F.col("name"))).alias("data_width"),
        )
        .where(F.col("names").isNotNull())
        .select(
            "folder",
            F.filter("names", lambda n: n != SAMPLES_COLUMN).alias("names"),
            F.when(F.array_contains("names", SAMPLES_COLUMN), F.coalesce("data_width", F.lit(1)))
            .otherwise(F.size("names")).alias("width"),
        )
        .withColumn("place", F.struct(*[
            _place(column).alias(column) for column in sorted(set(CSV_COLUMNS.values()))]))
    )


def _place(column: str) -> Column:
    """0-based place of the first header name that stands for the column; null when none does."""
    places = [
        F.nullif(F.array_position("names", name), F.lit(0)) for name, c in CSV_COLUMNS.items() if c == column
    ]
    found = F.coalesce(*places) if len(places) > 1 else places[0]
    return (found - F.lit(1)).cast("int")


def _fits(headers: DataFrame, data: DataFrame, delimiter: str) -> DataFrame:
    """``data(value, folder)`` without blank lines and lines with too many fields (the bad-line rule),
    with the header columns of its folder.

    Short lines are padded with nulls later. A folder without header raises.
    """
    most = F.coalesce(
        F.greatest(F.col("width"), F.size("names")),
        F.raise_error(F.lit("Could not find csv file with headers")).cast("int"))
    value = F.col("value")
    # Counting delimiters is cheaper than splitting.
    return (
        data.where(F.trim(value, F.lit(" \t")) != "").join(headers, "folder", "left")
        .where(_n_pieces(value, delimiter) <= most)
    )


def _kept_lines(lines: DataFrame, headers: DataFrame, delimiter: str) -> DataFrame:
    """Data lines still as text. Only the unnumbered file's first line is a header."""
    is_header_line = (F.col("line_no") == 0) & fx.is_unnumbered(F.col("source_file"))
    data = lines.where(~is_header_line).withColumn("folder", fx.folder_of(F.col("source_file")))
    return _fits(headers, data, delimiter).select("source_file", "line_no", "value")


def _with_layout(kept: DataFrame, headers: DataFrame, delimiter: str) -> DataFrame:
    return (
        kept.withColumn("folder", fx.folder_of(F.col("source_file")))
        .join(headers, "folder", "left").drop("folder")
        .withColumn("parts", _pieces(F.col("value"), delimiter)).drop("value")
    )


def listmode_csv_rows(lines: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """Data lines as ``(source_file, line_no, names, width, place, parts)``."""
    headers = measured(csv_folder_headers(lines, delimiter), "csv-headers")
    return _with_layout(_kept_lines(lines, headers, delimiter), headers, delimiter)


def csv_text_columns(rows: DataFrame) -> DataFrame:
    """Untyped form: every PSD column as text in a map, the trailing sample fields as a text array."""
    fields = F.transform(
        F.sequence(F.lit(0), F.size("names") - 1),
        lambda i: fx.null_if_na(F.get("parts", i)),
    )
    return rows.select(
        "source_file", "line_no", F.map_from_arrays("names", fields).alias("psd"),
        _sample_fields().alias("samples"),
    )


def _sample_fields(kind: str | None = None) -> Column:
    first, width = F.size("names"), F.col("width")

    def take(i):
        text = F.get("parts", i)
        return text.try_cast(kind) if kind else fx.null_if_na(text)

    return F.when(width > first, F.transform(F.sequence(first, width - 1), take))


def typed_listmode(rows: DataFrame) -> DataFrame:
    """The fixed ``listmode`` columns from delimited rows (``record_idx`` as found in the input)."""
    named = F.transform(F.sequence(F.lit(0), F.size("names") - 1),
                        lambda i: F.struct(F.get("names", i).alias("key"), F.get("parts", i).alias("value")))
    extra = F.map_from_entries(F.filter(named, lambda e: ~e["key"].isin(*CSV_COLUMNS)))
    return _typed(rows, lambda target: F.get("parts", F.col("place")[target]), _sample_fields("smallint"), extra)


def _typed(rows: DataFrame, raw: Callable[[str], Column], samples: Column, extra: Column) -> DataFrame:
    """``raw`` gives the text of a list-mode column; ``extra`` maps the names of all other columns to their text."""
    def text_of(target):
        return F.trim(raw(target))

    flags = text_of("FLAGS")
    hexadecimal = flags.rlike("^0[xX][0-9a-fA-F]{1,8}$")
    flag_value = F.when(hexadecimal, fx.uint32_from_hex(flags.substr(F.lit(3), F.length(flags))))
    flag_value = flag_value.otherwise(flags.try_cast("bigint"))
    return rows.select(
        fx.experiment_id_of_file(F.col("source_file")).alias("experiment_id"),
        "source_file",
        "record_idx",
        text_of("BOARD").try_cast("smallint").alias("BOARD"),
        text_of("CHANNEL").try_cast("smallint").alias("CHANNEL"),
        text_of("TIMESTAMP").try_cast("decimal(20,0)").alias("TIMESTAMP"),
        text_of("ENERGY").try_cast("smallint").alias("ENERGY"),
        text_of("CALIB_ENERGY").try_cast("double").alias("CALIB_ENERGY"),
        text_of("ENERGYSHORT").try_cast("smallint").alias("ENERGYSHORT"),
        flag_value.alias("FLAGS"),
        text_of("WAVEFORM_CODE").try_cast("smallint").alias("WAVEFORM_CODE"),
        samples.alias("samples"),
        F.when(F.size(extra) > 0, F.transform_values(extra, lambda _, v: fx.null_if_na(v))).alias("extra"),
    )


def parse_listmode_csv(lines: DataFrame, delimiter: str = DELIMITER, gapless: bool = True) -> DataFrame:
    """``listmode`` rows of delimited files.

    ``gapless=False`` takes the line number as ``record_idx``: still a key for joining waveforms, but
    without the shuffle that closing the gaps of header and dropped lines costs.
    """
    headers = measured(csv_folder_headers(lines, delimiter), "csv-headers")
    kept = _kept_lines(lines, headers, delimiter)
    if gapless:
        # Number the bare text: what the shuffle carries is the line and its place.
        kept = with_record_idx(kept)
    else:
        kept = kept.withColumn("record_idx", F.col("line_no"))
    return typed_listmode(_with_layout(kept, headers, delimiter))


def read_listmode_csv(spark: SparkSession, path, delimiter: str = DELIMITER, glob: str = CSV_GLOB,
                      prefix: str = "", split_bytes: int | None = None) -> DataFrame:
    """``listmode`` rows of the delimited files below ``path`` whose names start with the pattern ``prefix``."""
    files = filter_files(list_files(spark, path, glob), "", prefix, "path")
    return listmode_csv_of(files, delimiter, split_bytes)


def listmode_csv_of(files: DataFrame, delimiter: str = DELIMITER, split_bytes: int | None = None) -> DataFrame:
    """``listmode`` rows of the delimited files that a table ``files(path, length)`` names, read by spans.

    Same rows as ``parse_listmode_csv(read_lines(...))``. A counting pass finds how many lines each byte range keeps; a
    running sum over that small table numbers the first of each range, and reading tasks go on from there, so no line is
    shuffled or joined at any size. Headers come from the first lines of the unnumbered files among ``files``. A folder
    without a header raises, as does one of whose lines none has few enough fields for its header.
    """
    ship_package(files.sparkSession)
    files = materialize(files.select("path", "length").withColumn("folder", fx.folder_of(F.col("path"))), "csv-files")
    headed = fx.is_unnumbered(F.col("path")) & (F.col("length") > 0)
    size, tasks, totals = sized(files, split_bytes, F.count_if(headed).alias("headed"))
    spread = files.where(headed).select("path", "length").repartition(tasks_for(files.sparkSession, totals["headed"]))
    heads = spread.mapInArrow(over_spans(csv.head_lines), schemas.LINES)
    headers = csv_folder_headers(heads, delimiter)
    most = F.coalesce(
        F.greatest(F.col("width"), F.size("names")),
        F.raise_error(F.lit("Could not find csv file with headers")).cast("int"))
    extra = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: ~F.get("names", i).isin(*CSV_COLUMNS))
    laid_out = (
        files.join(headers, "folder", "left").withColumn("most", most)
        .select("path", "length", "folder", "most", "names", "width", "place", extra.alias("extra"),
                fx.is_unnumbered(F.col("path")).alias("headed"))
    )
    spans = cut_spans(materialize(laid_out, "csv-layout"), size)
    counted = materialize(spans.repartition(tasks).mapInArrow(
        over_spans(partial(csv.count_kept, delimiter=delimiter)),
        "path STRING, split BIGINT, folder STRING, n BIGINT, n_lines BIGINT"), "csv-counts")
    misfits = counted.groupBy("folder").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"))
    misfit = misfits.where((F.col("n") == 0) & (F.col("n_lines") > 0)).first()
    if misfit is not None:
        raise ValueError(f"no line fits the header of {misfit['folder']}")
    placed = spans.join(place_spans(counted).select("path", "split", "n", "first"), ["path", "split"]).where(F.col("n") > 0)
    texts = ", ".join(f"{name} STRING" for name in csv.TARGETS)
    rows = placed.repartition(tasks).mapInArrow(
        over_spans(partial(csv.read_kept, delimiter=delimiter)),
        f"source_file STRING, record_idx BIGINT, {texts}, samples ARRAY<STRING>, extra MAP<STRING,STRING>")
    samples = F.transform("samples", lambda v: v.try_cast("smallint"))
    return _typed(rows, F.col, samples, F.coalesce("extra", F.create_map().cast("map<string,string>")))


def with_channel_from_name(df: DataFrame) -> DataFrame:
    """``layout`` single/dual and, for the dual layout, the ``file_channel`` its file name tells."""
    name = fx.base_name(F.col("source_file"))
    digit = F.regexp_extract(name, rf"^{DUAL_CHANNEL_PREFIX}([01])", 1)
    layout = (
        F.when(name.startswith(SINGLE_CHANNEL_PREFIX), F.lit("single"))
        .when(digit != "", F.lit("dual"))
    )
    return df.withColumn("layout", layout).withColumn(
        "file_channel", F.when(digit != "", F.concat(F.lit("ch"), digit)))


def filter_files(df: DataFrame, extension: str, prefix: str = "", column: str = "source_file") -> DataFrame:
    """Rows of files with this extension (any case) whose name starts with the pattern ``prefix``."""
    name = fx.base_name(F.col(column))
    return df.where(F.lower(name).endswith(extension.lower()) & name.rlike(f"^{prefix}.*"))


def psd(df: DataFrame) -> DataFrame:
    return df.drop("samples")


def signals(df: DataFrame) -> DataFrame:
    return df.where(F.col("samples").isNotNull()).select("source_file", "record_idx", "samples")


def join_waveforms(psd_rows: DataFrame, signal_rows: DataFrame) -> DataFrame:
    """Put PSD rows and their waveforms together again."""
    return psd_rows.join(signal_rows, ["source_file", "record_idx"])


def samples_wide(df: DataFrame, n: int) -> DataFrame:
    """Export form with one column a sample, named by its number. A longer waveform raises: no sample is cut off."""
    kept = [c for c in df.columns if c != "samples"]
    whole = F.when(F.size("samples") > n, F.raise_error(F.lit(f"a waveform has more than {n} samples"))
                   .cast(df.schema["samples"].dataType)).otherwise(F.col("samples"))
    wide = df.select(*kept, whole.alias("samples"))
    return wide.select(*kept, *[F.get("samples", F.lit(i)).alias(str(i)) for i in range(n)])


def filter_sample_count(df: DataFrame, order: str = "raw_idx") -> DataFrame:
    """Keep records with as many samples as their file's first record; renumber the kept ones.

    The expected count is an aggregate per file joined back, so no file is held by one task.
    """
    counted = df.withColumn("__n", F.size("samples"))
    expected = counted.groupBy("source_file").agg(F.min_by("__n", order).alias("__first_n"))
    kept = join_summary(counted, expected, ["source_file"], label="sample-counts").where(F.col("__n") == F.col("__first_n"))
    return with_record_idx(kept.drop("__n", "__first_n"), order=order)


def conversion_summary(file_status: DataFrame) -> DataFrame:
    """Totals of one conversion; the failing files are rows of ``failing_files``."""
    return file_status.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("ok").alias("n_good"),
        F.count_if(~F.col("ok")).alias("n_bad"),
    )


def failing_files(file_status: DataFrame) -> DataFrame:
    return file_status.where(~F.col("ok")).select("source_file", "reason")
