"""Registered queries, one or more an operator, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import sinks
from pulseframe.functions import scalars as fx
from pulseframe.operators import devicelog, doselog, inventory as inv, listmode as lm, logs, metadata
from pulseframe.operators import overrides as ovr
from pulseframe.operators import reactor as rx
from pulseframe.operators import spectra
from pulseframe.plans import stand_ins as si
from pulseframe.plans.analysis import plan_analyses, plan_processing
from pulseframe.plans.conversion import CSV_CLASSES, convert_dose_log, convert_folder, convert_listmode_csv, convert_planned
from pulseframe.plans.inventory_view import current_inventory
from pulseframe.session import materialize, scratch_path
from pulseframe.sources import listmode_bin as lb
from pulseframe.sources.files import list_files, write_whole
from pulseframe.sources.lines import read_lines
from pulseframe.sources.manifest import classified_sources, sources_in
from pulseframe.sources.reactor import read_reactor_archives, reactor_members
from pulseframe.sources.tables import load_overrides, save_overrides
from pulseframe.streaming.conversion import continuous_conversion, continuous_experiments, converted_so_far
from pulseframe.streaming.logs import log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its oracle."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register



def _file_name():
    return fx.base_name(F.col("source_file")).alias("file_name")


# ---------------------------------------------------------------- list-mode binary

_EVENTS = """
WITH e AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""

_BIN_ROWS = _EVENTS + """, r AS (
  SELECT 'SData_' || CAST(event_id // 4096 AS VARCHAR) || '.bin' AS file_name,
         'run-' || CAST(event_id // 4096 // 8 AS VARCHAR) AS experiment_id,
         row_number() OVER (PARTITION BY event_id // 4096 ORDER BY event_id) - 1 AS record_idx,
         user_id % 7 AS board, user_id % 4 AS channel,
         CAST(event_id AS HUGEINT) + 9223372036854775808 AS stamp,
         CAST(floor(value) AS BIGINT) AS energy, value AS calib_energy, k AS energy_short,
         2147483648 + event_id % 1000 AS flags
  FROM e)
"""


def _bin_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "experiment_id", _file_name(), "record_idx", F.col("BOARD").cast("bigint").alias("board"),
        F.col("CHANNEL").cast("bigint").alias("channel"), F.col("TIMESTAMP").cast("string").alias("stamp"),
        F.col("ENERGY").cast("bigint").alias("energy"), F.col("CALIB_ENERGY").alias("calib_energy"),
        F.col("ENERGYSHORT").cast("bigint").alias("energy_short"), F.col("FLAGS").alias("flags"))


_BIN_SELECT = """
SELECT experiment_id, file_name, record_idx, board, channel, CAST(stamp AS VARCHAR) AS stamp, energy,
       calib_energy, CAST(energy_short AS BIGINT) AS energy_short, flags FROM r
"""


@query(_BIN_ROWS + _BIN_SELECT)
def listmode_bin_scan(spark, sf_dir):
    return _bin_columns(lb.read_listmode(spark, si.event_bin_files(spark, sf_dir), split_bytes=64 << 10))


@query(_BIN_ROWS + _BIN_SELECT)
def listmode_bin_format(spark, sf_dir):
    lb.register(spark)
    rows = spark.read.format("listmode_bin").option("splitBytes", 64 << 10)
    return _bin_columns(rows.load(si.event_bin_files(spark, sf_dir)))


@query(_BIN_ROWS + """
SELECT channel, board, count(*) AS n, CAST(sum(energy) AS BIGINT) AS energy, max(record_idx) AS last_idx
FROM r GROUP BY channel, board
""")
def listmode_rates(spark, sf_dir):
    """Counts and energy per channel and board straight from the binary files."""
    rows = _bin_columns(lb.read_listmode(spark, si.event_bin_files(spark, sf_dir)))
    return rows.groupBy("channel", "board").agg(
        F.count(F.lit(1)).alias("n"), F.sum("energy").alias("energy"), F.max("record_idx").alias("last_idx"))


@query(_EVENTS + """
SELECT 'SData_' || CAST(event_id // 4096 AS VARCHAR) || '.bin' AS file_name, 2 + 28 * count(*) AS length,
       CAST(51943 AS BIGINT) AS header, TRUE AS valid, TRUE AS has_energy, TRUE AS has_calib_energy, TRUE AS has_energy_short,
       FALSE AS has_waveform, CAST(28 AS BIGINT) AS record_length
FROM e GROUP BY event_id // 4096
""")
def listmode_headers(spark, sf_dir):
    files = list_files(spark, si.event_bin_files(spark, sf_dir), lb.BIN_GLOB)
    return lb.listmode_headers(files).select(
        _file_name(), "length", F.col("header").cast("bigint").alias("header"), "valid", "has_energy",
        "has_calib_energy", "has_energy_short", "has_waveform", "record_length")


_WAVES = """
WITH v AS (
  SELECT vec_id, label, vec_id // 100 AS file_no,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS samples
  FROM embeddings),
c AS (SELECT vec_id, label, file_no, CASE WHEN label = 7 THEN samples[1:8] ELSE samples END AS samples FROM v),
m AS (SELECT *, first_value(len(samples)) OVER (PARTITION BY file_no ORDER BY vec_id) AS first_n FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY vec_id) - 1 AS record_idx
      FROM m WHERE len(samples) = first_n)
"""


def _wave_facts(rows: DataFrame) -> DataFrame:
    return rows.select(
        _file_name(), "record_idx", F.size("samples").cast("bigint").alias("n"),
        F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.get("samples", F.lit(0)).cast("bigint").alias("first_sample"),
        F.element_at("samples", -1).cast("bigint").alias("last_sample"))


_WAVE_SELECT = """
SELECT 'SData_' || CAST(file_no AS VARCHAR) || '.bin' AS file_name, record_idx, len(samples) AS n,
       CAST(list_sum(samples) AS BIGINT) AS total, samples[1] AS first_sample, samples[-1] AS last_sample
"""


@query(_WAVES + _WAVE_SELECT + """
FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY vec_id) - 1 AS record_idx FROM v)
""")
def listmode_bin_waveforms(spark, sf_dir):
    return _wave_facts(lb.read_listmode(spark, si.waveform_bin_files(spark, sf_dir), split_bytes=4096))


@query(_WAVES + _WAVE_SELECT + """
FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY vec_id) - 1 AS record_idx FROM v)
""")
def listmode_format_waveforms(spark, sf_dir):
    """The data source on files with waveforms, each cut into several tasks."""
    lb.register(spark)
    folder = si.waveform_bin_files(spark, sf_dir)
    return _wave_facts(spark.read.format("listmode_bin").option("splitBytes", "4096").load(folder))


@query(_WAVES + _WAVE_SELECT + "FROM k")
def listmode_sample_mismatch(spark, sf_dir):
    """Records with another sample count than the file's first are skipped, without using an index."""
    return _wave_facts(lb.read_listmode(spark, si.waveform_bin_files(spark, sf_dir, cut=True), split_bytes=4096))


@query(_WAVES + _WAVE_SELECT + "FROM k")
def sample_count_filter(spark, sf_dir):
    """The same rule on records that are rows already."""
    rows = si.waveforms(spark, sf_dir).select(
        F.concat(F.lit("SData_"), F.col("file_no").cast("string"), F.lit(".bin")).alias("source_file"),
        "raw_idx", F.col("cut_samples").alias("samples"))
    return _wave_facts(lm.filter_sample_count(rows))


@query(_WAVES + """
SELECT 'SData_' || CAST(file_no AS VARCHAR) || '.bin' AS file_name, TRUE AS ok, 'OK' AS reason,
       count(*) FILTER (len(samples) = first_n) AS n_records,
       count(*) FILTER (len(samples) <> first_n) AS n_skipped
FROM m GROUP BY file_no
""")
def listmode_status(spark, sf_dir):
    return lb.read_listmode_status(
        spark, si.waveform_bin_files(spark, sf_dir, cut=True), split_bytes=4096
    ).select(_file_name(), "ok", "reason", "n_records", "n_skipped")


@query(_WAVES + """
SELECT 'SData_' || CAST(file_no AS VARCHAR) || '.bin' AS file_name, record_idx, CAST(vec_id AS BIGINT) AS stamp,
       len(samples) AS n, samples[1] AS first_sample FROM k
""")
def waveform_join(spark, sf_dir):
    rows = lb.read_listmode(spark, si.waveform_bin_files(spark, sf_dir, cut=True))
    return lm.join_waveforms(lm.psd(rows), lm.signals(rows)).select(
        _file_name(), "record_idx", F.col("TIMESTAMP").cast("bigint").alias("stamp"),
        F.size("samples").cast("bigint").alias("n"),
        F.get("samples", F.lit(0)).cast("bigint").alias("first_sample"))


@query(_WAVES + "SELECT vec_id, " + ", ".join(f'samples[{i + 1}] AS "{i}"' for i in range(64)) + " FROM v")
def samples_wide(spark, sf_dir):
    rows = si.waveforms(spark, sf_dir).select(
        F.col("raw_idx").alias("vec_id"), F.col("samples").cast("array<bigint>").alias("samples"))
    return lm.samples_wide(rows, 64)


# ---------------------------------------------------------------- list-mode delimited

_CSV_ROWS = _EVENTS + """, kept AS (
  SELECT *, event_type || '/UNFILTERED/SData_' || CAST(event_id // 4096 AS VARCHAR) || '.csv' AS source_file
  FROM e WHERE NOT k > 90)
SELECT event_type AS experiment_id, source_file,
       row_number() OVER (PARTITION BY source_file ORDER BY event_id) - 1 AS record_idx,
       user_id % 4 AS channel, CAST(event_id AS VARCHAR) AS stamp,
       CASE WHEN k <> 50 THEN CAST(floor(value) AS BIGINT) END AS energy, CAST(k AS BIGINT) AS energy_short,
       CASE WHEN k >= 10 THEN CAST(16384 AS BIGINT) END AS flags
FROM kept
UNION ALL
SELECT DISTINCT event_type, event_type || '/UNFILTERED/SData.csv', 0, 0, '0', 1, 1, 0 FROM e
"""


def _csv_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "experiment_id", F.substring_index("source_file", "/", -3).alias("source_file"), "record_idx",
        F.col("CHANNEL").cast("bigint").alias("channel"), F.col("TIMESTAMP").cast("string").alias("stamp"),
        F.col("ENERGY").cast("bigint").alias("energy"), F.col("ENERGYSHORT").cast("bigint").alias("energy_short"),
        F.col("FLAGS").alias("flags"))


@query(_CSV_ROWS)
def listmode_csv(spark, sf_dir):
    return _csv_columns(lm.parse_listmode_csv(si.csv_lines(spark, sf_dir)))


@query(_CSV_ROWS)
def listmode_csv_scan(spark, sf_dir):
    """The same rows read from files, numbered where they are read."""
    return _csv_columns(lm.read_listmode_csv(spark, si.csv_files(spark, sf_dir)))


@query(_EVENTS + """
SELECT 'SData_' || CAST(event_id // 4096 AS VARCHAR) || '.csv' AS file_name,
       row_number() OVER (PARTITION BY event_id // 4096 ORDER BY event_id) - 1 AS record_idx, user_id % 4 AS channel,
       CAST(event_id AS VARCHAR) AS stamp, 'b' || CAST(k AS VARCHAR) AS baseline,
       CASE WHEN k >= 50 THEN event_type END AS note, CAST(2 AS BIGINT) AS n_extra
FROM e UNION ALL SELECT 'SData.csv', 0, 0, '0', '0', '0', 2
""")
def listmode_csv_extra(spark, sf_dir):
    """Columns without a place in the list-mode table are kept by name; spans of a few KB."""
    rows = lm.read_listmode_csv(spark, si.extra_csv_files(spark, sf_dir), split_bytes=20_000)
    return rows.select(
        _file_name(), "record_idx", F.col("CHANNEL").cast("bigint").alias("channel"),
        F.col("TIMESTAMP").cast("string").alias("stamp"), F.col("extra")["BASELINE"].alias("baseline"),
        F.col("extra")["NOTE"].alias("note"), F.size("extra").cast("bigint").alias("n_extra"))


@query(_EVENTS + """
SELECT event_id, CAST(user_id % 4 AS VARCHAR) AS channel_text,
       CASE WHEN k <> 50 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS energy_text,
       CASE WHEN k >= 10 THEN '0x4000' END AS flags_text
FROM e WHERE NOT k > 90
""")
def listmode_csv_text(spark, sf_dir):
    """The untyped columns: text as it stands, missing spellings as null."""
    rows = lm.csv_text_columns(lm.listmode_csv_rows(si.csv_lines(spark, sf_dir)))
    numbered = rows.where(~fx.is_unnumbered(F.col("source_file")))
    return numbered.select(
        F.col("line_no").alias("event_id"), F.col("psd")["CHANNEL"].alias("channel_text"),
        F.col("psd")["ENERGY"].alias("energy_text"), F.col("psd")["FLAGS"].alias("flags_text"))


@query(_WAVES + """, f AS (
  SELECT *, 'wave/UNFILTERED/SData_' || CAST(file_no AS VARCHAR) || '.csv' AS source_file
  FROM c WHERE label <> 3)
SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY vec_id) - 1 AS record_idx,
       CAST(vec_id AS VARCHAR) AS stamp, CAST(64 AS BIGINT) AS n, len(samples) AS n_given, samples[1] AS first_sample,
       samples[64] AS last_sample, CAST(list_sum(samples) AS BIGINT) AS total
FROM f
UNION ALL
SELECT 'wave/UNFILTERED/SData.csv', 0, '0', 64, 64, 0, 0, 0
""")
def listmode_csv_samples(spark, sf_dir):
    rows = lm.parse_listmode_csv(si.csv_sample_lines(spark, sf_dir))
    given = F.filter("samples", lambda x: x.isNotNull())
    return rows.select(
        "source_file", "record_idx", F.col("TIMESTAMP").cast("string").alias("stamp"),
        F.size("samples").cast("bigint").alias("n"), F.size(given).cast("bigint").alias("n_given"),
        F.get("samples", F.lit(0)).cast("bigint").alias("first_sample"),
        F.get("samples", F.lit(63)).cast("bigint").alias("last_sample"),
        F.aggregate(given, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(_EVENTS + """
SELECT event_id, CASE WHEN k < 20 THEN 'single' WHEN (user_id % 12) IN (0, 1, 10, 11) THEN 'dual' END AS layout,
       CASE WHEN k < 20 THEN NULL WHEN (user_id % 12) = 0 THEN 'ch0'
            WHEN (user_id % 12) IN (1, 10, 11) THEN 'ch1' END AS file_channel
FROM e
""")
def dual_channel(spark, sf_dir):
    """Channel by file-name prefix; a two-digit channel that starts with 1 counts as channel 1."""
    rows = si.events(spark, sf_dir).select(
        "event_id",
        F.when(F.col("k") < 20, F.lit("d/SData@x.csv")).otherwise(
            F.concat(F.lit("d/Data_CH"), (F.col("user_id") % 12).cast("string"), F.lit("@x.csv")))
        .alias("source_file"))
    return lm.with_channel_from_name(rows).select("event_id", "layout", "file_channel")


@query(_EVENTS + """
SELECT event_id FROM e WHERE event_type IN ('click', 'view') AND k % 3 <> 2
""")
def file_name_filter(spark, sf_dir):
    suffix = F.when(F.col("k") % 3 == 0, F.lit(".csv")).when(F.col("k") % 3 == 1, F.lit(".CSV")).otherwise(
        F.lit(".csv.gz"))
    rows = si.events(spark, sf_dir).select(
        "event_id", F.concat(F.lit("d/"), F.col("event_type"), suffix).alias("source_file"))
    return lm.filter_files(rows, ".csv", "(click|vi)").select("event_id")


@query(_EVENTS + """
SELECT event_id,
       CASE WHEN k < 10 THEN 'run_00000' WHEN k < 20 THEN 'run_' || lpad(CAST(k AS VARCHAR), 5, '0')
            WHEN k < 30 THEN 'run_000' || CAST(k AS VARCHAR) WHEN k < 40 THEN 'run_1234' || CAST(k AS VARCHAR)
            ELSE 'a_b' || event_type || '_00000' END AS normal_name
FROM e
""")
def file_name_normal(spark, sf_dir):
    k = F.col("k").cast("string")
    name = (
        F.when(F.col("k") < 10, F.lit("run")).when(F.col("k") < 20, F.concat(F.lit("run_"), k))
        .when(F.col("k") < 30, F.concat(F.lit("run_000"), k)).when(F.col("k") < 40, F.concat(F.lit("run_1234"), k))
        .otherwise(F.concat(F.lit("a_b"), F.col("event_type"))))
    return si.events(spark, sf_dir).select(
        "event_id", fx.normalized_file_name(F.concat(F.lit("x/"), name, F.lit(".csv"))).alias("normal_name"))


@query(_EVENTS + """
SELECT event_id, CAST(CAST(event_id AS HUGEINT) + 18446744073000000000 AS VARCHAR) AS wide,
       4294000000 + event_id AS middle, (user_id + 65000) & 255 AS low
FROM e
""")
def unsigned_decode(spark, sf_dir):
    """Unsigned numbers from hex text keep their full range."""
    event_id = F.col("event_id")
    wide = F.hex(event_id + F.lit(18446744073000000000 - 2**64))
    return si.events(spark, sf_dir).select(
        "event_id", fx.uint64_from_hex(wide).cast("string").alias("wide"),
        fx.uint32_from_hex(F.hex(event_id + F.lit(4294000000))).alias("middle"),
        fx.low_byte(F.col("user_id") + 65000).cast("bigint").alias("low"))


@query(_EVENTS + """
SELECT 'f' || event_type AS source_file, event_id AS line_no,
       row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS record_idx
FROM e
""")
def record_index(spark, sf_dir):
    """Gapless index per file; buckets far smaller than a file, so several are chained."""
    rows = si.events(spark, sf_dir).select(
        F.concat(F.lit("f"), F.col("event_type")).alias("source_file"), F.col("event_id").alias("line_no"))
    return lm.with_record_idx(rows, bucket_rows=1000)


# ---------------------------------------------------------------- spectra

_HIST = """
WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin) - 1 AS bin_idx,
             count(*) OVER (PARTITION BY event_type) AS bins FROM h)
"""


@query(_HIST + """
SELECT event_type || 'Espectrum.txt3' AS source_file, bin_idx, CAST(bin AS DOUBLE) AS channel, n AS count,
       CAST(bin AS DOUBLE) / 2 AS bin_energy FROM b
""")
def energy_spectrum(spark, sf_dir):
    return spectra.parse_energy_spectrum(si.energy_lines(spark, sf_dir)).withColumn(
        "bin_idx", F.col("bin_idx").cast("bigint"))


@query(_HIST + """
SELECT event_type || 'PSDspectrum.txt' AS source_file, bin_idx, n AS count,
       round(bin_idx * (CAST(1.0 AS DOUBLE) / bins), 9) AS bin_psd FROM b
""")
def psd_spectrum(spark, sf_dir):
    rows = spectra.parse_psd_spectrum(si.count_lines(spark, sf_dir, "PSDspectrum.txt"))
    return rows.select("source_file", F.col("bin_idx").cast("bigint").alias("bin_idx"), "count",
                       F.round("bin_psd", 9).alias("bin_psd"))


@query(_HIST + """
SELECT event_type || 'Tspectrum.txt' AS source_file, bin_idx, n AS count,
       round(bin_idx * (CAST(900.0 AS DOUBLE) / bins) + 100.0, 6) AS bin_time FROM b
""")
def time_spectrum(spark, sf_dir):
    rows = spectra.parse_time_spectrum(si.count_lines(spark, sf_dir, "Tspectrum.txt"), 100.0, 1000.0)
    return rows.select("source_file", F.col("bin_idx").cast("bigint").alias("bin_idx"), "count",
                       F.round("bin_time", 6).alias("bin_time"))


@query(_HIST + """
SELECT 'energy' AS kind, event_type || 'Espectrum.txt3' AS file_name, bin_idx, n AS count, CAST(bin AS DOUBLE) / 2 AS place FROM b
UNION ALL SELECT 'psd', event_type || 'PSDspectrum.txt', bin_idx, n, round(bin_idx * (CAST(1.0 AS DOUBLE) / bins), 9) FROM b
UNION ALL SELECT 'time', event_type || 'Tspectrum.txt', bin_idx, n, round(bin_idx * (CAST(1000000.0 AS DOUBLE) / bins), 6) FROM b
""")
def spectra_scan(spark, sf_dir):
    """The three kinds of spectra read from their files."""
    tables = spectra.read_spectra(spark, si.spectrum_files(spark, sf_dir))
    place = {"energy": F.col("bin_energy"), "psd": F.round("bin_psd", 9), "time": F.round("bin_time", 6)}
    return rx.union_by_name([
        table.select(F.lit(kind).alias("kind"), _file_name(), F.col("bin_idx").cast("bigint").alias("bin_idx"), "count",
                     place[kind].alias("place"))
        for kind, table in tables.items()])


# ---------------------------------------------------------------- reactor telemetry

_REACTOR = _EVENTS + """, r AS (
  SELECT 'TB-' || CAST(event_id // 4096 AS VARCHAR) AS experiment_id, event_type || ' param' AS device_param,
         user_id % 4 AS seq, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, value, k FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, device_param, seq ORDER BY event_id) - 1 AS line_no
      FROM r)
"""


@query(_REACTOR + """
SELECT experiment_id, device_param, seq, line_no, stamp, value, CASE WHEN seq % 2 = 1 THEN CAST(k AS BIGINT) END AS k,
       row_number() OVER (PARTITION BY experiment_id, device_param ORDER BY stamp, seq, line_no) - 1 AS row_idx
FROM l
""")
def reactor_merge(spark, sf_dir):
    rows = read_reactor_archives(spark, si.reactor_archives(spark, sf_dir))
    merged = rx.merge_reactor_indexed(rows)
    return merged.select(
        "experiment_id", "device_param", F.col("seq").cast("bigint").alias("seq"), "line_no",
        F.col("Timestamp").alias("stamp"),
        F.col("fields").getItem("value (µA)").try_cast("double").alias("value"),
        F.col("fields").getItem("k").try_cast("bigint").alias("k"), "row_idx")


@query(_REACTOR + """
SELECT experiment_id, device_param, event_id AS stamp, value,
       row_number() OVER (PARTITION BY experiment_id, device_param ORDER BY event_id) - 1 AS row_idx
FROM l
""")
def reactor_merge_numeric(spark, sf_dir):
    """Numbers as times: ordered by value, not as text."""
    rows = rx.merge_reactor_indexed(read_reactor_archives(spark, si.reactor_archives(spark, sf_dir, numeric=True)))
    return rows.select(
        "experiment_id", "device_param", F.col("Timestamp").cast("bigint").alias("stamp"),
        F.col("fields").getItem("value (µA)").try_cast("double").alias("value"), "row_idx")


@query(_REACTOR + """
SELECT experiment_id || '_20240101-123456789_data.tar.gz' AS archive,
       experiment_id || ' ' || device_param || ' ' || CAST(seq AS VARCHAR) || '.csv' AS member,
       TRUE AS ok, 'OK' AS reason
FROM r GROUP BY experiment_id, device_param, seq
UNION ALL SELECT DISTINCT experiment_id || '_20240101-123456789_data.tar.gz', 'notes.txt', FALSE, 'not a .csv member' FROM r
UNION ALL SELECT DISTINCT experiment_id || '_20240101-123456789_data.tar.gz', 'other.csv', FALSE, 'name without parameter and number' FROM r
""")
def reactor_report(spark, sf_dir):
    rows = reactor_members(spark, si.reactor_archives(spark, sf_dir))
    return rows.withColumn("archive", fx.base_name(F.col("archive")))


@query(_REACTOR + """
SELECT experiment_id, device_param, seq, line_no, TRUE AS ok, stamp, value,
       'says "' || replace(device_param, ' param', '') || '",' || chr(10) || CAST(event_id AS VARCHAR) AS note
FROM l WHERE seq <> 3
UNION ALL
SELECT DISTINCT experiment_id, device_param, seq, NULL, FALSE, NULL, NULL, NULL FROM l WHERE seq = 3
""")
def reactor_faults(spark, sf_dir):
    """Records of several lines, and members that fail at their last record: these give no rows but a report."""
    root = si.reactor_archives(spark, sf_dir, faulty=True)
    rows = read_reactor_archives(spark, root).select(
        "experiment_id", "device_param", F.col("seq").cast("bigint").alias("seq"), "line_no", F.lit(True).alias("ok"),
        F.col("Timestamp").alias("stamp"), F.col("fields").getItem("value (µA)").try_cast("double").alias("value"),
        F.col("fields").getItem("note").alias("note"))
    failed = reactor_members(spark, root).where("NOT ok AND member LIKE '% param %'").select(
        F.regexp_extract("member", r"^(\S+) (.+) (\d+)\.csv$", 1).alias("experiment_id"),
        F.regexp_extract("member", r"^(\S+) (.+) (\d+)\.csv$", 2).alias("device_param"),
        F.regexp_extract("member", r"^(\S+) (.+) (\d+)\.csv$", 3).cast("bigint").alias("seq"), "ok")
    return rows.unionByName(failed, allowMissingColumns=True)


@query(_EVENTS + """
SELECT event_id, event_type, CASE WHEN k < 50 THEN value END AS low_value, CASE WHEN k >= 50 THEN k END AS high_k
FROM e
""")
def union_by_name(spark, sf_dir):
    e = si.events(spark, sf_dir)
    low = e.where("k < 50").select("event_id", "event_type", F.col("value").alias("low_value"))
    high = e.where("k >= 50").select(F.col("k").alias("high_k"), "event_type", "event_id")
    return rx.union_by_name([low, high])


# ---------------------------------------------------------------- dose log, run info, device log

@query(_EVENTS + """
SELECT 'wendi_' || strftime(ts, '%Y%m%d') || '.log' AS source_file, CAST(floor(epoch(ts)) AS BIGINT) AS at_second,
       floor(value) AS value_int, 'µSv/h' AS unit_int, CAST(k AS DOUBLE) AS value_ext, 'cps' AS unit_ext,
       event_type AS status, FALSE AS dst_gap, FALSE AS dst_ambiguous
FROM e WHERE event_type <> 'error'
""")
def dose_log(spark, sf_dir):
    return _dose_columns(doselog.parse_wendi_log(si.dose_lines(spark, sf_dir), si.DOSE_ZONE, on_dst="flag"))


@query(_EVENTS + """
SELECT 'wendi_' || CAST(event_id // 4096 AS VARCHAR) || '.log' AS source_file, CAST(floor(epoch(ts)) AS BIGINT) AS at_second,
       floor(value) AS value_int, 'µSv/h' AS unit_int, CAST(k AS DOUBLE) AS value_ext, 'cps' AS unit_ext,
       event_type AS status, FALSE AS dst_gap, FALSE AS dst_ambiguous
FROM e WHERE event_type <> 'error'
""")
def dose_log_scan(spark, sf_dir):
    """Dose logs read from files in the meter's character set."""
    folder = si.text_files(si.dose_lines(spark, sf_dir, by_range=True), "dose", "cp1252")
    rows = doselog.read_wendi_log(spark, folder, si.DOSE_ZONE, on_dst="flag")
    return _dose_columns(rows.withColumn("source_file", fx.base_name(F.col("source_file"))))


_METER = _EVENTS + """, m AS (
  SELECT event_id, k, event_id // 512 AS file_no, event_id // 512 % 4 AS kind, event_id % 512 AS minute FROM e),
f AS (
  SELECT *, kind = 1 AND minute >= 120 AND minute < 180 AS gap, kind = 2 AND minute >= 60 AND minute < 120 AS twice,
         kind = 3 AND minute = 7 AS bad,
         epoch(CASE kind WHEN 1 THEN TIMESTAMP '2024-03-10' WHEN 2 THEN TIMESTAMP '2024-11-03' ELSE TIMESTAMP '2024-06-01' END)
         + 60 * minute + 3600 * CASE WHEN kind = 1 AND minute < 180 OR kind = 2 AND minute >= 120 THEN 6 ELSE 5 END AS utc
  FROM m)
"""


@query(_METER + """
SELECT 'meter_' || CAST(file_no AS VARCHAR) || '.log' AS source_file, CAST(k AS DOUBLE) AS value_int, gap AS dst_gap,
       twice AS dst_ambiguous, CASE WHEN NOT (gap OR twice) THEN CAST(utc AS BIGINT) END AS at_second
FROM f WHERE NOT bad
""")
def dose_log_dst(spark, sf_dir):
    """Wall times of a zone that changes its clock: those that never happened or happened twice are marked."""
    rows = doselog.read_wendi_log(spark, si.text_files(si.meter_lines(spark, sf_dir), "meter", "cp1252"), si.METER_ZONE, on_dst="flag")
    return rows.where(F.col("DATETIME").isNotNull()).select(
        fx.base_name(F.col("source_file")).alias("source_file"), F.col("VALUE_INT").alias("value_int"), "dst_gap", "dst_ambiguous",
        F.when(~(F.col("dst_gap") | F.col("dst_ambiguous")), F.unix_seconds("DATETIME")).alias("at_second"))


@query(_METER + """
SELECT 'meter_' || CAST(file_no AS VARCHAR) || '.log' AS source_file, count(*) AS n_rows, count_if(bad) AS n_bad_times,
       count_if(gap) AS n_gap, count_if(twice) AS n_ambiguous, NOT bool_or(gap OR twice OR bad) AS ok,
       CASE WHEN NOT bool_or(gap OR twice OR bad) THEN count(*) ELSE 0 END AS n_written,
       CASE WHEN NOT bool_or(gap OR twice OR bad) THEN CAST(sum(utc) AS BIGINT) ELSE 0 END AS seconds
FROM f GROUP BY file_no
""")
def convert_dose_faults(spark, sf_dir):
    """A folder of dose logs converted; a log with a bad, missing or doubled time fails alone."""
    folder, dest = si.text_files(si.meter_lines(spark, sf_dir), "meter", "cp1252"), scratch_path(spark, "meter-converted")
    status = convert_dose_log(spark, folder, dest, si.METER_ZONE)
    written = spark.read.parquet(dest).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.unix_seconds("DATETIME")).alias("total"))
    return status.join(written, "source_file", "left").select(
        fx.base_name(F.col("source_file")).alias("source_file"), "n_rows", "n_bad_times", "n_gap", "n_ambiguous", "ok",
        F.coalesce("n", F.lit(0)).alias("n_written"), F.coalesce("total", F.lit(0)).alias("seconds"))


def _dose_columns(rows):
    return rows.select(
        "source_file", F.unix_seconds("DATETIME").alias("at_second"), F.col("VALUE_INT").alias("value_int"),
        F.col("UNIT_INT").alias("unit_int"), F.col("VALUE_EXT").alias("value_ext"),
        F.col("UNIT_EXT").alias("unit_ext"), F.col("STATUS").alias("status"), "dst_gap", "dst_ambiguous")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS run,
  CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')
       THEN strftime(o_orderdate, '%Y%m%d') || '_TB-' || CAST(o_orderkey AS VARCHAR) END AS exp_id,
  '<Add Description>' AS descr,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN epoch_ms(o_orderdate) + 6 * 3600000 + 250 END AS start_ms,
  TRUE AS from_run_info_file,
  CASE o_orderpriority WHEN '5-LOW' THEN 'Id could not be read'
       WHEN '4-NOT SPECIFIED' THEN 'Start time could not be read' ELSE 'OK' END AS reason
FROM orders
""")
def run_info(spark, sf_dir):
    rows = metadata.parse_run_info(si.run_info_lines(spark, sf_dir))
    return rows.select(
        fx.base_name(fx.folder_of(F.col("source_file"))).alias("run"), "exp_id", F.col("desc").alias("descr"),
        F.unix_millis("exp_start").alias("start_ms"), "from_run_info_file", "reason")


@query(ORACLES["run_info"])
def run_info_scan(spark, sf_dir):
    """Run info read from its files."""
    def read(root):
        return metadata.parse_run_info(read_lines(spark, root, "run.info"))

    rows = si.read_in_rounds(si.run_info_lines(spark, sf_dir), "run-info", read)
    return rows.select(
        fx.base_name(fx.folder_of(F.col("source_file"))).alias("run"), "exp_id", F.col("desc").alias("descr"),
        F.unix_millis("exp_start").alias("start_ms"), "from_run_info_file", "reason")


@query("""
SELECT 'data/' || CAST(o_orderkey AS VARCHAR) AS folder,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL
       WHEN o_orderpriority <> '4-NOT SPECIFIED' OR o_orderstatus <> 'P'
       THEN strftime(o_orderdate, '%Y%m%d') || '_TB-' || CAST(o_orderkey AS VARCHAR) END AS exp_id,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN epoch_ms(o_orderdate) + 6 * 3600000 + 250
       WHEN o_orderstatus <> 'P' THEN epoch_ms(o_orderdate) + 5 * 3600000 END AS start_ms,
  o_orderpriority <> '4-NOT SPECIFIED' AS from_run_info_file
FROM orders
""")
def run_info_fallback(spark, sf_dir):
    """Run info, or the folder name and the typed start where the file has a single line."""
    rows = metadata.run_info(si.run_info_lines(spark, sf_dir), si.run_folders(spark, sf_dir), "Etc/GMT+5")
    return rows.select("folder", "exp_id", F.unix_millis("exp_start").alias("start_ms"), "from_run_info_file")


_DEVICES = _EVENTS + """, d AS (
  SELECT CASE WHEN k < 5 THEN NULL WHEN event_type = 'click' THEN 'eRep' WHEN event_type = 'error' THEN 'edwr'
              ELSE 'uwGen' END AS device,
         CASE event_type WHEN 'click' THEN 'curr' WHEN 'error' THEN 'g1pres' WHEN 'signup' THEN 'unlisted'
              WHEN 'view' THEN 'curr' ELSE 'volt' END AS param,
         event_id, CAST(floor(value) AS BIGINT) AS data FROM e),
n AS (SELECT *, CASE device || '/' || param WHEN 'eRep/curr' THEN 'Target Current'
              WHEN 'edwr/g1pres' THEN 'Chamber Pressure' WHEN 'uwGen/curr' THEN 'Microwave Generator Current'
              WHEN 'uwGen/volt' THEN 'Microwave Generator Voltage' END AS name
      FROM d WHERE device IS NOT NULL)
"""


@query(_DEVICES + """
SELECT device, param, name, CAST(event_id AS VARCHAR) AS reading_time, CAST(data AS VARCHAR) AS data, 'u' AS unit
FROM n
""")
def device_parameters(spark, sf_dir):
    rows = devicelog.name_parameters(si.device_log(spark, sf_dir))
    return rows.select("device", "param", "name", F.col("Time").alias("reading_time"),
                       F.col("Data").alias("data"), F.col("Unit").alias("unit"))


@query(_DEVICES.replace("event_id, CAST", "event_type, event_id, CAST") + """
SELECT event_type AS experiment_id, device, param, name, CAST(event_id AS VARCHAR) AS reading_time,
       'µ;' || CAST(data AS VARCHAR) AS data, 'u' AS unit FROM n
""")
def device_log_scan(spark, sf_dir):
    """Device logs read from files of several experiments."""
    rows = devicelog.name_parameters(devicelog.read_device_log(spark, si.device_log_files(spark, sf_dir)))
    return rows.select("experiment_id", "device", "param", "name", F.col("Time").alias("reading_time"),
                       F.col("Data").alias("data"), F.col("Unit").alias("unit"))


@query(_DEVICES + "SELECT device, param, count(*) AS n_rows FROM n GROUP BY device, param")
def device_groups(spark, sf_dir):
    return devicelog.group_parameters(si.device_log(spark, sf_dir))


# ---------------------------------------------------------------- inventory

_INVENTORY = """
WITH o AS (
  SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, 'ID-' || CAST(o_orderkey AS VARCHAR) AS id,
         CAST(epoch_ms(o_orderdate) + o_custkey AS DOUBLE) AS t FROM orders),
inv AS (
  SELECT o_orderkey, st, pr, id,
         CASE WHEN pr <> '5-LOW' THEN t ELSE -1.0 END AS unconverted_mtime,
         CASE WHEN pr <> '5-LOW' THEN 'present' ELSE 'absent' END AS unconverted_state,
         CASE WHEN st <> 'O' THEN t ELSE -1.0 END AS converted_mtime,
         CASE WHEN st <> 'O' THEN 'present' ELSE 'absent' END AS converted_state,
         CASE WHEN st = 'F' OR pr = '1-URGENT' THEN t ELSE -1.0 END AS processed_mtime,
         CASE WHEN st = 'F' OR pr = '1-URGENT' THEN 'present' ELSE 'absent' END AS processed_state,
         FALSE AS overridden
  FROM o
  WHERE pr <> '5-LOW' OR st <> 'O')
"""
_PROPS = ("unconverted_mtime, unconverted_state, converted_mtime, converted_state, "
          "processed_mtime, processed_state")
_VALID = """,
checked AS (
  SELECT id, unconverted_mtime, unconverted_state,
    CASE WHEN converted_state = 'present' AND pr NOT IN ('1-URGENT', '2-HIGH') THEN NULL ELSE converted_mtime END
      AS converted_mtime,
    CASE WHEN converted_state = 'present' AND pr NOT IN ('1-URGENT', '2-HIGH') THEN 'malformed'
      ELSE converted_state END AS converted_state,
    CASE WHEN processed_state = 'present' AND pr >= '4' THEN NULL ELSE processed_mtime END AS processed_mtime,
    CASE WHEN processed_state = 'present' AND pr >= '4' THEN 'malformed' ELSE processed_state END
      AS processed_state, overridden
  FROM inv)
"""


def _inventory(spark, sf_dir):
    return inv.build_inventory(si.listing(spark, sf_dir))


def _checked(spark, sf_dir):
    rows = inv.mark_converted(_inventory(spark, sf_dir), si.log_contents(spark, sf_dir))
    return inv.mark_processed(rows, si.processed_manifest(spark, sf_dir))


@query(_INVENTORY + f"SELECT id, {_PROPS}, overridden FROM inv")
def inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query(_INVENTORY + f"""
SELECT coalesce(inv.id, 'ID-' || CAST(orders.o_orderkey AS VARCHAR)) AS id,
       coalesce(unconverted_mtime, -1.0) AS unconverted_mtime, coalesce(unconverted_state, 'absent') AS unconverted_state,
       coalesce(converted_mtime, -1.0) AS converted_mtime, coalesce(converted_state, 'absent') AS converted_state,
       coalesce(processed_mtime, -1.0) AS processed_mtime, coalesce(processed_state, 'absent') AS processed_state,
       FALSE AS overridden
FROM orders LEFT JOIN inv ON inv.o_orderkey = orders.o_orderkey
""")
def inventory_refresh(spark, sf_dir):
    """Ids of an earlier inventory stay, absent everywhere when no folder is left."""
    earlier = si.orders(spark, sf_dir).select(
        F.concat(F.lit("ID-"), F.col("o_orderkey").cast("string")).alias("id"))
    return inv.build_inventory(si.listing(spark, sf_dir), previous=earlier)


@query(_INVENTORY + "SELECT id FROM inv WHERE unconverted_state <> 'absent' AND converted_state = 'absent'")
def inventory_to_be_converted(spark, sf_dir):
    return inv.filter_inventory(_inventory(spark, sf_dir), "to_be_converted").select("id")


@query(_INVENTORY + "SELECT id FROM inv WHERE converted_state <> 'absent' AND processed_state = 'absent'")
def inventory_to_be_processed(spark, sf_dir):
    return inv.filter_inventory(_inventory(spark, sf_dir), "to_be_processed").select("id")


_TO_ANALYZE = "unconverted_state <> 'absent' AND (converted_state = 'absent' OR processed_state = 'absent')"


@query(_INVENTORY + f"SELECT id FROM inv WHERE {_TO_ANALYZE}")
def inventory_to_be_analyzed(spark, sf_dir):
    return inv.filter_inventory(_inventory(spark, sf_dir), "to_be_analyzed").select("id")


@query(_INVENTORY + "SELECT id FROM inv WHERE regexp_matches(id, '-[13]7.*0')")
def inventory_pattern(spark, sf_dir):
    return inv.filter_pattern(_inventory(spark, sf_dir), "-[13]7.*0").select("id")


@query(_INVENTORY + _VALID + "SELECT id, converted_mtime, converted_state FROM checked")
def conversion_validity(spark, sf_dir):
    return inv.mark_converted(_inventory(spark, sf_dir), si.log_contents(spark, sf_dir)).select(
        "id", "converted_mtime", "converted_state")


@query(_INVENTORY + _VALID + "SELECT id, processed_mtime, processed_state FROM checked")
def processing_validity(spark, sf_dir):
    return inv.mark_processed(_inventory(spark, sf_dir), si.processed_manifest(spark, sf_dir)).select(
        "id", "processed_mtime", "processed_state")


@query("""
SELECT 'ID-' || CAST(s_suppkey AS VARCHAR) AS id, 'present' AS unconverted_state,
       CASE WHEN s_nationkey >= 15 THEN 'absent' WHEN s_acctbal < 0 THEN 'malformed' ELSE 'present' END AS converted_state,
       CASE WHEN s_nationkey >= 8 THEN 'absent' WHEN s_acctbal < 0 THEN 'malformed' ELSE 'present' END AS processed_state
FROM supplier
""")
def inventory_from_folders(spark, sf_dir):
    """Listing, conversion logs and manifest read from folders on storage."""
    root = si.experiment_folders(spark, sf_dir)
    rows = current_inventory(spark, f"{root}/unconverted", f"{root}/converted", f"{root}/processed")
    return rows.select("id", "unconverted_state", "converted_state", "processed_state")


@query("""
SELECT 'ID-' || CAST(s_suppkey AS VARCHAR) AS id, 'present' AS unconverted_state,
       CASE WHEN s_nationkey >= 15 THEN 'absent' ELSE 'malformed' END AS converted_state,
       CASE WHEN s_nationkey >= 8 THEN 'absent' ELSE 'malformed' END AS processed_state
FROM supplier
""")
def inventory_empty_folders(spark, sf_dir):
    """Empty experiment folders count as present; without log or result they are malformed where those are due."""
    root = si.empty_folders(spark, sf_dir)
    rows = current_inventory(spark, f"{root}/unconverted", f"{root}/converted", f"{root}/processed")
    return rows.select("id", "unconverted_state", "converted_state", "processed_state")


_OVERRIDES = """,
ov AS (
  SELECT n_nationkey AS seq, 'ID-' || CAST(n_nationkey AS VARCHAR) || '[0-9][0-9]' AS pattern,
         CASE WHEN n_regionkey < 2 THEN n_nationkey * 100.0 END AS con, n_regionkey = 4 AS bad FROM nation),
hit AS (
  SELECT id, min(seq) AS seq FROM checked JOIN ov ON regexp_matches(id, pattern) GROUP BY id),
final AS (
  SELECT c.id,
    CASE WHEN h.seq IS NULL THEN unconverted_mtime ELSE 0.0 END AS unconverted_mtime,
    CASE WHEN h.seq IS NULL THEN unconverted_state ELSE 'present' END AS unconverted_state,
    CASE WHEN h.seq IS NULL THEN converted_mtime ELSE coalesce(CAST(ov.con AS DOUBLE), -1.0) END AS converted_mtime,
    CASE WHEN h.seq IS NULL THEN converted_state WHEN ov.con IS NULL THEN 'absent' ELSE 'present' END AS converted_state,
    CASE WHEN h.seq IS NULL THEN processed_mtime WHEN ov.bad THEN NULL ELSE -1.0 END AS processed_mtime,
    CASE WHEN h.seq IS NULL THEN processed_state WHEN ov.bad THEN 'malformed' ELSE 'absent' END AS processed_state,
    h.seq IS NOT NULL AS overridden
  FROM checked c LEFT JOIN hit h ON h.id = c.id LEFT JOIN ov ON ov.seq = h.seq)
"""


def _final(spark, sf_dir):
    return ovr.apply_overrides(_checked(spark, sf_dir), si.overrides(spark, sf_dir))


@query(_INVENTORY + _VALID + _OVERRIDES + f"SELECT id, {_PROPS}, overridden FROM final")
def inventory_overrides(spark, sf_dir):
    return _final(spark, sf_dir)


@query(_INVENTORY + _VALID + _OVERRIDES.replace("FROM nation)", "FROM nation WHERE n_nationkey <> 12)")
       + f"SELECT id, {_PROPS}, overridden FROM final")
def override_remove(spark, sf_dir):
    """Without one pattern, the ids only it matched show their own properties again."""
    rest = ovr.remove_override(si.overrides(spark, sf_dir), "ID-12[0-9][0-9]")
    return ovr.apply_overrides(_checked(spark, sf_dir), rest)


_SYNC = """
WITH kept AS (
  SELECT CAST(s_suppkey AS BIGINT) AS seq, 'S-' || CAST(s_suppkey AS VARCHAR) AS pattern, 1.0 AS unc
  FROM supplier WHERE s_acctbal < 0),
edge AS (
  SELECT (SELECT max(s_suppkey) FROM supplier) + 1 AS after,
         least((SELECT min(s_suppkey) FROM supplier WHERE s_acctbal < 0),
               (SELECT min(c_custkey) + 10000000 FROM customer)) AS first)
SELECT seq, pattern, CAST(unc AS DOUBLE) AS unconverted_mtime, 'present' AS unconverted_state,
       CAST(-1.0 AS DOUBLE) AS converted_mtime, 'absent' AS converted_state, CAST(5.0 AS DOUBLE) AS processed_mtime,
       'present' AS processed_state
FROM (SELECT * FROM kept UNION ALL
      SELECT after + c_custkey + 10000000 - first, 'C-' || CAST(c_custkey AS VARCHAR), 2.0 FROM customer, edge)
"""


@query(_SYNC)
def override_sync(spark, sf_dir):
    return ovr.sync_overrides(si.supplier_overrides(spark, sf_dir, False),
                              si.supplier_overrides(spark, sf_dir, True))


@query("SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS pattern FROM supplier WHERE NOT s_acctbal < 0")
def override_dropped(spark, sf_dir):
    return ovr.dropped_patterns(si.supplier_overrides(spark, sf_dir, False),
                                si.supplier_overrides(spark, sf_dir, True))


@query("""
SELECT CAST(min(rank) AS BIGINT) AS seq, 'ID-' || CAST(l_orderkey AS VARCHAR) AS pattern,
  coalesce(arg_max(l_quantity, rank) FILTER (l_returnflag <> 'N'), -1.0) AS unconverted_mtime,
  CASE WHEN count(*) FILTER (l_returnflag <> 'N') > 0 THEN 'present' ELSE 'absent' END AS unconverted_state,
  coalesce(arg_max(l_extendedprice, rank) FILTER (l_linestatus = 'F'), -1.0) AS converted_mtime,
  CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN 'present' ELSE 'absent' END AS converted_state,
  CASE WHEN arg_max(l_returnflag, rank) FILTER (l_returnflag <> 'N') = 'A' THEN NULL
    ELSE CAST(-1.0 AS DOUBLE) END AS processed_mtime,
  CASE WHEN arg_max(l_returnflag, rank) FILTER (l_returnflag <> 'N') = 'A' THEN 'malformed' ELSE 'absent' END
    AS processed_state
FROM (SELECT *, l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey AS rank FROM lineitem)
GROUP BY l_orderkey
""")
def override_patch(spark, sf_dir):
    """Latest given value of each property over all patches of a pattern."""
    return ovr.merge_props(si.patches(spark, sf_dir))


@query(_INVENTORY + """
SELECT id FROM inv WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def select_experiments(spark, sf_dir):
    chosen = si.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("ID-"), F.col("l_orderkey").cast("string")).alias("id"))
    return ovr.select_experiments(_inventory(spark, sf_dir), chosen).select("id")


@query(_INVENTORY + """
SELECT id FROM inv WHERE EXISTS (
  SELECT 1 FROM nation WHERE contains(inv.id, 'ID-' || CAST(n_nationkey + 30 AS VARCHAR)))
""")
def select_experiments_pattern(spark, sf_dir):
    """Substring selection: ID-31 also selects ID-310."""
    chosen = si.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("ID-"), (F.col("n_nationkey") + 30).cast("string")).alias("id"))
    return ovr.select_experiments(_inventory(spark, sf_dir), chosen, as_pattern=True).select("id")


_PLAN = _INVENTORY + _VALID + f", cand AS (SELECT * FROM checked WHERE {_TO_ANALYZE})"


def _plan_sql(force: bool, where: str = "TRUE") -> str:
    forced = ", CASE WHEN TRUE THEN '{0} is forced' END" if force else ""
    any_way = "TRUE OR " if force else ""
    return _PLAN + f"""
SELECT id, {any_way} converted_state = 'absent' AS run_convert,
  {any_way} (converted_state <> 'absent' AND processed_state = 'absent') AS run_process,
  concat_ws('; ', CASE WHEN converted_state <> 'absent' THEN 'converted files already exist' END
    {forced.format('conversion')}) AS convert_reasons,
  concat_ws('; ', CASE WHEN converted_state = 'absent' THEN 'converted files do not exist' END,
    CASE WHEN processed_state <> 'absent' THEN 'processed files already exist' END
    {forced.format('processing')}) AS process_reasons
FROM cand WHERE {where}
"""


def _joined_reasons(plan: DataFrame) -> DataFrame:
    return plan.select(
        "id", "run_convert", "run_process", F.array_join("convert_reasons", "; ").alias("convert_reasons"),
        F.array_join("process_reasons", "; ").alias("process_reasons"))


@query(_plan_sql(False))
def analysis_plan(spark, sf_dir):
    return _joined_reasons(plan_analyses(_checked(spark, sf_dir)))


@query(_plan_sql(True, "regexp_matches(id, 'ID-.*7$')"))
def analysis_plan_force(spark, sf_dir):
    return _joined_reasons(plan_analyses(_checked(spark, sf_dir), force=True, pattern="ID-.*7$"))


@query(_PLAN + "SELECT id, processed_state = 'absent' AS run_process FROM cand")
def analysis_plan_processing(spark, sf_dir):
    """Second decision, on an inventory in which every planned conversion has been done."""
    checked = _checked(spark, sf_dir)
    plan = plan_analyses(checked)
    converted = checked.withColumn("converted_state", F.lit("present"))
    return plan_processing(plan, converted).select("id", "run_process")


@query(_INVENTORY + "SELECT id, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS position FROM inv")
def inventory_by_id(spark, sf_dir):
    return inv.ranked_inventory(_inventory(spark, sf_dir), "id").select("id", "position")


@query(_INVENTORY + _VALID + """
SELECT id, row_number() OVER (ORDER BY converted_mtime DESC NULLS LAST, id) - 1 AS position FROM checked
""")
def inventory_by_mtime(spark, sf_dir):
    return inv.ranked_inventory(_checked(spark, sf_dir), "converted").select("id", "position")


@query(_INVENTORY + _VALID + """
SELECT id, row_number() OVER (ORDER BY processed_mtime ASC NULLS FIRST, id DESC) - 1 AS position FROM checked
""")
def inventory_by_mtime_reverse(spark, sf_dir):
    return inv.ranked_inventory(_checked(spark, sf_dir), "processed", reverse=True).select("id", "position")


def _label_sql(stage):
    state = f"{stage}_state"
    return f"""
  CASE {state} WHEN 'malformed' THEN 'Malformed' WHEN 'absent' THEN 'Not found' ELSE 'Found' END AS {stage}_label,
  CASE WHEN {state} = 'present' THEN CAST({stage}_mtime AS BIGINT) END AS {stage}_ms,
  CASE WHEN overridden THEN 'overridden' WHEN {state} = 'malformed' THEN 'malformed'
       WHEN {state} = 'absent' THEN 'not_found' ELSE 'found' END AS {stage}_class"""


@query(_INVENTORY + _VALID + _OVERRIDES + "SELECT id, "
       + ", ".join(_label_sql(s) for s in ("unconverted", "converted", "processed")) + " FROM final")
def status_label(spark, sf_dir):
    rows = inv.status_label(_final(spark, sf_dir))
    for stage in ("unconverted", "converted", "processed"):
        rows = rows.withColumn(f"{stage}_ms", F.unix_millis(f"{stage}_time")).drop(f"{stage}_time")
    return rows


@query("""
SELECT 'exp-' || CAST(o_orderkey AS VARCHAR) AS root,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority < '3' THEN 'dose_meter' ELSE 'unsupported' END
       WHEN o_orderpriority = '1-URGENT' THEN 'listmode_bin'
       WHEN o_orderpriority = '2-HIGH' THEN 'listmode_csv_single'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'listmode_csv_dual' ELSE 'unsupported' END AS source_class
FROM orders
""")
def source_classes(spark, sf_dir):
    return inv.classify_sources(si.source_manifest(spark, sf_dir))


_SOURCES = """
WITH s AS (
  SELECT s_suppkey AS key, s_nationkey AS nation, s_acctbal < 0 AS in_debt,
         CASE WHEN s_nationkey % 5 = 3 THEN 'day-' ELSE 'TB-' END || CAST(s_suppkey AS VARCHAR) AS id,
         CASE s_nationkey % 5 WHEN 0 THEN 'listmode_bin' WHEN 1 THEN 'listmode_csv_single'
              WHEN 2 THEN 'listmode_csv_dual' WHEN 3 THEN 'dose_meter' ELSE 'unsupported' END AS source_class
  FROM supplier)
"""


def _source_id(path):
    return F.regexp_replace(fx.base_name(F.col(path)), r"\.log$", "").alias("id")


@query(_SOURCES + """
SELECT id, source_class, CASE WHEN source_class = 'dose_meter' THEN id || '.log'
       WHEN source_class <> 'unsupported' THEN id END AS root_name FROM s
""")
def classify_from_folders(spark, sf_dir):
    """Sources found, rooted and classified on storage."""
    found = classified_sources(sources_in(spark, f"{si.source_folders(spark, sf_dir)}/in"))
    return found.select(_source_id("source"), "source_class", fx.base_name(F.col("root")).alias("root_name"))


@query(_SOURCES + """
SELECT id, source_class,
  CASE source_class WHEN 'listmode_bin' THEN 4 WHEN 'dose_meter' THEN 3 WHEN 'unsupported' THEN 0 ELSE 2 END AS n_rows,
  CAST(CASE source_class WHEN 'listmode_bin' THEN nation + key % 100 + 8 WHEN 'dose_meter' THEN 3 * nation
       WHEN 'unsupported' THEN 0 ELSE nation + key % 100 END AS DOUBLE) AS total,
  CASE WHEN source_class = 'listmode_csv_dual' THEN 'ch0,ch1' ELSE '' END AS channels,
  CASE WHEN source_class NOT IN ('dose_meter', 'unsupported') THEN '20230105_' || id END AS exp_id,
  CASE WHEN source_class = 'unsupported' THEN 'absent' WHEN source_class = 'listmode_bin' AND in_debt THEN 'malformed'
       ELSE 'present' END AS converted_state
FROM s
""")
def conversion_from_storage(spark, sf_dir):
    """A folder of sources converted in one go: what the tables, the metadata and the inventory then say of each."""
    root, out = si.source_folders(spark, sf_dir), scratch_path(spark, "converted")
    convert_folder(spark, f"{root}/in", f"{out}/data", fresh=True, log_root=f"{out}/logs")
    return _converted_facts(spark, root, out)


@query(ORACLES["conversion_from_storage"])
def continuous_conversion_inventory(spark, sf_dir):
    """The same from a stream of landing files: each experiment is converted when it is complete, and once."""
    root, out = si.source_folders(spark, sf_dir), scratch_path(spark, "converted")
    running = continuous_experiments(
        spark, f"{root}/in", f"{out}/data", f"{out}/logs", f"{out}/checkpoint", files_per_trigger=400)
    running.trigger(availableNow=True).start().awaitTermination()
    return _converted_facts(spark, root, out)


@query(_SOURCES + """
SELECT id, source_class = 'unsupported' OR key % 2 = 1 AS run_convert,
  CASE WHEN source_class = 'unsupported' THEN 'absent' WHEN source_class = 'listmode_bin' AND in_debt THEN 'malformed'
       ELSE 'present' END AS converted_state,
  source_class <> 'unsupported' AS run_process
FROM s WHERE source_class <> 'dose_meter'
""")
def analyses_planned_and_converted(spark, sf_dir):
    """Experiments planned from the inventory and converted together: the even ones, then what is left to do."""
    root, out = si.source_folders(spark, sf_dir), scratch_path(spark, "planned")

    def now():
        return current_inventory(spark, f"{root}/in", f"{out}/logs", f"{root}/processed")

    write_whole(f"{out}/logs/.keep", b"")
    plan = None
    for pattern in ("[02468]$", None):
        plan = materialize(plan_analyses(now(), pattern=pattern), "plan")
        convert_planned(spark, plan, f"{root}/in", f"{out}/data", fresh=True, log_root=f"{out}/logs")
    after = now()
    return (
        plan.select("id", "run_convert").join(after.select("id", "converted_state"), "id")
        .join(plan_processing(plan, after).select("id", "run_process"), "id"))


def _converted_facts(spark, root, out):
    classified = classified_sources(sources_in(spark, f"{root}/in"))
    events = sinks.read_listmode_table(spark, f"{out}/data/listmode").select(
        F.col("experiment_id").alias("id"), F.col("ENERGY").cast("double").alias("amount"), "file_channel")
    doses = spark.read.parquet(f"{out}/data/wendi").select(
        _source_id("source_file"), F.col("VALUE_INT").alias("amount"), F.lit(None).cast("string").alias("file_channel"))
    facts = events.unionByName(doses).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("sum"),
        F.array_join(F.array_sort(F.collect_set("file_channel")), ",").alias("folders"))
    known = sinks.read_experiments(spark, f"{out}/data/experiments").select(
        "exp_id", F.split_part("exp_id", F.lit("_"), F.lit(2)).alias("id"))
    states = current_inventory(spark, f"{root}/in", f"{out}/logs", f"{root}/processed").select("id", "converted_state")
    return (
        classified.select(_source_id("source"), "source_class").join(facts, "id", "left").join(known, "id", "left")
        .join(states, "id", "left")
        .select("id", "source_class", F.coalesce("n", F.lit(0)).alias("n_rows"),
                F.coalesce("sum", F.lit(0.0)).alias("total"), F.coalesce("folders", F.lit("")).alias("channels"),
                "exp_id", "converted_state"))


@query("""
WITH f AS (SELECT l_suppkey, l_returnflag,
  CASE WHEN l_returnflag = 'R' THEN 'Data_CH1_' ELSE 'SData_' END || lpad(CAST(l_orderkey AS VARCHAR), 12, '0')
  || '_' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linestatus = 'F' THEN '.csv' ELSE '.CSV' END AS name
  FROM lineitem)
SELECT 'data/' || CAST(l_suppkey AS VARCHAR) || '/' || name AS path
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY name) AS r FROM f)
WHERE r <= 300 AND l_returnflag <> 'R'
""")
def file_limit(spark, sf_dir):
    """The limit counts every file of the extension; the prefix is looked at afterwards."""
    return inv.limit_files(si.file_manifest(spark, sf_dir), ".csv", 300, prefix="SData")


@query("""
SELECT count(*) AS n_files, count(*) FILTER (o_orderstatus <> 'F') AS n_good,
       count(*) FILTER (o_orderstatus = 'F') AS n_bad FROM orders
""")
def conversion_summary(spark, sf_dir):
    return lm.conversion_summary(si.file_status(spark, sf_dir))


@query("""
SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS source_file, o_orderpriority AS reason FROM orders
WHERE o_orderstatus = 'F'
""")
def failing_files(spark, sf_dir):
    return lm.failing_files(si.file_status(spark, sf_dir))


@query("""
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 'TB-' || o_orderpriority WHEN o_orderstatus = 'O'
       THEN 'ID-' || CAST(o_orderkey AS VARCHAR) ELSE 'xTB-1' END AS prefixed,
  CASE WHEN o_orderstatus = 'F' THEN 'parent' ELSE 'leaf' END AS source_id
FROM orders
""")
def experiment_ids(spark, sf_dir):
    """Id prefixing and the id a source path stands for."""
    name = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("ID-"), F.col("o_orderkey").cast("string"))).otherwise(
        F.lit("xTB-1"))
    is_file = F.col("o_orderstatus") == "F"
    return si.orders(spark, sf_dir).select(
        "o_orderkey", fx.prefixed_id(name).alias("prefixed"),
        fx.experiment_id_from_source(F.lit("/a/parent/leaf"), is_file).alias("source_id"))


# ---------------------------------------------------------------- logs

_LOGS = _EVENTS + """, r AS (
  SELECT CAST(event_id AS VARCHAR) AS timestamp,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'DEBUG'
      WHEN 'view' THEN 'CRITICAL' ELSE 'INFO' END AS level, '*' AS icon,
    CAST(CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 10
      WHEN 'view' THEN 50 ELSE 20 END AS DOUBLE) AS level_no,
    'event ' || CAST(event_id AS VARCHAR) AS message, user_id
  FROM e WHERE k >= 5 AND k <> 7)
"""
_LOG_COLUMNS = "timestamp, level, icon, level_no, message"


@query(_LOGS + f"SELECT {_LOG_COLUMNS} FROM r")
def log_projection(spark, sf_dir):
    return logs.project_logs(logs.parse_logs(si.log_lines(spark, sf_dir)))


@query(_LOGS + f"SELECT {_LOG_COLUMNS} FROM r WHERE level_no >= 30")
def log_min_level(spark, sf_dir):
    return logs.at_least(logs.project_logs(logs.parse_logs(si.log_lines(spark, sf_dir))), "WARNING")


@query(_LOGS + f"SELECT {_LOG_COLUMNS} FROM r WHERE user_id NOT IN (1, 2)")
def log_noise(spark, sf_dir):
    return logs.project_logs(logs.drop_noise(logs.parse_logs(si.log_lines(spark, sf_dir))))


@query(_LOGS + f"SELECT {_LOG_COLUMNS} FROM r WHERE user_id NOT IN (1, 2) AND level_no >= 20")
def log_tail(spark, sf_dir):
    """The stream over log files that have landed, run until it has caught up."""
    folder, out = scratch_path(spark, "logs"), scratch_path(spark, "log-tail")
    si.log_lines(spark, sf_dir).write.text(folder)
    stream = log_stream(spark, folder, "INFO")
    running = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True).start(out))
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(_LOGS + f"SELECT {_LOG_COLUMNS} FROM r WHERE user_id NOT IN (1, 2) AND level_no >= 20")
def log_tail_growing(spark, sf_dir):
    """The stream over files that grow between its runs; they are cut within a line at first."""
    folder, out = scratch_path(spark, "growing-logs"), scratch_path(spark, "log-tail")
    for share in (0.37, 0.81, 1.0):
        si.grow_logs(spark, sf_dir, folder, share)
        stream = log_stream(spark, folder, "INFO", glob="*.log")
        (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
         .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


@query(_BIN_ROWS + _BIN_SELECT)
def continuous_conversion_run(spark, sf_dir):
    """Binary files converted as they land, sixteen files a batch."""
    folder, out = si.event_bin_files(spark, sf_dir), scratch_path(spark, "converted")
    running = continuous_conversion(
        spark, folder, out, f"{out}-checkpoint", files_per_trigger=16
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    return _bin_columns(converted_so_far(spark, out))


# ---------------------------------------------------------------- sinks

@query(_BIN_ROWS + _BIN_SELECT)
def sink_listmode(spark, sf_dir):
    """Written twice with the fresh option: the second run replaces the first."""
    dest = scratch_path(spark, "listmode")
    rows = lb.read_listmode(spark, si.event_bin_files(spark, sf_dir))
    sinks.write_listmode(rows, dest, records_per_file=2000)
    sinks.write_listmode(rows, dest, fresh=True)
    return _bin_columns(sinks.read_listmode_table(spark, dest))


@query(_REACTOR + """
SELECT experiment_id, device_param, seq, line_no, stamp, value FROM l
""")
def sink_reactor(spark, sf_dir):
    dest = scratch_path(spark, "reactor-table")
    sinks.write_reactor(read_reactor_archives(spark, si.reactor_archives(spark, sf_dir)), dest)
    return spark.read.parquet(dest).select(
        "experiment_id", "device_param", F.col("seq").cast("bigint").alias("seq"), "line_no",
        F.col("Timestamp").alias("stamp"),
        F.col("fields").getItem("value (µA)").try_cast("double").alias("value"))


@query(_HIST + """
SELECT kind, event_type || suffix AS source_file, bin_idx, n AS count
FROM b CROSS JOIN (VALUES ('energy', 'Espectrum.txt3'), ('psd', 'PSDspectrum.txt'), ('time', 'Tspectrum.txt')) AS t(kind, suffix)
""")
def sink_spectra(spark, sf_dir):
    """All three kinds, written twice with the fresh option: the second run replaces the first."""
    dest = scratch_path(spark, "spectra")
    tables = {
        "energy": spectra.parse_energy_spectrum(si.energy_lines(spark, sf_dir)),
        "psd": spectra.parse_psd_spectrum(si.count_lines(spark, sf_dir, "PSDspectrum.txt")),
        "time": spectra.parse_time_spectrum(si.count_lines(spark, sf_dir, "Tspectrum.txt"))}
    for _ in range(2):
        sinks.write_spectra(tables, dest, fresh=True)
    return rx.union_by_name([
        spark.read.parquet(f"{dest}/{kind}_spectrum").select(
            F.lit(kind).alias("kind"), "source_file", F.col("bin_idx").cast("bigint").alias("bin_idx"), "count")
        for kind in tables])


@query(_CSV_ROWS)
def convert_folders_csv(spark, sf_dir):
    """Experiment roots converted one by one into one destination; stray, deeper and raw files are left out."""
    root, dest = si.experiment_csv_folders(spark, sf_dir), scratch_path(spark, "converted")
    kinds = sorted(r[0] for r in si.events(spark, sf_dir).select("event_type").distinct().collect())  # a few types
    for kind in kinds:
        convert_listmode_csv(spark, f"{root}/{kind}/UNFILTERED", f"{dest}/listmode", True, CSV_CLASSES["listmode_csv_single"])
    return _csv_columns(sinks.read_listmode_table(spark, f"{dest}/listmode"))


@query(_EVENTS + """
SELECT CAST(floor(epoch(ts)) AS BIGINT) AS at_second, floor(value) AS value_int, 'µSv/h' AS unit_int,
       CAST(k AS DOUBLE) AS value_ext, 'cps' AS unit_ext, event_type AS status
FROM e WHERE event_type <> 'error'
""")
def sink_dose_log(spark, sf_dir):
    dest = scratch_path(spark, "wendi")
    sinks.write_wendi(doselog.parse_wendi_log(si.dose_lines(spark, sf_dir), si.DOSE_ZONE), dest)
    return spark.read.parquet(dest).select(
        F.unix_seconds("DATETIME").alias("at_second"), F.col("VALUE_INT").alias("value_int"),
        F.col("UNIT_INT").alias("unit_int"), F.col("VALUE_EXT").alias("value_ext"),
        F.col("UNIT_EXT").alias("unit_ext"), F.col("STATUS").alias("status"))


@query("""
SELECT strftime(o_orderdate, '%Y%m%d') || '_TB-' || CAST(o_orderkey AS VARCHAR) AS exp_id,
       epoch_ms(o_orderdate) + 6 * 3600000 + 250 AS start_ms
FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')
""")
def sink_experiments(spark, sf_dir):
    """Written twice: the rows of the second run replace those of the first."""
    dest = scratch_path(spark, "experiments")
    rows = metadata.parse_run_info(si.run_info_lines(spark, sf_dir)).where("reason = 'OK'")
    for _ in range(2):
        sinks.write_experiments(rows, dest)
    return sinks.read_experiments(spark, dest).select("exp_id", F.unix_millis("exp_start").alias("start_ms"))


@query(_DEVICES + """
SELECT name, CAST(event_id AS VARCHAR) AS reading_time, CAST(data AS VARCHAR) AS data, 'u' AS unit
FROM n WHERE name IS NOT NULL
""")
def sink_parameter_csv(spark, sf_dir):
    dest = scratch_path(spark, "parameters")
    sinks.write_parameter_csv(si.device_log(spark, sf_dir), dest, strict=False)
    rows = spark.read.schema("Time STRING, Data STRING, Unit STRING, name STRING").csv(dest, header=True)
    return rows.select("name", F.col("Time").alias("reading_time"), F.col("Data").alias("data"),
                       F.col("Unit").alias("unit"))


@query(_SYNC)
def sink_overrides(spark, sf_dir):
    """Stored, edited and stored again: loading gives the newest version."""
    root = scratch_path(spark, "overrides")
    save_overrides(si.supplier_overrides(spark, sf_dir, False), root)
    save_overrides(ovr.sync_overrides(load_overrides(spark, root), si.supplier_overrides(spark, sf_dir, True)), root)
    return load_overrides(spark, root)
