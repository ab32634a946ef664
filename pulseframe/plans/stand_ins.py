"""Detector-shaped inputs derived from the analytic test tables, for the registered queries.

Everything is a DataFrame over the given tables; the files some queries read back are written by tasks,
each from a bounded range of ids.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import scratch_path, ship_package, side_by_side
from pulseframe.sources.files import (
    list_children, remove_files_in, remove_folders, resolve, roots, write_files, write_whole,
)

RECORDS_PER_FILE = 4096
VECTORS_PER_FILE = 100
#: Small files with folders of their own in a round, 8 KB of blocks each on a usual disk, and rounds under way at a time.
#: Files that are removed within seconds are never written to the disk; removing ones that were takes longer than all else.
FILES_PER_ROUND = 10_000
ROUNDS_AT_ONCE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k``, the number in their JSON properties, and epoch microseconds."""
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key, in a fixed number of tasks: few bytes can name many files, and Spark would join them to one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def text_time(moment: Column, fmt: str) -> Column:
    return F.date_format(moment, fmt)


def _encode(frame: pd.DataFrame, header: int) -> bytes:
    """Records in frame order; with waveforms when there is a ``samples`` column."""
    fields = [("BOARD", "<u2"), ("CHANNEL", "<u2"), ("TIMESTAMP", "<u8"), ("ENERGY", "<i2"),
              ("CALIB_ENERGY", "<f8"), ("ENERGYSHORT", "<i2"), ("FLAGS", "<u4")]
    wave = "samples" in frame.columns
    if wave:
        fields += [("WAVEFORM_CODE", "u1"), ("n", "<u4")]
    records = np.zeros(len(frame), np.dtype(fields))
    for name in frame.columns:
        if name in records.dtype.names:
            records[name] = frame[name].to_numpy()
    out = io.BytesIO()
    out.write((0xCAE0 | header).to_bytes(2, "little"))
    if not wave:
        out.write(records.tobytes())
        return out.getvalue()
    for record, samples in zip(records, frame["samples"]):
        record["n"] = len(samples)
        out.write(record.tobytes())
        out.write(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def _write_bin(records: DataFrame, header: int, label: str, time_offset: int = 0) -> str:
    """One binary file per ``file_no`` (a bounded id range), records in ``raw_idx`` order."""
    spark = records.sparkSession
    ship_package(spark)
    root = scratch_path(spark, label)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("raw_idx")
        ordered["TIMESTAMP"] = ordered["TIMESTAMP"].astype("uint64") + np.uint64(time_offset)
        number = int(ordered["file_no"].iloc[0])
        write_whole(f"{root}/run-{number // 8}/UNFILTERED/SData_{number}.bin", _encode(ordered, header))
        return pd.DataFrame({"n": [len(ordered)]})

    records.groupBy("file_no").applyInPandas(write, "n BIGINT").write.format("noop").mode("overwrite").save()
    return root


def event_bin_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of binary files without waveforms; all optional fields, time stamps above 2^63."""
    records = events(spark, sf_dir).select(
        F.floor(F.col("event_id") / RECORDS_PER_FILE).alias("file_no"),
        F.col("event_id").alias("raw_idx"),
        (F.lit(256) + F.col("user_id") % 7).cast("int").alias("BOARD"),
        (F.col("user_id") % 4).cast("int").alias("CHANNEL"),
        F.col("event_id").alias("TIMESTAMP"),
        F.floor("value").cast("int").alias("ENERGY"),
        F.col("value").alias("CALIB_ENERGY"),
        F.col("k").alias("ENERGYSHORT"),
        (F.lit(1 << 31) + F.col("event_id") % 1000).alias("FLAGS"),
    )
    return _write_bin(records, 7, "events-bin", 1 << 63)


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms of int16 samples; vectors of label 7 keep their first 8 samples only."""
    vectors = table(spark, sf_dir, "embeddings")
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("smallint"))
    return vectors.select(
        F.floor(F.col("vec_id") / VECTORS_PER_FILE).alias("file_no"),
        F.col("vec_id").alias("raw_idx"),
        "label",
        samples.alias("samples"),
        F.when(F.col("label") == 7, F.slice(samples, 1, 8)).otherwise(samples).alias("cut_samples"),
    )


def waveform_bin_files(spark: SparkSession, sf_dir: str, cut: bool = False) -> str:
    """Folder of binary files with waveforms, of one length or (``cut``) of two."""
    records = waveforms(spark, sf_dir).select(
        "file_no", "raw_idx", F.col("label").alias("CHANNEL"), F.col("raw_idx").alias("TIMESTAMP"),
        F.col(("cut_" if cut else "") + "samples").alias("samples"),
        F.lit(0).alias("ENERGY"), F.lit(0.0).alias("CALIB_ENERGY"), F.lit(0).alias("ENERGYSHORT"),
    )
    return _write_bin(records, 15, "waves-bin")


CSV_HEADER = "BOARD;CHANNEL;TIMETAG;ENERGY;ENERGYSHORT;FLAGS"


def _with_header_file(data: DataFrame, header: str, first: str) -> DataFrame:
    """Data lines plus the unnumbered header file of every folder."""
    folders = data.select(F.regexp_replace("source_file", "/[^/]*$", "").alias("folder")).distinct()
    two = folders.select(
        F.concat("folder", F.lit("/SData.csv")).alias("source_file"),
        F.posexplode(F.array(F.lit(header), F.lit(first))).alias("line_no", "value"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    return data.unionByName(two)


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited list-mode lines: NA for k = 50, one field short for k < 10, one too many for k > 90."""
    e = events(spark, sf_dir)
    energy = F.when(F.col("k") == 50, F.lit("NA")).otherwise(F.floor("value").cast("string"))
    full = F.concat_ws(
        ";", F.lit("0"), (F.col("user_id") % 4).cast("string"), F.col("event_id").cast("string"), energy,
        F.col("k").cast("string"))
    value = (
        F.when(F.col("k") < 10, full)
        .when(F.col("k") > 90, F.concat(full, F.lit(";0x4000;surplus")))
        .otherwise(F.concat(full, F.lit(";0x4000")))
    )
    data = e.select(
        F.concat(F.col("event_type"), F.lit("/UNFILTERED/SData_"),
                 F.floor(F.col("event_id") / RECORDS_PER_FILE).cast("string"), F.lit(".csv"))
        .alias("source_file"),
        F.col("event_id").alias("line_no"), value.alias("value"))
    return _with_header_file(data, CSV_HEADER, "0;0;0;1;1;0x0")


def text_files(lines: DataFrame, label: str, encoding: str = "utf-8", root: str | None = None,
               by: str = "source_file") -> str:
    """Folder with ``lines(source_file, line_no, value)`` as files; those of a value of ``by`` are written by one task."""
    spark = lines.sparkSession
    ship_package(spark)
    root = root or scratch_path(spark, label)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        for name, ordered in frame.sort_values("line_no").groupby("source_file"):
            write_whole(f"{root}/{name}", ("\n".join(ordered["value"]) + "\n").encode(encoding))
        return pd.DataFrame({"n": [len(frame)]})

    lines.groupBy(by).applyInPandas(write, "n BIGINT").write.format("noop").mode("overwrite").save()
    return root


def _write_parts(lines: DataFrame, root: str) -> None:
    """``lines(source_file, line_no, value, part)`` as files below the folder of their part, those of a part by one task."""
    def write(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame.sort_values("line_no").groupby("source_file")["value"]
        files = {name: ("\n".join(values) + "\n").encode() for name, values in texts}
        write_files(f"{root}/{frame['part'].iloc[0]}", files)
        return pd.DataFrame({"n": [len(frame)]})

    ship_package(lines.sparkSession)
    dealt(lines, "part").groupBy("part").applyInPandas(write, "n BIGINT").write.format("noop").mode("overwrite").save()


def read_in_rounds(lines: DataFrame, label: str, read: Callable[[str], DataFrame],
                   files_per_round: int = FILES_PER_ROUND) -> DataFrame:
    """The rows that ``read(root)`` makes of all files of ``lines``, some rounds of about ``files_per_round`` on disk at a time.

    A round writes its files, dealt to some folders below ``root`` that tasks can list and empty side by side, keeps the rows
    read from them as a table and removes the files. What folders they leave are used by the next round at that root. A few
    rounds are under way at a time, each at its own root, so that one's planning does not leave the cores idle.
    """
    spark = lines.sparkSession
    parts = 4 * spark.sparkContext.defaultParallelism
    rounds = max(1, -(-lines.select("source_file").distinct().count() // files_per_round))
    shares = lines.where(F.col("source_file").isNotNull()).select(
        "source_file", "line_no", "value", F.pmod(F.xxhash64("source_file"), F.lit(rounds)).alias("round"),
        F.pmod(F.hash("source_file"), F.lit(parts)).alias("part"))
    written, rows = scratch_path(spark, f"{label}-lines"), scratch_path(spark, f"{label}-rows")
    shares.repartition(rounds, "round").write.partitionBy("round").parquet(written)
    shares = spark.read.schema(shares.schema).parquet(written)
    at_once = min(rounds, ROUNDS_AT_ONCE)

    def some(first: int):
        root = scratch_path(spark, label)
        system, inner = resolve(root)
        system.create_dir(inner, recursive=True)
        for number in range(first, rounds, at_once):
            _write_parts(shares.where(F.col("round") == number), root)
            found = read(root)
            found.write.parquet(f"{rows}/{number}")
            used = list_children(roots(spark, root)).where("is_dir").repartition(parts)
            (remove_files_in if number + at_once < rounds else remove_folders)(used)
        system.delete_dir(inner)
        return found.schema

    schema = side_by_side(spark, [partial(some, first) for first in range(at_once)], at_once)[0]
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(rows)


def csv_files(spark: SparkSession, sf_dir: str) -> str:
    """``csv_lines`` as files, each a bounded id range."""
    return text_files(csv_lines(spark, sf_dir), "events-csv")


def spectrum_files(spark: SparkSession, sf_dir: str) -> str:
    """The three spectra of each event type as files; a line a distinct whole value."""
    root = text_files(energy_lines(spark, sf_dir), "spectra")
    for suffix in ("PSDspectrum.txt", "Tspectrum.txt"):
        text_files(count_lines(spark, sf_dir, suffix), "spectra", root=root)
    return root


def experiment_csv_folders(spark: SparkSession, sf_dir: str) -> str:
    """``csv_files`` as experiment roots, with files a conversion must leave out and a dual-layout root."""
    root = csv_files(spark, sf_dir)
    lines = csv_lines(spark, sf_dir)
    decoys = [("/UNFILTERED/SData_", f) for f in ("/UNFILTERED/other_", "/RAW/SData_", "/UNFILTERED/deep/SData_")]
    for old, new in decoys:
        text_files(lines.withColumn("source_file", F.replace("source_file", F.lit(old), F.lit(new)))
                   .where(~F.col("source_file").endswith("/SData.csv")), "decoys", root=root)
    heads = lines.where(F.col("source_file").endswith("/SData.csv"))
    text_files(heads.withColumn("source_file", F.replace("source_file", F.lit("UNFILTERED/"), F.lit("UNFILTERED/deep/"))),
               "decoys", root=root)
    return root


def csv_sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited lines with 64 trailing samples; 8 only for label 7, one too many for label 3."""
    w = waveforms(spark, sf_dir)
    numbers = F.array_join(F.col("cut_samples").cast("array<string>"), ";")
    surplus = F.when(F.col("label") == 3, F.lit(";1")).otherwise(F.lit(""))
    data = w.select(
        F.concat(F.lit("wave/UNFILTERED/SData_"), F.col("file_no").cast("string"), F.lit(".csv"))
        .alias("source_file"),
        F.col("raw_idx").alias("line_no"),
        F.concat(F.lit("1;"), F.col("label").cast("string"), F.lit(";"), F.col("raw_idx").cast("string"),
                 F.lit(";7;1;"), numbers, surplus).alias("value"))
    return _with_header_file(
        data, "BOARD;CHANNEL;TIMETAG;FLAGS;PROBE_CODE;SAMPLES", "0;0;0;0;0;" + ";".join(["0"] * 64))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole event values per type, numbered in value order (a row a bin, not an event)."""
    from pyspark.sql import Window

    bins = events(spark, sf_dir).groupBy("event_type", F.floor("value").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("event_type").orderBy("bin")
    return bins.withColumn("line_no", (F.row_number().over(order) - 1).cast("bigint"))


def energy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy spectrum text; even bins write their count as a decimal, to be truncated."""
    h = histogram(spark, sf_dir)
    count = F.when(F.col("bin") % 2 == 0, F.concat(F.col("n").cast("string"), F.lit(".9"))).otherwise(
        F.col("n").cast("string"))
    name = F.concat(F.col("event_type"), F.lit("Espectrum.txt3")).alias("source_file")
    data = h.select(
        name, (F.col("line_no") + 3).alias("line_no"),
        F.concat_ws(" ", F.col("bin").cast("string"), count,
                    (F.col("bin").cast("double") / 2).cast("string")).alias("value"))
    top = h.select(name).distinct().select(
        "source_file", F.posexplode(F.array(F.lit("SPECTRUM"), F.lit("x y"), F.lit("1 2 3"))).alias(
            "line_no", "value")).withColumn("line_no", F.col("line_no").cast("bigint"))
    return data.unionByName(top)


def count_lines(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """PSD or time spectrum text: one count a line."""
    return histogram(spark, sf_dir).select(
        F.concat(F.col("event_type"), F.lit(suffix)).alias("source_file"), "line_no",
        F.col("n").cast("string").alias("value"))


def reactor_archives(spark: SparkSession, sf_dir: str, numeric: bool = False, faulty: bool = False) -> str:
    """Folder of archives: an experiment a range of events, a parameter an event type, members by user.

    Members with an odd number have an extra column; each archive also has two members to skip. ``numeric``
    archives have event numbers for times. ``faulty`` ones have notes of two lines, and members with number 3 end
    with a record that has too many fields.
    """
    ship_package(spark)
    root = scratch_path(spark, "reactor")
    rows = events(spark, sf_dir).select(
        F.floor(F.col("event_id") / RECORDS_PER_FILE).alias("exp"), "event_id", "event_type",
        (F.col("user_id") % 4).alias("seq"),
        (F.col("event_id").cast("string") if numeric else text_time(F.col("ts"), "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
        "value", "k")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["exp"].iloc[0])
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            def add(name, text):
                data = text.encode("cp1252")
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            add("notes.txt", "skip")
            add("other.csv", "a\n1\n")
            for (kind, seq), part in frame.sort_values("event_id").groupby(["event_type", "seq"]):
                columns = ["Timestamp", "value"] + (["k"] if seq % 2 else [])
                named = part[columns].rename(columns={"value": "value (µA)"})
                if faulty:
                    named["note"] = 'says "' + kind + '",\n' + part["event_id"].astype(str)
                surplus = "1,2,3,4,5,6\n" if faulty and seq == 3 else ""
                add(f"TB-{number} {kind} param {seq}.csv", named.to_csv(index=False) + surplus)
        write_whole(f"{root}/e{number}/TB-{number}_20240101-123456789_data.tar.gz", out.getvalue())
        return pd.DataFrame({"n": [len(frame)]})

    rows.groupBy("exp").applyInPandas(write, "n BIGINT").write.format("noop").mode("overwrite").save()
    return root


DOSE_ZONE = "Etc/GMT+6"


def dose_lines(spark: SparkSession, sf_dir: str, by_range: bool = False) -> DataFrame:
    """Dose-meter log a day, or a range of events: four header lines among blank ones, then readings six hours
    behind UTC."""
    e = events(spark, sf_dir)
    local = F.col("ts") - F.expr("interval 6 hours")
    part = (F.floor(F.col("event_id") / RECORDS_PER_FILE).cast("string") if by_range
            else text_time(F.col("ts"), "yyyyMMdd"))
    name = F.concat(F.lit("wendi_"), part, F.lit(".log")).alias("source_file")
    data = e.select(
        name, (F.col("event_id") + 8).alias("line_no"),
        F.concat_ws(
            "\t", text_time(local, "yyyy-MM-dd"), text_time(local, "HH:mm:ss"),
            F.floor("value").cast("string"), F.lit("µSv/h"), F.col("k").cast("string"), F.lit("cps"),
            F.when(F.col("event_type") == "error", F.lit("NA\tsurplus")).otherwise(F.col("event_type")),
        ).alias("value"))
    head = ["FH40G", "", "serial", "  ", "unit", "", "DATE\tTIME"]
    top = e.select(name).distinct().select(
        "source_file", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "value"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    return data.unionByName(top)


METER_ZONE = "America/Chicago"


def meter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dose log a range of events in a zone that changes its clock, a reading a minute: of every four files one is without
    fault, one goes through a night with an hour left out, one through a night with an hour twice, one has a bad time."""
    e = events(spark, sf_dir)
    kind = F.floor(F.col("event_id") / 512) % 4
    minute = F.col("event_id") % 512
    day = F.when(kind == 1, "2024-03-10").when(kind == 2, "2024-11-03").otherwise("2024-06-01")
    hour, rest = F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lpad((minute % 60).cast("string"), 2, "0")
    time = F.when((kind == 3) & (minute == 7), "late").otherwise(F.concat_ws(":", hour, rest, F.lit("00")))
    name = F.concat(F.lit("meter_"), F.floor(F.col("event_id") / 512).cast("string"), F.lit(".log")).alias("source_file")
    data = e.select(
        name, (F.col("event_id") + 4).alias("line_no"),
        F.concat_ws("\t", day, time, F.col("k").cast("string"), F.lit("µSv/h"), F.lit("1"), F.lit("cps"), F.lit("ok")).alias("value"))
    top = e.select(name).distinct().select(
        "source_file", F.posexplode(F.array(*map(F.lit, ("FH40G", "serial", "unit", "DATE\tTIME")))).alias("line_no", "value"))
    return data.unionByName(top.withColumn("line_no", F.col("line_no").cast("bigint")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


def run_info_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run info of each order: no id for 5-LOW, one line only for 4-NOT SPECIFIED, repeats for 3-MEDIUM."""
    o = orders(spark, sf_dir)
    key = F.col("o_orderkey").cast("string")
    id_line = F.concat(F.lit("id=TB-"), key)
    start = F.concat(F.lit("time.start="), text_time(F.col("o_orderdate"), "yyyy/MM/dd HH:mm:ss"),
                     F.lit(".250-0600"))
    texts = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("run"), start))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array(id_line))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.array(start, id_line, F.lit("id=LATER")))
        .otherwise(F.array(F.lit("run"), id_line, start))
    )
    return o.select(
        F.concat(F.lit("data/"), key, F.lit("/run.info")).alias("source_file"),
        F.posexplode(texts).alias("line_no", "value"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder of each order with the start its user would have typed; a bad one for status P."""
    o = orders(spark, sf_dir)
    typed = text_time(F.col("o_orderdate"), "yyyy/MM/dd-HH:mm")
    return o.select(
        F.concat(F.lit("data/"), F.col("o_orderkey").cast("string")).alias("folder"),
        F.when(F.col("o_orderstatus") == "P", F.lit("yesterday")).otherwise(typed).alias("start_time"))


def device_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: four event types are known codes, signup is an unknown one, k < 5 has no device."""
    kind = F.col("event_type")
    device = (
        F.when(F.col("k") < 5, F.lit(None).cast("string")).when(kind == "click", F.lit("eRep"))
        .when(kind == "error", F.lit("edwr")).otherwise(F.lit("uwGen")))
    param = (
        F.when(kind == "click", F.lit("curr")).when(kind == "error", F.lit("g1pres"))
        .when(kind == "signup", F.lit("unlisted")).when(kind == "view", F.lit("curr"))
        .otherwise(F.lit("volt")))
    return events(spark, sf_dir).select(
        device.alias("device"), param.alias("param"), F.col("event_id").cast("string").alias("Time"),
        F.floor("value").cast("string").alias("Data"), F.lit("u").alias("Unit"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of each order: not unconverted for 5-LOW; converted unless O; processed for F or 1-URGENT."""
    o = orders(spark, sf_dir)
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("double")
    stages = F.array_compact(F.array(
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit("unconverted")),
        F.when(F.col("o_orderstatus") != "O", F.lit("converted")),
        F.when((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT"), F.lit("processed")),
    ))
    return o.select(
        F.explode(stages).alias("stage"),
        F.concat(F.lit("ID-"), F.col("o_orderkey").cast("string")).alias("id"),
        (day * 86400000.0 + F.col("o_custkey").cast("double")).alias("mtime_ms"))


def log_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion log lines: complete for 1 and 2, with an error for 3, of another id for 4, none for 5."""
    o = orders(spark, sf_dir)
    number = F.col("o_orderkey").cast("string")
    identity = F.concat(F.lit("ID-"), number)
    done = F.concat(F.lit("INFO Conversion of /data/"), identity, F.lit(" complete"))
    texts = (
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.array(done, F.lit("ERROR disk")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED",
              F.array(F.concat(F.lit("INFO Conversion of ID-x"), number, F.lit(" complete"))))
        .when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("INFO start"), done)))
    return o.select(identity.alias("id"), F.explode(texts).alias("contents"))


def processed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of processed experiments: a csv on top for 1 to 3, deeper for 4, none for 5."""
    o = orders(spark, sf_dir)
    deep = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    name = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("plot.png")).otherwise(F.lit("output.csv"))
    return o.select(
        F.concat(F.lit("ID-"), F.col("o_orderkey").cast("string")).alias("id"), name.alias("file_name"),
        F.when(deep, F.lit(2)).otherwise(F.lit(1)).alias("depth"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override a nation: its key and two more digits. Some leave a property out, some are malformed."""
    n = table(spark, sf_dir, "nation")
    nothing = F.lit(None).cast("string")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("seq"),
        F.concat(F.lit("ID-"), F.col("n_nationkey").cast("string"), F.lit("[0-9][0-9]")).alias("pattern"),
        F.lit(0.0).alias("unconverted_mtime"), nothing.alias("unconverted_state"),
        F.when(F.col("n_regionkey") < 2, F.col("n_nationkey") * 100.0).alias("converted_mtime"),
        nothing.alias("converted_state"),
        F.lit(None).cast("double").alias("processed_mtime"),
        F.when(F.col("n_regionkey") == 4, F.lit("malformed")).alias("processed_state"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property patches: the lines of an order, in line order (then by part and supplier)."""
    li = table(spark, sf_dir, "lineitem")
    nothing = F.lit(None).cast("string")
    return li.select(
        F.concat(F.lit("ID-"), F.col("l_orderkey").cast("string")).alias("pattern"),
        (F.col("l_linenumber") * F.lit(10**14) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey"))
        .alias("seq"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("unconverted_mtime"),
        nothing.alias("unconverted_state"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("converted_mtime"),
        nothing.alias("converted_state"),
        F.lit(None).cast("double").alias("processed_mtime"),
        F.when(F.col("l_returnflag") == "A", F.lit("malformed"))
        .when(F.col("l_returnflag") == "R", F.lit("absent")).alias("processed_state"))


def supplier_overrides(spark: SparkSession, sf_dir: str, edited: bool) -> DataFrame:
    """Stored overrides of all suppliers, or the edited list: those in debt, and a new one a customer."""
    s = table(spark, sf_dir, "supplier")
    nothing = F.lit(None).cast("string")

    def rows(df, pattern, seq, mtime):
        return df.select(
            seq.cast("bigint").alias("seq"), pattern.alias("pattern"),
            mtime.alias("unconverted_mtime"), nothing.alias("unconverted_state"),
            F.lit(None).cast("double").alias("converted_mtime"), nothing.alias("converted_state"),
            F.lit(5.0).alias("processed_mtime"), nothing.alias("processed_state"))

    known = F.concat(F.lit("S-"), F.col("s_suppkey").cast("string"))
    if not edited:
        return rows(s, known, F.col("s_suppkey"), F.lit(1.0))
    c = table(spark, sf_dir, "customer")
    in_debt = rows(s.where("s_acctbal < 0"), known, F.col("s_suppkey"), F.lit(None).cast("double"))
    fresh = rows(c, F.concat(F.lit("C-"), F.col("c_custkey").cast("string")),
                 F.col("c_custkey") + 10_000_000, F.lit(2.0))
    return in_debt.unionByName(fresh)


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each order's source: complete roots for statuses F and O, a dose log or nothing for P."""
    o = orders(spark, sf_dir)

    def entries(*paths):
        return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(h).cast("string").alias("head"))
                         for p, h in paths])

    root = [("run.info", None), ("settings.xml", None), ("FILTERED/x", None), ("RAW/x", None)]
    files = (
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") < "3"),
               entries(("meter.LOG", "FH40G-L10 header")))
        .when(F.col("o_orderstatus") == "P", entries(("app.log", "plain log")))
        .when(F.col("o_orderpriority") == "1-URGENT",
              entries(*root, ("UNFILTERED/SData_1.BIN", None), ("UNFILTERED/SData.csv", None)))
        .when(F.col("o_orderpriority") == "2-HIGH",
              entries(*root, ("UNFILTERED/SData.csv", None), ("UNFILTERED/Data_CH0@x.csv", None)))
        .when(F.col("o_orderpriority") == "3-MEDIUM", entries(*root, ("UNFILTERED/Data_CH1@x.CSV", None)))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", entries(*root, ("UNFILTERED/notes.txt", None)))
        .otherwise(entries(*root[:3], ("UNFILTERED/SData_1.bin", None))))
    return o.select(
        F.concat(F.lit("exp-"), F.col("o_orderkey").cast("string")).alias("root"),
        F.explode(files).alias("f")).select("root", "f.path", "f.head")


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a supplier, a file a line item; names sort as text; extension by line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(
        F.lit("data/"), F.col("l_suppkey").cast("string"), F.lit("/"),
        F.when(F.col("l_returnflag") == "R", F.lit("Data_CH1_")).otherwise(F.lit("SData_")),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("_"), F.col("l_linenumber").cast("string"),
        F.when(F.col("l_linestatus") == "F", F.lit(".csv")).otherwise(F.lit(".CSV"))).alias("path"))


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return o.select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("source_file"),
        (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_orderpriority").alias("reason"),
        F.lit(1).cast("bigint").alias("n_records"), F.lit(0).cast("bigint").alias("n_skipped"))


def log_lines(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """JSON log lines after the ``keys`` of their events; not JSON for k < 5, without a message for k = 7, noise for users 1 and 2."""
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", F.lit("ERROR")).when(kind == "purchase", F.lit("WARNING"))
        .when(kind == "signup", F.lit("DEBUG")).when(kind == "view", F.lit("CRITICAL"))
        .otherwise(F.lit("INFO")))
    number = (
        F.when(kind == "error", F.lit(40)).when(kind == "purchase", F.lit(30))
        .when(kind == "signup", F.lit(10)).when(kind == "view", F.lit(50)).otherwise(F.lit(20)))
    text = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    named = F.struct(F.lit(1).alias("id"), F.lit("Main").alias("name"))
    record = F.struct(
        F.struct(F.lit("0:00").alias("repr"), F.lit(1.5).alias("seconds")).alias("elapsed"),
        F.struct(F.lit("1").alias("x")).alias("extra"),
        F.struct(F.lit("a.py").alias("name"), F.lit("/a.py").alias("path")).alias("file"),
        F.lit("run").alias("function"),
        F.struct(F.lit("*").alias("icon"), level.alias("name"), number.alias("no")).alias("level"),
        F.lit(3).alias("line"),
        F.when(F.col("k") != 7, text).alias("message"),
        F.when(F.col("user_id") == 1, F.lit("sh")).otherwise(F.lit("app")).alias("module"),
        F.when(F.col("user_id") == 2, F.lit("werkzeug.serving")).otherwise(F.lit("app")).alias("name"),
        named.alias("process"), named.alias("thread"),
        F.struct(F.col("event_id").cast("string").alias("repr"), F.lit(0.5).alias("timestamp")).alias("time"))
    line = F.to_json(F.struct(text.alias("text"), record.alias("record")))
    return e.select(*keys, F.when(F.col("k") < 5, F.lit("Traceback (most recent call last):"))
                    .otherwise(line).alias("value"))


def grow_logs(spark: SparkSession, sf_dir: str, folder: str, share: float) -> None:
    """Log files of a bounded id range each, written up to a share of their bytes: lines are cut anywhere."""
    ship_package(spark)
    lines = log_lines(spark, sf_dir, "event_id").withColumn("file_no", F.floor(F.col("event_id") / RECORDS_PER_FILE))

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("event_id")
        data = ("\n".join(ordered["value"]) + "\n").encode()
        write_whole(f"{folder}/{int(ordered['file_no'].iloc[0])}.log", data[:int(len(data) * share)])
        return pd.DataFrame({"n": [len(ordered)]})

    lines.groupBy("file_no").applyInPandas(write, "n BIGINT").write.format("noop").mode("overwrite").save()


def extra_csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Delimited files with two columns that list-mode tables have no place for."""
    e = events(spark, sf_dir)
    note = F.when(F.col("k") < 50, F.lit("NA")).otherwise(F.col("event_type"))
    data = e.select(
        F.concat(F.lit("x/UNFILTERED/SData_"), F.floor(F.col("event_id") / RECORDS_PER_FILE).cast("string"), F.lit(".csv"))
        .alias("source_file"), F.col("event_id").alias("line_no"),
        F.concat_ws(";", (F.col("user_id") % 4).cast("string"), F.concat(F.lit("b"), F.col("k").cast("string")),
                    F.col("event_id").cast("string"), note).alias("value"))
    return text_files(_with_header_file(data, "CHANNEL;BASELINE;TIMETAG;NOTE", "0;0;0;0"), "extra-csv")


def device_log_files(spark: SparkSession, sf_dir: str) -> str:
    """Headerless device logs in latin-1, one of a bounded id range in the folder of each event type."""
    rows = device_log(spark, sf_dir)
    e = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("Time"), "event_type", "event_id")
    quoted = F.concat(F.lit('"µ;'), F.col("Data"), F.lit('"'))
    lines = rows.join(e, "Time").select(
        F.concat("event_type", F.lit("/log_"), F.floor(F.col("event_id") / RECORDS_PER_FILE).cast("string"), F.lit(".csv"))
        .alias("source_file"), F.col("event_id").alias("line_no"),
        F.concat_ws(",", F.coalesce("device", F.lit("")), "param", "Time", quoted, "Unit").alias("value"))
    return text_files(lines, "device-logs", "latin-1")


def _supplier_tasks(spark: SparkSession, sf_dir: str, write_one) -> None:
    """Run ``write_one(key, nation, balance)`` for every supplier, a hundred a group; groups are dealt to all cores."""
    ship_package(spark)
    rows = table(spark, sf_dir, "supplier").select(
        F.floor(F.col("s_suppkey") / SUPPLIERS_PER_TASK).alias("task"), "s_suppkey", "s_nationkey", "s_acctbal")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        for key, nation, balance in zip(frame["s_suppkey"], frame["s_nationkey"], frame["s_acctbal"]):
            write_one(int(key), int(nation), float(balance))
        return pd.DataFrame({"n": [len(frame)]})

    dealt(rows, "task").groupBy("task").applyInPandas(write, "n BIGINT").write.format("noop").mode("overwrite").save()


def empty_folders(spark: SparkSession, sf_dir: str) -> str:
    """Stage roots with an empty folder a supplier: all unconverted, nations below 15 converted, below 8 processed."""
    root = scratch_path(spark, "empty-folders")

    def write(key: int, nation: int, balance: float) -> None:
        for stage, there in (("unconverted", True), ("converted", nation < 15), ("processed", nation < 8)):
            if there:
                system, inner = resolve(f"{root}/{stage}/ID-{key}")
                system.create_dir(inner, recursive=True)

    _supplier_tasks(spark, sf_dir, write)
    return root


def source_folders(spark: SparkSession, sf_dir: str) -> str:
    """A source a supplier below ``in``, of a class by its nation: binary (cut off when in debt), delimited of one or of two
    channels, a dose log, or an experiment without settings. An empty root of processed experiments beside it."""
    root = scratch_path(spark, "sources")
    meter = "FH40G\nserial\nunit\nDATE\tTIME\n"

    def write(key: int, nation: int, balance: float) -> None:
        kind, folder = nation % 5, f"{root}/in/TB-{key}"
        if kind == 3:
            text = meter + "".join(f"2024-01-02\t03:04:0{i}\t{nation}\tm\t2\tcps\tok\n" for i in range(3))
            write_whole(f"{root}/in/day-{key}.log", text.encode("cp1252"))
            return
        write_whole(f"{folder}/run.info", f"id=TB-{key}\ntime.start=2023/01/05 23:30:00.123-0600\n".encode())
        write_whole(f"{folder}/FILTERED/SDataF_1.bin", b"x")
        write_whole(f"{folder}/RAW/SDataR_1.bin", b"x")
        if kind != 4:
            write_whole(f"{folder}/settings.xml", b"")
        raw = f"{folder}/UNFILTERED"
        if kind == 0:
            zeros = {n: [0] * 4 for n in ("BOARD", "CHANNEL", "TIMESTAMP", "CALIB_ENERGY", "ENERGYSHORT", "FLAGS")}
            data = _encode(pd.DataFrame({**zeros, "ENERGY": [nation, key % 100, 7, 1]}), 7)
            write_whole(f"{raw}/SData_1.bin", data + (b"x" if balance < 0 else b""))
            write_whole(f"{raw}/deep/SData_2.bin", data)
        elif kind == 1:
            write_whole(f"{raw}/AAA.csv", b"OTHER\n1\n")
            write_whole(f"{raw}/SData.csv", f"CHANNEL;ENERGY\n0;{nation}\n".encode())
            write_whole(f"{raw}/SData_1.csv", f"1;{key % 100}\n1;2;3\n".encode())
        else:
            write_whole(f"{raw}/Data_CH0.csv", f"CHANNEL;ENERGY\n0;{nation}\n".encode())
            write_whole(f"{raw}/Data_CH1_1.csv", f"0;{key % 100}\n".encode())

    _supplier_tasks(spark, sf_dir, write)
    write_whole(f"{root}/processed/.keep", b"")
    return root


SUPPLIERS_PER_TASK = 100


def experiment_folders(spark: SparkSession, sf_dir: str) -> str:
    """Three stage roots with a folder a supplier: all unconverted, nations below 15 converted (with an
    error in the log when in debt), nations below 8 processed (without a csv when in debt)."""
    root = scratch_path(spark, "experiments")

    def write(key: int, nation: int, balance: float) -> None:
        name, in_debt = f"ID-{key}", balance < 0
        write_whole(f"{root}/unconverted/{name}/UNFILTERED/SData.bin", b"x")
        if nation < 15:
            text = f"start\nConversion of {name} complete\n" + ("ERROR late\n" if in_debt else "")
            write_whole(f"{root}/converted/{name}/conversion.log", text.encode())
        if nation < 8:
            write_whole(f"{root}/processed/{name}/" + ("plot.png" if in_debt else "output.csv"), b"x")

    _supplier_tasks(spark, sf_dir, write)
    return root
