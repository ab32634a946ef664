"""Experiment inventory: stage presence, validity, filters, ordering and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import scalars as fx
from pulseframe.operators.positions import sorted_positions
from pulseframe.schemas import STAGES

ABSENT_MTIME = -1.0
ABSENT, PRESENT, MALFORMED = "absent", "present", "malformed"
FILTERS = ("all", "to_be_converted", "to_be_processed", "to_be_analyzed")
PROP_COLUMNS = [f"{s}_{kind}" for s in STAGES for kind in ("mtime", "state")]


def state_of(mtime: Column) -> Column:
    return F.when(mtime == ABSENT_MTIME, F.lit(ABSENT)).otherwise(F.lit(PRESENT))


def build_inventory(listing: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row an experiment id from ``listing(stage, id, mtime_ms)``; a stage not seen is absent.

    Ids of an earlier inventory stay known, with the stages they no longer have marked absent.
    """
    seen = listing.select("id", "stage", "mtime_ms")
    if previous is not None:
        nothing = F.lit(None).cast("string").alias("stage"), F.lit(None).cast("double").alias("mtime_ms")
        seen = seen.unionByName(previous.select("id", *nothing))
    mtimes = seen.groupBy("id").agg(*[
        F.coalesce(F.max(F.when(F.col("stage") == s, F.col("mtime_ms"))), F.lit(ABSENT_MTIME))
        .alias(f"{s}_mtime") for s in STAGES
    ])
    columns = [F.col("id")]
    for s in STAGES:
        columns += [F.col(f"{s}_mtime"), state_of(F.col(f"{s}_mtime")).alias(f"{s}_state")]
    return mtimes.select(*columns, F.lit(False).alias("overridden"))


def _mark_malformed(inventory: DataFrame, valid: DataFrame, stage: str) -> DataFrame:
    """Malformed where the stage is present but ``valid(id, is_valid)`` does not vouch for it."""
    present = F.col(f"{stage}_state") == PRESENT
    bad = present & ~F.coalesce(F.col("is_valid"), F.lit(False))
    return (
        inventory.join(valid, "id", "left")
        .withColumn(f"{stage}_mtime", F.when(~bad, F.col(f"{stage}_mtime")))
        .withColumn(f"{stage}_state", F.when(bad, F.lit(MALFORMED)).otherwise(F.col(f"{stage}_state")))
        .select(*inventory.columns)
    )


def conversion_verdicts(logs: DataFrame) -> DataFrame:
    """``(id, is_valid)`` from ``logs(id, contents)``, where contents is a whole log or any one line of it.

    Neither test looks across lines, so a log may arrive line by line and is never held whole. The id
    takes part in the pattern as it is, unescaped; ``(?d)`` makes only a newline end a line.
    """
    done = F.concat(F.lit("(?d)Conversion of .*"), F.col("id"), F.lit(" complete"))
    # The cheap tests go first, so the pattern is compiled for candidate lines only.
    maybe = F.col("contents").contains("Conversion of ") & F.col("contents").contains(" complete")
    complete = F.when(maybe, F.regexp(F.col("contents"), done)).otherwise(F.lit(False))
    return logs.groupBy("id").agg(
        (F.bool_or(complete) & ~F.bool_or(F.col("contents").contains("ERROR"))).alias("is_valid")
    )


def mark_converted(inventory: DataFrame, logs: DataFrame) -> DataFrame:
    """Converted experiments without a clean, complete log are malformed."""
    return _mark_malformed(inventory, conversion_verdicts(logs), "converted")


def mark_processed(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Processed experiments without a ``.csv`` directly in their folder are malformed."""
    with_csv = (
        manifest.where((F.col("depth") == 1) & F.col("file_name").endswith(".csv"))
        .select("id").distinct().withColumn("is_valid", F.lit(True))
    )
    return _mark_malformed(inventory, with_csv, "processed")


def _is(stage: str) -> Column:
    """Malformed counts as present."""
    return F.col(f"{stage}_state") != ABSENT


def inventory_filter(name: str) -> Column:
    unconverted, converted, processed = _is("unconverted"), _is("converted"), _is("processed")
    choices = {
        "all": F.lit(True),
        "to_be_converted": unconverted & ~converted,
        "to_be_processed": converted & ~processed,
        "to_be_analyzed": unconverted & (~converted | ~processed),
    }
    if name not in choices:
        raise ValueError(f"Invalid experiment filter {name!r}: use one of {FILTERS}")
    return choices[name]


def filter_inventory(inventory: DataFrame, name: str = "all") -> DataFrame:
    return inventory.where(inventory_filter(name))


def filter_pattern(inventory: DataFrame, pattern: str) -> DataFrame:
    """Ids in which the pattern is found anywhere."""
    return inventory.where(F.col("id").rlike(pattern))


def _id_number() -> Column:
    """Number after the first dash; null (sorted last) when there is none or it is not a number."""
    text = F.trim(F.split_part(F.col("id"), F.lit("-"), F.lit(2)))
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | text.rlike(r"^[+-]?Infinity$")
    return F.when(number, text.try_cast("double"))


def _inventory_key(by: str) -> Column:
    if by == "id":
        return _id_number()
    if by not in STAGES:
        raise ValueError(f"cannot sort by {by!r}: use id or one of {STAGES}")
    return F.col(f"{by}_mtime")


def _inventory_order(by: str, reverse: bool) -> list[Column]:
    key = _inventory_key(by)
    if reverse:
        return [key.asc_nulls_first(), F.col("id").desc()]
    return [key.desc_nulls_last(), F.col("id").asc()]


def sort_inventory(inventory: DataFrame, by: str = "id", reverse: bool = False) -> DataFrame:
    """Newest first; non-numeric ids and malformed times last; absent (-1) before malformed.

    ``reverse`` flips the whole order. Equal keys are ordered by id, to be deterministic.
    """
    return inventory.orderBy(*_inventory_order(by, reverse))


def ranked_inventory(inventory: DataFrame, by: str = "id", reverse: bool = False) -> DataFrame:
    """``sort_inventory`` with the 0-based display ``position``."""
    return sorted_positions(inventory, _inventory_order(by, reverse))


def status_label(inventory: DataFrame) -> DataFrame:
    """Per stage: label, time of the newest file, and colour class (an override takes precedence)."""
    columns = [F.col("id")]
    for s in STAGES:
        state = F.col(f"{s}_state")
        columns += [
            F.when(state == MALFORMED, F.lit("Malformed")).when(state == ABSENT, F.lit("Not found"))
            .otherwise(F.lit("Found")).alias(f"{s}_label"),
            F.when(state == PRESENT, fx.ms_to_timestamp(F.col(f"{s}_mtime"))).alias(f"{s}_time"),
            F.when(F.col("overridden"), F.lit("overridden")).otherwise(
                F.when(state == MALFORMED, F.lit("malformed")).when(state == ABSENT, F.lit("not_found"))
                .otherwise(F.lit("found"))
            ).alias(f"{s}_class"),
        ]
    return inventory.select(*columns)


def limit_files(manifest: DataFrame, extension: str, n: int | None = None, prefix: str = "") -> DataFrame:
    """First ``n`` files of an extension in each folder (by name), and of those the ones with the prefix.

    ``manifest(path)``; no limit for ``None`` or 0. Spark prunes to ``n`` rows a folder before shuffling.
    """
    from pyspark.sql import Window

    name = fx.base_name(F.col("path"))
    files = manifest.where(F.lower(name).endswith(extension.lower()))
    if n:
        rank = F.row_number().over(
            Window.partitionBy(fx.folder_of(F.col("path"))).orderBy(name))
        files = files.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    return files.where(fx.base_name(F.col("path")).rlike(f"^{prefix}.*"))


def classify_sources(manifest: DataFrame) -> DataFrame:
    """``(root, source_class)`` from ``manifest(root, path, head)``; ``path`` is relative to its root.

    A ``.log`` file whose text starts with the dose-meter model is a dose log. Anything else must be an
    experiment root: run info, settings and the three data folders. There, binary files win over
    delimited ones and the single-channel layout over the dual one.
    """
    path, name = F.col("path"), fx.base_name(F.col("path"))
    unfiltered = path.startswith("UNFILTERED/") & ~path.substr(F.lit(12), F.length(path)).contains("/")

    def any_row(condition):
        return F.bool_or(F.coalesce(condition, F.lit(False)))

    facts = manifest.groupBy("root").agg(
        any_row(F.lower(name).endswith(".log") & fx.is_dose_meter_log(F.col("head"))).alias("dose"),
        any_row(path == "run.info").alias("info"),
        any_row(path == "settings.xml").alias("settings"),
        any_row(path.startswith("FILTERED/")).alias("filtered"),
        any_row(path.startswith("RAW/")).alias("raw"),
        any_row(path.startswith("UNFILTERED/")).alias("unfiltered"),
        any_row(unfiltered & name.rlike(r"(?i)^.*\.bin$")).alias("bin"),
        any_row(unfiltered & name.rlike(r"(?i)^.*\.csv$")).alias("csv"),
        any_row(unfiltered & name.startswith("SData")).alias("single"),
        any_row(unfiltered & name.startswith("Data_CH")).alias("dual"),
    )
    is_root = F.col("info") & F.col("settings") & F.col("filtered") & F.col("raw") & F.col("unfiltered")
    return facts.select(
        "root",
        F.when(F.col("dose"), F.lit("dose_meter"))
        .when(~is_root, F.lit("unsupported"))
        .when(F.col("bin"), F.lit("listmode_bin"))
        .when(F.col("csv") & F.col("single"), F.lit("listmode_csv_single"))
        .when(F.col("csv") & F.col("dual"), F.lit("listmode_csv_dual"))
        .otherwise(F.lit("unsupported")).alias("source_class"),
    )
