"""Device log: one row a reading, split into one table per device parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.functions import scalars as fx

# Readable name of each (device, parameter) code. Fixed values.
PARAMETER_NAMES = {
    ("eRep", "curr"): "Target Current",
    ("edwr", "g1pres"): "Chamber Pressure",
    ("edwr", "g1gas"): "Chamber Gas",
    ("uwGen", "isOn"): "Microwave Generator Active",
    ("uwGen", "volt"): "Microwave Generator Voltage",
    ("uwGen", "ignite"): "Microwave Generator Ignite",
    ("uwGen", "conPwr"): "Microwave Generator Control Power",
    ("uwGen", "auto"): "Microwave Generator Automatic Mode",
    ("uwGen", "setpoint"): "Microwave Generator Setpoint",
    ("uwGen", "forPwr"): "Microwave Generator Forward Power",
    ("uwGen", "revPwr"): "Microwave Generator Reverse Power",
    ("uwGen", "curr"): "Microwave Generator Current",
    ("uwGen", "temp"): "Microwave Generator Temperature",
}


def read_device_log(spark: SparkSession, path) -> DataFrame:
    """Headerless five-column latin-1 files, with the ``experiment_id`` that each file's folder tells."""
    rows = spark.read.option("recursiveFileLookup", "true").csv(
        path, schema=schemas.DEVICE_LOG, header=False, encoding="ISO-8859-1", escape='"')
    return rows.withColumn("experiment_id", fx.experiment_id_of_file(fx.decode_file_url(F.col("_metadata.file_path"))))


def parameter_names(spark: SparkSession) -> DataFrame:
    rows = [(d, p, n) for (d, p), n in PARAMETER_NAMES.items()]
    return spark.createDataFrame(rows, "device STRING, param STRING, name STRING")


def keyed_readings(device_log: DataFrame) -> DataFrame:
    """Readings without a device or parameter belong to no group."""
    cleaned = device_log.withColumns({k: fx.null_if_na(F.col(k)) for k in ("device", "param")})
    return cleaned.dropna(subset=["device", "param"])


def group_parameters(device_log: DataFrame) -> DataFrame:
    """Which (device, parameter) groups there are, and how large."""
    return keyed_readings(device_log).groupBy("device", "param").agg(F.count(F.lit(1)).alias("n_rows"))


def name_parameters(device_log: DataFrame, names: DataFrame | None = None,
                    strict: bool = False) -> DataFrame:
    """Add the readable ``name``; an unknown code has none, or raises when ``strict``."""
    table = names
    if table is None:
        # 13 fixed rows: safe to broadcast. A caller's table is left to the optimizer.
        table = F.broadcast(parameter_names(device_log.sparkSession))
    named = keyed_readings(device_log).join(table, ["device", "param"], "left")
    name = F.col("name")
    if strict:
        code = F.concat_ws("/", "device", "param")
        name = F.coalesce(
            name, F.raise_error(F.concat(F.lit("unknown device parameter "), code)).cast("string"))
    kept = ["experiment_id"] if "experiment_id" in named.columns else []
    return named.select(*kept, "device", "param", name.alias("name"), "Time", "Data", "Unit")
