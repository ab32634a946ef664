"""Log tail as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.operators.logs import at_least, drop_noise, parse_logs, project_logs
from pulseframe.sources import growing_text


def read_log_stream(spark: SparkSession, folder: str, glob: str = "*", latest: bool = False) -> DataFrame:
    """Lines of the log files in ``folder``, as they are completed; files may still be growing.

    ``latest`` leaves out what is there when the stream starts.
    """
    growing_text.register(spark)
    return (
        spark.readStream.format(growing_text.FORMAT).option("pathGlobFilter", glob)
        .option("startingOffsets", "latest" if latest else "earliest").load(folder)
    )


def log_stream(spark: SparkSession, folder: str, lowest: str = "NOTSET", glob: str = "*",
               latest: bool = False) -> DataFrame:
    """Displayed log rows: noise removed, projected, at the chosen level or above. Stateless."""
    lines = read_log_stream(spark, folder, glob, latest)
    return at_least(project_logs(drop_noise(parse_logs(lines))), lowest)
