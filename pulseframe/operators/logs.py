"""Application log lines: one JSON document a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe import schemas

# Log levels and their numbers.
LEVELS = {"CRITICAL": 50, "ERROR": 40, "WARNING": 30, "INFO": 20, "DEBUG": 10, "NOTSET": 0}

# Members a record must have to be accepted; ``exception`` may be anything.
_REQUIRED = (
    "record.elapsed.repr", "record.elapsed.seconds", "record.extra", "record.file.name",
    "record.file.path", "record.function", "record.level.icon", "record.level.name",
    "record.level.no", "record.line", "record.message", "record.module", "record.name",
    "record.process.id", "record.process.name", "record.thread.id", "record.thread.name",
    "record.time.repr", "record.time.timestamp", "text",
)


def _accepted(log: Column) -> Column:
    level = log["record"]["level"]["name"].isin(*LEVELS)
    for member in _REQUIRED:
        value = log
        for name in member.split("."):
            value = value[name]
        level = level & value.isNotNull()
    return level


def parse_logs(lines: DataFrame) -> DataFrame:
    """``log`` struct of each line of ``value``; lines that fail the schema are dropped.

    The test runs inside a generator, so a line is parsed once. As a plain filter, Spark would push it
    below the parse and repeat the parse for every member looked at.
    """
    one = F.array(F.from_json("value", schemas.LOG_RECORD))
    return lines.select("*", F.explode(F.filter(one, _accepted)).alias("log"))


def is_noise(log: Column) -> Column:
    """Records of the web server and of the shell helper."""
    return log["record"]["name"].contains("werkzeug") | (log["record"]["module"] == "sh")


def drop_noise(logs: DataFrame) -> DataFrame:
    return logs.where(~is_noise(F.col("log")))


def project_logs(logs: DataFrame) -> DataFrame:
    record = "log.record"
    return logs.select(
        F.col(f"{record}.time.repr").alias("timestamp"),
        F.col(f"{record}.level.name").alias("level"),
        F.col(f"{record}.level.icon").alias("icon"),
        F.col(f"{record}.level.no").alias("level_no"),
        F.col(f"{record}.message").alias("message"),
    )


def at_least(logs: DataFrame, lowest: str) -> DataFrame:
    """Projected logs at the level or above."""
    if lowest not in LEVELS:
        raise ValueError(f"unknown level {lowest!r}: use one of {tuple(LEVELS)}")
    return logs.where(F.col("level_no") >= LEVELS[lowest])
