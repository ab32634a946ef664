"""Fixed Spark schemas (DDL) of every table the package produces or consumes."""

LISTMODE = (
    "experiment_id STRING, source_file STRING, record_idx BIGINT, BOARD SMALLINT, CHANNEL SMALLINT, "
    "TIMESTAMP DECIMAL(20,0), ENERGY SMALLINT, CALIB_ENERGY DOUBLE, ENERGYSHORT SMALLINT, "
    "FLAGS BIGINT, WAVEFORM_CODE SMALLINT, samples ARRAY<SMALLINT>, extra MAP<STRING,STRING>"
)

LISTMODE_HEADERS = (
    "source_file STRING, length BIGINT, header INT, valid BOOLEAN, has_energy BOOLEAN, "
    "has_calib_energy BOOLEAN, has_energy_short BOOLEAN, has_waveform BOOLEAN, "
    "n_samples BIGINT, record_length BIGINT"
)

FILE_STATUS = (
    "source_file STRING, ok BOOLEAN, reason STRING, n_records BIGINT, n_skipped BIGINT"
)

REACTOR = (
    "experiment_id STRING, device_param STRING, seq INT, line_no BIGINT, "
    "Timestamp STRING, fields MAP<STRING,STRING>"
)

REACTOR_MEMBERS = "archive STRING, member STRING, ok BOOLEAN, reason STRING"

EXPERIMENTS = "exp_id STRING, `desc` STRING, exp_start TIMESTAMP, from_run_info_file BOOLEAN"

DEVICE_LOG = "device STRING, param STRING, Time STRING, Data STRING, Unit STRING"

LISTING = "stage STRING, id STRING, mtime_ms DOUBLE"

STAGES = ("unconverted", "converted", "processed")

PROPS = ", ".join(f"{s}_mtime DOUBLE, {s}_state STRING" for s in STAGES)

INVENTORY = f"id STRING, {PROPS}, overridden BOOLEAN"

OVERRIDES = f"seq BIGINT, pattern STRING, {PROPS}"

LINES = "source_file STRING, line_no BIGINT, value STRING"

# One application log record, as written one JSON document a line.
LOG_RECORD = (
    "text STRING, record STRUCT<"
    "elapsed: STRUCT<repr: STRING, seconds: DOUBLE>, exception: STRING, extra: MAP<STRING,STRING>, "
    "file: STRUCT<name: STRING, path: STRING>, function: STRING, "
    "level: STRUCT<icon: STRING, name: STRING, no: DOUBLE>, line: DOUBLE, message: STRING, "
    "module: STRING, name: STRING, process: STRUCT<id: DOUBLE, name: STRING>, "
    "thread: STRUCT<id: DOUBLE, name: STRING>, time: STRUCT<repr: STRING, timestamp: DOUBLE>>"
)
