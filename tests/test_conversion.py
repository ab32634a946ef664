import io
import json
import tarfile

import pytest
from binfile import record, write
from pulseframe import sinks
from pulseframe.operators import listmode as lm
from pulseframe.plans.conversion import convert_dose_log, convert_experiment, convert_folder
from pulseframe.plans.inventory_view import current_inventory
from pulseframe.sources.tables import read_conversion_logs
from pulseframe.streaming.conversion import (
    _logged,
    continuous_conversion, continuous_experiments, converted_so_far, status_so_far,
)
from pulseframe.streaming.logs import log_stream


def test_convert_experiment(spark, tmp_path):
    root, dest = tmp_path / "TB-7", tmp_path / "out"
    write(root / "UNFILTERED" / "SData_0.bin", 9, [
        record(9, channel=i % 2, timestamp=i, energy=i, samples=(i, 2, 3)) for i in range(10)], b"\1")
    (root / "run.info").write_text("id=TB-7\ntime.start=2023/01/05 23:30:00.123-0600\n")
    (root / "UNFILTERED" / "aPSDspectrum.txt").write_text("1\n2\n")
    for decoy in ("RAW", "FILTERED"):  # neither spectra nor run info of other folders count
        (root / decoy).mkdir()
        (root / decoy / "aPSDspectrum.txt").write_text("7\n8\n9\n")
        (root / decoy / "run.info").write_text("id=WRONG\ntime.start=2020/01/05 23:30:00.123-0600\n")
    with tarfile.open(root / "TB-7_20240101-123456789_data.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("TB-7 Gas 1.csv")
        data = b"Timestamp,v\n2,b\n1,a\n"
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    status = convert_experiment(spark, str(root), str(dest), "listmode_bin")
    assert lm.conversion_summary(status).first()[:] == (1, 0, 1)
    assert [r["source_file"].split("/")[-1] for r in lm.failing_files(status).collect()] == ["SData_0.bin"]
    table = sinks.read_listmode_table(spark, f"{dest}/listmode")
    assert sorted((r["experiment_id"], r["CHANNEL"], int(r["TIMESTAMP"]), r["samples"][0]) for r in table.collect()) == [
        ("TB-7", i % 2, i, i) for i in sorted(range(10), key=lambda i: (i % 2, i))]
    pruned = table.where("CHANNEL = 1 and experiment_id = 'TB-7'").select("ENERGY")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "samples" not in plan and "PartitionFilters: [isnotnull" in plan
    assert [r["fields"] for r in spark.read.parquet(f"{dest}/reactor").collect()] == [{"v": "a"}, {"v": "b"}]
    assert spark.read.parquet(f"{dest}/spectra/psd_spectrum").count() == 2
    assert spark.read.parquet(f"{dest}/experiments").first()["exp_id"] == "20230105_TB-7"
    # Converting again with fresh replaces this experiment and no other.
    other = table.selectExpr("'other' as experiment_id", "* except (experiment_id)")
    sinks.write_listmode(other, f"{tmp_path}/both")
    sinks.write_listmode(table, f"{tmp_path}/both", fresh=True)
    sinks.write_listmode(table, f"{tmp_path}/both", fresh=True)
    assert sinks.read_listmode_table(spark, f"{tmp_path}/both").count() == 20


def test_convert_without_run_info(spark, tmp_path):
    root, dest = tmp_path / "55", tmp_path / "out"
    folder = root / "UNFILTERED"
    folder.mkdir(parents=True)
    (folder / "SData.csv").write_text("CHANNEL;ENERGY\n0;5\n0;6\n")
    (folder / "SData_1.csv").write_text("0;7\n")
    convert_experiment(spark, str(root), str(dest), "listmode_csv_single", start_time="2024/01/02-03:04")
    table = sinks.read_listmode_table(spark, f"{dest}/listmode")
    assert sorted(r["ENERGY"] for r in table.collect()) == [5, 6, 7]
    row = spark.read.parquet(f"{dest}/experiments").first()
    assert (row["exp_id"], row["from_run_info_file"]) == ("20240102_TB-55", False)


def run(query):
    query.trigger(availableNow=True).start().awaitTermination()


def test_continuous_conversion_converts_each_file_once(spark, tmp_path):
    source, dest, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write(source / "e1" / "a.bin", 0, [record(0, timestamp=i) for i in range(3)])
    run(continuous_conversion(spark, str(source), dest, state))
    assert converted_so_far(spark, dest).count() == 3
    write(source / "e2" / "b.bin", 8, [record(8, timestamp=i, samples=(1, 2)) for i in range(4)])
    run(continuous_conversion(spark, str(source), dest, state))
    run(continuous_conversion(spark, str(source), dest, state))
    counts = {r[0]: r[1] for r in converted_so_far(spark, dest).groupBy("experiment_id").count().collect()}
    assert counts == {"e1": 3, "e2": 4}


def log_line(number, name, logger="app", module="app"):
    return json.dumps({"text": "t", "record": {
        "elapsed": {"repr": "0", "seconds": 0.1}, "exception": None, "extra": {"a": {"b": 1}},
        "file": {"name": "f", "path": "/f"}, "function": "f",
        "level": {"icon": "i", "name": name, "no": number}, "line": 1, "message": f"m{number}", "module": module,
        "name": logger, "process": {"id": 1, "name": "p"}, "thread": {"id": 1, "name": "t"},
        "time": {"repr": f"t{number}", "timestamp": 1.5}}})


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    levels = {"CRITICAL": 50, "ERROR": 40, "WARNING": 30, "INFO": 20, "DEBUG": 10, "NOTSET": 0}
    text = [log_line(n, k) for k, n in levels.items()]
    text += ["not json", "{}", log_line(50, "LOUD"), log_line(50, "ERROR", logger="werkzeug"),
             log_line(50, "ERROR", module="sh"), log_line(40, "ERROR").replace('"message"', '"massage"')]
    (folder / "a.log").write_text("\n".join(text) + "\n")
    stream = log_stream(spark, str(folder), "INFO")
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start(str(tmp_path / "o")))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r["level"] for r in rows) == ["CRITICAL", "ERROR", "INFO", "WARNING"]
    assert all(r["message"] == f"m{int(r['level_no'])}" for r in rows)


def test_convert_dual_layout_and_log(spark, tmp_path):
    root, dest = tmp_path / "in" / "TB-9", tmp_path / "out"
    folder = root / "UNFILTERED"
    (folder / "deep").mkdir(parents=True)
    (folder / "Data_CH0.csv").write_text("CHANNEL;ENERGY\n0;5\n")
    (folder / "Data_CH0_1.csv").write_text("0;6\n")
    (folder / "Data_CH1_1.csv").write_text("1;7\n")
    (folder / "Data_CH2_1.csv").write_text("2;99\n")  # neither of the two channels
    (folder / "SData_1.csv").write_text("0;77\n")  # other layout
    (folder / "deep" / "Data_CH0.csv").write_text("CHANNEL;ENERGY\n0;88\n")
    convert_experiment(spark, str(root), str(dest), "listmode_csv_dual", log_root=str(tmp_path / "logs"))
    table = sinks.read_listmode_table(spark, f"{dest}/listmode")
    assert sorted(r["ENERGY"] for r in table.collect()) == [5, 6, 7]
    log = read_conversion_logs(spark, str(tmp_path / "logs")).collect()
    assert [(r["id"], r["contents"]) for r in log] == [("TB-9", f"INFO - Conversion of {root} complete")]


def test_convert_dose_meter(spark, tmp_path):
    log = tmp_path / "day.log"
    log.write_bytes("FH40G\nserial\nunit\nDATE\tTIME\n2024-01-02\t03:04:05\t1\tµSv/h\t2\tcps\tok\n".encode("cp1252"))
    convert_experiment(spark, str(log), str(tmp_path / "out"), "dose_meter", log_root=str(tmp_path / "logs"))
    row = spark.read.parquet(f"{tmp_path}/out/wendi").first()
    assert (row["VALUE_INT"], row["UNIT_INT"], row["STATUS"]) == (1.0, "µSv/h", "ok")
    assert read_conversion_logs(spark, str(tmp_path / "logs")).first()["id"] == "day"


def test_failed_files_are_in_log_and_stream_status(spark, tmp_path):
    root, dest = tmp_path / "TB-8", tmp_path / "out"
    write(root / "UNFILTERED" / "SData_0.bin", 7, [record(7, timestamp=i) for i in range(3)], b"\1")
    convert_experiment(spark, str(root), str(dest), "listmode_bin", log_root=str(tmp_path / "logs"))
    lines = sorted(r["contents"] for r in read_conversion_logs(spark, str(tmp_path / "logs")).collect())
    assert lines == ["ERROR - 1 files failed", f"INFO - Conversion of {root} complete"]
    running = continuous_conversion(spark, str(root), f"{tmp_path}/stream", f"{tmp_path}/cp").trigger(availableNow=True).start()
    running.awaitTermination()
    assert converted_so_far(spark, f"{tmp_path}/stream").count() == 3
    assert [r["ok"] for r in status_so_far(spark, f"{tmp_path}/stream").collect()] == [False]


def test_wide_samples_cut_nothing(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "k INT, samples ARRAY<INT>")
    assert sorted(map(tuple, lm.samples_wide(rows, 3).collect())) == [(1, 1, 2, 3), (2, 4, None, None)]
    with pytest.raises(Exception, match="more than 2 samples"):
        lm.samples_wide(rows, 2).collect()


def test_growing_log_loses_no_line(spark, tmp_path):
    """Lines appended to a file, a line completed later, a new file, and a file started anew."""
    folder = tmp_path / "logs"
    folder.mkdir()

    def caught_up():
        stream = log_stream(spark, str(folder), "INFO", glob="*.log")
        (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination())
        return spark.read.schema(stream.schema).parquet(str(tmp_path / "o")).count()

    line = log_line(40, "ERROR") + "\n"
    (folder / "a.log").write_text(line * 3 + line[:30])
    (folder / "other.txt").write_text(line)
    assert caught_up() == 3
    assert caught_up() == 3
    with open(folder / "a.log", "a") as log:
        log.write(line[30:] + line + line[:-1])
    (folder / "b.log").write_text(line)
    assert caught_up() == 6
    with open(folder / "a.log", "a") as log:
        log.write("\n")
    assert caught_up() == 7
    (folder / "b.log").write_text(log_line(50, "CRITICAL")[:40])
    assert caught_up() == 7
    (folder / "b.log").write_text(log_line(50, "CRITICAL") + "\n" + line)
    assert caught_up() >= 8


def test_metadata_is_replaced_by_experiment(spark, tmp_path):
    dest = str(tmp_path / "experiments")

    def row(name, text):
        return spark.createDataFrame([(name, text, None, True)], "exp_id STRING, desc STRING, exp_start TIMESTAMP, "
                                     "from_run_info_file BOOLEAN")
    for name, text in (("20240101_A", "first"), ("20240101_B", "b"), ("20240101_A", "second"), (None, "x")):
        sinks.write_experiments(row(name, text), dest)
    assert sorted((r.exp_id, r.desc) for r in sinks.read_experiments(spark, dest).collect()) == [
        ("20240101_A", "second"), ("20240101_B", "b")]


def test_convert_a_folder_of_experiments(spark, tmp_path):
    """From the folder to the inventory: classes, file limit, channel folders, metadata, logs."""
    source, dest, done = tmp_path / "in", str(tmp_path / "out"), tmp_path / "converted"
    for name in ("TB-1", "TB-2", "TB-3", "TB-4"):
        for folder in ("RAW", "FILTERED", "UNFILTERED/deep"):
            (source / name / folder).mkdir(parents=True)
        (source / name / "settings.xml").write_text("")
        (source / name / "run.info").write_text(f"id={name}\ntime.start=2023/01/05 23:30:00.123-0600\n")
    write(source / "TB-1" / "UNFILTERED" / "SData_0.bin", 1, [record(1, energy=i) for i in range(4)])
    write(source / "TB-1" / "UNFILTERED" / "SData_1.bin", 1, [record(1, energy=9)], b"\1")
    write(source / "TB-1" / "UNFILTERED" / "deep" / "SData_2.bin", 1, [record(1, energy=99)])
    (source / "TB-2" / "UNFILTERED" / "SData.csv").write_text("CHANNEL;ENERGY\n0;5\n")
    (source / "TB-3" / "UNFILTERED" / "Data_CH1.csv").write_text("CHANNEL;ENERGY\n0;6\n")
    (source / "TB-3" / "UNFILTERED" / "aPSDspectrum.txt").write_text("1\n2\n")
    meter = b"FH40G\nserial\nunit\nDATE\tTIME\n2024-01-02\t03:04:05\t1\tm\t2\tcps\tok\n"
    (source / "day.log").write_bytes(meter)
    for _ in range(2):
        found = convert_folder(spark, str(source), dest, fresh=True, log_root=str(done))
    assert {r.source.rsplit("/", 1)[-1]: r.source_class for r in found.collect()} == {
        "TB-1": "listmode_bin", "TB-2": "listmode_csv_single", "TB-3": "listmode_csv_dual", "TB-4": "unsupported",
        "day.log": "dose_meter"}
    rows = sinks.read_listmode_table(spark, f"{dest}/listmode").collect()
    assert sorted((r.experiment_id, r.ENERGY, r.file_channel) for r in rows) == [
        ("TB-1", i, None) for i in (0, 1, 2, 3, 9)] + [("TB-2", 5, None), ("TB-3", 6, "ch1")]
    assert sorted(r.exp_id for r in sinks.read_experiments(spark, f"{dest}/experiments").collect()) == [
        "20230105_TB-1", "20230105_TB-2", "20230105_TB-3"]
    assert spark.read.parquet(f"{dest}/wendi").count() == 1
    assert spark.read.parquet(f"{dest}/spectra/psd_spectrum").count() == 2
    (tmp_path / "processed").mkdir()
    states = {r.id: r.converted_state for r in
              current_inventory(spark, str(source), str(done), str(tmp_path / "processed")).collect()}
    assert states == {"TB-1": "malformed", "TB-2": "present", "TB-3": "present", "TB-4": "absent", "day": "present"}
    convert_folder(spark, str(source), dest, fresh=True, file_limit=1)
    assert sinks.read_listmode_table(spark, f"{dest}/listmode").where("experiment_id = 'TB-1'").count() == 4


METER = "FH40G\nserial\nunit\nDATE\tTIME\n"


def test_a_faulty_dose_log_fails_alone(spark, tmp_path):
    folder, dest = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    times = {"good": ["2024-06-01\t01:00:00"], "gap": ["2024-06-01\t01:00:00", "2024-03-10\t02:30:00"],
             "twice": ["2024-11-03\t01:30:00"], "bad": ["2024-06-01\tlate", "\t"], "none": []}
    for name, stamps in times.items():
        (folder / f"{name}.log").write_text(METER + "".join(f"{t}\t1\tu\t2\tv\tok\n" for t in stamps))
    (folder / "empty.log").write_text("")
    (folder / "short.log").write_text("FH40G\nserial\n")
    for _ in range(2):
        status = convert_dose_log(spark, str(folder), dest, "America/Chicago", fresh=True)
    got = {r.source_file.rsplit("/", 1)[-1]: (r.ok, r.n_rows, r.reason) for r in status.collect()}
    assert got == {
        "good.log": (True, 1, None), "gap.log": (False, 2, "1 times never happened"),
        "twice.log": (False, 1, "1 times happened twice"), "bad.log": (False, 2, "2 times cannot be read"),
        "none.log": (False, 0, "no readings"), "empty.log": (False, 0, "no readings"), "short.log": (False, 0, "no readings")}
    assert [r.log for r in spark.read.parquet(dest).collect()] == ["good.log"]
    (folder / "good.log").rename(folder / "later.log")  # another log of the folder leaves the first one's rows alone
    convert_dose_log(spark, str(folder / "later.log"), dest, "America/Chicago", fresh=True)
    assert sorted(r.log for r in spark.read.parquet(dest).collect()) == ["good.log", "later.log"]


def test_experiments_are_converted_once_complete(spark, tmp_path):
    """Files land in any order; nothing is converted before the class can be told and the marker is there."""
    source, dest, logs = tmp_path / "in", str(tmp_path / "out"), tmp_path / "logs"
    source.mkdir()

    def land(**options):
        running = continuous_experiments(spark, str(source), dest, str(logs), str(tmp_path / "c"), **options)
        running.trigger(availableNow=True).start().awaitTermination()

    def rows():
        return sorted((r.experiment_id, r.ENERGY) for r in sinks.read_listmode_table(spark, f"{dest}/listmode").collect())

    for name in ("TB-1", "TB-2"):
        for folder in ("RAW", "FILTERED", "UNFILTERED"):
            (source / name / folder).mkdir(parents=True)
        (source / name / "run.info").write_text(f"id={name}\ntime.start=2023/01/05 23:30:00.123-0600\n")
        (source / name / "UNFILTERED" / "SData.csv").write_text(f"CHANNEL;ENERGY\n0;{name[-1]}\n")
    (source / "TB-2" / "settings.xml").write_text("")
    land(marker="done")
    assert not logs.exists()
    (source / "day.log").write_text(METER + "2024-06-01\t01:00:00\t1\tu\t2\tv\tok\n")
    (source / "bad.log").write_text(METER + "never\t\t1\tu\t2\tv\tok\n")
    (source / "TB-2" / "done").write_text("x")
    land(marker="done")
    assert {p.name for p in logs.iterdir()} == {"TB-2", "day", "bad"}
    assert "ERROR - 1 times cannot be read" in (logs / "bad" / "conversion.log").read_text()
    assert rows() == [("TB-2", 2)]
    (source / "TB-1" / "settings.xml").write_text("")
    (source / "TB-1" / "done").write_text("x")
    (source / "TB-2" / "UNFILTERED" / "SData_1.csv").write_text("0;22\n")
    land(marker="done")
    assert rows() == [("TB-1", 1), ("TB-2", 2)]
    (source / "TB-2" / "UNFILTERED" / "SData_2.csv").write_text("0;222\n")
    land(marker="done", reconvert=True)
    assert rows() == [("TB-1", 1), ("TB-2", 2), ("TB-2", 22), ("TB-2", 222)]
    assert [r.log for r in spark.read.parquet(f"{dest}/wendi").collect()] == ["day.log"]


def test_only_logs_of_landed_experiments_are_looked_for(spark, tmp_path):
    for name in ("TB-1", "TB-2", "day-3"):
        (tmp_path / "logs" / name).mkdir(parents=True)
        (tmp_path / "logs" / name / "conversion.log").write_text("x")
    (tmp_path / "logs" / "TB-4" / "conversion.log").mkdir(parents=True)
    landed = spark.createDataFrame([("TB-1",), ("day-3",), ("TB-4",), ("TB-5",)], "id STRING")
    assert {r.id for r in _logged(landed, f"{tmp_path}/logs").collect()} == {"TB-1", "day-3"}
    assert _logged(landed, f"{tmp_path}/none").count() == 0
