import datetime
import io
import math
import os
import random
import tarfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from pulseframe import sinks
from pulseframe.functions import scalars as fx
from pulseframe.operators import devicelog, doselog, listmode as lm, logs, metadata, reactor as rx, spectra
from pulseframe.operators import joins
from pulseframe.operators.inventory import classify_sources, limit_files
from pulseframe.operators.positions import sorted_positions, with_record_idx
from pulseframe.plans import queries, stand_ins as si
from pulseframe.plans.conversion import convert_listmode_csv
from pulseframe.plans.inventory_view import current_inventory
from pulseframe.sources import reactor, text_format as fmt
from pulseframe.sources.files import list_files
from pulseframe.sources.lines import read_lines
from pulseframe.sources.manifest import classified_sources, source_manifest, source_roots
from pulseframe.sources.reactor import read_reactor_archives, reactor_members
from pyspark.sql import functions as F


def test_line_numbers_over_file_blocks(spark, tmp_path):
    big = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a b+1%20.txt").write_text("\n".join(big) + "\n")
    (tmp_path / "crlf.txt").write_bytes(b"one\r\n\r\nthree")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("10000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_lines(spark, str(tmp_path)).collect()
            named = {}
            for r in rows:
                named.setdefault(r["source_file"].split("/")[-1], []).append((r["line_no"], r["value"]))
            assert sorted(named["a b+1%20.txt"]) == list(enumerate(big))
            assert sorted(named["crlf.txt"]) == [(0, "one"), (1, ""), (2, "three")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_decoding(spark, tmp_path):
    raw = bytes(b for b in range(256) if b not in (10, 13))
    (tmp_path / "t.txt").write_bytes(raw)
    for encoding, codec in (("cp1252", "cp1252"), ("latin-1", "latin-1")):
        (row,) = read_lines(spark, str(tmp_path), encoding=encoding).collect()
        assert row["value"] == raw.decode(codec, errors="replace")
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path), encoding="ebcdic")


@pytest.mark.parametrize("name, expected", [
    ("run", "run_00000"), ("run_7", "run_00007"), ("run_00012", "run_00012"), ("run_123456", "run_123456"),
    ("a_1.b", "a_1.b_00000"), ("a.b_3", "a.b_00003"), ("_5", "_00005"),
])
def test_file_names(spark, name, expected):
    df = spark.createDataFrame([(f"/x.y/{name}.csv",)], "p STRING")
    assert df.select(fx.normalized_file_name(F.col("p"))).first()[0] == expected


@pytest.mark.parametrize("text, expected", [
    ("6", 6), (" 7\n", 7), ("6.9", 6), ("-6.9", -6), ("1e3", 1000), ("x", None), ("", None), ("9007199254740993", 9007199254740993),
])
def test_int_from_text(spark, text, expected):
    assert spark.createDataFrame([(text,)], "s STRING").select(fx.int_from_text(F.col("s"))).first()[0] == expected


def test_csv_folder(spark, lines):
    head = "BOARD;CHANNEL;TIMETAG;ENERGY;FLAGS;SAMPLES"
    table = lines({
        "e1/UNFILTERED/SDataX.csv": [head, "0;1;18446744073709551615;5;0x4000;1;2;3", "0;1;2", "", "0;1;3;NA;7;1;2;3;4"],
        "e1/UNFILTERED/SDataX_1.csv": ["0;2;4;6;1;7;8;9", "  ", "0;2;5;6;1;7;8", "0;x;6;6;1;7;99999;9"],
    })
    rows = sorted(lm.parse_listmode_csv(table).collect(), key=lambda r: (r["source_file"], r["record_idx"]))
    got = [(r["record_idx"], r["CHANNEL"], None if r["TIMESTAMP"] is None else int(r["TIMESTAMP"]), r["ENERGY"],
            r["FLAGS"], r["samples"]) for r in rows]
    assert got == [
        (0, 1, 2**64 - 1, 5, 16384, [1, 2, 3]), (1, 1, 2, None, None, [None] * 3),
        (0, 2, 4, 6, 1, [7, 8, 9]), (1, 2, 5, 6, 1, [7, 8, None]), (2, None, 6, 6, 1, [7, None, 9]),
    ]
    assert {r["experiment_id"] for r in rows} == {"e1"}
    by_line = lm.parse_listmode_csv(table, gapless=False).collect()
    assert sorted(r["record_idx"] for r in by_line) == [0, 1, 2, 2, 3]


def test_csv_files_match_parsed_lines(spark, tmp_path):
    """Numbering where lines are read gives what numbering after a shuffle gives, for any file split."""
    head = "BOARD;CHANNEL;TIMETAG;ENERGY;FLAGS;SAMPLES"

    def body(start, count):
        out = []
        for i in range(start, start + count):
            line = f"0;1;{i};{i % 9};0x1;1;2;3"
            out.append(line + ";9" if i % 7 == 3 else "" if i % 11 == 5 else line[:-2] if i % 5 == 1 else line)
        return out

    files = {
        "a b/UNFILTERED/SData.csv": [head, "0;1;5;5;5;1;2;3"] + body(0, 2000),
        "a b/UNFILTERED/SData_1.csv": body(5000, 3000), "a b/UNFILTERED/SData_2.CSV": ["", "0;1;1;1;1;1;1;1;1;1"],
        "c/Data_CH0@x.csv": ["CHANNEL;ENERGY", "1;2"] + ["3;4"] * 500, "c/Data_CH1@x.csv": ["too;long;header", "5;6"],
    }
    for name, texts in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(texts) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    columns = ["source_file", "record_idx", "TIMESTAMP", "CHANNEL", "ENERGY", "FLAGS", "samples", "experiment_id"]
    try:
        for size in ("6000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted(map(str, lm.read_listmode_csv(spark, str(tmp_path)).select(*columns).collect()))
            want = sorted(map(str, lm.parse_listmode_csv(
                read_lines(spark, str(tmp_path), "*.[cC][sS][vV]")).select(*columns).collect()))
            assert got == want and len(got) > 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_without_samples_and_without_header(spark, lines):
    table = lines({"f/SData.csv": ["CHANNEL;ENERGY", "1;2", "1;2;3"], "f/SData_1.csv": ["3;4"]})
    got = sorted((r["CHANNEL"], r["ENERGY"], r["samples"]) for r in lm.parse_listmode_csv(table).collect())
    assert got == [(1, 2, None), (3, 4, None)]
    with pytest.raises(PySparkException, match="headers"):
        lm.parse_listmode_csv(lines({"f/SData_1.csv": ["3;4"]})).collect()


def test_hot_group_positions(spark):
    df = spark.range(5000).selectExpr("case when id % 10 < 9 then 'hot' else concat('f', id % 7) end source_file",
                                      "id * 3 as line_no")
    want = {}
    for r in df.orderBy("line_no").collect():
        want.setdefault(r[0], []).append(r[1])
    for got in (with_record_idx(df, bucket_rows=100).collect(),
                sorted_positions(df, [F.col("line_no")], ["source_file"], out="record_idx").collect()):
        seen = {}
        for r in got:
            seen.setdefault(r["source_file"], {})[r["record_idx"]] = r["line_no"]
        assert {k: [v[i] for i in range(len(v))] for k, v in seen.items()} == want


def test_spectra(spark, tmp_path):
    (tmp_path / "aEspectrum1.txt3").write_text("p\np\np\n0 5 0.0\n1.0 6.9 1.5\n")
    (tmp_path / "aPSDspectrum.txt").write_text("1\n2\n3\n4\n")
    (tmp_path / "aTspectrum.txt").write_text("1\n2\n")
    (tmp_path / "other.txt").write_text("9\n")
    got = spectra.read_spectra(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in got["energy"].collect()) == [(0, 0.0, 5, 0.0), (1, 1.0, 6, 1.5)]
    assert sorted(tuple(r)[1:] for r in got["psd"].collect()) == [(0, 1, 0.0), (1, 2, 0.25), (2, 3, 0.5), (3, 4, 0.75)]
    assert sorted(tuple(r)[1:] for r in got["time"].collect()) == [(0, 1, 0.0), (1, 2, 500000.0)]


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_reactor(spark, tmp_path):
    archive(tmp_path / "TB-100_20240101-123456789_data.tar.gz", [
        ("TB-100 Chamber Pressure 1.csv", b"Timestamp,p (\xb5bar)\n2024-01-02,2\n2024-01-01,1\n,9\n"),
        ("sub/TB-100 Chamber Pressure 2.csv", b"Timestamp,p (\xb5bar),q\n2024-01-01,3,4\n"),
        ("TB-100 Target Current 1.csv", b"Timestamp,c\n2024-01-05,NA\n"),
        ("TB-100 Bad One 1.csv", b"Timestamp,c\n1,2\n1,2,3,4,5\n"),
        ("notes.txt", b"x"), ("other.csv", b"a\n1\n"),
    ])
    archive(tmp_path / "TB-200_20240101-123456789_data.tar.gz", [("TB-200 A 1.csv", b"Timestamp\n1\n")])
    (tmp_path / "TB-300_1_data.tar.gz").write_bytes(b"not picked")
    merged = rx.merge_reactor_indexed(read_reactor_archives(spark, str(tmp_path)))
    got = [(r["device_param"], r["row_idx"], r["Timestamp"], r["fields"]) for r in
           merged.orderBy("device_param", "row_idx").collect()]
    assert got == [
        ("Chamber Pressure", 0, "2024-01-01", {"p (µbar)": "1"}),
        ("Chamber Pressure", 1, "2024-01-01", {"p (µbar)": "3", "q": "4"}),
        ("Chamber Pressure", 2, "2024-01-02", {"p (µbar)": "2"}),
        ("Chamber Pressure", 3, None, {"p (µbar)": "9"}),
        ("Target Current", 0, "2024-01-05", {}),
    ]
    report = {r["member"]: r["ok"] for r in reactor_members(spark, str(tmp_path)).collect()}
    assert report == {
        "TB-100 Chamber Pressure 1.csv": True, "sub/TB-100 Chamber Pressure 2.csv": True,
        "TB-100 Target Current 1.csv": True, "TB-100 Bad One 1.csv": False, "notes.txt": False, "other.csv": False,
    }
    typed = rx.typed_parameter(read_reactor_archives(spark, str(tmp_path)), "Chamber Pressure", {"p (µbar)": "double"})
    assert sorted(r["p (µbar)"] for r in typed.collect()) == [1.0, 2.0, 3.0, 9.0]
    (tmp_path / "TB-050_20240101-123456789_data.tar.gz").write_bytes(b"\x1f\x8bbroken")
    (row,) = reactor_members(spark, str(tmp_path)).collect()
    assert not row["ok"] and row["archive"].endswith("TB-050_20240101-123456789_data.tar.gz")


def test_member_pieces_give_the_rows_of_the_whole_member():
    cells = ["1", "", "NA", '"a,b"', '"a\nb"', '"a""b"', 'x"y', '"q"z', " ", "é"]
    picks = random.Random(7)
    for case in range(400):
        end = picks.choice(["\n", "\r\n"])
        width = picks.choice([1, 2, 3])
        lines = ["Timestamp,p,q"]
        for _ in range(picks.randrange(12)):
            lines.append(",".join(picks.choice(cells) for _ in range(width)))
            lines += ["", "  "][:picks.randrange(3)]
        data = (end.join(lines) + end * picks.randrange(2)).encode("cp1252")
        want = pd.read_csv(io.BytesIO(data), encoding="windows-1252", dtype=str)
        pieces = list(reactor.member_pieces(io.BytesIO(data), picks.choice([1, 7, 30, 1000])))
        frames = [reactor.piece_frame(head, body) for _, _, head, body in pieces]
        got = pd.concat(frames, ignore_index=True)
        assert got.astype(object).where(got.notna(), None).values.tolist() == \
            want.astype(object).where(want.notna(), None).values.tolist(), data
        assert [first for _, first, _, _ in pieces] == [sum(map(len, frames[:n])) for n in range(len(frames))], data
        assert [part for part, *_ in pieces] == list(range(len(pieces)))


def test_reactor_long_members(spark, tmp_path):
    lines = [f'{n},"v\n{n}"\n' for n in range(300_000)]
    good = "".join(["Timestamp,v\n", *lines]).encode()
    archive(tmp_path / "TB-1_20240101-123456789_data.tar.gz", [
        ("TB-1 Long 1.csv", good), ("TB-1 Long 2.csv", good + b"1,2,3\n"), ("TB-1 Empty 1.csv", b""),
        ("TB-1 Open 1.csv", b'Timestamp,v\n1,"2\n'), ("TB-1 Long 1.csv", b"Timestamp\n5\n")])
    rows = read_reactor_archives(spark, str(tmp_path))
    got = rows.groupBy("device_param", "seq").agg(
        F.count("*"), F.count_distinct("line_no"), F.max("line_no"),
        F.count_if(F.col("fields")["v"] == F.concat(F.lit("v\n"), F.col("Timestamp")))).collect()
    assert [tuple(r) for r in got] == [("Long", 1, 300_001, 300_000, 299_999, 300_000)]
    assert rows.rdd.getNumPartitions() > 1
    report = [(r["member"], r["ok"]) for r in reactor_members(spark, str(tmp_path)).collect()]
    assert sorted(report) == [("TB-1 Empty 1.csv", False), ("TB-1 Long 1.csv", True), ("TB-1 Long 1.csv", True),
                              ("TB-1 Long 2.csv", False), ("TB-1 Open 1.csv", False)]


def test_reactor_cut_archive(spark, tmp_path):
    body = "Timestamp\n" + "".join(f"{random.Random(n).random()}\n" for n in range(200_000))
    path = tmp_path / "TB-1_20240101-123456789_data.tar.gz"
    archive(path, [("TB-1 A 1.csv", b"Timestamp\n1\n"), ("TB-1 B 1.csv", body.encode())])
    path.write_bytes(path.read_bytes()[:-200_000])
    assert [r["device_param"] for r in read_reactor_archives(spark, str(tmp_path)).collect()] == ["A"]
    report = {r["member"]: r["ok"] for r in reactor_members(spark, str(tmp_path)).collect()}
    assert report == {"TB-1 A 1.csv": True, "TB-1 B 1.csv": False}


def test_dose_log(spark, tmp_path):
    day = "2024-03-10\t{}\t1.5\tµSv/h\t2\tcps\tok"
    text = ["FH40G-L10", "", "serial 1", "unit", "   ", "DATE\tTIME\tetc", day.format("01:59:59"),
            day.format("03:00:00"), day.format("04:00:00") + "\tsurplus", "", "2024-03-10\t05:00:00\tx"]
    (tmp_path / "w.log").write_bytes("\r\n".join(text).encode("cp1252"))
    rows = sorted(doselog.read_wendi_log(spark, str(tmp_path), "America/Chicago").collect())
    utc = [r["DATETIME"].astimezone(datetime.timezone.utc).strftime("%H:%M:%S") if r["DATETIME"].tzinfo else
           r["DATETIME"].strftime("%H:%M:%S") for r in rows]
    assert utc == ["07:59:59", "08:00:00", "10:00:00"]
    assert [(r["VALUE_INT"], r["UNIT_INT"], r["STATUS"]) for r in rows] == [
        (1.5, "µSv/h", "ok"), (1.5, "µSv/h", "ok"), (None, None, None)]


@pytest.mark.parametrize("date, time, gap, twice", [
    ("2024-03-10", "02:30:00", True, False), ("2024-11-03", "01:30:00", False, True),
    ("2024-11-03", "02:00:00", False, False), ("2024-07-01", "12:00:00", False, False),
])
def test_dst(spark, lines, date, time, gap, twice):
    table = lines({"w": ["FH40G", "a", "b", "c", f"{date}\t{time}\t1\tu\t2\tv\tok"]})
    (row,) = doselog.parse_wendi_log(table, "America/Chicago", on_dst="flag").collect()
    assert (row["dst_gap"], row["dst_ambiguous"]) == (gap, twice)
    assert doselog.parse_wendi_log(table, "America/Chicago", on_dst="resolve").count() == 1
    strict = doselog.parse_wendi_log(table, "America/Chicago")
    if gap or twice:
        with pytest.raises(PySparkException, match="wall time"):
            strict.collect()
    else:
        assert len(strict.collect()) == 1


def test_run_info(spark, lines):
    table = lines({
        "d/a/run.info": ["id=TB-100", "time.start=2023/01/05 23:30:00.123-0600", "id=TB-2"],
        "d/b/run.info": ["time.start=2023/01/05 23:30:00.123-0600", "x"],
        "d/c/run.info": ["id=TB-1", "x"], "d/d/run.info": ["id=TB-1", "time.start=yesterday"],
        "d/e/run.info": ["id=TB-1"],
    })
    got = {r["source_file"].split("/")[1]: r for r in metadata.parse_run_info(table).withColumn(
        "ms", F.unix_millis("exp_start")).collect()}
    assert (got["a"]["exp_id"], got["a"]["ms"], got["a"]["reason"]) == ("20230105_TB-100", 1672983000123, "OK")
    assert [got[k]["exp_id"] for k in "bcd"] == [None] * 3
    assert got["d"]["reason"] == "Start time is malformed"
    folders = spark.createDataFrame(
        [(f"d/{k}", "2024/01/02-03:04") for k in ("a", "e", "ID-7", "plain")] + [("d/bad", "soon")],
        "folder STRING, start_time STRING")
    full = {r["folder"]: r for r in metadata.run_info(table, folders, "America/Chicago").collect()}
    assert full["d/a"]["from_run_info_file"] and full["d/a"]["exp_id"] == "20230105_TB-100"
    assert (full["d/e"]["exp_id"], full["d/e"]["from_run_info_file"]) == ("20240102_TB-e", False)
    assert full["d/ID-7"]["exp_id"] == "20240102_ID-7" and full["d/plain"]["exp_id"] == "20240102_TB-plain"
    assert full["d/bad"]["exp_id"] is None


def test_device_log(spark, tmp_path):
    (tmp_path / "log.csv").write_bytes("eRep,curr,t1,1,µA\nxx,yy,t2,2,u\n,curr,t3,3,u\nuwGen,curr,t4,4,A\n".encode("latin-1"))
    log = devicelog.read_device_log(spark, str(tmp_path / "log.csv"))
    got = {r["Time"]: (r["name"], r["Unit"]) for r in devicelog.name_parameters(log).collect()}
    assert got == {"t1": ("Target Current", "µA"), "t2": (None, "u"), "t4": ("Microwave Generator Current", "A")}
    assert devicelog.group_parameters(log).count() == 3
    with pytest.raises(PySparkException, match="unknown device parameter xx/yy"):
        devicelog.name_parameters(log, strict=True).collect()


def test_log_levels(spark):
    assert list(logs.LEVELS) == ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "NOTSET"]
    with pytest.raises(ValueError):
        logs.at_least(None, "LOUD")


def test_classification_and_limit(spark):
    root = ["run.info", "settings.xml", "FILTERED/a", "RAW/a"]
    files = [("bin", p, None) for p in root + ["UNFILTERED/x.BIN", "UNFILTERED/SData.csv"]]
    files += [("single", p, None) for p in root + ["UNFILTERED/SData.csv", "UNFILTERED/Data_CH0.csv"]]
    files += [("dual", p, None) for p in root + ["UNFILTERED/Data_CH0.csv"]]
    files += [("bare", p, None) for p in root] + [("noinfo", p, None) for p in root[1:] + ["UNFILTERED/x.bin"]]
    files += [("meter", "w.log", "FH40G-L10"), ("text", "w.log", "hello"), ("meter2", "w.txt", "FH40G-L10")]
    got = dict(tuple(r) for r in classify_sources(
        spark.createDataFrame(files, "root STRING, path STRING, head STRING")).collect())
    assert got == {
        "bin": "listmode_bin", "single": "listmode_csv_single", "dual": "listmode_csv_dual", "bare": "unsupported",
        "noinfo": "unsupported", "meter": "dose_meter", "text": "unsupported", "meter2": "unsupported",
    }
    manifest = spark.createDataFrame([(f"d/{n}",) for n in ("a1.csv", "b1.CSV", "b2.csv", "b0.txt")], "path STRING")
    assert sorted(r[0] for r in limit_files(manifest, ".csv", 2, "b").collect()) == ["d/b1.CSV"]
    assert limit_files(manifest, ".csv", 0).count() == 3 and limit_files(manifest, ".csv").count() == 3


def test_bin_low_bounds_follow_the_customary_order(spark, lines):
    rows = spectra.parse_psd_spectrum(lines({"x": ["1"] * 49})).collect()
    width = 1 / 49
    assert all(math.isclose(r["bin_psd"], r["bin_idx"] * width, rel_tol=0, abs_tol=0) for r in rows)


def naive_lines(data):
    """Lines as universal newlines give them, without a last empty one."""
    text = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    return text.split(b"\n")[:-1] if text.endswith(b"\n") else text.split(b"\n") if text else []


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, size, offset):
        return self.data[offset:offset + size]


@settings(max_examples=300, deadline=None)
@given(st.text("ab\n\r", max_size=40), st.integers(1, 12), st.integers(1, 9), st.lists(st.integers(0, 40), max_size=4))
def test_byte_ranges_give_whole_lines(text, split, chunk, stops):
    """Any cut of a file into ranges and chunks gives its lines once, in order."""
    data = text.encode()
    handle, size = Bytes(data), len(data)
    got, counted = [], 0
    for start in range(0, size, split):
        stop = min(start + split, size)
        for block in fmt.line_blocks(handle, size, start, stop, chunk):
            got += [t.encode() for t in block.texts().to_pylist()]
        counted += fmt.count_lines(handle, size, start, stop)
    assert got == naive_lines(data) and counted == len(got)
    # As the file grows: a line is given when its line feed is there.
    seen, at = [], 0
    for stop in sorted({min(s, size) for s in stops} | {size}):
        seen += list(fmt.completed_lines(handle, at, stop, chunk)) if stop > at else []
        at = stop
    assert [t for _, t in seen] == [t.removesuffix(b"\r") for t in data.split(b"\n")[:-1]]
    assert all(o == 0 or data[o - 1] == 10 for o, _ in seen)


def test_csv_scan_shuffles_no_lines(spark, tmp_path, monkeypatch):
    """Spans carry all that is needed: with no broadcast allowed, lines are neither exchanged nor joined."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    folder = tmp_path / "e1" / "UNFILTERED"
    folder.mkdir(parents=True)
    (folder / "SData.csv").write_text("CHANNEL;BASELINE;ENERGY;NOTE\n0;1.5;5;NA\n\n1;2;3;4;5\n")
    (folder / "SData_1.csv").write_text("".join(f"1;b{i};{i}\n" for i in range(500)))
    rows = lm.read_listmode_csv(spark, str(tmp_path), split_bytes=64)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Join" not in plan[:plan.index("MapInArrow")] and "Exchange" not in plan[:plan.index("MapInArrow")]
    assert below.count("RoundRobinPartitioning") == 1  # spans, not lines, are dealt out
    by_file = {}
    for r in rows.collect():
        by_file.setdefault(r.source_file.split("/")[-1], []).append((r.record_idx, r.CHANNEL, r.ENERGY, r.extra))
    assert by_file["SData.csv"] == [(0, 0, 5, {"BASELINE": "1.5", "NOTE": None})]
    assert sorted(by_file["SData_1.csv"], key=lambda r: r[0]) == [
        (i, 1, i, {"BASELINE": f"b{i}", "NOTE": None}) for i in range(500)]
    text = lm.parse_listmode_csv(read_lines(spark, str(tmp_path), "*.csv", split_bytes=50))
    columns = ["record_idx", "CHANNEL", "ENERGY", "extra"]
    assert sorted(map(str, text.select(*columns).collect())) == sorted(map(str, rows.select(*columns).collect()))


def test_csv_headers_come_from_the_right_files(spark, tmp_path):
    folder = tmp_path / "e1" / "UNFILTERED"
    (folder / "old").mkdir(parents=True)
    (folder / "AAA.csv").write_text("X\n1\n")
    (folder / "SData.csv").write_text("CHANNEL;ENERGY\n0;5\n")
    (folder / "SData_1.csv").write_text("0;6\n")
    (folder / "old" / "x_1.csv").write_text("7;8\n")  # no header there
    dest = str(tmp_path / "out")
    convert_listmode_csv(spark, str(folder), dest, prefix="SData")
    assert sorted(r.ENERGY for r in sinks.read_listmode_table(spark, dest).collect()) == [5, 6]
    convert_listmode_csv(spark, str(folder), dest + "2", prefix="SData", file_limit=2)  # AAA.csv and SData.csv
    assert [r.ENERGY for r in sinks.read_listmode_table(spark, dest + "2").collect()] == [5]
    with pytest.raises(Exception, match="Could not find csv file with headers"):
        lm.read_listmode_csv(spark, str(folder), prefix="[Sx]").collect()
    (folder / "old" / "a.csv").write_text("Y\n1;2\n1;2\n")
    with pytest.raises(ValueError, match="no line fits"):
        lm.read_listmode_csv(spark, str(folder / "old"))


def test_listing_of_empty_folders_and_files(spark, tmp_path):
    """Presence of experiments whose folders are empty; files below folders do not change a folder's time."""
    for stage, names in {"unc": ["ID-UNC", "ID-UNC-CON", "ID-UNC-PRO", "ID-ALL"], "con": ["ID-UNC-CON", "ID-CON-PRO", "ID-ALL"],
                         "pro": ["ID-UNC-PRO", "ID-CON-PRO", "ID-ALL"]}.items():
        for name in names:
            (tmp_path / stage / name).mkdir(parents=True)
    (tmp_path / "unc" / "stray.txt").write_text("")
    (tmp_path / "pro" / "ID-ALL" / "result.csv").write_text("")
    roots = [str(tmp_path / s) for s in ("unc", "con", "pro")]
    rows = {r.id: r for r in current_inventory(spark, *roots).collect()}
    seen = {i: tuple(r[f"{s}_state"] for s in ("unconverted", "converted", "processed")) for i, r in rows.items()}
    assert seen == {
        "ID-UNC": ("present", "absent", "absent"), "ID-UNC-CON": ("present", "malformed", "absent"),
        "ID-UNC-PRO": ("present", "absent", "malformed"), "ID-CON-PRO": ("absent", "malformed", "malformed"),
        "ID-ALL": ("present", "malformed", "present")}
    assert rows["ID-UNC"].unconverted_mtime == pytest.approx((tmp_path / "unc" / "ID-UNC").lstat().st_mtime * 1000, abs=0.01)
    files = {r.path.rsplit("/", 1)[-1]: r.length for r in list_files(spark, str(tmp_path)).collect()}
    assert files == {"stray.txt": 0, "result.csv": 0}
    assert list_files(spark, f"{tmp_path}/*/ID-ALL", "*.[cC]SV").count() == 0
    assert list_files(spark, [f"{tmp_path}/p*", f"{tmp_path}/unc"], "*.*").count() == 2


def test_sources_are_classified_from_storage(spark, tmp_path):
    def put(*paths, text=""):
        for path in paths:
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(text)

    for name in "abcde":
        put(f"{name}/run.info", f"{name}/settings.xml")
        for folder in ("RAW", "FILTERED", "UNFILTERED"):
            (tmp_path / name / folder).mkdir(parents=True, exist_ok=True)
    put("a/UNFILTERED/SData_1.BIN", "a/UNFILTERED/SData.csv", "b/UNFILTERED/SData_1.csv", "c/UNFILTERED/Data_CH0.CSV",
        "d/UNFILTERED/deep/SData_1.bin", "e/RAW/SDataR_2.bin", "e/UNFILTERED/SData_1.bin", "e/plain.log", "f/UNFILTERED/SData_1.bin")
    put("day.LOG", text="FH40G-L10\nx\n")
    sources = ["a", "b/UNFILTERED", "c", "c/UNFILTERED", "d", "e/RAW", "e/plain.log", "e/UNFILTERED/SData_1.bin", "f", "day.LOG"]
    table = spark.createDataFrame([(f"{tmp_path}/{s}",) for s in sources], "source STRING")
    short = lambda p: None if p is None else p.removeprefix(f"{tmp_path}/")
    got = {short(r.source): (short(r.root), r.source_class) for r in classified_sources(table).collect()}
    assert got == {
        "a": ("a", "listmode_bin"), "b/UNFILTERED": ("b", "listmode_csv_single"), "c": ("c", "listmode_csv_dual"),
        "c/UNFILTERED": (None, "unsupported"), "d": (None, "unsupported"), "e/RAW": ("e", "listmode_bin"),
        "e/plain.log": ("e", "listmode_bin"), "e/UNFILTERED/SData_1.bin": ("e", "listmode_bin"), "f": (None, "unsupported"),
        "day.LOG": ("day.LOG", "dose_meter")}


def test_a_folder_of_many_logs_is_listed_once(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"day-{i}.log").write_text("FH40G\n" if i % 2 else "other\n")
    table = spark.createDataFrame([(f"{tmp_path}/day-{i}.log",) for i in range(40)] * 2, "source STRING")
    found = source_roots(table)
    assert source_manifest(found).count() == 20 + 40  # each dose log, and the entries of the folder of the others
    got = {r.source.rsplit("-", 1)[-1]: (r.root, r.source_class) for r in classified_sources(table).collect()}
    assert got == {f"{i}.log": (f"{tmp_path}/day-{i}.log", "dose_meter") if i % 2 else (None, "unsupported") for i in range(40)}


def test_files_read_in_rounds_are_removed(spark, lines):
    names = [f"data/{k}/run.info" for k in range(40)]
    table = lines({name: ["run", f"id={name}"] for name in names})
    seen = []

    def read(root):
        seen.append((root, list_files(spark, root).count()))
        return read_lines(spark, root, "run.info")

    got = si.read_in_rounds(table, "rounds", read, files_per_round=10)
    assert sorted(r["value"] for r in got.where("line_no = 1").collect()) == sorted(f"id={name}" for name in names)
    assert got.count() == 80 and len(seen) == 4
    assert max(n for _, n in seen) < 40 and sum(n for _, n in seen) == 40
    assert not any(os.path.exists(root) for root, _ in seen)


def test_run_info_scan_leaves_no_files(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS o_orderkey, DATE'2024-01-02' AS o_orderdate, 'O' AS o_orderstatus, id AS o_custkey, 1.0 AS o_totalprice,
        CASE id % 3 WHEN 0 THEN '5-LOW' WHEN 1 THEN '3-MEDIUM' ELSE '4-NOT SPECIFIED' END AS o_orderpriority
        FROM range(30)""").write.parquet(f"{tmp_path}/orders.parquet")
    made = []

    def scratch(session, label):
        made.append(f"{tmp_path}/{label}-{len(made)}")
        return made[-1]

    monkeypatch.setattr(si, "scratch_path", scratch)
    got = queries.run_info_scan(spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(queries.run_info(spark, str(tmp_path)).collect(), key=str) and len(got) == 30
    assert made and not list(tmp_path.rglob("run.info"))


def test_small_files_share_tasks_of_lines():
    from pulseframe.sources.lines import LINE_FILES_PER_TASK, cut

    size, tasks = cut(6_000_000, 150_000, 8, files_per_task=LINE_FILES_PER_TASK)
    assert size == 4 << 20 and tasks < 200  # 2,346 before
    assert cut(6_000, 150, 8, files_per_task=LINE_FILES_PER_TASK) == (4 << 20, 8)
