"""Steps of a conversion that do not wait for each other, and those that have nothing to do."""

import threading

import pytest
from binfile import record, write
from pulseframe import sinks
from pulseframe.operators import joins
from pulseframe.plans.conversion import convert_folder
from pulseframe.session import ITEMS_PER_TASK, known_empty, side_by_side, tasks_for
from pulseframe.sources import reactor
from pyspark.sql import functions as F


def source(folder, csv=None):
    for name in ("RAW", "FILTERED", "UNFILTERED"):
        (folder / name).mkdir(parents=True)
    (folder / "run.info").write_text(f"id={folder.name}\ntime.start=2023/01/05 23:30:00.123-0600\n")
    (folder / "settings.xml").write_text("")
    if csv is None:
        write(folder / "UNFILTERED" / "SData_1.bin", 0, [record(0, timestamp=i) for i in range(3)])
    for name, text in (csv or {}).items():
        (folder / "UNFILTERED" / name).write_text(text)


def test_steps_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)
    done = []

    def step(n):
        both.wait()
        done.append(spark.range(n).count())
        if n == 3:
            raise ValueError("three")
        return n

    assert side_by_side(spark, [lambda: step(1), lambda: step(2)], 2) == [1, 2]
    assert side_by_side(spark, [], 0) == []
    with pytest.raises(ValueError, match="three"):
        side_by_side(spark, [lambda: step(3), lambda: step(4)], 2)
    assert sorted(done) == [1, 2, 3, 4]


def test_conversion_passes_over_what_is_not_there(spark, tmp_path, monkeypatch):
    """No spectrum file and no archive: nothing is staged, counted or parsed for them."""
    labels = []
    for module in (sinks, joins, reactor):
        original = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, f=original: labels.append(label) or f(df, label))
    source(tmp_path / "in/TB-1")
    source(tmp_path / "in/TB-2", {"SData.csv": "CHANNEL;ENERGY\n0;4\n"})
    convert_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), fresh=True)
    assert labels.count("written-files") == 2  # the binary and the delimited rows; before also the three spectra
    assert not {"bin-counts", "archive-rows", "failed-members"} & set(labels)
    rows = sinks.read_listmode_table(spark, f"{tmp_path}/out/listmode")
    assert sorted((r[0], r[1]) for r in rows.groupBy("experiment_id").count().collect()) == [("TB-1", 3), ("TB-2", 1)]
    assert sinks.read_experiments(spark, f"{tmp_path}/out/experiments").count() == 2
    assert not [p for p in (tmp_path / "out/spectra").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]


def test_a_class_that_fails_leaves_the_others_whole(spark, tmp_path):
    source(tmp_path / "in/TB-1")
    source(tmp_path / "in/TB-2", {"SData.csv": "CHANNEL;ENERGY\n1;2;3\n"})
    source(tmp_path / "in/TB-3", {"Data_CH0.csv": "CHANNEL;ENERGY\n0;4\n"})
    with pytest.raises(ValueError, match="no line fits the header"):
        convert_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), fresh=True, log_root=str(tmp_path / "logs"))
    assert not (tmp_path / "logs").exists()
    rows = sinks.read_listmode_table(spark, f"{tmp_path}/out/listmode")
    assert sorted((r[0], r[1]) for r in rows.groupBy("experiment_id").count().collect()) == [("TB-1", 3), ("TB-3", 1)]
    assert not list((tmp_path / "out/listmode").glob("_aside-*"))


def test_few_items_take_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [tasks_for(spark, n) for n in (0, 1, ITEMS_PER_TASK, ITEMS_PER_TASK + 1)] == [1, 1, 1, 2]
    assert tasks_for(spark, 10**9) == cores


def test_plans_that_tell_they_are_empty(spark):
    none = spark.createDataFrame([], "a STRING, b BIGINT").limit(0)
    assert known_empty(none) and known_empty(none.groupBy("a").agg(F.sum("b"))) and not known_empty(spark.range(3).where("id > 5"))
    assert joins.measured(none).collect() == []
