import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pulseframe import sinks
from pulseframe.session import prepare
from pulseframe.sources import lines
from pulseframe.sources.files import joined


def _files(root):
    return sorted(os.path.relpath(os.path.join(at, n), root) for at, _, names in os.walk(root) for n in names
                  if n.endswith(".parquet"))


def test_partitions_are_those_of_the_plain_writer(spark, tmp_path):
    odd = ["a/b:c%41", "é ü", "", None, "1=2", "[x]{y}^", "tab\there", "007"]
    rows = spark.createDataFrame(
        [(e, c, i, [i, None], {"k": None}) for i in range(3) for e in odd for c in (0, None)],
        "experiment_id STRING, CHANNEL SMALLINT, n BIGINT, samples ARRAY<SMALLINT>, extra MAP<STRING,STRING>")
    rows = rows.withColumn("big", F.lit("18446744073709551615").cast("decimal(20,0)")).withColumn(
        "at", F.timestamp_seconds(F.col("n") - 5_000_000_000)).withColumn("wall", F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"))
    keys = ["experiment_id", "CHANNEL"]
    sinks._writer(rows, keys, True).parquet(f"{tmp_path}/plain")
    sinks._write_partitions(rows, f"{tmp_path}/ours", keys, True)
    plain, ours = ({os.path.dirname(f) for f in _files(tmp_path / n)} for n in ("plain", "ours"))
    assert plain == ours and len(ours) == 14  # the empty text and null share a folder
    one, other = (spark.read.schema(rows.schema).parquet(f"{tmp_path}/{n}").select(*rows.columns) for n in ("plain", "ours"))
    as_text = [F.to_json(F.struct(*rows.columns)).alias("row")]
    assert sorted(r[0] for r in one.select(as_text).collect()) == sorted(r[0] for r in other.select(as_text).collect())
    assert [f.dataType for f in spark.read.parquet(f"{tmp_path}/ours/experiment_id=007/CHANNEL=0").schema] == [
        f.dataType for f in rows.drop(*keys).schema]
    assert not [n for n in os.listdir(tmp_path / "ours") if "=" not in n]  # nothing is left aside


def test_only_partitions_at_hand_are_replaced(spark, tmp_path):
    def rows(ids, n):
        return spark.range(n).select(F.explode(F.array(*map(F.lit, ids))).alias("e"), "id")

    for fresh in (False, True):
        dest = f"{tmp_path}/{fresh}"
        sinks._write_partitions(rows("ab", 5), dest, ["e"], fresh)
        sinks._write_partitions(rows("bc", 3), dest, ["e"], fresh, per_file=1)
        got = dict(spark.read.parquet(dest).groupBy("e").count().collect())
        assert got == {"a": 5, "b": 3 if fresh else 8, "c": 3}
        assert len([f for f in _files(dest) if f.startswith("e=c/")]) == 3
    sinks._write_partitions(rows("a", 0), f"{tmp_path}/none", ["e"], True)
    assert spark.read.schema("id BIGINT, e STRING").parquet(f"{tmp_path}/none").count() == 0


def test_failed_write_changes_no_partition(spark, tmp_path):
    sinks._write_partitions(spark.range(5).selectExpr("'a' AS e", "id"), f"{tmp_path}/t", ["e"], True)
    bad = spark.range(50).select(F.lit("a").alias("e"), F.when(F.col("id") == 49, F.raise_error(F.lit("no"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks._write_partitions(bad, f"{tmp_path}/t", ["e"], True)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5 and os.listdir(tmp_path / "t") == ["e=a"]


def test_files_moved_again_stay(tmp_path):
    (tmp_path / "dest/_aside/x").mkdir(parents=True)
    (tmp_path / "dest/e=a").mkdir()
    (tmp_path / "dest/e=a/old.parquet").write_text("old")
    for n in "12":
        (tmp_path / f"dest/_aside/x/{n}").write_text(n)
    place = sinks._placed(f"{tmp_path}/dest/_aside", f"{tmp_path}/dest", True)
    for _ in range(2):  # as a task does that is tried again
        list(place([pa.RecordBatch.from_pylist([{"folder": "e=a", "files": ["x/1", "x/2"]}])]))
    assert sorted(os.listdir(tmp_path / "dest/e=a")) == ["1", "2"]
    with pytest.raises(OSError):
        list(place([pa.RecordBatch.from_pylist([{"folder": "e=a", "files": ["x/3"]}])]))


def test_runs_of_rows_over_batches():
    def batch(keys):
        return pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.string()), "n": pa.array(range(len(keys)), pa.int64())})

    found = [(folder, piece.num_rows) for folder, piece in sinks._pieces([batch([None, "a", "a"]), batch([]), batch(["a", "b"])], ["k"])]
    assert found == [("k=__HIVE_DEFAULT_PARTITION__", 1), ("k=a", 2), ("k=a", 1), ("k=b", 1)]


def test_small_files_share_a_batch(tmp_path):
    rows = []
    for i in range(50):
        (tmp_path / f"{i}").write_text(f"{i}\nx\n")
        rows.append({"path": f"{tmp_path}/{i}", "length": (tmp_path / f"{i}").stat().st_size, "split": 0, "start": 0,
                     "stop": (tmp_path / f"{i}").stat().st_size, "first": 0})
    found = list(lines.over_spans(lines._read)([pa.RecordBatch.from_pylist(rows)]))
    assert len(found) == 1 and found[0].num_rows == 100
    large = pa.RecordBatch.from_pydict({"v": ["x" * 1000] * 10})
    assert [b.num_rows for b in joined([large] * 5, size=20_000)] == [20, 20, 10]


def test_values_have_no_numbers_and_all_lines(spark, tmp_path):
    texts = {"a/conversion.log": "x\r\ny\n\nz", "b/conversion.log": "", "b/other.log": "no\n", "_c/conversion.log": "no\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = lines.read_values(spark, str(tmp_path), "conversion.log").collect()
    assert [(r["source_file"].split("/")[-2], r["value"]) for r in got] == [("a", v) for v in ("x", "y", "", "z")]


def test_folders_are_listed_by_few_tasks(spark):
    prepare(spark)
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 4 * spark.sparkContext.defaultParallelism
