"""Many small files: written, read and removed in rounds."""

import os

from pulseframe.plans import stand_ins as si
from pulseframe.sources import lines as line_source
from pulseframe.sources.files import list_files, remove_files_in, write_files
from pulseframe.sources.lines import read_lines


def test_whole_files_are_not_counted(spark, tmp_path, monkeypatch):
    labels = []
    original = line_source.materialize
    monkeypatch.setattr(line_source, "materialize", lambda df, label: labels.append(label) or original(df, label))
    for name, count in (("a", 3), ("b", 40), ("c", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(count)))
    want = sorted([("a", i, f"a{i}") for i in range(3)] + [("b", i, f"b{i}") for i in range(40)])

    def rows(path, **options):
        found = read_lines(spark, path, **options).collect()
        return sorted((r.source_file[-5], r.line_no, r.value) for r in found)

    assert rows(str(tmp_path)) == want
    assert labels == ["text-files"]
    assert rows(str(tmp_path), split_bytes=20) == want
    assert labels[1:] == ["text-files", "line-counts"]
    one = str(tmp_path / "a.txt")
    assert [n for _, n, _ in rows([one, one])] == list(range(6))  # named twice: numbered on, as before
    assert rows(str(tmp_path), glob="*.none") == []


def test_empty_folders_are_renamed_to_new_ones(spark, tmp_path):
    root = f"file://{tmp_path}/part"
    write_files(root, {f"data/{k}/run.info": b"old" for k in range(3)})
    (tmp_path / "part/data/2/other").write_text("x")
    inodes = {(tmp_path / f"part/data/{k}").stat().st_ino for k in range(2)}
    remove_files_in(spark.createDataFrame([(f"{root}/data/0",), (f"{root}/data/1",), (f"{root}/none",)], "path STRING"))
    assert not (tmp_path / "part/data/0/run.info").exists() and (tmp_path / "part/data/0").is_dir()
    write_files(root, {"data/8/run.info": b"8", "data/9/run.info": b"9", "data/10/deep/run.info": b"10", "top.info": b"t"})
    found = {str(p.relative_to(tmp_path / "part")): p.read_text() for p in (tmp_path / "part").rglob("*") if p.is_file()}
    assert found == {"data/2/run.info": "old", "data/2/other": "x", "data/8/run.info": "8", "data/9/run.info": "9",
                     "data/10/deep/run.info": "10", "top.info": "t"}
    assert inodes < {p.stat().st_ino for p in (tmp_path / "part").rglob("*") if p.is_dir()}
    write_files(root, {"data/8/run.info": b"again"})
    assert (tmp_path / "part/data/8/run.info").read_text() == "again"


def test_rounds_use_folders_again(spark, lines, monkeypatch):
    monkeypatch.setattr(si, "ROUNDS_AT_ONCE", 2)
    names = [f"data/{k}/run.info" for k in range(60)]
    table = lines({name: ["run", f"id={name}"] for name in names})
    seen = []

    def read(root):
        seen.append((root, list_files(spark, root).count()))
        return read_lines(spark, root, "run.info")

    got = si.read_in_rounds(table, "rounds", read, files_per_round=10).collect()
    assert sorted(r["value"] for r in got if r["line_no"]) == sorted(f"id={name}" for name in names) and len(got) == 120
    assert len(seen) == 6 and len({root for root, _ in seen}) == 2 and sum(n for _, n in seen) == 60
    assert not any(os.path.exists(root) for root, _ in seen)
