import re

import pytest
from pyspark.sql import functions as F

from pulseframe import schemas
from pulseframe.operators import inventory as inv
from pulseframe.operators import overrides as ovr
from pulseframe.operators.pattern_index import required_literals
from pulseframe.plans.analysis import plan_analyses, plan_processing
from pulseframe.plans.inventory_view import current_inventory, inventory_query
from pulseframe.sources.tables import load_overrides, save_overrides

FIVE = {
    "ID-UNC": ["unconverted"], "ID-UNC-CON": ["unconverted", "converted"],
    "ID-UNC-PRO": ["unconverted", "processed"], "ID-CON-PRO": ["converted", "processed"],
    "ID-ALL": ["unconverted", "converted", "processed"],
}


@pytest.fixture
def five(spark):
    rows = [(stage, i, 1000.0) for i, stages in FIVE.items() for stage in stages]
    present = inv.build_inventory(spark.createDataFrame(rows, schemas.LISTING))
    nothing = spark.createDataFrame([], "id STRING, contents STRING")
    no_files = spark.createDataFrame([], "id STRING, file_name STRING, depth INT")
    return inv.mark_processed(inv.mark_converted(present, nothing), no_files)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("name, expected", [
    ("all", sorted(FIVE)),
    ("to_be_converted", ["ID-UNC", "ID-UNC-PRO"]),
    ("to_be_processed", ["ID-UNC-CON"]),
    ("to_be_analyzed", ["ID-UNC", "ID-UNC-CON", "ID-UNC-PRO"]),
])
def test_filters(five, name, expected):
    assert ids(inv.filter_inventory(five, name)) == expected


def test_unknown_filter_and_sort(five):
    with pytest.raises(ValueError):
        inv.filter_inventory(five, "nope")
    with pytest.raises(ValueError):
        inv.sort_inventory(five, "nope")


@pytest.mark.parametrize("kwargs, convert, process", [
    ({}, ["ID-UNC", "ID-UNC-PRO"], ["ID-UNC-CON"]),
    ({"process": False}, ["ID-UNC", "ID-UNC-PRO"], []),
    ({"convert": False}, [], ["ID-UNC-CON"]),
    ({"pattern": "ID-UNC-.*"}, ["ID-UNC-PRO"], ["ID-UNC-CON"]),
    ({"force": True}, ["ID-UNC", "ID-UNC-CON", "ID-UNC-PRO"], ["ID-UNC", "ID-UNC-CON", "ID-UNC-PRO"]),
])
def test_plan(five, kwargs, convert, process):
    plan = plan_analyses(five, **kwargs)
    assert ids(plan.where("run_convert")) == convert
    assert ids(plan.where("run_process")) == process


def test_plan_reasons_and_second_decision(five):
    plan = plan_analyses(five, force=True)
    reasons = {r["id"]: r["convert_reasons"] for r in plan.collect()}
    assert reasons["ID-UNC-CON"] == ["converted files already exist", "conversion is forced"]
    assert reasons["ID-UNC"] == ["conversion is forced"]
    later = five.selectExpr("id", "unconverted_state", "'present' as converted_state", "processed_state")
    again = plan_processing(plan_analyses(five), later)
    assert ids(again.where("run_process")) == ["ID-UNC", "ID-UNC-CON"]


def props(spark, rows):
    """(id, unc, con, pro) mtimes as an inventory."""
    listing = [(s, r[0], float(m)) for r in rows for s, m in zip(schemas.STAGES, r[1:]) if m != -1]
    known = spark.createDataFrame([(r[0],) for r in rows], "id STRING")
    return inv.build_inventory(spark.createDataFrame(listing, schemas.LISTING), previous=known)


@pytest.mark.parametrize("step, state, kwargs, run", [
    ("convert", (0, -1, -1), {}, True), ("convert", (0, 0, -1), {}, False),
    ("convert", (0, -1, -1), {"convert": False}, False), ("convert", (0, 0, -1), {"force": True}, True),
    ("process", (0, 0, -1), {}, True), ("process", (0, -1, -1), {}, False),
    ("process", (0, -1, 0), {"force": True}, True), ("process", (0, 0, -1), {"process": False}, False),
])
def test_decisions(spark, step, state, kwargs, run):
    (row,) = plan_analyses(props(spark, [("ID-1", *state)]), **kwargs).collect()
    assert row[f"run_{step}"] is run


@pytest.mark.parametrize("state", [(0, 0, 0), (-1, -1, -1), (-1, 0, -1)])
def test_no_candidates(spark, state):
    assert plan_analyses(props(spark, [("ID-1", *state)]), force=True).count() == 0


SORT_ROWS = [("ID-100", 100, 200, 500), ("ID-101", 200, 100, 400), ("ID-102", 50, 300, 300)]


@pytest.mark.parametrize("by, expected", [
    ("id", ["ID-102", "ID-101", "ID-100"]), ("unconverted", ["ID-101", "ID-100", "ID-102"]),
    ("converted", ["ID-102", "ID-100", "ID-101"]), ("processed", ["ID-100", "ID-101", "ID-102"]),
])
def test_sorting(spark, by, expected):
    rows = props(spark, SORT_ROWS)
    assert [r["id"] for r in inv.sort_inventory(rows, by).collect()] == expected
    assert [r["id"] for r in inv.sort_inventory(rows, by, reverse=True).collect()] == expected[::-1]
    ranked = inv.ranked_inventory(rows, by).orderBy("position").collect()
    assert [(r["id"], r["position"]) for r in ranked] == list(zip(expected, range(3)))


def test_sorting_odd_ids_and_malformed(spark):
    rows = props(spark, [("ID-9", 1, 5, -1), ("ID-10", 1, -1, -1), ("plain", 1, 7, -1), ("ID-x", 1, 6, -1)])
    assert [r["id"] for r in inv.sort_inventory(rows).collect()] == ["ID-10", "ID-9", "ID-x", "plain"]
    logs = spark.createDataFrame(
        [("ID-9", "Conversion of ID-9 complete"), ("ID-x", "Conversion of ID-x complete")], "id STRING, contents STRING")
    checked = inv.mark_converted(rows, logs)
    assert [r["id"] for r in inv.sort_inventory(checked, "converted").collect()] == ["ID-x", "ID-9", "ID-10", "plain"]


def test_conversion_verdicts(spark):
    logs = spark.createDataFrame([
        ("a", "x\nConversion of /d/a complete\ny"), ("b", "Conversion of\n b complete"), ("c", "start"),
        ("c", "Conversion of c complete"), ("d", "Conversion of d complete"), ("d", "ERROR late"),
        ("e", "Conversion of other complete"),
    ], "id STRING, contents STRING")
    got = {r["id"]: r["is_valid"] for r in inv.conversion_verdicts(logs).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False}


def overrides(spark, rows):
    full = [(n, p, *[v for pair in vals for v in pair]) for n, (p, *vals) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.OVERRIDES)


def three(a, b, c):
    return tuple((None if m is None else float(m), None) for m in (a, b, c))


def test_first_match_wins(spark):
    rows = props(spark, [("ID-100", 9, 9, 9), ("ID-245", 9, 9, 9), ("ID-023", 9, 9, 9), ("xID-2000", 9, 9, 9)])
    table = overrides(spark, [("ID-100", *three(1, 1, 1)), ("ID-2..", *three(2, None, 2)), ("ID-.*", *three(3, 3, 3)),
                              ])
    got = {r["id"]: r["override_seq"] for r in ovr.match_overrides(rows, table.where("seq < 2")).collect()}
    assert got == {"ID-100": 0, "ID-245": 1, "ID-023": None, "xID-2000": 1}
    applied = {r["id"]: r for r in ovr.apply_overrides(rows, table).collect()}
    assert applied["ID-100"]["unconverted_mtime"] == 1.0 and applied["ID-100"]["overridden"]
    assert (applied["ID-245"]["converted_mtime"], applied["ID-245"]["converted_state"]) == (-1.0, "absent")
    assert applied["ID-023"]["unconverted_mtime"] == 3.0


@pytest.mark.parametrize("pattern, literals", [
    ("ID-12[0-9][0-9]", ["ID-12"]), ("ID-1..", ["ID-1"]), ("^ID-100$", ["ID-100"]), ("ab+c", ["ab"]), ("abc?d", ["ab"]),
    (r"a\.b\d+cd", ["a.b"]), ("ID-7|TB-[12]x", ["ID-7", "TB-"]), ("ID-7|[0-9]", []), ("(ID-1|ID-2)-long", ["-long"]),
    ("(?i)id-1", []), ("(?:x)ID", ["ID"]), (".*", []), ("", []), ("a{0,2}", []), ("a[]x]bc", ["bc"]), ("[a[bc]]d", []),
    (r"\x41BC", []), (r"\Qa.b\E", []), ("ID-1234567890", ["34567890"]), ("(open", []), ("[open", []), ("x*", []),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_indexed_patterns_match_as_plain_search(spark):
    """Against every pattern tried on every id, with ties, repeated ids, nulls and a text shared by most patterns."""
    ids = [f"{p}-{i}{s}" for p in ("ID", "TB", "id") for i in range(40) for s in ("", "x", ".b")] + ["", "I", "ID-1", None, "µID-7"]
    patterns = ([f"ID-{i}$" for i in range(20)] + [f"ID-.*{i}x" for i in range(20)] + [f"TB-{i}|id-{i + 1}$" for i in range(9)]
                + [r"ID-3\.b", "[7-9]\\.b$", "(?i)tb-30", "(ID|TB)-2[0-9]", "µ"])
    inventory = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id STRING, literal INT")
    table = spark.createDataFrame([(n, p) for n, p in enumerate(patterns)], "seq BIGINT, pattern STRING")
    got = ovr.match_overrides(inventory, table)
    assert got.columns == ["id", "literal", "override_seq"]
    want = [(n, next((s for s, p in enumerate(patterns) if re.search(p, i)), None) if i is not None else None)
            for n, i in enumerate(ids)]
    assert sorted((r.literal, r.override_seq) for r in got.collect()) == want
    chosen = table.where("seq < 3").select(F.col("pattern").alias("id"))
    assert {r.id for r in ovr.select_experiments(inventory, chosen, as_pattern=True).collect()} == {"ID-0", "ID-1", "ID-2"}


def test_many_patterns_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ovr, "PATTERNS_PER_ROUND", 7)
    monkeypatch.setattr(ovr, "ROUNDS_PER_WRITE", 2)
    rows = props(spark, [(f"ID-{i}", 9, 9, 9) for i in range(60)])
    table = overrides(spark, [(f"(ID-{i})$", *three(i, i, i)) for i in range(50)])
    got = {r["id"]: r["override_seq"] for r in ovr.match_overrides(rows, table).collect()}
    assert got == {f"ID-{i}": (i if i < 50 else None) for i in range(60)}


def test_override_replaces_and_reverts(spark):
    rows = props(spark, [("ID-280", 100, -1, -1), ("ID-342", 100, 100, 100)])
    table = overrides(spark, [("ID-3..", *three(0, 0, 0)), ("ID-2..", *three(5, 5, 5))])
    applied = {r["id"]: r for r in ovr.apply_overrides(rows, table).collect()}
    assert applied["ID-342"]["processed_mtime"] == 0.0 and applied["ID-280"]["overridden"]
    after = {r["id"]: r for r in ovr.apply_overrides(rows, ovr.remove_override(table, "ID-2..")).collect()}
    assert after["ID-280"]["unconverted_mtime"] == 100.0 and not after["ID-280"]["overridden"]
    with pytest.raises(KeyError):
        ovr.remove_override(table, "ID-FAKE")


def test_merge_keeps_old_values(spark):
    rows = spark.createDataFrame([
        (0, "a", 0.0, None, 0.0, None, 0.0, None, False), (1, "a", 100.0, None, None, None, 300.0, None, True),
        (0, "b", None, "malformed", None, None, 4.0, None, None), (1, "b", 7.0, None, None, None, None, "malformed", None),
    ], schemas.OVERRIDES + ", overridden BOOLEAN")
    got = {r["pattern"]: r for r in ovr.merge_props(rows).collect()}
    a, b = got["a"], got["b"]
    assert (a["unconverted_mtime"], a["converted_mtime"], a["processed_mtime"], a["overridden"]) == (100, 0, 300, True)
    assert (b["unconverted_mtime"], b["unconverted_state"]) == (7.0, "present")
    assert (b["converted_mtime"], b["converted_state"]) == (-1.0, "absent")
    assert (b["processed_mtime"], b["processed_state"]) == (None, "malformed")


def test_sync(spark):
    current = overrides(spark, [("ID-OVR", *three(0, 0, 0)), ("ID-OVR-2", *three(100, 200, 300))])
    edited = overrides(spark, [("NEW", *three(1, None, 1)), ("ID-OVR-2", *three(None, 5, None))])
    got = [tuple(r) for r in ovr.sync_overrides(current, edited).orderBy("seq").collect()]
    assert [(r[1], r[2], r[4], r[6]) for r in got] == [("ID-OVR-2", 100.0, 5.0, 300.0), ("NEW", 1.0, -1.0, 1.0)]
    with pytest.raises(ValueError):
        ovr.sync_overrides(current, overrides(spark, [("", *three(1, 1, 1))]))
    empty = ovr.sync_overrides(ovr.empty_overrides(spark), edited).orderBy("seq").collect()
    assert [r["pattern"] for r in empty] == ["NEW", "ID-OVR-2"]


def test_bad_patterns(spark):
    ovr.validate_patterns(overrides(spark, [("ID-1..", *three(0, 0, 0))]))
    with pytest.raises(ValueError, match="cannot be compiled"):
        ovr.validate_patterns(overrides(spark, [("(?P<n>a)", *three(0, 0, 0))]))


def test_selection(spark):
    rows = props(spark, [("ID-10", 1, 1, 1), ("ID-100", 1, 1, 1), ("ID-2", 1, 1, 1)])
    assert ids(ovr.select_experiments(rows, ["ID-10"])) == ["ID-10"]
    assert ids(ovr.select_experiments(rows, ["ID-10"], as_pattern=True)) == ["ID-10", "ID-100"]
    assert ids(ovr.select_experiments(rows, [], as_pattern=True)) == ["ID-10", "ID-100", "ID-2"]


def test_status_label(spark, five):
    got = {r["id"]: r for r in inv.status_label(five).collect()}
    row = got["ID-UNC-CON"]
    assert (row["unconverted_label"], row["converted_label"], row["processed_label"]) == (
        "Found", "Malformed", "Not found")
    assert (row["unconverted_class"], row["converted_class"], row["processed_class"]) == (
        "found", "malformed", "not_found")


def touch(root, *parts, text="x"):
    path = root.joinpath(*parts)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_inventory_from_folders(spark, tmp_path):
    unc, con, pro = (tmp_path / n for n in ("unc", "con", "pro"))
    touch(unc, "ID-001", "a b+c%.bin")
    touch(unc, "ID-002", "deep", "a.bin")
    touch(unc, "loose.txt")
    touch(con, "ID-001", "conversion.log", text="start\nConversion of ID-001 complete\n")
    touch(con, "ID-002", "conversion.log", text="Conversion of ID-002 complete\nERROR x\n")
    touch(con, "ID-003", "deep", "conversion.log", text="Conversion of ID-003 complete\n")
    touch(pro, "ID-001", "output.csv")
    touch(pro, "ID-002", "deep", "output.csv")
    got = {r["id"]: r for r in current_inventory(spark, str(unc), str(con), str(pro)).collect()}
    states = {k: (r["unconverted_state"], r["converted_state"], r["processed_state"]) for k, r in got.items()}
    assert states == {
        "ID-001": ("present", "present", "present"), "ID-002": ("present", "malformed", "malformed"),
        "ID-003": ("absent", "malformed", "absent"),
    }
    assert abs(got["ID-001"]["unconverted_mtime"] - (unc / "ID-001" / "a b+c%.bin").stat().st_mtime * 1000) < 1.0
    root = str(tmp_path / "overrides")
    assert load_overrides(spark, root).count() == 0
    save_overrides(overrides(spark, [("ID-003", *three(1, 1, 1))]), root)
    save_overrides(overrides(spark, [("ID-003", *three(1, None, 1))]), root)
    assert load_overrides(spark, root).first()["converted_mtime"] is None
    rows = inventory_query(spark, str(unc), str(con), str(pro), root, "to_be_converted")
    assert ids(rows) == ["ID-003"]
    assert ids(inventory_query(spark, str(unc), str(con), str(pro), root)) == ["ID-001", "ID-002", "ID-003"]
