"""Which experiments to convert and process next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.inventory import filter_inventory, filter_pattern
from pulseframe.operators.inventory import ABSENT


def plan_analyses(inventory: DataFrame, convert: bool = True, process: bool = True,
                  force: bool = False, pattern: str | None = None) -> DataFrame:
    """Candidates (still to be analyzed, id matching the pattern) with ``run_convert`` and its reasons.

    ``force`` runs a step regardless of state; it does not add candidates. ``run_process`` shows the
    decision on the state given; after the conversions, decide again with ``plan_processing``.
    """
    candidates = filter_inventory(inventory, "to_be_analyzed")
    if pattern is not None:
        candidates = filter_pattern(candidates, pattern)
    return _decide(candidates, convert, process, force)


def plan_processing(plan: DataFrame, refreshed: DataFrame, process: bool = True,
                    force: bool = False) -> DataFrame:
    """Processing decision for the planned ids on the inventory as it is after conversion."""
    planned = refreshed.join(plan.select("id"), "id", "left_semi")
    return _decide(planned, False, process, force).select("id", "run_process", "process_reasons")


def _decide(candidates: DataFrame, convert: bool, process: bool, force: bool) -> DataFrame:
    def step(enabled, name, needs, makes):
        has_input = F.col(f"{needs}_state") != ABSENT
        has_output = F.col(f"{makes}_state") != ABSENT
        run = F.lit(enabled) & (F.lit(force) | (has_input & ~has_output))
        if not enabled:
            reasons = F.array(F.lit(f"{name} is switched off"))
        else:
            reasons = F.array_compact(F.array(
                F.when(~has_input, F.lit(f"{needs} files do not exist")),
                F.when(has_output, F.lit(f"{makes} files already exist")),
                F.when(F.lit(force), F.lit(f"{name} is forced")),
            ))
        return run, reasons

    run_convert, convert_reasons = step(convert, "conversion", "unconverted", "converted")
    run_process, process_reasons = step(process, "processing", "converted", "processed")
    return candidates.select(
        "id",
        run_convert.alias("run_convert"),
        run_process.alias("run_process"),
        convert_reasons.alias("convert_reasons"),
        process_reasons.alias("process_reasons"),
    )
