"""Session plumbing: shared scratch folder, small written tables, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: dict[str, str] = {}
_own_folders: dict[str, str] = {}
#: Kept, as each thread of the driver that calls Spark has a connection and a thread in the JVM.
_threads = ThreadPoolExecutor(32)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a folder of its own; on a cluster a
    machine-local folder would be unreadable from the other executors.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="pulseframe-")
        context.setCheckpointDir(_own_folders[context.applicationId])
    return _own_folders[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared scratch folder."""
    return f"{scratch_root(spark)}/pulseframe/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Used to cut lineage, and to pin the physical row order of a sorted table before it is read twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders to list or small files to handle that cost about as much as starting a Python task.
ITEMS_PER_TASK = 32


def tasks_for(spark: SparkSession, items: int) -> int:
    """Python tasks for so many folders or small files: all cores, unless there are few items.

    Few bytes name many folders, so Spark, which goes by bytes, would give them all to one task.
    """
    return max(1, min(-(-items // ITEMS_PER_TASK), spark.sparkContext.defaultParallelism))


def known_empty(df: DataFrame) -> bool:
    """Whether the plan alone tells that there is no row; nothing is computed."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0


def side_by_side(spark: SparkSession, steps: Iterable[Callable], at_once: int) -> list:
    """What each step returns; ``at_once`` of them run at a time, on threads of the driver.

    For steps of many small jobs that do not need each other: most of such a job's time goes by on the driver. When a step
    fails, those under way end, no other begins, and its error is raised.
    """
    waiting = list(enumerate(steps))[::-1]
    made, errors = {}, {}

    def run():
        while waiting and not errors:
            try:
                number, step = waiting.pop()
            except IndexError:  # another thread took the last one
                return
            try:
                made[number] = step()
            except Exception as error:
                errors[number] = error

    # The caller works, too, so a step that has steps of its own never waits for a thread of the pool.
    inherits = inheritable_thread_target(spark)
    others = [_threads.submit(inherits(run)) for _ in range(min(at_once, len(waiting)) - 1)]
    run()
    for other in others:
        if not other.cancel():
            other.result()
    if errors:
        raise errors[min(errors)]
    return [made[number] for number in sorted(made)]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(package_dir)
    archive = os.path.join(tempfile.mkdtemp(prefix="pulseframe-ship-"), "pulseframe.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, names in os.walk(package_dir):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    target.write(full, os.path.relpath(full, base))
    context.addPyFile(archive)
    _shipped[context.applicationId] = archive


def prepare(spark: SparkSession) -> None:
    """Settings the operators rely on: wall times are read in UTC unless an operator names a zone.

    Tables of many folders are listed by a few tasks a core; Spark would start one for each of up to 10,000 folders.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    ship_package(spark)
