"""Hard negatives of anchor rows by shared candidate lists: one list a cluster of anchors, walked by every member.

Vectors are integers (``floor(256 * x)``), a score is an inner product with the anchor. Anchors are the stated query set;
they are searched in blocks of about ``BLOCK`` rows, each block against all rows, so what is broadcast is bounded.

1. The anchors of a block are clustered by direction (spherical k-means). A cluster keeps the largest angle between a
   member and its centroid.
2. Each task takes its rows in chunks. For each cluster it bounds a row's score with any member of norm 1: the row's
   norm times the cosine of its angle to the centroid less the cluster's largest angle (0 at least). The rows are
   sorted by that bound once for the whole cluster.
3. All members walk the list from the top. A member's walk ends, certified, as soon as its norm times the next bound is
   below what it still needs: its fifth best score so far in the task.
4. The first walk finds the positives, the best rows of the anchor's own label. The second finds for each positive
   score the best rows of other labels within ``low`` to ``high`` percent of it.

Scores are sums of exact integers in doubles; where they could pass 2**53, 64-bit integers are used.

Cases: rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors are filled up with
zeros; zero vectors score 0; repeated rows are rows of their own (a row is no positive of itself, its copy is); null ids are no
anchors and come last among equal scores; an empty table gives no rows; other columns are ignored. Scores beyond 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.run import ready, stream
from pulseframe.session import materialize

#: Anchors searched together, about.
BLOCK = 1 << 15
#: Rows of a task that are sorted and walked together.
CHUNK = 1 << 15
#: Clusters of a block, at most.
CLUSTERS = 256
#: Candidates scored at first; each further step takes twice as many, up to the second number.
STEP, LARGEST_STEP = 128, 4096

_NO_ID = np.iinfo(np.int64).max


def integer_vectors(table: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """Rows that take part: ``row``, ``id``, ``label``, ``vector`` (integers)."""
    values = F.col(vector).cast("array<double>")
    return (table.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), values.alias("values"))
            .filter(F.col("label").isNotNull() & F.col("values").isNotNull())
            .filter(~F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .select(F.monotonically_increasing_id().alias("row"), "id", "label",
                    F.transform("values", lambda x: F.floor(x * 256)).alias("vector")))


class Rows:
    """Rows of integer vectors as arrays."""

    def __init__(self, data: pa.Table, width: int):
        data = data.combine_chunks()
        self.row = data.column("row").to_numpy()
        self.id = data.column("id").fill_null(_NO_ID).to_numpy()
        self.label = data.column("label").to_numpy()
        lists = pa.concat_arrays(data.column("vector").chunks) if data.num_rows else pa.array([], pa.list_(pa.int64()))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        if len(flat) == len(sizes) * width:
            self.vector = flat.reshape(len(sizes), width)
        else:
            self.vector = np.zeros((len(sizes), width), np.int64)
            self.vector[np.arange(width) < sizes[:, None]] = flat
        self.real = self.vector.astype(np.float64)
        self.norm = np.sqrt((self.real * self.real).sum(axis=1))
        self.unit = self.real / np.maximum(self.norm, 1e-300)[:, None]

    def __len__(self) -> int:
        return len(self.row)


class Clusters:
    """Anchors of a block in order of cluster: ``first[c]`` to ``first[c + 1]`` are the members of ``c``."""

    def __init__(self, anchors: Rows):
        count = min(CLUSTERS, max(1, int(np.sqrt(len(anchors)))))
        random = np.random.default_rng(7)
        centres = anchors.unit[random.choice(len(anchors), count, replace=False)]
        for _ in range(8):
            home = np.argmax(anchors.unit @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, anchors.unit)
            norms = np.sqrt((sums * sums).sum(axis=1))
            some = norms > 0
            centres[some] = sums[some] / norms[some, None]
        home = np.argmax(anchors.unit @ centres.T, axis=1)
        self.order = np.argsort(home, kind="stable")
        self.first = np.searchsorted(home[self.order], np.arange(count + 1))
        self.centres = centres
        cosines = np.einsum("ij,ij->i", anchors.unit, centres[home])
        angles = np.where(anchors.norm > 0, np.arccos(np.clip(cosines, -1, 1)), 0.0)
        self.angle = np.zeros(count)
        np.maximum.at(self.angle, home, angles)

    def bounds(self, rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each cluster with members: the members, and the bound of each row's score with a member of norm 1."""
        angles = np.arccos(np.clip(rows.unit @ self.centres.T, -1, 1))
        for c in np.flatnonzero(np.diff(self.first)):
            bound = rows.norm * np.cos(np.maximum(0, angles[:, c] - self.angle[c]))
            yield self.order[self.first[c]:self.first[c + 1]], bound


def scores(anchors: Rows, members: np.ndarray, rows: Rows, picked: np.ndarray) -> np.ndarray:
    if not len(members) or not len(picked):
        return np.zeros((len(members), len(picked)), np.int64)
    most = float(anchors.norm[members].max()) * float(rows.norm[picked].max())
    if most < 1 << 52:
        return (anchors.real[members] @ rows.real[picked].T).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("inner products do not fit into 64 bits")
    return anchors.vector[members] @ rows.vector[picked].T


class Best:
    """The best ``k`` rows of each of some lists: by score, then by id (and row)."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k = k
        self.need = floors.astype(np.float64)  # a lower score is of no use
        self.held: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(floors)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        use = np.flatnonzero(score >= self.need[at])
        if not len(use):
            return
        if len(use) > self.k:  # what is below the k-th of these alone is out
            least = np.partition(score[use], len(use) - self.k)[len(use) - self.k]
            use = use[score[use] >= least]
        mine = np.concatenate([self.held[at], np.stack([score[use], ids[use], row[use]], axis=1)])
        mine = mine[np.lexsort((mine[:, 2], mine[:, 1], -mine[:, 0]))[:self.k]]
        self.held[at] = mine
        if len(mine) == self.k:
            self.need[at] = max(self.need[at], float(mine[-1, 0]))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(h) for h in self.held], np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*self.held, np.zeros((0, 3), np.int64)])


def walk(anchors: Rows, clusters: Clusters, rows: Rows, need: np.ndarray, visit) -> int:
    """Every member of every cluster walks its cluster's list; ``need`` is what each anchor needs, kept by ``visit``.

    Returns how many scores were computed.
    """
    work = 0
    for members, bound in clusters.bounds(rows):
        order = np.argsort(-bound, kind="stable")
        slack = 1e-9 * anchors.norm * float(rows.norm.max(initial=0)) + 0.5  # rounding of the bounds; scores are whole
        low, step = 0, STEP
        while low < len(order):
            members = members[anchors.norm[members] * bound[order[low]] + slack[members] >= need[members]]
            if not len(members):
                break
            picked = order[low:low + step]
            found = scores(anchors, members, rows, picked)
            work += found.size
            for member, mine in zip(members, found, strict=True):
                visit(member, mine, picked)
            low, step = low + step, min(2 * step, LARGEST_STEP)
    return work


def _chunks(batches, width: int) -> Iterator[Rows]:
    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= CHUNK:
            yield Rows(pa.Table.from_batches(waiting), width)
            waiting, held = [], 0
    if held:
        yield Rows(pa.Table.from_batches(waiting), width)


def _found(anchor_rows: np.ndarray, held: np.ndarray, **more: np.ndarray) -> dict:
    ids = pa.array(held[:, 1])
    return {"anchor": anchor_rows, **more, "score": held[:, 0], "row": held[:, 2],
            "id": pc.if_else(pc.equal(ids, _NO_ID), pa.scalar(None, pa.int64()), ids)}


def positives_in(batches, anchors: Rows, clusters: Clusters, width: int, k: int) -> Iterator[dict]:
    best = Best(np.full(len(anchors), -np.inf), k)
    for rows in _chunks(batches, width):
        def visit(member, score, picked):
            same = np.flatnonzero((rows.label[picked] == anchors.label[member]) & (rows.row[picked] != anchors.row[member]))
            best.add(member, score[same], rows.id[picked[same]], rows.row[picked[same]])
        walk(anchors, clusters, rows, best.need, visit)
    at, held = best.table()
    yield _found(anchors.row[at], held)


def negatives_in(batches, anchors: Rows, clusters: Clusters, width: int, k: int, targets: list[np.ndarray],
                 low: int, high: int) -> Iterator[dict]:
    """``targets``: the different positive scores of each anchor."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in targets])]).astype(np.int64)
    target = np.concatenate([*targets, np.zeros(0, np.int64)]).astype(np.int64)
    floor, ceiling = -(-low * target // 100), high * target // 100
    best = Best(np.where(floor <= ceiling, floor, np.inf), k)
    lists = [range(first[a], first[a + 1]) for a in range(len(anchors))]
    need = np.array([min((best.need[j] for j in own), default=np.inf) for own in lists])
    for rows in _chunks(batches, width):
        def visit(member, score, picked):
            other = np.flatnonzero((rows.label[picked] != anchors.label[member]) & (score >= need[member]))
            for j in lists[member]:
                use = other[score[other] <= ceiling[j]]
                best.add(j, score[use], rows.id[picked[use]], rows.row[picked[use]])
            need[member] = min(best.need[j] for j in lists[member])
        walk(anchors, clusters, rows, need, visit)
    at, held = best.table()
    owner = np.repeat(anchors.row, np.diff(first))
    yield _found(owner[at], held, target=target[at])


def best_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   block: int = BLOCK) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (of ``integer_vectors``).

    ``anchor`` says which rows are anchors. Result: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.
    """
    spark = ready(rows)
    rows = materialize(rows, "vectors")
    chosen = rows.filter(anchor)
    size = chosen.agg(F.count("*").alias("n")).first().n
    width = rows.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    blocks = -(-size // block)
    out = None
    for number in range(blocks):
        mine = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number)
        anchors = Rows(mine.toArrow(), width)
        if not len(anchors):
            continue
        held = spark.sparkContext.broadcast((anchors, Clusters(anchors)))

        def first(batches, held=held):
            return positives_in(batches, *held.value, width, positives)

        found = stream(rows, first, "anchor long, score long, row long, id long")
        kept = materialize(best_rows(found, ["anchor"], positives), "positives")
        asked = kept.groupBy("anchor").agg(F.collect_set("score").alias("targets")).toArrow()  # a few numbers an anchor
        place = {a: i for i, a in enumerate(anchors.row.tolist())}
        targets = [np.zeros(0, np.int64)] * len(anchors)
        for a, values in zip(asked.column("anchor").to_pylist(), asked.column("targets").to_pylist(), strict=True):
            targets[place[a]] = np.array(sorted(values), np.int64)
        wanted = spark.sparkContext.broadcast(targets)

        def second(batches, held=held, wanted=wanted):
            return negatives_in(batches, *held.value, width, negatives, wanted.value, low, high)

        found = stream(rows, second, "anchor long, target long, score long, row long, id long")
        best = best_rows(found, ["anchor", "target"], negatives)
        names = kept.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("target"))
        result = materialize(
            best.join(names, ["anchor", "target"])
            .join(chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                    F.col("target").alias("positive_score"), F.col("score").alias("negative_score")), "hard-negatives")
        out = result if out is None else out.unionByName(result)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                        "positive_score long, negative_score long")
    return out
