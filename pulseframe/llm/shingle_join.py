"""Near-duplicate classes by a prefix-tree join of n-gram sets.

A document's set holds its distinct word shingles; two sets link when their Jaccard similarity reaches the threshold.
Equal sets are one node. The join is exact:

1. A common order of the shingles, rarest first. Linked sets share a shingle among the first
   ``|set| - ceil(0.8 |set|) + 1`` of that order. The order needs counts only for shingles with a small hash
   (``REGION`` of all): those counted once come first, so a document with too many of its own can link with nothing
   and leaves here. Most documents do.
2. Sets that share a prefix shingle and whose sizes allow a link are chained, and the chains' components are cells.
   No set is compared outside its cell, and no pair of a group is listed.
3. In a cell the ordered sets form a trie (kept as sorted sequences with their common prefix lengths). The walk shares
   the partial overlaps of a common prefix. ``near_duplicates`` tests every set against all others of its cell and
   counts its links, ``n_links``: the other documents that link with a document, its copies among them. Only links
   that join two components are listed. ``deduplicate`` needs no counts, and its walk drops a subtree when its
   remaining length cannot reach any set that is not yet connected. A cell of more than ``CELL_SHINGLES`` is cut into
   blocks, and every pair of blocks is walked in a task of its own.

Cases: null, empty and blank texts have the empty set, link with nothing and are their own component (their id, null
if that is null); with fewer words than a shingle the whole sequence is the set; rows with equal ids are judged each;
component ids are the smallest non-null id of the component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.components import components
from pulseframe.llm.run import (column, emit_rows, fresh_bitmap, in_bitmap, map_texts, partitions, quoted, ready, stream,
                                tidy, whole_groups)
from pulseframe.llm.text import Block, Words, hash_runs, window_starts
from pulseframe.session import materialize

SHINGLE = 5
PERCENT = 80
REGION = 0.3
CELL_SHINGLES = 1_000_000
_NULL_ID = -(1 << 63)


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's set starts."""
    words = Words(block.lowered())
    counts = words.counts()
    hashes = words.hashes()
    starts = window_starts(words, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    keys = np.append(hash_runs(hashes, starts, starts + size),
                     hash_runs(hashes, words.first[short], words.first[short + 1]))
    text = np.append(words.doc()[starts], short)
    order = np.argsort(keys)
    order = order[np.argsort(text[order], kind="stable")]
    keys, text = keys[order], text[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[fresh], text[fresh]
    return keys, np.searchsorted(text, np.arange(len(block) + 1))


def set_nodes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal numbers, the empty set has 0."""
    node = hash_runs(keys, first[:-1], first[1:], 1).view(np.int64)
    node[first[1:] == first[:-1]] = 0
    return node


def _prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (-(-percent * size // 100)) + 1


def _tokens(block: Block, size: int, percent: int, region: float) -> dict:
    """Token rows (``n`` 0) of the counted region, more tokens for sets with too few there, and one size row a set."""
    keys, first = shingle_sets(block, size)
    node = set_nodes(keys, first)
    total = np.diff(first)
    _, pick = np.unique(node, return_index=True)
    pick = pick[total[pick] > 0]
    owner = np.repeat(np.arange(len(block)), total)
    low = keys < np.uint64(int(region * 2**64))
    inside = np.bincount(owner[low], minlength=len(block))
    place = np.arange(len(keys)) - np.repeat(first[:-1], total)
    # keys are sorted, so the region's are the first of each set, and the next ones follow in hash order
    wanted = low | (place < _prefix_length(total, percent)[owner])
    chosen = np.zeros(len(block), dtype=bool)
    chosen[pick] = True
    wanted &= chosen[owner]
    return {"token": np.append(keys[wanted].view(np.int64), node[pick]),
            "node": np.append(node[owner[wanted]], node[pick]),
            "n": np.append(np.zeros(int(wanted.sum()), int), total[pick]),
            "inside": np.append(np.zeros(int(wanted.sum()), int), inside[pick])}


def _prefixes(batches, percent: int, region: float):
    """Prefix tokens that other sets hold as well, of sets that can link at all."""
    bound = np.uint64(int(region * 2**64))
    for group in whole_groups(batches, ["node"]):
        node, token, df, n, inside = (group.column(c).to_numpy() for c in ("node", "token", "df", "n", "inside"))
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        owner = np.cumsum(np.append(True, node[1:] != node[:-1])) - 1
        size = np.maximum.reduceat(n, head)
        in_region = np.maximum.reduceat(inside, head)
        is_token = n == 0
        low = is_token & (token.view(np.uint64) < bound)
        alone = in_region - np.bincount(owner[low], minlength=len(head))
        need = _prefix_length(size, percent) - alone
        # rows of a node are sorted: its size row, region tokens by count and hash, the others by hash
        rank = np.arange(len(node)) - head[owner] - 1
        keep = is_token & (rank < need[owner]) & (need[owner] > 0)
        yield {"token": token[keep], "node": node[keep], "n": size[owner[keep]]}


def _chains(batches, percent: int):
    """Edges between neighbours by size among the sets that share a token."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, node, n = (column(batch, c) for c in ("token", "node", "n"))
        if last is not None:
            token, node, n = np.append(last[0], token), np.append(last[1], node), np.append(last[2], n)
        last = (token[-1], node[-1], n[-1])
        linked = (token[1:] == token[:-1]) & (node[1:] != node[:-1]) & (100 * n[:-1] >= percent * n[1:])
        pairs = np.unique(np.stack([np.minimum(node[1:], node[:-1])[linked],
                                    np.maximum(node[1:], node[:-1])[linked]], axis=1), axis=0)
        yield {"a": pairs[:, 0], "b": pairs[:, 1]}


def _trie(sets: list[np.ndarray]):
    """Sizes, each set's ordered tokens, the holders of each token and where they start, the sets in the order of the
    trie, and the common prefix length of each with the one before it."""
    count = len(sets)
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(count), size)
    _, which, often = np.unique(tokens, return_inverse=True, return_counts=True)
    # frequent tokens first, so that near copies share long prefixes; ties by hash
    rank_of = np.empty(len(often), np.int64)
    rank_of[np.lexsort((np.arange(len(often)), -often))] = np.arange(len(often))
    rank = rank_of[which]
    order = np.argsort(rank, kind="stable")
    posting, post_first = owner[order], np.append(0, np.cumsum(np.sort(often)[::-1]))
    path = np.lexsort((rank, owner))
    ranks = np.split(rank[path], np.cumsum(size)[:-1])
    walk = sorted(range(count), key=lambda i: ranks[i].astype(">u4").tobytes())
    shared = [0]
    for left, right in zip(walk, walk[1:]):
        most = min(size[left], size[right])
        differ = np.flatnonzero(ranks[left][:most] != ranks[right][:most])
        shared.append(int(differ[0]) if len(differ) else int(most))
    shared.append(0)
    return size, ranks, posting, post_first, walk, shared


def link_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a cell that join its components: pairs of indices into ``sets``."""
    count = len(sets)
    size, ranks, posting, post_first, walk, shared = _trie(sets)
    tail = np.array(shared)

    component = np.arange(count)
    links: list[tuple[int, int]] = []
    largest = int(size.max())
    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(count, np.int64))]
    skip_from = None  # depth of a subtree that cannot reach any set

    def step(overlap: np.ndarray, of: int, low: int, high: int) -> np.ndarray:
        if low == high:
            return overlap
        spans = [posting[post_first[r]:post_first[r + 1]] for r in ranks[of][low:high]]
        return overlap + np.bincount(np.concatenate(spans), minlength=count)

    for at, one in enumerate(walk):
        if skip_from is not None and shared[at] >= skip_from:
            continue
        skip_from = None
        while stack[-1][0] > shared[at]:
            stack.pop()
        depth, overlap = stack[-1]
        below = shared[at + 1]
        if below > depth:  # the next sets branch off here: keep the partial overlap for them
            subtree = walk[at:at + 2 + int(np.argmax(tail[at + 2:] < below))]
            own = component[subtree[0]]
            joined = bool((component[subtree] == own).all())
            if joined and bool((component == own).all()):
                break
            overlap = step(overlap, one, depth, below)
            depth = below
            stack.append((depth, overlap))
            # a set y of the subtree overlaps p in at most overlap + |y| - depth
            reach = (100 + percent) * overlap >= (100 + percent) * depth + percent * size - 100 * largest
            if joined and not (reach & (component != own)).any():
                skip_from = depth
                continue
        open_sets = ((component != component[one]) & (100 * np.minimum(size, size[one])
                                                      >= percent * np.maximum(size, size[one])))
        if not open_sets.any():
            continue
        overlap = step(overlap, one, depth, int(size[one]))
        hit = open_sets & (100 * overlap >= percent * (size + size[one] - overlap))
        if hit.any():
            others, first = np.unique(component[hit], return_index=True)
            links.extend((one, int(np.flatnonzero(hit)[i])) for i in first)
            component[np.isin(component, others)] = component[one]
    return links


def count_links(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None,
                percent: int = PERCENT) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Copies of the other sets that each set of a cell links with, and the links that join its components. With
    ``side`` only links between different sides are looked at."""
    count = len(sets)
    size, ranks, posting, post_first, walk, shared = _trie(sets)
    # a token that most sets hold is kept as the sets without it; those tokens come first
    common = int((2 * np.diff(post_first) > count).sum())
    holders = [posting[post_first[r]:post_first[r + 1]] for r in range(len(post_first) - 1)]
    for r in range(common):
        without = np.ones(count, dtype=bool)
        without[holders[r]] = False
        holders[r] = np.flatnonzero(without)

    def step(overlap: np.ndarray, of: int, low: int, high: int) -> np.ndarray:
        mine = ranks[of][low:high]
        most = int(np.searchsorted(mine, common))
        out = overlap + most
        if most:
            out -= np.bincount(np.concatenate([holders[r] for r in mine[:most]]), minlength=count)
        if most < len(mine):
            out += np.bincount(np.concatenate([holders[r] for r in mine[most:]]), minlength=count)
        return out

    component = np.arange(count)
    links: list[tuple[int, int]] = []
    many = np.zeros(count, np.int64)
    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(count, np.int64))]
    for at, one in enumerate(walk):
        while stack[-1][0] > shared[at]:
            stack.pop()
        depth, overlap = stack[-1]
        below = shared[at + 1]
        if below > depth:  # the next sets branch off here: keep the partial overlap for them
            overlap = step(overlap, one, depth, below)
            depth = below
            stack.append((depth, overlap))
        overlap = step(overlap, one, depth, int(size[one]))
        hit = (100 + percent) * overlap >= percent * (size + size[one])
        hit[one] = False
        if side is not None:
            hit &= side != side[one]
        many[one] = copies[hit].sum()
        new = np.flatnonzero(hit & (component != component[one]))
        if len(new):
            others, first = np.unique(component[new], return_index=True)
            links.extend((one, int(new[i])) for i in first)
            component[np.isin(component, others)] = component[one]
    return many, links


def _cell_counts(batches, percent: int):
    """Links that join components (``links`` -1), and the number of links of each node ``a`` in a part."""
    for group in whole_groups(batches, ["cell", "part"]):
        cell, part, node, mine, cross, copies = (
            group.column(c).to_numpy() for c in ("cell", "part", "node", "mine", "cross", "copies"))
        values = group.column("shingles").combine_chunks()
        head = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
        left, right, total = [], [], np.zeros(len(node), np.int64)
        for low, high in zip(head, np.append(head[1:], len(cell))):
            if high - low < 2:
                continue
            sets = [np.frombuffer(values[i].as_buffer(), dtype=np.uint64) for i in range(low, high)]
            total[low:high], links = count_links(sets, copies[low:high], mine[low:high] if cross[low] else None, percent)
            for a, b in links:
                left.append(node[low + a])
                right.append(node[low + b])
        some = total > 0
        yield {"a": np.append(np.array(left, np.int64), node[some]), "b": np.append(np.array(right, np.int64), node[some]),
               "links": np.append(np.full(len(left), -1, np.int64), total[some])}


def _cell_links(batches, percent: int):
    for group in whole_groups(batches, ["cell", "part"]):
        cell, part, node = (group.column(c).to_numpy() for c in ("cell", "part", "node"))
        values = group.column("shingles").combine_chunks()
        head = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
        left, right = [], []
        for low, high in zip(head, np.append(head[1:], len(cell))):
            sets = [np.frombuffer(values[i].as_buffer(), dtype=np.uint64) for i in range(low, high)]
            for a, b in link_sets(sets, percent) if high - low > 1 else ():
                left.append(node[low + a])
                right.append(node[low + b])
        yield {"a": np.array(left, np.int64), "b": np.array(right, np.int64)}


def _classes(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, region: float,
             cell_shingles: int, count: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` (of its set) and ``root`` (of the set's component) of every document; with
    ``count`` also ``n_links``."""
    spark = ready(docs)
    width = partitions(spark)
    tokens = emit_rows(docs, lambda block, key: _tokens(block, size, percent, region),
                       "token long, node long, n int, inside int", doc_id, text)
    same = Window.partitionBy("token").orderBy("node", "n")
    counted = (tokens.withColumn("before", F.lag(F.struct("node", "n")).over(same))
               .filter(F.col("before").isNull() | (F.col("before") != F.struct("node", "n"))).drop("before")
               .withColumn("df", F.count("*").over(Window.partitionBy("token")))
               .filter((F.col("df") > 1) | (F.col("n") > 0)))
    if not 0 < region <= 0.5:
        raise ValueError("region must be over 0 and at most 0.5")
    # the region's tokens come before the others; the order is that of unsigned numbers
    beyond = ~F.col("token").between(0, int(region * 2**64) - 1)
    by_node = (counted.repartition(width, "node")
               .sortWithinPartitions("node", F.col("n").desc(), beyond,
                                     F.when(beyond, F.lit(0)).otherwise(F.col("df")), F.col("token") < 0, "token"))
    prefixes = stream(by_node, lambda batches: _prefixes(batches, percent, region), "token long, node long, n int")
    chains = stream(prefixes.repartition(width, "token").sortWithinPartitions("token", "n", "node"),
                    lambda batches: _chains(batches, percent), "a long, b long")
    cells = materialize(components(chains, "shingle-cells"), "shingle-cells")
    bitmap = spark.sparkContext.broadcast(fresh_bitmap(cells, "node"))

    def members(block: Block) -> dict:
        keys, first = shingle_sets(block, size)
        node = set_nodes(keys, first)
        held = in_bitmap(bitmap.value, node) & (first[1:] > first[:-1])
        _, pick = np.unique(node, return_index=True)
        once = np.zeros(len(block), dtype=bool)
        once[pick] = True
        sets = [keys[a:b].tobytes() if use else None for a, b, use in zip(first[:-1], first[1:], held & once)]
        return {"n_shingles": np.diff(first), "node": node, "shingles": pa.array(sets, pa.binary())}

    rows = materialize(map_texts(docs, members, "n_shingles long, node long, shingles binary", [doc_id], text),
                       "shingle-sets")
    sets = (rows.filter(F.col("shingles").isNotNull()).select("node", "n_shingles", "shingles")
            .join(cells.select("node", F.col("root").alias("cell")), "node").dropDuplicates(["node"]))
    weight = (rows.filter(F.col("shingles").isNotNull()).select("node", "n_shingles").distinct()
              .join(cells, "node").groupBy(F.col("root").alias("cell")).agg(F.sum("n_shingles").alias("weight"))
              .select("cell", F.ceil(F.col("weight") / cell_shingles).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    placed = (sets.join(weight, "cell").withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("part", F.least("mine", "other") * F.col("blocks").cast("long") + F.greatest("mine", "other")))
    if count:
        copies = rows.groupBy("node").agg(F.count("*").alias("copies"))
        placed = placed.join(copies, "node").select("cell", "part", "node", "shingles", "mine",
                                                    (F.col("mine") != F.col("other")).alias("cross"), "copies")
        walked = materialize(stream(placed.repartition(width, "cell", "part").sortWithinPartitions("cell", "part", "node"),
                                    lambda batches: _cell_counts(batches, percent), "a long, b long, links long"),
                             "shingle-counts")
        roots = components(walked.filter("links < 0").select("a", "b"), "shingle-links")
        linked = (walked.filter("links >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")))
        named = (copies.join(roots, "node", "left").join(linked, "node", "left")
                 .select("node", F.coalesce("root", "node").alias("root"),
                         (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
        return (rows.select(quoted(doc_id), "n_shingles", "node").join(named, "node")
                .withColumn("n_links", F.when(F.col("n_shingles") > 0, F.col("links")).otherwise(F.lit(0))).drop("links"))
    walked = stream(placed.select("cell", "part", "node", "shingles").repartition(width, "cell", "part")
                    .sortWithinPartitions("cell", "part", "node"),
                    lambda batches: _cell_links(batches, percent), "a long, b long")
    roots = components(walked, "shingle-links")
    named = rows.select("node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows.select(quoted(doc_id), "n_shingles", "node").join(named, "node")


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id and text under names of their own, which no column of the documents can clash with."""
    return docs.select(F.col(quoted(doc_id)).alias("__doc"), F.col(quoted(text)).alias("__words"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT, region: float = REGION, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """``n_shingles``, ``component_id`` and ``n_links`` of every document."""
    rows = _classes(_plain(docs, doc_id, text), "__doc", "__words", size, percent, region, cell_shingles, True)
    key = F.col("__doc")
    least = (rows.filter(F.col("n_shingles") > 0).groupBy("root").agg(F.min(key).alias("component_id")))
    return (rows.join(least, "root", "left")
            .select(key.alias(doc_id), "n_shingles",
                    F.when(F.col("n_shingles") == 0, key).otherwise(F.col("component_id")).alias("component_id"), "n_links"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                percent: int = PERCENT, region: float = REGION, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """One document of each class, with all columns: the one with the smallest id (null last). Documents without
    words stay. Only documents whose id may be that of a dropped one are shuffled."""
    spark = ready(docs)
    key, inner = F.col(quoted(doc_id)).cast("long"), F.col("__doc").cast("long")
    rows = materialize(_classes(_plain(docs, doc_id, text), "__doc", "__words", size, percent, region, cell_shingles)
                       .filter(F.col("n_shingles") > 0)
                       .select(F.coalesce(inner, F.lit(_NULL_ID)).alias("id"), inner.isNull().alias("absent"), "node", "root"),
                       "shingle-classes")
    best = rows.groupBy("root").agg(F.min(F.struct("absent", "id", "node")).alias("best"))
    judged = (rows.join(best, "root")
              .withColumn("stays", F.col("best") == F.struct("absent", "id", "node"))
              .groupBy("id", "node").agg(F.count("*").alias("copies"), F.max("stays").alias("stays"))
              .filter(~F.col("stays") | (F.col("copies") > 1)).select("id", "node", "stays"))
    judged = materialize(judged, "shingle-dropped")
    held = spark.sparkContext.broadcast(fresh_bitmap(judged, "id"))
    names = docs.columns
    place = names.index(doc_id)

    def split(maybe: bool):
        def pick(batches):
            for batch in batches:
                ids = batch.column(place).cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                keep = pa.array(in_bitmap(held.value, ids) == maybe)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], names=names)
        return pick

    def nodes(block: Block) -> dict:
        keys, first = shingle_sets(block, size)
        return {"__node": set_nodes(keys, first), "__size": np.diff(first)}

    certain = docs.mapInArrow(tidy(split(False)), docs.schema)
    # filter and sets in one Python worker a task
    maybe = map_texts(docs, nodes, "__node long, __size long", names, text, only=split(True))
    # of equal rows in a class only the first can stay; where nothing is dropped, equal rows are empty ones
    open_rows = (maybe.withColumn("__id", F.coalesce(key, F.lit(_NULL_ID)))
                 .join(judged.select(F.col("id").alias("__id"), F.col("node").alias("__node"), F.col("stays").alias("__stays")),
                       ["__id", "__node"], "left")
                 .filter(F.coalesce("__stays", F.lit(True)))
                 .withColumn("__turn", F.row_number().over(Window.partitionBy("__id", "__node").orderBy("__size")))
                 .filter(F.col("__stays").isNull() | (F.col("__turn") == 1)))
    return certain.union(open_rows.select(*[quoted(c) for c in names]))
