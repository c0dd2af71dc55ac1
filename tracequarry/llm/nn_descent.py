"""Approximate nearest neighbours by cosine: a graph built by NN-descent, searched greedily.

Equal vectors share one node. Each node starts with near nodes of small random-hyperplane blocks.
Then, round by round, each node joins its neighbours and some nodes that it is a neighbour of; all
pairs that meet at a node and didn't meet there in the round before are compared, and each node keeps
its nearest, until a round changes few of the edges. Queries walk the graph: the best nodes of a query's beam that were not yet expanded
give way to their neighbours, until the beam has none left. The nearest found are scored again in
double precision.

Defined cases: vectors that are null, empty, zero, of another dimension than most, or that hold null
or non-finite components take no part, nor do rows with a null id; equal vectors have equal scores,
and ids break ties; an id that stands at several rows is, as a query, each of its vectors, and is found
once, with its best score; fewer than k candidates are all returned if the graph reaches them (it does, if
they fit into one block); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mix64, stash
from .vectors import bytes_matrix, matrix, smallest_ids, valid_vectors

#: Neighbours kept, trees and size of their blocks, reverse neighbours joined.
DEGREE, TREES, BLOCK, REVERSE = 48, 6, 384, 48
#: The descent ends with the round after which at most this share of the edges is new.
SETTLED = 0.001
#: Beam of a query, nodes expanded a round.
BEAM, EXPAND = 128, 32
#: A node and edges of it; rows of a step in a worker, so many that numpy does the work.
EDGES, GATHERED = "node long, other array<long>, near array<float>, fresh array<boolean>", 8192
ARROW_EDGES = pa.schema([("node", pa.int64()), ("other", pa.list_(pa.int64())), ("near", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))])


def unit_nodes(table: DataFrame, id_col: str, vector_col: str, ids: int) -> tuple[DataFrame, int]:
    """Distinct vectors: node (smallest id), ids, vector (array of double), unit (float32 bytes); and the dimension."""
    rows = valid_vectors(table, id_col, vector_col).where(F.exists("vector", lambda x: x != 0)).withColumn("size", F.size("vector"))
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    dimension = usual["size"] if usual else 1
    distinct = smallest_ids(rows.where(F.col("size") == dimension).select("id", "vector").distinct(), "vector", ids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"))
                x = x / np.abs(x).max(1, keepdims=True)
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("ids"), batch.column("vector"), pa.array([u.tobytes() for u in unit], pa.binary())], ["node", "ids", "vector", "unit"])

    nodes = distinct.select(F.element_at("ids", 1).alias("node"), "ids", "vector").mapInArrow(run, "node long, ids array<long>, vector array<double>, unit binary")
    return stash(nodes, "nodes"), dimension


def planes_of(dimension: int, bits: int) -> np.ndarray:
    """Random hyperplanes of all trees, fixed by their numbers."""
    n = TREES * bits * dimension
    u = (mix64(np.arange(1, 2 * n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    normal = np.sqrt(-2 * np.log(np.maximum(u[:n], 1e-300))) * np.cos(2 * np.pi * u[n:])
    return normal.reshape(TREES, bits, dimension).astype(np.float32)


def first_graph(nodes: DataFrame, dimension: int, count: int) -> DataFrame:
    """node, and arrays other, near, fresh: neighbours within random-hyperplane blocks; a large block is dealt into several."""
    bits = max(0, math.ceil(math.log2(max(1, count) / BLOCK)))
    planes = planes_of(dimension, max(bits, 1))

    def sides(batches):
        for batch in batches:
            if batch.num_rows:
                x = bytes_matrix(batch.column("unit"), np.float32)
                for tree in range(TREES if bits else 1):
                    code = ((x @ planes[tree].T > 0) @ (1 << np.arange(planes.shape[1]))) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int64))], ["node", "unit", "tree", "code"])

    placed = nodes.select("node", "unit").mapInArrow(sides, "node long, unit binary, tree int, code long")
    sizes = placed.groupBy("tree", "code").count().select("tree", "code", F.ceil(F.col("count") / (2 * BLOCK)).alias("cuts"))
    placed = placed.join(sizes, ["tree", "code"]).withColumn("cut", F.pmod(F.xxhash64("node", "tree"), F.col("cuts")))
    kept = DEGREE // 2 if bits else DEGREE

    def compare(table: pa.Table) -> pa.Table:
        x, names = bytes_matrix(table.column("unit"), np.float32), table.column("node").to_numpy()
        near = x @ x.T
        np.fill_diagonal(near, -2)
        k = min(kept, len(names) - 1)
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(names), 0), np.int64)
        return best_of(np.repeat(names, k), names[best.ravel()], np.take_along_axis(near, best, 1).ravel(), np.ones(len(names) * k, bool))

    return packed(placed.groupBy("tree", "code", "cut").applyInArrow(compare, EDGES))


def edges_of(graph: DataFrame) -> DataFrame:
    """node, other, near, fresh: one row an edge."""
    return graph.select("node", F.inline(F.arrays_zip("other", "near", "fresh")))


def around(edges: DataFrame) -> DataFrame:
    """at, node: each node's neighbours, and some that it is a neighbour of (the nearest of these); a pair may come twice."""
    back = edges.withColumn("place", F.row_number().over(W.partitionBy("other").orderBy(F.desc("near"), "node"))).where(F.col("place") <= REVERSE)
    return edges.select(F.col("node").alias("at"), F.col("other").alias("node")).union(back.select(F.col("other").alias("at"), "node"))


def marked(edges: DataFrame, before: DataFrame | None) -> DataFrame:
    """at, node, new, live: the pairs of ``around``; new: not among those of ``before``; live: its ``at`` has a new one."""
    pairs = around(edges).withColumn("new", F.lit(True))
    if before is not None:
        pairs = pairs.union(before.select("at", "node", F.lit(False)))
    # Dealt by at once, for both the comparison with the pairs before and the groups.
    pairs = pairs.repartition("at").groupBy("at", "node").agg(F.min("new").alias("new"), F.max("new").alias("now")).where("now").drop("now")
    return stash(pairs.withColumn("live", F.max("new").over(W.partitionBy("at"))), "pairs")


def best_of(node: np.ndarray, other: np.ndarray, near: np.ndarray, fresh: np.ndarray) -> pa.Table:
    """node, other, near, fresh (arrays): each node's DEGREE nearest distinct others; an edge is fresh if it is so wherever it occurs."""
    if not len(node):
        return ARROW_EDGES.empty_table()
    order = np.lexsort((other, node))
    node, other, near, fresh = node[order], other[order], near[order], fresh[order]
    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])]))
    node, other, near, fresh = node[first], other[first], np.maximum.reduceat(near, first), np.logical_and.reduceat(fresh, first)
    order = np.lexsort((other, -near, node))
    node, other, near, fresh = node[order], other[order], near[order], fresh[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, len(node)))
    kept = np.arange(len(node)) - np.repeat(first, size) < DEGREE
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(size, DEGREE))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept])) for x in (other, near, fresh)]
    return pa.table([pa.array(node[first]), *lists], ARROW_EDGES)


def gathered(batches, rows: int):
    """The batches as tables of at least ``rows`` rows (but the last)."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, many = [], 0
    if many:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(found: DataFrame) -> DataFrame:
    """The nearest edges of each node, of rows that hold some of them (node and arrays)."""

    def merge(batches):
        held = None
        for table in gathered(batches, GATHERED):
            table = table.cast(ARROW_EDGES)  # Spark's lists may say that they hold no nulls
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            lists = [table.column(c).combine_chunks() for c in ("other", "near", "fresh")]
            lists = [pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            node = np.repeat(table.column("node").to_numpy(), lists[0].value_lengths().to_numpy())
            best = best_of(node, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists))
            # The last node may go on in the next rows; it has at most DEGREE edges now.
            held = best.slice(max(0, best.num_rows - 1))
            yield from best.slice(0, max(0, best.num_rows - 1)).to_batches()
        if held is not None:
            yield from held.to_batches()

    found = found.repartition("node").sortWithinPartitions("node")
    return stash(found.mapInArrow(merge, EDGES), "graph")


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round that compares all pairs, of and to one row an edge."""
    lists = graph.select("node", *(F.array(c).alias(c) for c in ("other", "near", "fresh")))
    return edges_of(compared(packed(lists), nodes, marked(graph, None)))


def compared(graph: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One round: neighbours of a node are compared with one another; each node keeps its nearest. Edges that it had not are fresh.

    Two nodes that met at the same node in the last round were compared then, and what a node keeps only
    gets nearer, so only comparisons with a new one can change the graph.
    """
    least = graph.select("node", F.when(F.size("near") >= DEGREE, F.array_min("near")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    # Many short rows in small files: never broadcast through the driver.
    met = pairs.where("live").select("at", "node", "new").hint("merge").join(nodes.select("node", "unit").join(least, "node"), "node")
    met = met.repartition("at").sortWithinPartitions("at")

    def run(batches):
        held = None
        for table in gathered(batches, GATHERED):
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            at = table.column("at").to_numpy()
            cut = int(np.searchsorted(at, at[-1]))  # the last group may go on
            held = table.slice(cut)
            yield from compare(table.slice(0, cut))
        if held is not None:
            yield from compare(held)

    def compare(table: pa.Table):
        if not table.num_rows:
            return
        at, names, least, new = (table.column(c).to_numpy() for c in ("at", "node", "least", "new"))
        x = bytes_matrix(table.column("unit"), np.float32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(first, len(at)))
        parts = []
        for k in range(0, len(first), 64):
            f, s = first[k : k + 64], size[k : k + 64]
            width = int(s.max())
            place = np.minimum(f[:, None] + np.arange(width), len(at) - 1)
            live = np.arange(width) < s[:, None]
            block = x[place]
            near = block @ block.transpose(0, 2, 1)
            fresh = live & new[place]
            better = (near > np.where(live, least[place], 3)[:, :, None]) & live[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
            better[:, np.arange(width), np.arange(width)] = False
            g, i, j = np.nonzero(better)
            parts.append((names[place[g, i]], names[place[g, j]], near[g, i, j]))
        node, other, near = (np.concatenate(c) for c in zip(*parts))
        yield from best_of(node, other, near, np.ones(len(node), bool)).to_batches()

    found = met.select("at", "node", "unit", "least", "new").mapInArrow(run, EDGES)
    old = graph.select("node", "other", "near", F.transform("fresh", lambda _: F.lit(False)).alias("fresh"))
    return packed(old.union(found))


def build_graph(nodes: DataFrame, dimension: int) -> DataFrame:
    """node, other, near, fresh: the graph after the rounds, one row an edge."""
    graph, pairs = first_graph(nodes, dimension, nodes.count()), None
    while True:
        before, pairs = pairs, marked(edges_of(graph), pairs)
        if before is not None:
            discard(before)
        before, graph = graph, compared(graph, nodes, pairs)
        discard(before)
        fresh, edges = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if (fresh or 0) <= SETTLED * (edges or 0):
            discard(pairs)
            return edges_of(graph)


@F.pandas_udf(T.FloatType())
def dots(a, b):
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float32")
    x, y = (np.frombuffer(b"".join(s), np.float32).reshape(len(s), -1) for s in (a, b))
    return pd.Series(np.einsum("ij,ij->i", x, y))


@F.pandas_udf(T.DoubleType())
def cosines(a, b):
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = np.stack(list(a)), np.stack(list(b))
    return pd.Series((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))))


def greedy_search(starts: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, node, near: the beams of ``starts`` (query, node, unit of the query) after the walk."""
    units = nodes.select("node", F.col("unit").alias("to"))
    queries = stash(starts.select("query", "unit").distinct(), "queries")
    links = stash(around(graph).distinct().withColumnRenamed("at", "from"), "links")
    beam = starts.select("query", "node").distinct().join(units, "node").join(queries, "query").select("query", "node", dots("unit", "to").alias("near"), F.lit(False).alias("done"))
    beam = stash(beam, "beam")
    while True:
        place = F.row_number().over(W.partitionBy("query", "done").orderBy(F.desc("near"), "node"))
        ranked = beam.withColumn("now", ~F.col("done") & (place <= EXPAND))
        met = ranked.where("now").select("query", F.col("node").alias("from")).join(links, "from").select("query", "node").distinct()
        met = met.join(beam.select("query", "node"), ["query", "node"], "left_anti")
        fresh = met.join(units, "node").join(queries, "query").select("query", "node", dots("unit", "to").alias("near"), F.lit(False).alias("done"))
        both = ranked.select("query", "node", "near", (F.col("done") | F.col("now")).alias("done")).union(fresh)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "node"))
        before, beam = beam, stash(both.withColumn("place", place).where(F.col("place") <= BEAM).drop("place"), "beam")
        discard(before)
        if beam.where("NOT done").isEmpty():
            return beam.select("query", "node", "near")


def top_k(table: DataFrame, k: int, id_col: str, vector_col: str, is_query) -> DataFrame:
    """query_id, rank, vec_id, score: of each row with ``is_query`` (over ``id``), the k nearest other rows found."""
    nodes, dimension = unit_nodes(table, id_col, vector_col, k + 1)
    graph = build_graph(nodes, dimension)
    # A query is a row of the table: its vector's node, wherever that node is, begins the walk.
    rows = valid_vectors(table, id_col, vector_col).where(is_query)
    queries = stash(rows.join(nodes.select("node", "vector"), "vector").select(F.col("id").alias("query_id"), "node"), "asked")
    starts = queries.select("node").distinct().join(nodes.select("node", "unit"), "node").select(F.col("node").alias("query"), "node", "unit")
    found = greedy_search(starts, graph, nodes)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "node"))
    found = found.withColumn("place", place).where(F.col("place") <= 4 * (k + 1)).select("query", "node")
    vectors = nodes.select("node", "ids", "vector")
    exact = found.join(vectors, "node").join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("asked")), "query")
    exact = exact.select(F.col("query").alias("node"), "ids", cosines("asked", "vector").alias("score"))
    pairs = queries.join(exact, "node").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
