"""Approximate nearest neighbours by NN-descent and greedy graph search.

Similarity is the cosine.  The graph starts from random projection trees: rows of one leaf are
compared with each other.  Each round then joins, at every node, its neighbours and the nodes that
have it as theirs, and offers every pair of them to each other where one of the two links is new
and the similarity beats the worst neighbour held, until few links change.  Vectors travel with a
byte for each dimension; the neighbours that are given out are compared anew in full precision.
Rows with equal vectors are one node.  A query walks the graph: it looks at the neighbours of the
best nodes it has not looked at yet, until it has looked into all that it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.llm.common import cut, group_bounds, table, whole_groups

NEIGHBOURS = 10
#: Links of each node in the graph, and of those to it that a round joins.
DEGREE = 48
TREES = 4
LEAF = 384
ROUNDS = 8
#: A round that changes less than this share of the links is the last.
CHANGED = 0.015
#: Nodes that a query looks into in each round of its walk.
EXPAND = 4
#: Neighbours that are held in a walk, and compared in full precision, for each one given out.
SPARE = 2
#: The queries are the rows whose id this divides.
ASKED = 20

LINKS = "id long, ids array<long>, sims array<float>, fresh array<boolean>"


def _fixed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in single precision from their bytes and scale."""
    raw = _fixed(column, np.uint8, dim + 4)
    return raw[:, :dim].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, dim:]).view(np.float32)


def valid(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the rows that have an id and a vector of finite numbers of the commonest length, the longer of two; least vector of an id."""
    x = F.col(vector).cast("array<double>")
    named = rows.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    fine = named.where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v)))
    common = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common.n if common else 0
    return fine.where(F.size("x") == dim).groupBy("id").agg(F.min("x").alias("x")), dim


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """(id, v): unit vectors, a byte for each dimension and the scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, dim)
            big = np.abs(x).max(axis=1, keepdims=True)
            x = x / np.where(big > 0, big, 1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            scale = (np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30) / 127).astype(np.float32)
            raw = np.concatenate((np.rint(x / scale).astype(np.int8).view(np.uint8), scale.view(np.uint8).reshape(-1, 4)), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "v"])

    return rows.mapInArrow(run, "id long, v binary")


def _lists(owner: list[np.ndarray], size: list[np.ndarray], ids: list[np.ndarray], sims: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(size)))).astype(np.int32))
    every = np.concatenate(ids)
    values = (pa.array(every, pa.int64()), pa.array(np.concatenate(sims), pa.float32()), pa.array(np.ones(len(every), bool)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(owner), pa.int64()), *(pa.ListArray.from_arrays(offsets, v) for v in values)], names=["id", "ids", "sims", "fresh"])


def seeds(vectors: DataFrame, dim: int, n: int, degree: int, trees: int, leaf: int) -> DataFrame:
    """Links between rows of a leaf of each random projection tree."""
    bits = max(0, int(math.log2(max(1, n / leaf))))
    planes = np.random.default_rng(1).normal(size=(trees, dim, bits + 1)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column("v"), dim)
            for t in range(trees):
                p = x @ planes[t]
                code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(p), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t)), pa.array(code), pa.array(p[:, bits]), batch.column("id"), batch.column("v")], names=["tree", "code", "p", "id", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["tree", "code"], leaf):
            ids, x = part.column("id").to_numpy(), _unpack(part.column("v").combine_chunks(), dim)
            out: tuple[list, list, list, list] = ([], [], [], [])
            edges = group_bounds(part.column("tree").to_numpy(), part.column("code").to_numpy())
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                pieces = np.linspace(lo, hi, -(-(hi - lo) // leaf) + 1).astype(int)
                for a, b in zip(pieces[:-1], pieces[1:], strict=True):
                    if b - a < 2:
                        continue
                    s = x[a:b] @ x[a:b].T
                    np.fill_diagonal(s, -9)
                    m = min(degree, b - a - 1)
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    out[0].append(ids[a:b]), out[1].append(np.full(b - a, m))
                    out[2].append(ids[a:b][top].reshape(-1)), out[3].append(np.take_along_axis(s, top, 1).reshape(-1))
            if out[0]:
                yield _lists(*out)

    placed = vectors.mapInArrow(place, "tree long, code long, p float, id long, v binary")
    return placed.repartition("tree", "code").sortWithinPartitions("tree", "code", "p", "id").mapInArrow(compare, LINKS)


def merged(links: DataFrame, degree: int) -> DataFrame:
    """The best links of each node: by similarity, then id; a link held before counts as old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column("ids")
                begin = column.offsets.to_numpy().astype(np.int64)
                own = np.repeat(np.arange(part.num_rows), np.diff(begin))
                flat = [part.column(c).values.slice(begin[0], begin[-1] - begin[0]).to_numpy(zero_copy_only=False) for c in ("ids", "sims", "fresh")]
                order = np.lexsort((flat[2], flat[0], own))
                own, (ids, sims, fresh) = own[order], (f[order] for f in flat)
                once = np.ones(len(own), bool)
                once[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])
                own, ids, sims, fresh = own[once], ids[once], sims[once], fresh[once]
                order = np.lexsort((ids, -sims, own))
                own, ids, sims, fresh = own[order], ids[order], sims[order], fresh[order]
                first = np.searchsorted(own, np.arange(part.num_rows))
                best = np.arange(len(own)) - first[own] < degree
                own, ids, sims, fresh = own[best], ids[best], sims[best], fresh[best]
                offsets = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32))
                values = (pa.array(ids, pa.int64()), pa.array(sims, pa.float32()), pa.array(fresh.astype(bool)))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.ListArray.from_arrays(offsets, v) for v in values)], names=["id", "ids", "sims", "fresh"])

    together = links.groupBy("id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "sims", "fresh")))
    return together.mapInArrow(run, LINKS)


def offers(graph: DataFrame, vectors: DataFrame, dim: int, degree: int, turn: int) -> DataFrame:
    """What the local join of each node offers to its members."""
    link = graph.select(F.col("id").alias("a"), F.explode(F.arrays_zip("ids", "fresh")).alias("l")).select("a", F.col("l.ids").alias("b"), F.col("l.fresh").alias("fresh"))
    chosen = Window.partitionBy("b").orderBy(F.desc("fresh"), F.xxhash64("a", "b", F.lit(turn)))
    back = link.withColumn("i", F.row_number().over(chosen)).where(F.col("i") <= degree)
    member = link.select(F.col("a").alias("centre"), F.col("b").alias("id"), "fresh").unionByName(back.select(F.col("b").alias("centre"), F.col("a").alias("id"), "fresh"))
    worst: Column = F.when(F.size("sims") >= degree, F.element_at("sims", -1)).otherwise(F.lit(-9.0)).cast("float")
    known = vectors.join(graph.select("id", worst.alias("worst")), "id", "left")
    rows = member.join(known, "id").select("centre", "id", "fresh", F.coalesce("worst", F.lit(-9.0).cast("float")).alias("worst"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["centre"]):
            ids, fresh, worst = (part.column(c).to_numpy() for c in ("id", "fresh", "worst"))
            x = _unpack(part.column("v").combine_chunks(), dim)
            edges = group_bounds(part.column("centre").to_numpy())
            out: tuple[list, list, list, list] = ([], [], [], [])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                new = fresh[a:b].astype(bool)
                if b - a < 2 or not new.any():
                    continue
                s = x[a:b] @ x[a:b].T
                good = (s > worst[a:b, None]) & (new[:, None] | new[None, :]) & (ids[a:b, None] != ids[None, a:b])
                size = good.sum(axis=1)
                some = np.flatnonzero(size)
                if len(some):
                    i, j = np.nonzero(good)
                    out[0].append(ids[a:b][some]), out[1].append(size[some])
                    out[2].append(ids[a:b][j]), out[3].append(s[i, j])
            if out[0]:
                yield _lists(*out)

    return rows.repartition("centre").sortWithinPartitions("centre", "id").mapInArrow(run, LINKS)


def descend(vectors: DataFrame, dim: int, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, changed: float = CHANGED) -> DataFrame:
    """The neighbour graph (id, ids, sims, fresh) of vectors (id, v); fresh marks what the last round changed."""
    n = vectors.count()
    graph = cut(merged(seeds(vectors, dim, n, degree, trees, leaf), degree))
    for turn in range(rounds):
        old = graph.select("id", "ids", "sims", F.transform("fresh", lambda _: F.lit(False)).alias("fresh"))
        graph = cut(merged(old.unionByName(offers(graph, vectors, dim, degree, turn)), degree))
        new = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if new < changed * n * degree:
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, dim: int, beam: int, expand: int = EXPAND) -> DataFrame:
    """(id, ids, sims, fresh) for queries (id, v, start array<long>): the best nodes found by walking the graph from start.

    In each hop a query looks into the neighbours of its best nodes, of the beam it holds, that it
    has not looked into; the walk ends when no query has one left.  A query is not its own
    neighbour where a node has its id.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _unpack(batch.column("qv"), dim), _unpack(batch.column("v"), dim))
                one = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.ListArray.from_arrays(one, v) for v in (batch.column("node"), pa.array(s, pa.float32()), pa.array(np.ones(len(s), bool))))], names=["id", "ids", "sims", "fresh"])

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.where("id <> node").join(vectors.withColumnRenamed("id", "node"), "node")
        return near.join(queries.select("id", F.col("v").alias("qv")), "id").select("id", "node", "qv", "v").mapInArrow(measure, LINKS)

    pool = cut(merged(compared(queries.select("id", F.explode(F.col("start").cast("array<long>")).alias("node")).distinct()), beam))
    seen = queries.select("id", F.array().cast("array<long>").alias("done"))
    while True:
        state = pool.join(seen, "id", "left").withColumn("next", F.slice(F.array_except("ids", F.coalesce("done", F.array().cast("array<long>"))), 1, expand))
        state = cut(state.withColumn("done", F.concat(F.coalesce("done", F.array().cast("array<long>")), "next")))
        step = state.select("id", F.explode("next").alias("at"), F.col("ids").alias("have"))
        if step.isEmpty():
            break
        found = step.join(graph.select(F.col("id").alias("at"), F.col("ids").alias("to")), "at").select("id", F.explode(F.array_except("to", "have")).alias("node")).distinct()
        pool = cut(merged(pool.unionByName(compared(found)), beam))
        seen = state.select("id", "done")
    return pool


def nodes(exact: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, id, x) of the k + 1 least ids of each distinct vector of exact (id, x), and (id, node) of all rows; node: the least id that has the vector."""
    key = exact.select("id", "x", F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(7), "x").alias("b")).alias("key"))
    least = Window.partitionBy("key").orderBy("id")
    few = cut(key.withColumn("i", F.row_number().over(least)).where(F.col("i") <= k + 1))
    of = few.where("i = 1").select("key", F.col("id").alias("node"))
    return few.join(of, "key").select("node", "id", "x"), key.select("id", "key").join(of, "key").select("id", "node")


def nearest(rows: DataFrame, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, asked: int = 1) -> DataFrame:
    """The k nearest other rows of each row whose id asked divides, among all rows, by walks that start from its links in the graph.

    Returns (vec_id, neighbour_ids, similarities), one row for each distinct id, best first; equal
    similarities go by id.  Rows without an id are left out.  A null, empty or odd-sized vector and
    one with null or infinite parts is no node: its row has null lists.  Of rows that repeat an id
    the least vector counts.  A zero vector has similarity 0 to all.  With fewer rows than k the
    lists are shorter; an empty table gives no rows; further columns are left out.
    """
    exact, dim = valid(rows, id_column, vector)
    every = rows.select(F.col(id_column).cast("long").alias("vec_id")).where(f"vec_id IS NOT NULL AND vec_id % {asked} = 0").distinct()
    if not dim:
        return every.select("vec_id", F.lit(None).cast("array<long>").alias("neighbour_ids"), F.lit(None).cast("array<double>").alias("similarities"))
    exact = cut(exact)
    members, of = nodes(exact, k)
    members = cut(members)
    vectors = cut(packed(members.where("id = node").select("id", "x"), dim))
    graph = descend(vectors, dim, degree)
    of = cut(of.where(f"id % {asked} = 0"))
    starts = graph.join(of.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", F.slice("ids", 1, SPARE * k).alias("start"))
    found = search(vectors.join(starts, "id"), graph, vectors, dim, SPARE * k).select("id", F.explode("ids").alias("near"))
    # A query's own node holds the rows that equal it.
    found = found.unionByName(of.select(F.col("node").alias("id"), F.col("node").alias("near")).distinct())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for c in ("x", "y"))
                size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                s = np.einsum("ij,ij->i", a, b) / np.where(size > 0, size, 1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("near"), pa.array(s)], names=["id", "near", "s"])

    single = members.where("id = node").select("node", F.col("x").cast("array<float>").alias("x"))
    both = found.join(single.select(F.col("node").alias("near"), F.col("x").alias("y")), "near").join(single.select(F.col("node").alias("id"), "x"), "id").select("id", "near", "x", "y")
    near = both.mapInArrow(measure, "id long, near long, s double")
    # The nodes' rows: k + 1 of each are enough, as a query leaves out no row but itself.
    reached = near.join(members.select(F.col("node").alias("near"), F.col("id").alias("other")), "near")
    ranked = reached.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "other"))), 1, k + 1).alias("best"))
    best = F.slice(F.filter("best", lambda b: b["other"] != F.col("i")), 1, k)
    # A row without any other has an empty list.
    named = of.select(F.col("id").alias("i"), "node").join(ranked, F.col("node") == F.col("id"), "left").select("i", best.alias("best"))
    named = named.select("i", F.coalesce(F.col("best.other"), F.array().cast("array<long>")).alias("neighbour_ids"), F.coalesce(F.transform("best", lambda b: -b["d"]), F.array().cast("array<double>")).alias("similarities"))
    return every.join(named, F.col("vec_id") == F.col("i"), "left").select("vec_id", "neighbour_ids", "similarities")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are nodes of the graph; the rows whose id ASKED divides are the queries."""
    return nearest(table(spark, sf_dir, "embeddings"), asked=ASKED)
