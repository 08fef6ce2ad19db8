"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node with its smallest ids. The graph starts from small cells, cut by random hyperplanes several
times over, in which all pairs are compared. A round of NN-descent joins every node's neighbours and reverse neighbours
with their vectors, compares the neighbours of a node with each other, and keeps each node's nearest; rounds end when few
neighbours change. A query starts at its own node's neighbours and, round by round, expands its nearest candidates in
the graph until none that it keeps is left to expand; candidates are scored in double precision on the original vectors.

Cells and reverse lists are bounded, so no task holds more than a bounded group; bounds cost only recall, which is
measured against brute force in the tests.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the most common one (the smaller of ties); null ids take no part; a repeated id is one candidate for each
different vector; a table with one vector has no pairs; vectors with components of any size are compared by their
directions (they are scaled by a power of two first); a query whose search ends with fewer candidates than were asked for is
compared with all vectors; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_rows, parallelism, saved, table

#: Neighbours a node keeps; reverse neighbours that join them; finds of a neighbour in one neighbourhood.
DEGREE, REVERSE, FINDS = 30, 15, 4
#: Cuts of the start; vectors wanted and at most in a cell; neighbours taken from a cell.
TREES, CELL, MOST_IN_CELL, CELL_LINKS = 16, 768, 1536, 8
#: The descent ends when fewer neighbours than this share change in a round.
ENOUGH = 0.02
#: Vectors that the planes are drawn from.
SAMPLE = 4000
#: Queries without enough candidates that are compared with all vectors at a time, times 64.
BLOCK = 8
#: Candidates a query keeps; those it expands in a round.
BEAM, EXPAND = 160, 25

GRAPH = "node long, near long, sim float"


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, h) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")  # exact for floats
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (size["d"] if size else 0)).withColumn("h", F.xxhash64("v"))


def _group_rows(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with the same first n_keys values."""
    now, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != now:
                if group:
                    yield group
                now, group = row[:n_keys], []
            group.append(row)
    if group:
        yield group


def _edges(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, s = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], ["node", "near", "sim"])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
        # a direction in a byte a component: enough to steer by, as results are scored on the original vectors
        u = np.rint(v / np.abs(v).max(axis=1, keepdims=True) * 127).astype(np.int8) if v.size else v.astype(np.int8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in u], pa.binary())], ["node", "u"])


def _units(data: list[bytes]) -> np.ndarray:
    u = np.frombuffer(b"".join(data), np.int8).reshape(len(data), -1).astype(np.float32)
    return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)


def _cutter(planes, cuts):
    """Rows (node, u) -> (tree, cell, node, u); a cell is the side of each of a tree's planes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _units(batch.column(1).to_pylist())
            for tree, (p, c) in enumerate(zip(planes, cuts)):
                sides = (u @ p.T > c).astype(np.int64)
                cell = sides @ (1 << np.arange(sides.shape[1], dtype=np.int64)) if sides.shape[1] else np.zeros(len(u), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), tree, np.int32)), pa.array(cell), batch.column(0), batch.column(1)], ["tree", "cell", "node", "u"])

    return cut


def _compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = []
    for group in _group_rows(batches, 3):
        ids = [g[3] for g in group]
        u = _units([g[4] for g in group])
        s = u @ u.T
        np.fill_diagonal(s, -2)
        k = min(CELL_LINKS, len(ids) - 1)
        if k > 0:
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found += [(ids[i], ids[j], float(s[i, j])) for i in range(len(ids)) for j in best[i]]
        if len(found) > 50_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _join_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, near, worst, u) sorted by node: for each neighbour of a node the nearest others among them, if they are
    nearer than its worst neighbour so far."""
    found = []
    for group in _group_rows(batches, 1):
        ids, worst = np.array([g[1] for g in group]), np.array([g[2] for g in group], np.float32)
        u = _units([g[3] for g in group])
        s = u @ u.T
        np.fill_diagonal(s, -2)
        s[s <= worst[:, None] + 1e-6] = -2
        k = min(FINDS, len(ids))
        b = np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()
        a = np.repeat(np.arange(len(ids)), k)
        keep = s[a, b] > -2
        a, b = a[keep], b[keep]
        found += zip(ids[a].tolist(), ids[b].tolist(), s[a, b].tolist())
        if len(found) > 50_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _nearest(edges: DataFrame, k: int, key: str = "node", other: str = "near") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("sim"), other))
    return edges.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def graph(units: DataFrame, degree: int = DEGREE, trees: int = TREES, seed: int = 7) -> DataFrame:
    """units(node, u) -> (node, near, sim): about the `degree` nearest of every node."""
    spark = units.sparkSession
    n = units.count()
    sample = units.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("u").collect()  # bounded by SAMPLE
    u = _units([r["u"] for r in sample]) if sample else np.zeros((0, 1), np.float32)
    bits = max(0, int(np.ceil(np.log2(max(1, n) / CELL))))
    rng = np.random.default_rng(seed)
    planes, cuts = [], []
    for _ in range(trees):
        if len(u) > 1 and bits:
            # a plane between two sampled vectors follows the data's own directions
            a, b = (u[rng.integers(0, len(u), bits)] for _ in range(2))
            p = a - b + rng.normal(size=a.shape).astype(np.float32) * 0.05
        else:
            p = np.zeros((0, u.shape[1]), np.float32)
        planes.append(p)
        cuts.append(np.median(u @ p.T, axis=0) if len(p) else np.zeros(0))
    cells = saved(units.mapInArrow(_cutter(planes, cuts), "tree int, cell long, node long, u binary"), "nn-cells")
    # a cell with many vectors is dealt in parts of bounded size
    parts = cells.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / MOST_IN_CELL).alias("parts"))
    dealt = cells.join(parts, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    dealt = dealt.select("tree", "cell", "part", "node", "u").repartition(parallelism(spark), "tree", "cell", "part").sortWithinPartitions("tree", "cell", "part")
    g = saved(_nearest(dealt.mapInArrow(_compare_cells, GRAPH).groupBy("node", "near").agg(F.max("sim").alias("sim")), degree), "nn-graph")
    while True:  # neighbours only ever get nearer, so it ends
        worst = g.groupBy("node").agg(F.when(F.count(F.lit(1)) < degree, F.lit(-2.0)).otherwise(F.min("sim")).cast("float").alias("worst"))
        back = _nearest(g.select(F.col("near").alias("node"), F.col("node").alias("near"), "sim"), REVERSE)
        around = g.unionByName(back).select("node", "near").distinct()
        info = units.join(worst, "node", "left").select(F.col("node").alias("near"), F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "u")
        joined = around.join(info, "near").select("node", "near", "worst", "u").repartition(parallelism(spark), "node").sortWithinPartitions("node")
        more = joined.mapInArrow(_join_neighbours, GRAPH)
        new = saved(_nearest(g.unionByName(more).groupBy("node", "near").agg(F.max("sim").alias("sim")), degree), "nn-graph")
        changed = new.join(g.select("node", "near"), ["node", "near"], "left_anti").count()
        g = new
        if changed <= ENOUGH * n * degree:
            return g


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, c, qu, u) -> similarity by units."""
    for batch in batches:
        s = (_units(batch.column(2).to_pylist()) * _units(batch.column(3).to_pylist())).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))], ["q", "c", "sim"])


def scaled(v: Column) -> Column:
    """v times the power of two that brings its largest component near 1: exact, so that squares neither vanish nor overflow
    and a cosine stays the same to the last bit. The smallest doubles are below the reach of one power, and have two."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    power = -F.floor(F.log2(most))
    first = F.least(power, F.lit(1000))
    return F.transform(v, lambda x: x * F.pow(F.lit(2.0), first.cast("double")) * F.pow(F.lit(2.0), (power - first).cast("double")))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (na * nb)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows that were found."""
    spark = vectors.sparkSession
    batch_rows(spark, 5000)
    rows = saved(valid(vectors, id_col, vec_col), "nn-rows")
    nodes = rows.groupBy("h", "v").agg(F.min("vec_id").alias("node")).withColumn("w", scaled(F.col("v")))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    nodes = saved(nodes.withColumn("norm", norm), "nn-nodes")
    of_row = saved(rows.join(nodes.select("h", F.col("v").alias("v2"), "node"), "h").filter("v = v2").select("vec_id", "node"), "nn-members")
    units = saved(nodes.select("node", "v").mapInArrow(_unit, "node long, u binary"), "nn-units")
    g = graph(units)
    queries = saved(of_row.filter(is_query), "nn-queries").withColumnRenamed("vec_id", "query_id")
    start = queries.select(F.col("node").alias("q")).distinct()
    asked = saved(start.join(units, F.col("q") == F.col("node")).select("q", F.col("u").alias("qu")), "nn-asked")

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(units, F.col("c") == F.col("node")).join(asked, "q").select("q", "c", "qu", "u")
        return full.mapInArrow(_score, "q long, c long, sim float")

    found = saved(scored(start.select("q", F.col("q").alias("c"))).withColumn("open", F.lit(True)), "nn-found")
    back = saved(_nearest(g, REVERSE, "near", "node").select(F.col("near").alias("node"), F.col("node").alias("c")), "nn-back")
    # a candidate that has left the beam can't come back, as the beam only gets nearer: each is expanded once
    while not found.filter("open").isEmpty():
        rank = F.row_number().over(W.partitionBy("q", "open").orderBy(F.desc("sim"), "c"))
        ranked = found.withColumn("go", F.col("open") & (rank <= EXPAND))
        front = ranked.filter("go").select("q", F.col("c").alias("node"))
        # out and back along the edges of the graph
        forth = front.join(g, "node").select("q", F.col("near").alias("c"))
        out = forth.unionByName(front.join(back, "node").select("q", "c"))
        new = out.distinct().join(found.select("q", "c"), ["q", "c"], "left_anti")
        both = ranked.select("q", "c", "sim", (F.col("open") & ~F.col("go")).alias("open")).unionByName(scored(new).withColumn("open", F.lit(True)))
        found = saved(_nearest(both, BEAM, "q", "c"), "nn-found")
    # the best by direction are scored in double precision on the original vectors
    vec = nodes.select("node", F.col("w").alias("v"), "norm")
    best = found.select("q", "c").join(vec.select(F.col("node").alias("c"), "v", "norm"), "c").join(vec.select(F.col("node").alias("q"), F.col("v").alias("qv"), F.col("norm").alias("qn")), "q")
    best = _nearest(best.select("q", "c", cosine(F.col("qv"), F.col("v"), F.col("qn"), F.col("norm")).alias("sim")), k + 1, "q", "c")
    members = of_row.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).filter(F.col("_r") <= k + 1).select(F.col("node").alias("c"), "vec_id")
    pairs = queries.join(best, F.col("node") == F.col("q")).join(members, "c").filter("vec_id <> query_id").select("query_id", "vec_id", F.col("sim").alias("score"))
    pairs = saved(pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "nn-pairs")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # queries that the graph didn't lead to enough candidates, as a vector that shares no cell with others has no edges
    enough = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
    counts = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough)
    short = saved(queries.select("query_id", "node").distinct().join(counts, "query_id", "left_anti").withColumn("block", F.floor((F.row_number().over(W.partitionBy(F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) - 1) / BLOCK)), "nn-short")
    blocks = (short.agg(F.max("block")).first()[0] if enough else None)
    for b in range(0 if blocks is None else int(blocks) + 1):
        # at most 64 * BLOCK queries meet all vectors at a time
        ask = short.filter(F.col("block") == b).join(vec, "node").select("query_id", F.col("node").alias("q"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
        every = vec.crossJoin(F.broadcast(ask)).select(F.col("query_id").alias("q"), F.col("node").alias("c"), cosine(F.col("qv"), F.col("v"), F.col("qn"), F.col("norm")).alias("sim"))
        near = _nearest(every, k + 1, "q", "c").join(members, "c").filter("vec_id <> q").select(F.col("q").alias("query_id"), "vec_id", F.col("sim").alias("score"))
        pairs = saved(pairs.unionByName(near).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "nn-pairs")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
