"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is built on the driver from a seeded sample of about ``sample_rows``
vectors; every vector of the table is then sent down to a leaf.  A query visits
leaves best bin first: a priority queue holds branches by the inner product
that their centre promises.  How many leaves a query visits is calibrated: for
a few queries the true neighbours among all vectors are found by a scan, and
visits are widened until these queries reach ``recall``, and some more.

Leaves are searched as blocks of a matrix product, the first few of each query
before the others: of the others only rows come back that reach the last place
so far.  Leaves with many vectors, or that many queries visit, are cut into
lots, so that no block outgrows a task.  What is broadcast, the tree and the
visits of the calibrated queries, is bounded by parameters: leaves number a
``SAMPLE_A_LEAF``-th of the sample at most, and beyond that grow in rows.

Each row carries the number of leaves that queries visit and the recall that
the calibrated queries reach with it.

Vectors that are null, empty or zero, hold a null or a number that isn't
finite, or are not as long as most are, take no part.  Equal scores go to the
smaller id; rows that repeat id and vector count once, and an id with several
vectors takes part with each of them, as query and as candidate, but never
finds itself; rows without id take no part; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import stored

SAMPLE_ROWS, BRANCHES, LEAF_ROWS, SAMPLE_A_LEAF = 100_000, 8, 200, 20
#: Queries that are calibrated, the share of their true neighbours that visits must reach, and visits beyond that.
CALIBRATED, RECALL, MARGIN = 100, 0.97, 1.25
#: Leaves that are searched first, to know what a row of the other ones must reach.
FIRST = 4
#: Vectors and queries in a block.
LOT_ROWS, LOT_QUERIES = 4_000, 1_000


class Tree:
    """Nodes by number; ``children`` of a leaf are empty, ``leaf`` numbers leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.centres, self.radii, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        least = max(1, len(sample) // max(1, leaves))
        self._grow(sample, least, rng)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _grow(self, rows: np.ndarray, least: int, rng) -> int:
        me = len(self.centres)
        centre = rows.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(rows, min(BRANCHES, -(-len(rows) // least)), rng) if len(rows) >= 2 * least else []
        if len(parts) > 1:
            self.children[me] = [self._grow(p, least, rng) for p in parts]
        else:
            self.leaf[me] = self.leaves
            self.leaves += 1
        return me

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng, steps: int = 10) -> list[np.ndarray]:
        centres = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(steps):
            near = (rows @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
            centres = np.array([rows[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        near = (rows @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        return [rows[near == j] for j in range(k) if (near == j).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at each step down."""
        out, open_ = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while open_:
            node, own = open_.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            centres = self.centres[kids]
            near = (rows[own] @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
            open_ += [(int(k), own[near == j]) for j, k in enumerate(kids) if (near == j).any()]
        return out

    def visits(self, query: np.ndarray, most: int, slack: float = 0.5) -> list[int]:
        """Leaves in the order in which a priority queue reaches them, at most ``most``."""
        length, found, queue = float(np.sqrt(query @ query)), [], [(0.0, 0)]
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
                continue
            kids = self.children[node]
            for k, promise in zip(kids, (self.centres[kids] @ query + slack * length * self.radii[kids]).tolist(), strict=True):
                heapq.heappush(queue, (-promise, k))
        return found


def scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever the row lies."""
    return (rows * query).sum(axis=1)


def best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """For each query: positions of its ``k`` best rows, by score, then id, without itself; and their scores."""
    product = queries @ rows.T
    for q, query in enumerate(queries):
        line = product[q].copy()
        line[ids == own[q]] = -np.inf
        n = int((line > -np.inf).sum())
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        floor = -np.partition(-line, min(k, n) - 1)[min(k, n) - 1]
        near = np.flatnonzero(line >= floor - 1e-9 * (1 + abs(floor)))
        exact = scores(query, rows[near])
        order = np.lexsort((ids[near], -exact))[:k]
        yield near[order], exact[order]


def _matrix(column) -> np.ndarray:
    """A list column whose rows are equally long, as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the distinct vectors that take part."""
    v = F.col("v")
    sound = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0)).distinct()


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, ``id_col``, score, leaves_visited, calibrated_recall: the ``k`` best rows of ``table`` for each row of ``queries`` but itself."""
    spark = table.sparkSession
    rows = stored(vectors(table, id_col, vector_col), "vectors")
    asked = stored(vectors(queries, id_col, vector_col).join(rows.limit(1).select(F.size("v").alias("n")), F.size("v") == F.col("n"), "left_semi"), "queries")
    count, n_asked = rows.count(), asked.count()
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double, leaves_visited int, calibrated_recall double")
    if not count or not n_asked:
        return empty
    part = lambda n, of, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(min(1, n / of) * 1_000_000)
    sample = rows.where(part(sample_rows, count, 1)).toPandas().sort_values("id") if count > 1 else rows.toPandas()
    if sample.empty:
        sample = rows.limit(1).toPandas()
    tree = Tree(np.stack(sample["v"].to_numpy()).astype(float), max(1, min(-(-len(sample) // SAMPLE_A_LEAF), count // leaf_rows)))

    def placed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(_matrix(b.column(1))) if b.num_rows else [], pa.int32())], ["id", "v", "leaf"])

    held = stored(rows.mapInArrow(placed, "id long, v array<double>, leaf int"), "leaves")

    # calibration: true neighbours of a few queries, by a scan of all vectors
    few = asked.where(part(CALIBRATED, n_asked, 2)).toPandas().sort_values("id")
    if few.empty:
        few = asked.limit(1).toPandas()
    own, matrix = few["id"].to_numpy(), np.stack(few["v"].to_numpy()).astype(float)

    def scanned(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                out = [(int(own[q]), float(s), int(ids[at]), int(leaf[at])) for q, (where, exact) in enumerate(best(matrix, own, ids, _matrix(b.column(1)), k)) for at, s in zip(where, exact, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["query_id", "score", "id", "leaf"])

    top = _top(held.mapInArrow(scanned, "query_id long, score double, id long, leaf int"), k)
    true = top.select("query_id", "leaf").toPandas()
    ranks = {int(i): {leaf: r for r, leaf in enumerate(tree.visits(v, tree.leaves))} for i, v in zip(own, matrix, strict=True)}
    needed = np.sort([ranks[q][leaf] + 1 for q, leaf in zip(true["query_id"], true["leaf"], strict=True)])
    visits = min(tree.leaves, int(np.ceil(MARGIN * needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))) if len(needed) else tree.leaves
    reached = float((needed <= visits).mean()) if len(needed) else 1.0

    def routed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([tree.visits(v, visits) for v in _matrix(b.column(1))], pa.list_(pa.int32()))], ["id", "v", "leaf"])

    ways = stored(asked.mapInArrow(routed, "id long, v array<double>, leaf array<int>"), "ways")
    # two numbers a leaf: in how many lots its vectors and its queries lie
    asks = ways.select(F.explode("leaf").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / LOT_QUERIES).cast("int").alias("query_lots"))
    lots = held.groupBy("leaf").agg(F.ceil(F.count("*") / LOT_ROWS).cast("int").alias("rows_lots")).join(asks, "leaf")
    lots = F.broadcast(spark.createDataFrame(lots.collect(), "leaf int, rows_lots int, query_lots int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = held.join(lots, "leaf").withColumn("a", lot("rows_lots")).withColumn("b", spread("query_lots")).select("leaf", "a", "b", "id", "v")
    keys = ["leaf", "a", "b"]

    def block(own, asking):
        import pandas as pd

        out = []
        if len(own) and len(asking):
            matrix, rows = np.stack(asking["v"].to_numpy()).astype(float), np.stack(own["v"].to_numpy()).astype(float)
            wanted, ids, floor = asking["id"].to_numpy(), own["id"].to_numpy(), asking["floor"].to_numpy(float)
            reach = (matrix @ rows.T >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]).sum(axis=1)
            some = np.flatnonzero(reach)
            for q, (where, exact) in zip(some, best(matrix[some], wanted[some], ids, rows, k), strict=True):
                out += [(int(wanted[q]), float(x), int(ids[at])) for at, x in zip(where, exact, strict=True) if x >= floor[q]]
        return pd.DataFrame(out, columns=["query_id", "score", "id"])

    def found_in(visits: DataFrame) -> DataFrame:
        right = visits.withColumn("leaf", F.explode("leaf")).join(lots, "leaf").withColumn("b", lot("query_lots")).withColumn("a", spread("rows_lots")).select(*keys, "id", "v", "floor")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, score double, id long")

    first = stored(_top(found_in(ways.withColumn("leaf", F.slice("leaf", 1, FIRST)).withColumn("floor", F.lit(float("-inf")))), k).select("query_id", "rank", "id", "score"), "first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = ways.withColumn("leaf", F.slice("leaf", FIRST + 1, tree.leaves)).where(F.size("leaf") > 0).join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.select("query_id", "score", "id").union(found_in(rest))
    return _top(found, k).select("query_id", "rank", F.col("id").alias(id_col), "score", F.lit(visits).alias("leaves_visited"), F.lit(reached).alias("calibrated_recall"))


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
