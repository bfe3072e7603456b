"""Exact top-k search by inner product: a Voronoi kNN join.

Inner products become distances by one more coordinate: data get sqrt(M^2 - |s|^2), M being the largest norm, and queries
0, so the largest product is the nearest point. Pivots (rows of a bounded sample that lie far apart, about the square root
of the data's size) cut the space into cells. Per cell summaries are gathered: how far its queries lie from the pivot at most, how far its
data lie at least and at most, and the k smallest of those distances. From the summaries alone each query cell gets a
bound on the distance of its k-th neighbour.

Query cells next to each other form groups of bounded size. A data vector is sent to a group only if its distance from
its own pivot could lie within the bound of one of the group's cells; so a vector is copied once for each group that
needs it, not for each cell. A group's data are cut into blocks, each is solved where it lands, and the k best per block
meet in a last ranking. Where vectors point in all directions alike no bound can turn any away, and each goes to every
group once; where they form clusters most are left out.

Bounds are floats with a margin; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE, TOP, QUERY_STEP = 256, 5, 50
#: Pivots at most (what is collected and broadcast of them), and vectors of one group of queries and one block of data.
PIVOTS, QUERY_BLOCK, DATA_BLOCK = 1_024, 4_096, 16_384
#: Rows that each pivot is picked from.
PICKED = 16
#: Rows whose distances are held at once.
AT_ONCE = 4_096


def integer_vectors(df: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Adds v: floor(scale * x) of every component as bigint. Rows whose vector is null, is empty, or holds a null or non-finite component are left out."""
    x = F.col(vec)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    sound = df.filter(x.isNotNull() & (F.size(x) > 0) & ~odd)
    return sound.withColumn("v", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list<int64> column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact integer products; by floats where these are exact too."""
    if len(q) and len(s) and float(np.abs(q).max()) * float(np.abs(s).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    return q @ s.T


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    a, b = np.c_[x.astype(np.float64), extra], np.c_[pivots, pivot_extra]
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


ASSIGNED = "id long, query boolean, cell int, query_cell int, dist double, query_dist double, w binary"


def _assign(pivots: np.ndarray, pivot_extra: np.ndarray, top_norm2: float, packed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            norm2 = (x.astype(np.float64) ** 2).sum(1)
            d = _distances(x, np.sqrt(np.maximum(top_norm2 - norm2, 0)), pivots, pivot_extra)
            e = _distances(x, np.zeros(len(x)), pivots, pivot_extra)
            cell, near = d.argmin(1), e.argmin(1)
            i = np.arange(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("query"), pa.array(cell, pa.int32()), pa.array(near, pa.int32()), pa.array(d[i, cell]), pa.array(e[i, near]), pa.array([r.tobytes() for r in x.astype(packed)], pa.binary())], ASSIGNED.replace(" long", "").replace(" boolean", "").replace(" int", "").replace(" double", "").replace(" binary", "").split(", "))

    return run


def apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it, so that no far cluster is without one; fewer if x has fewer different ones."""
    out = [0]
    least = ((x - x[0]) ** 2).sum(1)
    while len(out) < n and least.max() > 0:
        out.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[out[-1]]) ** 2).sum(1))
    return x[out]


def bounds(between: np.ndarray, query_far: np.ndarray, nearest: list[list[float]], k: int) -> np.ndarray:
    """For each query cell, a distance within which each of its queries has k neighbours at least (infinite if the data are fewer).

    A point at distance d from pivot j is within query_far[i] + between[i, j] + d of any query of cell i; the k-th
    smallest of these over all data is the bound.
    """
    out = np.full(len(query_far), np.inf)
    for i, far in enumerate(query_far):
        if far >= 0:
            reach = np.sort(np.concatenate([far + between[i, j] + np.array(near) for j, near in enumerate(nearest)])) if any(nearest) else np.empty(0)
            if len(reach) >= k:
                out[i] = reach[k - 1]
    return out


def _spread_evenly(ids: np.ndarray, over) -> np.ndarray:
    """A number below `over` for each id, whatever divisors the ids share."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)) % over


class Plan:
    """What the summaries tell: which cells' queries make up which groups, and which data a group needs.

    queries, far: of each cell, its queries and how far the farthest lies; data, lo, hi: the same of its data; bound: of
    each query cell.
    """

    BLOCKS = 1 << 20

    def __init__(self, between: np.ndarray, queries: np.ndarray, far: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray):
        self.between, self.far, self.bound = between, far, bound
        self.asking = np.flatnonzero(queries)
        #: By cell its first group; a cell of more than QUERY_BLOCK queries has several of its own.
        self.first, self.split = np.zeros(len(queries), dtype=np.int64), np.maximum(1, -(-queries // QUERY_BLOCK))
        self.cells: list[list[int]] = []
        room = 0
        for i in self._walk():
            if queries[i] > room:
                self.cells.append([])
                room = QUERY_BLOCK
            self.first[i] = len(self.cells) - 1
            self.cells[-1].append(i)
            self.cells += [[i] for _ in range(self.split[i] - 1)]
            room = room - queries[i] if self.split[i] == 1 else 0
        #: By group the blocks that its data are cut into: cells none of whose data can be near enough don't count.
        self.blocks = []
        for cells in self.cells:
            gap = np.maximum(between[cells] - far[cells, None] - hi[None, :], lo[None, :] - between[cells] - far[cells, None])
            self.blocks.append(max(1, int(-(-data[(gap <= bound[cells, None]).any(0)].sum() // DATA_BLOCK))))
        if len(self.cells) >= self.BLOCKS or max(self.blocks, default=0) >= self.BLOCKS:
            raise ValueError("too many groups or blocks; make them larger")

    def _walk(self) -> list[int]:
        """The cells that have queries, each next to a near one."""
        left, out = self.asking.tolist(), []
        while left:
            at = min(range(len(left)), key=lambda k: self.between[out[-1], left[k]]) if out else 0
            out.append(left.pop(at))
        return out

    def of_queries(self, cell: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of every block that a query takes part in."""
        group = self.first[cell] + _spread_evenly(ids, self.split[cell])
        blocks = np.array(self.blocks, dtype=np.int64)[group]
        row = np.repeat(np.arange(len(cell)), blocks)
        return row, group[row] * self.BLOCKS + np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)

    def of_data(self, cell: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of every group that needs a data vector."""
        rows, blocks = [], []
        for at in range(0, len(cell), AT_ONCE):
            own, d = cell[at : at + AT_ONCE], dist[at : at + AT_ONCE, None]
            to = self.between[own]
            # a vector at distance d from pivot j is at least between - far - d, and d - between - far, from a query of cell i
            need = np.maximum(to - self.far - d, d - to - self.far) <= self.bound
            for g, cells in enumerate(self.cells):
                got = at + np.flatnonzero(need[:, cells].any(1))
                rows.append(got)
                blocks.append(g * self.BLOCKS + _spread_evenly(ids[got], self.blocks[g]))
        return (np.concatenate(rows), np.concatenate(blocks)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _spread(plan: Plan, kind: str):
    """Query or data rows -> a row per block that they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows, blocks = plan.of_data(batch.column("cell").to_numpy(), batch.column("dist").to_numpy(), ids) if kind == "data" else plan.of_queries(batch.column("query_cell").to_numpy(), ids)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("id").take(take), batch.column("w").take(take)], ["block", "id", "w"])

    return run


SPREAD = "block long, id long, w binary"


def spread(rows: DataFrame, k: int, pivots: int, packed: str, norm2: float) -> tuple[DataFrame, DataFrame]:
    """rows (id, v, query) -> the queries and the data by the blocks that they take part in: (block, id, w)."""
    top_norm2 = norm2 * (1 + 1e-9) + 1.0
    wanted = max(4, min(pivots, int(rows.count() ** 0.5)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(PICKED * wanted).select("v").collect()
    points = apart(np.array([r["v"] for r in picked], dtype=np.float64), wanted)
    extra = np.sqrt(np.maximum(top_norm2 - (points**2).sum(1), 0))
    cells = len(points)
    assigned = written(rows.mapInArrow(_assign(points, extra, top_norm2, packed), ASSIGNED), "assigned")

    # summaries: a row per cell
    queries, data, far, lo, hi = (np.full(cells, x, dtype=t) for x, t in ((0, int), (0, int), (-np.inf, float), (np.inf, float), (-np.inf, float)))
    for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect():
        data[r["cell"]], lo[r["cell"]], hi[r["cell"]] = r["n"], r["lo"], r["hi"]
    for r in assigned.filter("query").groupBy("query_cell").agg(F.count(F.lit(1)).alias("n"), F.max("query_dist").alias("far")).collect():
        queries[r["query_cell"]], far[r["query_cell"]] = r["n"], r["far"]
    # the nearest ids of each cell, one more than k, as a query's own is no neighbour of it; copies of an id count once
    each = assigned.groupBy("cell", "id").agg(F.min("dist").alias("dist"))
    order = Window.partitionBy("cell", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("dist", "id")
    least = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("dist")).alias("d"))
    nearest: list[list[float]] = [[] for _ in range(cells)]
    for r in least.collect():
        nearest[r["cell"]] = r["d"][: k + 1]
    between = _distances(points, extra, points, extra)
    bound = bounds(between, far, nearest, k + 1) + 1e-6 * (1 + np.sqrt(top_norm2))
    plan = Plan(between, queries, far, data, lo, hi, bound)
    asked = assigned.filter("query").select("id", "query_cell", "w").dropDuplicates(["id", "w"])
    return asked.mapInArrow(_spread(plan, "query"), SPREAD), assigned.select("id", "cell", "dist", "w").mapInArrow(_spread(plan, "data"), SPREAD)


def top_k(data: DataFrame, is_query, k: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """data (id, v: equally long arrays of bigint) -> query_id, rank, vec_id, score: the k best of all other rows for every row where is_query.

    Ties go to the smaller id. Fewer than k others: all of them. A query never meets its own id (nor another row of it);
    equal rows ask once and count as neighbours each, and an id of several vectors asks once for each. Rows with a null
    id take no part. No rows or no queries give none; unequal lengths fail. v's products must fit 64 bits.
    """
    spark = data.sparkSession
    rows = written(data.filter("id IS NOT NULL").select("id", "v", is_query.alias("query")), "vectors")
    sizes = rows.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm2")).first()
    if sizes["a"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['b']} components")
    packed = "<i2" if sizes["norm2"] < 2.0**29 else "<i4" if sizes["norm2"] < 2.0**61 else "<i8"
    query_rows, data_rows = spread(rows, k, pivots, packed, float(sizes["norm2"]))

    def solve(_key, queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(others):
            return pd.DataFrame({n: np.empty(0, np.int64) for n in ("query_id", "asked", "vec_id", "score")})
        q, s = (np.frombuffer(b"".join(x["w"]), dtype=packed).astype(np.int64).reshape(len(x), -1) for x in (queries, others))
        ids, own, asked = others["id"].to_numpy(), queries["id"].to_numpy(), queries["asked"].to_numpy()
        sort = np.argsort(ids, kind="stable")
        ids, s = ids[sort], s[sort]
        found = ([], [], [], [])
        for at in range(0, len(q), 64):
            score = _products(q[at : at + 64], s)
            for r, line in enumerate(score):
                other = np.flatnonzero(ids != own[at + r])
                if len(other) > k:
                    kth = np.partition(line[other], len(other) - k)[len(other) - k]
                    other = other[line[other] >= kth]
                best = other[np.argsort(-line[other], kind="stable")][:k]  # ids ascend, so ties go to the smaller
                for out, x in zip(found, (np.full(len(best), own[at + r]), np.full(len(best), asked[at + r]), ids[best], line[best]), strict=True):
                    out.append(x)
        return pd.DataFrame({n: np.concatenate(x).astype(np.int64) for n, x in zip(("query_id", "asked", "vec_id", "score"), found, strict=True)})

    asked = query_rows.withColumn("asked", F.xxhash64("w"))  # tells the vectors of one id apart
    local = asked.groupBy("block").cogroup(data_rows.groupBy("block")).applyInPandas(solve, "query_id long, asked long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: query_id, rank, vec_id, score of the 5 best of every vector whose id is divisible by 50."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(F.col("vec_id").alias("id"), "v")
    return top_k(rows, F.col("id") % QUERY_STEP == 0)
