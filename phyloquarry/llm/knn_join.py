"""Exact top-k search as a Voronoi kNN join by integer inner product.

Pivots (a fixed number, picked by hash) part queries and data into Voronoi cells. Summaries of the query cells
(radius) and the data cells (radius, largest norm), all of size pivots, give bounds: a query q of the cell
around p with radius r has q.s between p.s - r|s| and p.s + r|s|. The (k+1)-th largest lower bound over all data
is what every query of the cell surely reaches; a data cell, and then a data row, is replicated to the query
cell only if its upper bound reaches that. Replicated rows travel as packed blocks with a salt, so a cell with
a third of all rows is many blocks; the queries of a cell are split into small sets and sent to each salt.
Each pair of a block and a query set is solved by one matrix product, and the best of each query are merged.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

TOP, SCALE = 5, 256
#: Queries a cell is meant to have, pivots at least and at most, queries in a set, rows of a block, rows a salt.
PER_CELL, LEAST_PIVOTS, MOST_PIVOTS = 256, 8, 256
QUERY_SET, BLOCK, PER_SALT = 512, 4096, 20_000
#: Sums of at least this size aren't exact as doubles.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of each row; shorter vectors end in zeros."""
    values = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    sizes = np.asarray(column.value_lengths(), np.int64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out, ends = np.zeros((len(sizes), dims)), np.cumsum(sizes)
    for i, end in enumerate(ends):
        out[i, : sizes[i]] = values[end - sizes[i] : end]
    return out


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and its distance to the cell's pivot (rounding can't make it too small)."""
    square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    cell = square.argmin(1)
    return cell, np.sqrt(np.maximum(square[np.arange(len(x)), cell], 0)) + 1e-6


def best_distinct(low: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest values of ``low`` that belong to different ids, each with its id."""
    most = min(len(low), 8 * k)
    while True:
        at = np.argpartition(-low, most - 1)[:most] if most < len(low) else np.arange(len(low))
        at = at[np.argsort(-low[at], kind="stable")]
        first = np.sort(np.unique(ids[at], return_index=True)[1])[:k]
        if len(first) == k or most >= len(low):
            return low[at[first]], ids[at[first]]
        most = min(len(low), 8 * most)


def summaries(vectors: DataFrame, pivots: np.ndarray, dims: int, radii: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radius and largest norm of each cell, and, given the query cells' radii, the bound each query cell reaches.

    That bound is the ``k``-th highest lower bound of different ids.
    """
    p = len(pivots)

    def task(batches):
        radius, norm = np.full(p, -1.0), np.zeros(p)
        best = [(np.zeros(0), np.zeros(0, np.int64))] * p
        for batch in batches:
            x, ids = matrix(batch.column(1), dims), np.asarray(batch.column(0), np.int64)
            if not len(x):
                continue
            cell, far = nearest(x, pivots)
            size = np.linalg.norm(x, axis=1)
            np.maximum.at(radius, cell, far)
            np.maximum.at(norm, cell, size)
            if radii is not None:
                low = pivots @ x.T - radii[:, None] * size[None]
                best = [best_distinct(np.concatenate([b, one]), np.concatenate([i, ids]), k) for (b, i), one in zip(best, low, strict=True)]
        kinds = pa.list_(pa.float64()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array(radius), pa.array(norm), pa.array([b.tolist() for b, _ in best], kinds[0]), pa.array([i.tolist() for _, i in best], kinds[1])], ["cell", "radius", "norm", "low", "ids"])

    each = vectors.select("id", "v").mapInArrow(task, "cell int, radius double, norm double, low array<double>, ids array<bigint>")
    each = each if radii is None else written(each)
    radius, norm, reach = np.full(p, -1.0), np.zeros(p), np.full(p, -np.inf)
    for r in each.groupBy("cell").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect():  # a row for each pivot
        radius[r.cell], norm[r.cell] = r.radius, r.norm
    if radii is not None:
        lows = each.select("cell", F.explode(F.arrays_zip("ids", "low")).alias("z")).groupBy("cell", "z.ids").agg(F.max("z.low").alias("low"))
        down = Window.partitionBy("cell").orderBy(F.desc("low"))
        for r in lows.withColumn("place", F.row_number().over(down)).where(F.col("place") == k).collect():  # a row for each pivot
            reach[r.cell] = r.low
    return radius, norm, reach


def knn_join(queries: DataFrame, data: DataFrame, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): the ``k`` highest inner products of each query over rows of other ids.

    Components become floor(256 x) as double and travel in the smallest type that holds them all; where sums may
    reach 2**53 they are taken over whole numbers (a score beyond 64 bits is an error). Ties go to the smaller id. Rows whose id is null or no 64-bit
    number, a null vector or null or non-finite components take no part; vectors of other lengths are filled up
    with zeros. Repeated query rows count once, repeated data rows each. Query rows of one id with unlike vectors are
    separate queries, told apart by ``query_row`` (a 64-bit hash of the vector). Empty tables give no rows; other columns
    play no part.
    """
    spark = data.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, query_row bigint, rank int, vec_id bigint, score bigint")
    clean = lambda df: df.select(F.col(id_col).try_cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = clean(data), clean(queries).distinct()
    measures = F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("high")
    sizes, asked_sizes = rows.agg(*measures).first(), asked.agg(*measures).first()
    if not sizes.n or not asked_sizes.n:
        return empty
    dims = max(sizes.d, asked_sizes.d, 1)
    highest = SCALE * max(sizes.high or 0.0, asked_sizes.high or 0.0) + 1
    kind = next((np.dtype(t) for t in ("<i2", "<i4") if highest < np.iinfo(t).max), np.dtype("<f8"))
    whole = dims * highest * highest >= EXACT
    wanted = min(max(ceil(asked_sizes.n / PER_CELL), LEAST_PIVOTS), MOST_PIVOTS)
    picked = asked.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(wanted).collect()  # at most MOST_PIVOTS vectors
    pivots = np.unique(matrix(pa.array([r.v for r in picked], pa.list_(pa.float64())), dims), axis=0)
    radii, _, _ = summaries(asked, pivots, dims, None, 1)
    data_radii, norms, reach = summaries(rows, pivots, dims, np.maximum(radii, 0), k + 1)  # a query's own rows don't count
    lengths = np.linalg.norm(pivots, axis=1)
    slack = 1e-3 + 1e-11 * dims * highest * highest  # what rounding can make of sums of this size
    cell_high = pivots @ pivots.T + lengths[:, None] * data_radii[None] + radii[:, None] * norms[None] + slack
    needed = (radii[:, None] >= 0) & (data_radii[None] >= 0) & ~(cell_high < reach[:, None])
    salts = max(1, ceil(sizes.n / PER_SALT))

    def blocks(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids, x = np.asarray(part.column(0), np.int64), matrix(part.column(1), dims)
                cell, _ = nearest(x, pivots)
                high = pivots @ x.T + np.maximum(radii, 0)[:, None] * np.linalg.norm(x, axis=1)[None] + slack
                keep = needed[:, cell] & ~(high < reach[:, None])
                cells = np.flatnonzero(keep.any(1))
                salt = int(ids[0]) % salts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int32()), pa.array([salt] * len(cells), pa.int32()), pa.array([ids[keep[c]].tobytes() for c in cells], pa.binary()), pa.array([x[keep[c]].astype(kind).tobytes() for c in cells], pa.binary())],
                    ["cell", "salt", "ids", "x"],
                )

    def placed(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            cell = nearest(x, pivots)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], ["id", "row", "cell", "q"])

    set_of = asked.select("id", "v", F.xxhash64("v").alias("row")).mapInArrow(placed, "id bigint, row bigint, cell int, q binary")
    in_cell = set_of.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    set_of = set_of.join(in_cell, "cell").withColumn("set", F.pmod(F.xxhash64("id", "q"), F.ceil(F.col("n") / QUERY_SET)))
    sets = set_of.groupBy("cell", "set").agg(F.collect_list(F.struct("id", "row", "q")).alias("asked"))
    sets = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def numbers(packed: bytes) -> np.ndarray:
        x = np.frombuffer(packed, kind).reshape(-1, dims).astype(np.float64)
        return np.array([[int(v) for v in row] for row in x.tolist()], object) if whole else x

    def solve(batches):
        for batch in batches:
            out = [[], [], [], []]
            for asked_here, ids, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                scores = numbers(b"".join(a["q"] for a in asked_here)) @ numbers(x)[order].T
                for a, s in zip(asked_here, scores, strict=True):
                    others = np.flatnonzero(ids != a["id"])
                    s = s[others]
                    if len(s) > k:
                        least = np.partition(s, -k)[-k]
                        above = np.flatnonzero(s > least)
                        best = others[np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])]
                        s = np.concatenate([s[s > least], s[s == least][: k - len(above)]])
                    else:
                        best = others
                    out[0] += [a["id"]] * len(best)
                    out[1] += [a["row"]] * len(best)
                    out[2] += ids[best].tolist()
                    out[3] += [int(v) for v in s]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "query_row", "vec_id", "score"])

    spread = rows.mapInArrow(blocks, "cell int, salt int, ids binary, x binary")
    met = spread.join(sets, ["cell", "salt"]).select("asked", "ids", "x")
    local = met.mapInArrow(solve, "query_id bigint, query_row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``embeddings`` row with an id divisible by 50 against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn_join(rows.where(F.col("vec_id") % 50 == 0), rows).drop("query_row")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {"op10_voronoi_knn": (op10_voronoi_knn, ORACLE)}
