"""Exact nearest neighbours of many queries, pruned by distances to pivots.

Some vectors are pivots, at most MOST_PIVOTS; every vector belongs to the cell of its nearest one. By the triangle
inequality no vector of a cell is nearer to a query than the query's distance to the pivot less the cell's radius, and
no single one nearer than the difference of both distances to the pivot.

* First round: each query visits its nearest cells until they hold k others. The k-th distance found bounds what can matter.
* Second round: it visits those other cells that may hold something within the bound, and there only meets
  vectors whose own distance to the pivot allows it.

Cells are cut into blocks of about BLOCK vectors that are tasks' keys, so a hot cell is no task of its own. How much is
pruned depends on the data: in few dimensions most, among directions of many dimensions little; the result is exact anyway.

Defined cases: vectors and ids aren't null and all vectors have one length; ties go to the smaller id; a query isn't
its own neighbour; fewer than k others give fewer rows, an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from glyphlake.sources.folders import written

MOST_PIVOTS = 256
BLOCK = 4096
#: Room for the rounding of distances when bounds are compared.
SLACK = 1e-9
#: Squared distances that may be equal once they are rounded to nine digits.
TIE = 2e-9
#: Queries that are compared with a block at once.
QUERIES = 64


def _pivot_distances(column: pa.Array, pivots: np.ndarray) -> np.ndarray:
    x = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)
    out = np.empty((len(x), len(pivots)))
    for at in range(0, len(x), 64):
        out[at : at + 64] = np.sqrt(((x[at : at + 64, None, :] - pivots[None]) ** 2).sum(2))
    return out


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors (id, e, ...) with their cell and their distance to its pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            far = _pivot_distances(batch.column("e"), shared.value)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], [*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, cell int, far double")


def _visits(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(q, qe, bound, cell, away) of the cells each query visits: the nearest that hold k others (bound null), or all
    others within its bound; away: its distance to the pivot."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, sizes, radius))

    def run(batches):
        pivots, sizes, radius = shared.value
        for batch in batches:
            away = _pivot_distances(batch.column("qe"), pivots)
            order = np.argsort(away, axis=1, kind="stable")
            held = np.take_along_axis(np.broadcast_to(sizes, away.shape), order, 1).cumsum(1)
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, held - np.take_along_axis(np.broadcast_to(sizes, away.shape), order, 1) <= k, 1)
            bound = np.array(batch.column("bound").fill_null(np.inf))
            second = np.array(batch.column("bound").is_valid())
            reach = (away - radius <= bound[:, None] + SLACK) & ~first
            row, cell = np.nonzero(np.where(second[:, None], reach, first) & (sizes > 0))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(away[row, cell])], [*batch.schema.names, "cell", "away"])

    return queries.mapInArrow(run, "q long, qe array<double>, bound double, cell int, away double")


def met_blocks(visits: DataFrame, placed: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors by the blocks (cell, salt) in which they meet."""
    dealt = placed.join(F.broadcast(blocks), "cell").withColumn("salt", F.expr("pmod(xxhash64(id), n)"))
    spread = visits.join(F.broadcast(blocks), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return spread.drop("n"), dealt.drop("n")


def compared_pairs(visits: DataFrame, placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Queries and the vectors of the cells they visit that their bound allows, cell by cell in blocks."""
    left, right = met_blocks(visits, placed, blocks)
    near = F.col("bound").isNull() | (F.abs(F.col("away") - F.col("far")) <= F.col("bound") + SLACK)
    return left.join(right, ["cell", "salt"]).where((F.col("q") != F.col("id")) & near)


def _compared(k: int, schema: StructType):
    """The nearest vectors of a block to each query that visits it: the k first and what may tie with the last once distances are rounded."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(schema)
        if not len(left) or not len(right):
            return arrow.empty_table()
        q, ids, far = left.column("q").to_numpy(), right.column("id").to_numpy(), right.column("far").to_numpy()
        away, bound = left.column("away").to_numpy(), left.column("bound").fill_null(np.inf).to_numpy()
        queries, vectors = matrix(left.column("qe")), matrix(right.column("e")).T.copy()
        rows, columns, found = [], [], []
        for at in range(0, len(q), QUERIES):
            part = slice(at, at + QUERIES)
            d2 = np.zeros((len(q[part]), len(ids)))
            for axis, values in enumerate(vectors):  # one after another, as sums of doubles depend on their order
                step = queries[part, axis, None] - values
                d2 += step * step
            d2[(q[part, None] == ids) | (np.abs(away[part, None] - far) > bound[part, None] + SLACK)] = np.inf
            last = np.partition(d2, k - 1, axis=1)[:, k - 1] if k <= len(ids) else np.full(len(d2), np.inf)
            row, column = np.nonzero((d2 <= last[:, None] + TIE) & (d2 < np.inf))
            rows.append(row + at)
            columns.append(column)
            found.append(d2[row, column])
        taken = right.take(pa.array(np.concatenate(columns)))
        made = {"q": pa.array(q[np.concatenate(rows)]), "d2": pa.array(np.concatenate(found))}
        return pa.table([made[f.name] if f.name in made else taken.column(f.name) for f in arrow], schema=arrow)

    return run


def _best(pairs: DataFrame, k: int, *by: str) -> DataFrame:
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("d2", "id")))
    return ranked.where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 12, pivots: int | None = None) -> DataFrame:
    """(q, id, d2, rank, further columns of the vectors) of the k nearest vectors (id, e, ...) of each query (q, qe).

    e and qe are arrays of doubles; d2 is the squared distance, rounded to nine digits, by which ranks go.
    """
    n = vectors.count()
    if not n:
        return vectors.selectExpr("id as q", "*", "0D as d2", "0 as rank").drop("e")
    wanted = pivots or max(1, min(MOST_PIVOTS, math.isqrt(n)))
    chosen = vectors.select("e").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # at most MOST_PIVOTS rows
    table = np.array([r["e"] for r in chosen])
    placed = written(_placed(vectors, table), "placed")
    sizes, radius = np.zeros(len(table), np.int64), np.zeros(len(table))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each pivot
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    blocks = vectors.sparkSession.createDataFrame([(c, max(1, -(-int(s) // BLOCK))) for c, s in enumerate(sizes)], "cell int, n long")
    more = [c for c in vectors.columns if c not in ("id", "e")]

    def found(rows: DataFrame) -> DataFrame:
        left, right = met_blocks(_visits(rows, table, sizes, radius, k), placed, blocks)
        kinds = StructType([StructField("q", LongType()), *[vectors.schema[c] for c in ("id", *more)], StructField("d2", DoubleType())])
        pairs = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(_compared(k, kinds), kinds)
        return pairs.select("q", "id", F.round("d2", 9).alias("d2"), *more)

    first = written(_best(found(queries.select("q", "qe", F.lit(None).cast("double").alias("bound"))), k, "q").drop("rank"), "nearest")
    bounds = first.groupBy("q").agg(F.sqrt(F.max("d2")).alias("m"), F.count("*").alias("n")).select("q", F.when(F.col("n") >= k, F.col("m") + 1e-6).otherwise(float("inf")).alias("bound"))
    second = found(queries.join(bounds, "q").select("q", "qe", "bound"))
    return _best(first.unionByName(second), k, "q")
