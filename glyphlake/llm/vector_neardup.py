"""Near-duplicate vectors by collision counting on one-dimensional projections.

Every vector has many projections. Some of them only divide the work: TABLES groups of a few projections,
each halved at 0, give the cells in which vectors meet, so many groups that a pair at the limit shares a
cell with probability RECALL. (Windows over a sorted projection of the whole table would hold over a third
of all vectors for each query at this limit, so whole sorted projections alone don't scale.) Inside a cell
further projections are sorted, and each query counts the others in the windows centred on it; pairs with fewer
collisions than the count that RECALL allows for a pair at the limit are dropped.

Two rounds keep the vectors still. In the first only sketches move: COUNTED + FINE projections of a byte each,
rounded so that no collision is lost. It finds which vectors have a candidate in which cell, which few have. In
the second those vectors meet in those cells, candidates are counted and verified by their cosine in double
precision. A pair that meets in several cells counts in the first.

The number of cells grows with the vectors so that a cell holds about CELL_ROWS; larger cells are cut
into blocks, compared block by block in tasks of their own, so no task holds more than two blocks and no
pair becomes a row: tasks return each vector's number of links and the links that hold its part of the
block together.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
equal vectors are one class, linked with each other, and count each; vectors of different length don't
link; a row without id takes part, its component is the smallest id reached; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, connected_components

LIMIT = 0.95
RECALL = 0.99999
COUNTED = 16
#: Further projections that the first round counts for pairs that pass the others.
FINE = 32
#: Steps of a sketch's byte in one unit of a projection.
STEPS = 32
CELL_ROWS = 256
BLOCK_ROWS = 1024


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class Projections:
    """Directions and the numbers that follow from the limit, the recall and the number of vectors."""

    def __init__(self, rows: int, limit: float = LIMIT, recall: float = RECALL, counted: int = COUNTED, seed: int = 11):
        self.limit, self.counted, self.seed = limit, counted, seed
        self.bits = min(24, max(2, round(math.log2(max(rows, 1) / CELL_ROWS)))) if rows > CELL_ROWS else 1
        same = (1 - math.acos(limit) / math.pi) ** self.bits
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - same))
        distance = math.sqrt(2 - 2 * limit)
        self.window = 2.5 * distance
        p = 2 * _normal(2.5) - 1
        fewer = lambda n, of: sum(math.comb(of, k) * p**k * (1 - p) ** (of - k) for k in range(n))
        calibrated = lambda of: max(n for n in range(of + 1) if fewer(n, of) <= 1 - recall)
        self.least, self.least_fine = calibrated(counted), calibrated(counted + FINE)
        #: The window in a sketch's steps, with room for the rounding of both.
        self.steps = math.floor(self.window * STEPS) + 1

    def directions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions of the cells, and of the counted projections (the sketch's first ones)."""
        rng = np.random.default_rng([self.seed, size])
        return rng.standard_normal((size, self.tables * self.bits)), rng.standard_normal((size, self.counted))

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """Projections as bytes; far ones are pulled in, which only brings them nearer to each other."""
        fine = np.random.default_rng([self.seed, unit.shape[1], 1]).standard_normal((unit.shape[1], FINE))
        values = unit @ np.concatenate([self.directions(unit.shape[1])[1], fine], axis=1)
        return np.clip(np.rint(values * STEPS), -127, 127).astype(np.int8)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table."""
        side = (unit @ self.directions(unit.shape[1])[0] >= 0).reshape(len(unit), self.tables, self.bits)
        return side @ (1 << np.arange(self.bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(rules: Projections):
    """Rows (cell, node, sketch): the sketch of every vector once for each table."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes):
                for at in range(0, batch.num_rows, 2048):
                    rows = at + np.flatnonzero(sizes[at : at + 2048] == size)
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    unit = _unit(_matrix(part.column("vector")))
                    cell = ((np.int64(size) << 32) + np.arange(rules.tables, dtype=np.int64)) * (1 << 24) + rules.codes(unit)
                    sketch = np.repeat(rules.sketches(unit), rules.tables, axis=0)
                    packed = pa.Array.from_buffers(pa.binary(sketch.shape[1]), len(sketch), [None, pa.py_buffer(np.ascontiguousarray(sketch))])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), rules.tables)), packed.cast(pa.binary())], ["cell", "node", "sketch"])

    return run


def window_counts(queries: np.ndarray, others: np.ndarray, window: float) -> np.ndarray:
    """On how many projections (columns) each other lies in the window centred on each query: (queries, others).

    Each projection of the others is sorted; a query's window is a stretch of that order, found by bisection,
    and holds the others whose place in the order is in the stretch.
    """
    count = np.zeros((len(queries), len(others)), np.int8)
    place = np.empty(len(others), np.uint16 if len(others) < 1 << 15 else np.uint32)
    for q, o in zip(queries.T, others.T):
        order = np.argsort(o, kind="stable")
        place[order] = np.arange(len(o), dtype=place.dtype)
        begin = np.searchsorted(o[order], q - window, side="left").astype(place.dtype)
        size = np.searchsorted(o[order], q + window, side="right").astype(place.dtype) - begin
        # places before the stretch wrap around to numbers beyond any size
        count += (place[None, :] - begin[:, None]) < size[:, None]
    return count


def sketch_counts(queries: np.ndarray, others: np.ndarray, steps: int) -> np.ndarray:
    """``window_counts`` of sketches, all projections sorted at once; a byte's place is looked up, not searched."""
    width = others.shape[1]
    columns = np.arange(width)
    order = np.argsort(others, axis=0, kind="stable")
    kind = np.uint16 if len(others) < 1 << 15 else np.uint32
    place = np.empty(others.shape, kind)
    np.put_along_axis(place, order, np.arange(len(others), dtype=kind)[:, None], axis=0)
    # below[c, v + 384]: how many others have less than v in column c
    values = np.bincount((others.astype(np.int64) + 385 + columns * 1024).ravel(), minlength=width * 1024).reshape(width, 1024)
    below = np.cumsum(values, axis=1)
    at = queries.astype(np.int64) + 384
    begin = below[columns, at - steps].astype(kind)
    size = below[columns, at + steps + 1].astype(kind) - begin
    count = np.zeros((len(queries), len(others)), np.int8)
    apart, hit = np.empty(count.shape, kind), np.empty(count.shape, bool)
    place, begin, size = (np.ascontiguousarray(x.T) for x in (place, begin, size))
    for c in range(width):
        np.subtract(place[c][None, :], begin[c][:, None], out=apart)
        np.less(apart, size[c][:, None], out=hit)
        np.add(count, hit.view(np.int8), out=count)
    return count


def _grouped(batches, names: list[str]):
    """Tables sorted by (cell, left, right) as (key, salt, node, further columns) of each group of two rows or more."""

    def groups(table: pa.Table, last: bool):
        keys = np.stack([table.column(c).to_numpy() for c in ("cell", "left", "right")], axis=1)
        cuts = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1)), [len(keys)]])
        whole = len(cuts) - 1 if last else len(cuts) - 2
        columns = {c: table.column(c).combine_chunks() for c in names}
        found = [(tuple(int(x) for x in keys[cuts[k]]), {c: x.slice(cuts[k], cuts[k + 1] - cuts[k]) for c, x in columns.items()}) for k in range(whole) if cuts[k + 1] - cuts[k] > 1]
        return found, table.slice(cuts[whole])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None and rest.num_rows else table
        if table.num_rows:
            found, rest = groups(table, False)
            yield from found
    if rest is not None and rest.num_rows:
        yield from groups(rest.combine_chunks(), True)[0]


def _candidates(rules: Projections):
    """From sketches sorted by (cell, left, right): (cell, node) of those with a candidate in the cell."""

    def marked(x: np.ndarray, y: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        rough = sketch_counts(x[:, : rules.counted], y[:, : rules.counted], rules.steps)
        enough = rough >= rules.least
        if own:
            enough = np.triu(enough, 1)
        pairs = np.flatnonzero(enough)
        i, j = np.divmod(pairs, enough.shape[1])
        count = rough.ravel()[pairs]
        for at in range(rules.counted, x.shape[1], 8):
            if not len(i):
                break
            near = np.abs(x[:, at : at + 8].take(i, axis=0) - y[:, at : at + 8].take(j, axis=0)) <= rules.steps
            count = count + near.sum(1, dtype=np.int8)
            good = count >= rules.least_fine - max(0, x.shape[1] - at - 8)  # what can still be reached
            i, j, count = i[good], j[good], count[good]
        return np.unique(i), np.unique(j)

    def run(batches):
        cells, nodes, waiting = [], [], 0
        for (cell, left, right), columns in _grouped(batches, ["salt", "node", "sketch"]):
            salt, node = columns["salt"].to_numpy(), columns["node"].to_numpy()
            packed = columns["sketch"]
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :]
            width = rules.counted + FINE
            sketch = np.frombuffer(packed.buffers()[2], np.int8)[ends[0] : ends[0] + len(node) * width].reshape(len(node), width).astype(np.int16)
            one, two = np.flatnonzero(salt == left), np.flatnonzero(salt == right)
            i, j = marked(sketch[one], sketch[two], left == right)
            hit = np.unique(np.concatenate([one[i], two[j]]))
            if len(hit):
                cells.append(np.full(len(hit), cell))
                nodes.append(node[hit])
                waiting += len(hit)
            if waiting > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(nodes))], ["cell", "node"])
                cells, nodes, waiting = [], [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(nodes))], ["cell", "node"])

    return run


def _collide(rules: Projections, x, px, cx, y, py, cy, table: int) -> np.ndarray:
    """Links of two blocks, as a boolean matrix: counted, verified, and met in no earlier table."""
    i, j = np.nonzero(window_counts(px, py, rules.window) >= rules.least)
    linked = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        good = np.einsum("ij,ij->i", x[a], y[b]) >= rules.limit
        a, b = a[good], b[good]
        if table and len(a):
            first = (cx[a, :table] == cy[b, :table]).any(1)
            a, b = a[~first], b[~first]
        linked[a, b] = True
    return linked


def _compare(rules: Projections):
    """From rows sorted by (cell, left, right): (node, links, root), partial numbers of links and local roots."""

    def group(cell: int, left: int, right: int, salt, node, many, vector):
        table = (cell >> 24) & 0xFFFFFFFF
        unit = _unit(vector)
        counted = unit @ rules.directions(unit.shape[1])[1]
        codes = rules.codes(unit)
        one = np.flatnonzero(salt == left)
        two = one if left == right else np.flatnonzero(salt == right)
        if not len(one) or not len(two):
            return None
        links = _collide(rules, unit[one], counted[one], codes[one], unit[two], counted[two], codes[two], table)
        if left == right:
            np.fill_diagonal(links, False)
        if not links.any():
            return None
        n = np.zeros(len(node), np.int64)
        n[one] += links @ many[two]
        if left != right:
            n[two] += links.T @ many[one]
        # local components: smallest node by spreading labels over the links
        label = node.copy()
        i, j = np.nonzero(links)
        a, b = one[i], two[j]
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            if (new == label).all():
                break
            label = new
        rows = np.flatnonzero(n)
        return node[rows], n[rows], label[rows]

    def run(batches):
        for key, columns in _grouped(batches, ["salt", "node", "many", "vector"]):
            salt, node, many = (columns[c].to_numpy() for c in ("salt", "node", "many"))
            found = group(*key, salt, node, many.astype(np.int64), _matrix(columns["vector"]))
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int64)), pa.array(found[2])], ["node", "links", "root"])

    return run


def _dealt(scratch: Scratch, rows: DataFrame, *columns: str) -> DataFrame:
    """Rows (cell, node, ...) in groups (cell, left, right) that meet in one task, sorted by them; salt is a row's own block.

    Cells of more than BLOCK_ROWS rows are cut into blocks, each of which meets each.
    """
    large = scratch.put(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), "large")
    met = rows.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    met = met.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("salt")).alias("left"), F.greatest(k, F.col("salt")).alias("right")))
    met = met.withColumn("t", F.explode(turns)).select("cell", "t.left", "t.right", "salt", "node", *columns)
    return met.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right")


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    v = F.col(f"`{vector}`")
    good = v.isNotNull() & F.expr(f"size(`{vector}`) > 0") & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.when(good, v).alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    rows = rows.withColumn("check", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit("second"), F.reverse("vector"))))
    classes = rows.where("vector is not null").groupBy("node", "check").agg(F.min("id").alias("first"), F.count("*").alias("many"), F.first("vector").alias("vector"))
    classes = scratch.put(classes, "classes")
    rules = Projections(classes.count(), limit, recall)

    cells = scratch.put(classes.select("node", "vector").mapInArrow(_cells(rules), "cell long, node long, sketch binary"), "cells")
    near = scratch.put(_dealt(scratch, cells, "sketch").mapInArrow(_candidates(rules), "cell long, node long").distinct(), "candidates")
    met = scratch.put(near.join(classes.select("node", "many", "vector"), "node"), "met")
    scratch.drop(cells, near)
    compared = _dealt(scratch, met, "many", "vector").mapInArrow(_compare(rules), "node long, links long, root long")
    compared = scratch.put(compared, "compared")
    found = connected_components(scratch, compared.selectExpr("node as a", "root as b"))

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.drop("vector").join(links, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = scratch.put(named.groupBy("component").agg(F.min("first").alias("component_id")), "lowest")
    named = scratch.put(named.join(lowest, "component").select("node", "check", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")), "named")
    out = rows.select("id", "node", "check").join(named, ["node", "check"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    result = scratch.put(out.select(F.col("id").alias(id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")), "result")
    scratch.close(keep=result)
    return result


def op2_collision_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP2_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95),
c(a, c) as (select a, a from l union select l.a, c.c from c join l on l.b = c.a where c.c < l.a),
n as (select a, count(*) as n from l group by a),
m as (select a, min(c) as c from c group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(least(vec_id, c), vec_id) as component_id, vec_id = coalesce(least(vec_id, c), vec_id) as kept
from embeddings left join n on n.a = vec_id left join m on m.a = vec_id
"""
