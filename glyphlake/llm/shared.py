"""Shared storage for intermediate tables, and connected components over link tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further columns behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def mapped_rows(df: DataFrame, keep: list[str], column: str, run, made: str, names: list[str]) -> DataFrame:
    """Columns ``keep`` as they are and those that ``run`` makes of ``column``, named ``names``.

    run(batches, kept) gets Arrow batches whose columns have names of their own, whatever they are called (with
    dots, say): ``column`` is ``_in``, and those to keep are named in ``kept``. It gives the kept ones and those of ``made``.
    """
    kept = ["_in" if c == column else f"_{k}" for k, c in enumerate(keep)]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], *([] if column in keep else [F.col(f"`{column}`").alias("_in")]))
    return rows.mapInArrow(lambda batches: run(batches, kept), extended(rows.select(*kept), made)).toDF(*keep, *names)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns but those named so, whatever their case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; on a cluster that would be one machine's own, so
    it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="glyphlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Written tables that cut lineage and outlive executors; drop() and close() delete them again."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").rstrip("/")
        self.paths: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def found(self, name: str) -> list[DataFrame]:
        """The finished tables of a name that lie in the folder, oldest first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}-*/_SUCCESS")
        out = []
        for status in sorted(place.getFileSystem(conf).globStatus(place) or [], key=lambda x: x.getModificationTime()):
            path = status.getPath().getParent().toString()
            table = self.spark.read.parquet(path)
            table.scratch_path = path
            self.paths.append(path)
            out.append(table)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table.scratch_path)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in self.paths:
            self.paths.remove(path)

    def close(self, keep: DataFrame | None = None) -> None:
        """Delete all tables but ``keep``."""
        for path in list(self.paths):
            if keep is None or path != keep.scratch_path:
                self._delete(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Hand Python tasks so many rows at once, while the jobs inside run: whole texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


BITS = 1 << 27


def bit_table(keys: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits (16 MB, whatever the input) in which the bit of every hashed key is set.

    keys has one column of 64-bit hashes. A clear bit means that a key isn't there; a set one may be
    another key's, so it only saves work ahead of an exact join.
    """
    slot = keys.toDF("key").selectExpr(f"pmod(key, {BITS}) as s")
    words = slot.selectExpr("s div 64 as w", "shiftleft(1L, cast(s % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def prefilter(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids`` (a column doc_id), ahead of a join on it."""
    columns = docs.columns
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64("doc_id"))))

    def run(batches):
        words = table.value
        for batch in batches:
            slot = batch.column("_slot").to_numpy()
            keep = (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            rows = batch.filter(pa.array(keep.astype(bool)))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in columns], columns)

    return docs.withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(BITS))).mapInArrow(run, docs.schema)


def wanted_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` joined with ``ids`` by doc_id.

    Sorted and merged whatever the size of ``ids``: behind a broadcast join, what a Python operator makes of
    the rows would run in the tasks of the prefilter, with two Python workers for each of them.
    """
    return prefilter(docs, ids).hint("merge").join(ids, "doc_id")


def connected_components(scratch: Scratch, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map every node of ``links`` (a, b) to the smallest node of its component: (node, component).

    Alternating large-star and small-star rounds; all work is joins and map-side combined minima, each
    round is written, and a round that changes nothing ends the loop. Self links and repeated links are
    allowed; an empty table gives an empty result. Raises if max_rounds are not enough (the number of
    rounds grows with the logarithm of the longest chain).
    """

    def canonical(e: DataFrame) -> DataFrame:
        return e.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = scratch.put(canonical(links), "edges")
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.put(canonical(large), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.toDF("a", "b"))
        new = scratch.put(canonical(small), "edges")
        scratch.drop(large, edges)
        edges, now = new, mark(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = scratch.put(edges.toDF("node", "component").union(roots), "components")
    scratch.drop(edges)
    return found
