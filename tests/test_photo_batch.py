"""The transactional photo sink: whole batches or none, whatever is killed."""

import glob
import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from glyphlake.sources import folders, manifests, photo_batch
from tests.conftest import ROOT


@pytest.fixture(scope="module")
def rows(spark):
    photo_batch.register(spark)
    status = F.when(F.col("id") % 5 == 3, "failed").when(F.col("id") % 7 == 6, "canceled").otherwise("succeeded")
    return spark.range(40).repartition(4).select(
        F.format_string("p%d", "id").alias("stem"), status.alias("status"), F.format_string("in/%d.png", "id").alias("source"), F.encode(F.col("id").cast("string"), "utf-8").alias("png"),
        F.when(F.col("id") % 2 == 0, F.encode(F.lit("mask"), "utf-8")).alias("mask_png"), F.format_string('{"n": %d, "é": null}', "id").alias("report"),
        F.when(status == "failed", "no date").alias("error"), F.lit(None).cast("string").alias("traceback"), (status == "succeeded").alias("audit_passed"), F.lit("x").alias("further"),
    )


def put(rows, path, **options):
    rows.write.format("photo_batch").mode("append").options(**options).save(path)


def files(path):
    return sorted(os.path.relpath(f, path) for f in glob.glob(f"{path}/**/*", recursive=True) if os.path.isfile(f))


def test_batch_is_published_with_its_files(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    put(rows, path, method="auto", batch="one")
    got = {r["source"]: r for r in spark.read.format("photo_batch").option("files", "true").load(path).collect()}
    assert len(got) == 40
    for k in range(40):
        r = got[f"in/{k}.png"]
        if k % 5 == 3 or k % 7 == 6:
            assert r["status"] == ("failed" if k % 5 == 3 else "canceled") and r["output"] is r["png"] is r["report"] is None
            continue
        assert bytes(r["png"]).decode() == str(k) and r["output"].endswith(f"images/p{k}_date_removed.png") and open(r["output"]).read() == str(k)
        assert (r["mask"] is None) == (r["mask_png"] is None) == bool(k % 2) and json.loads(r["report_json"]) == {"n": k, "é": None}
    head = photo_batch.batch_heads(spark, path).first()
    assert (head["batch"], head["method"], head["total"], head["succeeded"], head["failed"], head["canceled"]) == ("one", "auto", 40, 28, 8, 4)
    assert sum(f.endswith("removed.png") for f in files(path)) == 28


def test_a_committed_batch_stays(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    put(rows, path, batch="one")
    before = files(path)
    put(rows.limit(3), path, batch="one")
    assert files(path) == before
    put(rows.limit(3), path)
    assert [h["total"] for h in photo_batch.batch_heads(spark, path).orderBy("total").collect()] == [3, 40]
    put(rows.limit(0), path, batch="none")
    assert photo_batch.batch_heads(spark, path).where("batch = 'none'").first()["total"] == 0
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format("photo_batch").mode("overwrite").save(path)
    with pytest.raises(Exception, match="needs the columns"):
        put(rows.drop("png", "stem"), path)


def test_a_failed_task_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    for broken in (rows.withColumn("png", F.when(F.col("stem") != "p7", F.col("png"))), rows.withColumn("status", F.when(F.col("stem") == "p7", "lost").otherwise(F.col("status")))):
        with pytest.raises(Exception, match="in/7.png|'lost'"):
            put(broken, path, batch="one")
        assert files(path) == [] and photo_batch.markers(path) == []
    put(rows, path, batch="one")
    assert photo_batch.batch_heads(spark, path).first()["total"] == 40


def test_killed_attempts_are_repeated_without_a_trace(tmp_path):
    """A Python worker dies in the middle of a task: the next attempt's files are the only ones. Then it dies in each attempt."""
    script = textwrap.dedent("""
        import os, sys
        from pyspark.sql import SparkSession, functions as F
        from glyphlake.sources import photo_batch
        out, mark = sys.argv[1:]
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        photo_batch.register(spark)
        class Dying(photo_batch.Stager):
            def _put(self, files, folder, row, part):
                if row["source"] == "5" and (mark == "always" or not os.path.exists(mark)):
                    if mark != "always":
                        open(mark, "w").close()
                    os._exit(1)
                return super()._put(files, folder, row, part)
        class Dies(photo_batch.PhotoBatch):
            name = classmethod(lambda cls: "dying_batch")
            def _stager(self, schema, overwrite, batch):
                return Dying(self.options["path"], "", batch)
        spark.dataSource.register(Dies)
        rows = spark.range(0, 12, 1, 2).selectExpr("cast(id as string) as stem", "'succeeded' as status", "cast(id as string) as source", "encode(cast(id as string), 'utf-8') as png")
        rows.write.format("dying_batch").mode("append").option("batch", "b").save(out)
        got = spark.read.format("photo_batch").load(out)
        assert sorted(int(r["source"]) for r in got.collect()) == list(range(12))
        kept = len({r["output"].split("/images/")[0] for r in got.collect()})
        swept = photo_batch.sweep(out)
        assert len(swept) == 1 and kept == 2, (swept, kept)
        assert got.count() == 12
    """)
    path = tmp_path / "kill.py"
    path.write_text(script)
    env = {**os.environ, "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, str(path), str(tmp_path / "out"), str(tmp_path / "mark")], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert sum(f.endswith("removed.png") for f in files(tmp_path / "out")) == 12
    lost = subprocess.run([sys.executable, str(path), str(tmp_path / "out2"), "always"], env=env, capture_output=True, text=True, timeout=300)
    assert lost.returncode != 0 and files(tmp_path / "out2") == []


def test_stream_sink_takes_each_batch_once(spark, rows, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = rows.schema
    rows.limit(5).write.parquet(f"{source}/a")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        query = stream.writeStream.format("photo_batch").option("path", path).option("batch", "s").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    run(str(tmp_path / "c"))
    rows.limit(4).write.parquet(f"{source}/b")
    run(str(tmp_path / "c"))
    assert [(m["batch"], m["total"]) for m in photo_batch.markers(path)] == [("s-0000000000", 5), ("s-0000000001", 4)]
    before = files(path)
    run(str(tmp_path / "other"))  # a replay from the start: its first batch has the id of the one that is there
    assert files(path) == before and spark.read.format("photo_batch").load(path).count() == 9


def test_run_folders_are_claimed_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda _: manifests.new_run_folder(spark, str(tmp_path), "Run"), range(8)))
    assert sorted(os.path.basename(p) for p in made) == ["Run", *(f"Run {k}" for k in range(2, 9))]
    assert not folders.claim(spark, str(tmp_path / "Run"))


def test_png_rows_of_every_kind_and_damage():
    import struct
    import time
    import zlib

    import numpy as np

    from glyphlake.functions import png

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 30, 3)).astype(np.int32)
    raw = b""
    for y in range(40):
        kind, line = y % 5, image[y]
        left = np.vstack([np.zeros((1, 3), int), line[:-1]])
        up = image[y - 1] if y else np.zeros((30, 3), int)
        corner = np.vstack([np.zeros((1, 3), int), up[:-1]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (0 * left, left, up, (left + up) >> 1, near)[kind]
        raw += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 40, 8, 2, 0, 0, 0))
    data = png.SIGNATURE + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (png.decode(data) == image).all()
    for bad in (png.SIGNATURE, png.SIGNATURE + head, data[:-3], data[:60]):
        with pytest.raises(ValueError, match="PNG"):
            png.decode(bad)
    start = time.perf_counter()
    png._predicted(bytes(512 * 512 * 3), bytes(512 * 512 * 3), 3, False)
    assert time.perf_counter() - start < 3
