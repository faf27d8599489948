"""Keyed state over batches, admission, progress and cancelling."""

import base64
import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import batch
from glyphlake.sources import photo_batch
from glyphlake.streaming import admission, lines, progress

LINES = "stream string, number long, line string, expected long"


def odd_streams(rng):
    rows = []
    for s in range(12):
        n = int(rng.integers(0, 9))
        for k in range(n):
            text = rng.choice(["aGk=", " aGVsbG8= ", "", "   ", "?", "aGk", base64.b64encode(bytes(rng.integers(0, 256, 40).tolist())).decode()], p=[0.4, 0.15, 0.1, 0.05, 0.03, 0.02, 0.25])
            rows.append([f"s{s}", k, str(text), None])
        if rng.random() < 0.8:
            rows.append([f"s{s}", n, "__END__", None])
            rows += [[f"s{s}", n + 1 + k, "aGk=", None] for k in range(rng.integers(0, 3))]
        if rng.random() < 0.5 and n:
            size = sum(len(lines.payload(r[2]) or b"") for r in rows if r[0] == f"s{s}" and r[1] < n)
            rows[-1 - int(rng.integers(0, n))][3] = size + int(rng.integers(0, 2))
    return [tuple(r) for r in rows]


def brute(rows):
    out = []
    for s in {r[0] for r in rows}:
        size = count = 0
        expected = None
        for _, k, line, wanted in sorted(r for r in rows if r[0] == s):
            text, expected = line.strip(), wanted if wanted is not None else expected
            if text == "__END__":
                out.append((s, k, size, None, "whole" if expected in (None, size) else "short", size, count))
                break
            if text and lines.payload(text) is None:
                out.append((s, k, size, None, "broken", size, count))
                break
            if text:
                out.append((s, k, size, lines.payload(text), None, None, None))
                size, count = size + len(lines.payload(text)), count + 1
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_in_any_cut_equal_one_batch(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = odd_streams(rng)
    one = lines.line_streams(spark.createDataFrame(rows, LINES))
    assert collected(one) == brute(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    cut = rng.integers(0, 3, len(rows))
    for k in range(3):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("stream", "number", "line", "expected"), rows[i]))) for i in rng.permutation(np.flatnonzero(cut == k))))
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(str(folder))
    out = str(tmp_path / "out")
    query = lines.line_streams(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    written = spark.read.schema(lines.OUT).parquet(out)
    assert collected(written) == brute(rows)
    whole = {r[0] for r in brute(rows) if r[4] == "whole"}
    assert collected(lines.whole_payloads(written)) == sorted([r[:4] for r in brute(rows) if r[4] is None and r[0] in whole], key=str)


def test_lines_of_odd_tables(spark):
    rows = [(None, 0, "aGk=", None), ("a", None, "aGk=", None), ("b", 0, None, None), ("b", 1, "__END__", None), ("c", -1, "?", None), ("d", 1, "__END__", None)]
    assert collected(lines.line_streams(spark.createDataFrame(rows, LINES))) == [("b", 1, 0, None, "whole", 0, 0)]
    assert lines.line_streams(spark.createDataFrame([], LINES)).count() == 0


def offers(rng, n, start):
    names = ["A.jpg", "a.JPG", "b.png", "c.gif", "d.jpeg", "e", "F.png", "f.PNG", None] + [f"x{k}.jpg" for k in range(12)]
    return [(names[rng.integers(0, len(names))], start + k) for k in range(n)]


def test_admission_over_batches(spark, tmp_path):
    rng = np.random.default_rng(7)
    parts = [offers(rng, n, 100 * k) for k, n in enumerate((15, 0, 20, 25))]
    source, log = tmp_path / "in", admission.AdmissionLog(str(tmp_path / "log"), most=10)
    schema = "path string, at long"
    stream = spark.readStream.schema(schema).parquet(f"{source}/*")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/{k}")
        admission.admit(stream, log, str(tmp_path / "c")).awaitTermination()
    union = spark.createDataFrame(sum(parts, []), schema)
    want = batch.rejected_files(union.fillna("", ["path"]), "path", "at", most=10).first().asDict()
    assert log.totals() == {k: want[k] for k in ("offered", "unsupported", "repeated", "over_limit", "accepted")}
    taken = {r["at"] for r in log.rows(spark).where("reason = 'accepted'").collect()}
    first = {}
    for path, at in sum(parts, []):
        if path and path.lower().rsplit(".", 1)[-1] in ("jpg", "jpeg", "png") and "." in path:
            first.setdefault(path.lower(), at)
    assert taken == set(sorted(first.values())[:10])
    before = log.totals()
    log.write(log.rows(spark), 0)  # a batch that comes again
    admission.admit(stream, log, str(tmp_path / "new checkpoint")).awaitTermination()
    assert log.totals() == before and log.rows(spark).count() == before["offered"]


def results(slow):
    def work(photos):
        @F.udf("string")
        def status(path):
            if slow and int(path) % 2:
                time.sleep(0.05)
            return "failed" if int(path) % 10 == 3 else "succeeded"

        rows = photos.withColumn("status", status("path"))
        return rows.select(F.col("path").alias("stem"), "status", F.col("path").alias("source"), F.encode("path", "utf-8").alias("png"), F.lit(None).cast("string").alias("error"))

    return work


def test_progress_and_going_on(spark, tmp_path):
    photos = spark.range(60).select(F.col("id").cast("string").alias("path"))
    events = []
    run = progress.BatchRun(photos, results(False), str(tmp_path), waves=4, on_progress=events.append)
    assert run.run() and [e["wave"] for e in events] == [0, 1, 2, 3] and events[-1]["completed"] == 60
    assert sum(e["succeeded"] for e in events) == 54 and sum(e["failed"] for e in events) == 6
    assert run.finish().groupBy("status").count().orderBy("status").collect() == [("failed", 6), ("succeeded", 54)]
    assert progress.BatchRun(photos, results(False), str(tmp_path), waves=4, on_progress=events.append).run() and len(events) == 4


def test_cancel_midway(spark, tmp_path):
    photos = spark.range(400).repartition(4).select(F.col("id").cast("string").alias("path"))
    second = threading.Event()
    run = progress.BatchRun(photos, results(True), str(tmp_path), waves=8, on_progress=lambda e: second.set() if e["wave"] == 1 else None)
    out = []
    thread = threading.Thread(target=lambda: out.append(run.run()))
    thread.start()
    assert second.wait(120)
    time.sleep(0.4)
    run.cancel()
    thread.join(60)
    assert out == [False]
    finished = {m["batch"]: m["total"] for m in photo_batch.markers(str(tmp_path))}
    assert 2 <= len(finished) < 8
    counts = {r["status"]: r["count"] for r in run.finish().groupBy("status").count().collect()}
    assert sum(counts.values()) == 400 and counts["canceled"] == 400 - sum(finished.values()) > 0
    rows = spark.read.format("photo_batch").load(str(tmp_path))
    assert rows.select("source").distinct().count() == 400 and rows.where("status = 'succeeded' and output is null").count() == 0
    assert spark.range(3).count() == 3  # the session goes on


def test_stream_progress(spark, tmp_path):
    log = progress.ProgressLog("counts")
    spark.streams.addListener(log)
    try:
        for k, n in enumerate((3, 5)):
            spark.range(n).selectExpr("if(id % 2 = 0, 'succeeded', 'failed') as status").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = progress.observed_counts(stream, "counts").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if len(log.events) == 2:
                break
            time.sleep(0.1)
        assert log.events[-1]["completed"] == 8 and sum(e["succeeded"] for e in log.events) == 5
    finally:
        spark.streams.removeListener(log)
