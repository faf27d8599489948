"""Every registered query of the image-batch side against its DuckDB twin, and the sources."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphlake.plans import registry
from glyphlake.sources import manifests, photos
from glyphlake.streaming import inbox
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(f"select {', '.join(names)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == sorted(map(str, want))


def test_photo_files(spark, tmp_path):
    import numpy as np

    from glyphlake.functions import png

    image = np.zeros((100, 100, 3), np.uint8)
    image[80, 60] = (250, 95, 5)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    (tmp_path / "b.png").write_bytes(b"broken")
    images = photos.decoded(photos.photo_files(spark, str(tmp_path))).cache()
    rows = {os.path.basename(r["path"]): r for r in images.collect()}
    assert rows["a.png"]["height"] == 100 and rows["b.png"]["error"].startswith("ValueError")
    assert [tuple(r)[1:] for r in photos.orange_pixels(images).collect()] == [(80, 60, 250, 95, 5)]
    assert bytes(photos.encoded(images.where("error is null")).first()["png"]) == png.encode(image)
    seen = []
    inbox.run_available(inbox.preflight_inbox(spark, str(tmp_path)), str(tmp_path / "checkpoint"), lambda df, k: seen.extend(df.collect()))
    assert len(seen) == 2


def test_manifest_and_stream(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"method": "auto", "total": 2, "results": [{"status": "succeeded", "source": "a"},\n {"status": "failed", "error": "x"}]}')
    assert [r["status"] for r in manifests.read_results(spark, str(tmp_path / "m.json")).collect()] == ["succeeded", "failed"]
    lines = spark.createDataFrame([("s", 1, "aGk="), ("s", 2, ""), ("s", 3, "?"), ("s", 4, "__END__"), ("s", 5, "aGk=")], "stream string, number int, line string")
    got = manifests.decode_base64_lines(lines).orderBy("number").collect()
    assert [(r["number"], r["valid"]) for r in got] == [(1, True), (3, False)] and bytes(got[0]["bytes"]) == b"hi"
    streams = spark.createDataFrame([(s, 1, "aGk=") for s in "abc"] + [("c", 2, "?")], "stream string, number int, line string")
    expected = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2)], "stream string, bytes long")
    assert [r["stream"] for r in manifests.whole_streams(manifests.decode_base64_lines(streams), expected).collect()] == ["a"]


def test_running_sum(spark):
    from glyphlake.operators.ranking import running_sum

    rows = [(k, k * k % 97) for k in range(3000) if k % 5]
    got = {r["k"]: r["before"] for r in running_sum(spark.createDataFrame(rows, "k long, v int"), F.expr("k div 64"), ["k"], F.col("v")).collect()}
    assert got == {k: sum(v for _, v in rows[:at]) for at, (k, _) in enumerate(rows)}


def test_whole_sheet(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert registry.QUERIES["page_grid_all"](spark, SF).count() == parts
    assert registry.QUERIES["row_offsets_all"](spark, SF).count() == -(-parts // 4)
    # only the table of bucket sums may meet in one task
    plan = registry.QUERIES["row_offsets"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\(height#\d+ \+ 8\)[^\n]*\], \[row#", plan) and "_bucket" in plan


def test_manifests_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("succeeded", "a"), ("failed", "b"), ("failed", "c")], "status string, source string")
    manifests.write_manifest(rows, str(tmp_path / "m"), "auto")
    head, results = manifests.read_manifest(spark, str(tmp_path / "m"))
    assert head.first()[1:] == ("auto", 3, 1, 2, 0) and results.count() == 3
    with pytest.raises(FileExistsError):
        manifests.write_manifest(rows, str(tmp_path / "m"), "auto")
    assert [manifests.new_run_folder(spark, str(tmp_path), "run")[-5:] for _ in range(3)] == [f"{tmp_path}/run"[-5:], "run 2", "run 3"]
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "a.json").write_text('{"verified": true,\n "n": 1}')
    found = spark.createDataFrame([("a", "x/a.json")], "source string, report string")
    assert manifests.read_reports(spark, found, str(tmp_path / "reports"), "verified boolean, n int").first()["n"] == 1
    with pytest.raises(Exception, match="no report"):
        manifests.read_reports(spark, found.selectExpr("source", "'x/b.json' as report"), str(tmp_path / "reports"), "verified boolean, n int").collect()
    report = spark.createDataFrame([(True, 0, True, False, True, False, "m")], "verified boolean, changed_pixels_outside_mask int, outside_mask_rgb_exact boolean, timestamp_sequence_redetected boolean, timestamp_imprint_check_applied boolean, timestamp_imprint_detected boolean, model_sha256 string")
    assert manifests.write_audit(report, str(tmp_path / "audit")) and not manifests.write_audit(report.withColumn("verified", F.lit(False)), str(tmp_path / "audit2"))


def test_process_of_files(spark, tmp_path):
    """PNG files through folder scan, decoding and the whole process: one with a date, one without, one broken."""
    import numpy as np

    from glyphlake.functions import png
    from glyphlake.operators import process

    image = np.full((1152, 864, 3), 112, np.uint8)
    (tmp_path / "plain.png").write_bytes(png.encode(image))
    for x in (500, 517, 549, 566, 598, 615, 632, 649):
        image[1016:1050, x - 4 : x + 16] = 4
    for x in (500, 517, 549, 566, 598, 615, 632, 649):
        image[1020:1046, x : x + 12] = (250, 95, 5)
    (tmp_path / "dated.png").write_bytes(png.encode(image))
    (tmp_path / "broken.png").write_bytes(b"x")
    rows = {os.path.basename(r["path"]): r for r in process.process(photos.decoded(photos.photo_files(spark, str(tmp_path))), "harmonic").collect()}
    assert rows["plain.png"]["error"] == "no date was found" and rows["broken.png"]["error"].startswith("ValueError") and rows["broken.png"]["status"] == "failed"
    done = rows["dated.png"]
    assert done["status"] == "succeeded" and done["mask_pixels"] == 4318 and done["changed_pixels"] == 2496 and done["changed_pixels_outside_mask"] == 0
    assert (png.decode(bytes(done["mask_png"]))[..., 0] == 255).sum() == 4318 and (png.decode(bytes(done["png"])) == 112).all(2).sum() > 900_000
    ready = {os.path.basename(r["path"]): r for r in process.preflight(photos.decoded(photos.photo_files(spark, str(tmp_path)))).collect()}
    assert ready["dated.png"]["status"] == "detected" and ready["dated.png"]["detector_score"] == pytest.approx(12.149293053339173) and ready["dated.png"]["glyphs"] == 8
    assert [ready[x]["status"] for x in ("plain.png", "broken.png")] == ["failed", "failed"]
    with pytest.raises(FileNotFoundError):
        photos.folder_batch(spark, str(tmp_path))
    (tmp_path / "b.JPG").write_bytes(b"x")
    (tmp_path / "a.jpeg").write_bytes(b"x")
    (tmp_path / "c.Jpg").write_bytes(b"x")
    assert [os.path.basename(r["path"]) for r in photos.folder_batch(spark, str(tmp_path)).collect()] == ["a.jpeg", "b.JPG"]
    with pytest.raises(ValueError):
        process.process(photos.decoded(photos.photo_files(spark, str(tmp_path))), "nonsense")


def test_progress_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"at": "2024-01-01T00:00:00Z", "status": "succeeded"}\n{"at": "2024-01-01T00:01:00Z", "status": "failed"}\n')
    stream = spark.readStream.schema("at timestamp, status string").json(str(tmp_path / "in"))
    query = inbox.progress_counts(stream).writeStream.format("memory").queryName("progress").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["succeeded"], r["failed"]) for r in spark.table("progress").collect()] == [(1, 1)]
