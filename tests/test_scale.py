"""What grows with the number of photos: nothing broadcast, no pixels shuffled or sent to Python one by one."""

import numpy as np
import pytest

from glyphlake.operators import batch, components, detect, nearest, pixels as P, process, scenes
from glyphlake.plans import registry
from tests.conftest import SF


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("name", ["changed_outside_mask", "remaining_orange", "detected_core", "harmonic_fill_scene", "restore_scene", "process_scene", "golden_pairs", "sequence_gaps", "undated_candidates", "rescue_mask_bound"])
def test_no_photos_are_broadcast(spark, name):
    assert not [line for line in plan(registry.QUERIES[name](spark, SF)) if "Broadcast" in line]


def test_no_photos_are_broadcast_on_the_way(spark):
    keys = spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("s_suppkey as photo_id")
    images = process.scene_photos(scenes.scene_pixels(keys), keys, 1152, 864, 112)
    for df in (images, process.detections(images), process.pairs(images, images)):
        assert not [line for line in plan(df) if "Broadcast" in line]


@pytest.mark.parametrize("name", ["orange_count", "mask_bbox", "edited_area", "mask_dilate", "mask_l1_dilate", "erosion_boundary", "changed_outside_mask", "remaining_orange", "rescue_mask_bound"])
def test_no_pixels_are_shuffled(spark, name):
    """Only keys are dealt out; all else happens in their tasks, so shuffled rows don't grow with a photo's pixels."""
    shuffled = [line for line in plan(registry.QUERIES[name](spark, SF)) if "Exchange" in line]
    assert shuffled and all("hashpartitioning(photo_id" in line and "REPARTITION_BY_NUM" in line for line in shuffled)


@pytest.mark.parametrize("of", [detect.labelled_orange, lambda p, h, w: detect.detect_runs(p, h, w)[1]])
def test_labels_are_of_runs(spark, of):
    keys = spark.createDataFrame([(0,), (77,)], "photo_id long")
    found = of(scenes.scene_pixels(keys), 1152, 864)
    assert {"photo_id", "y", "l", "r"} <= set(found.columns) and found.count() <= 2 * (8 * 27 + 9)


def odd_grids():
    rng = np.random.default_rng(5)
    return {p: {(y, x) for y, x in np.argwhere(rng.random((9, 140)) < share).tolist()} for p, share in ((1, 0.5), (2, 0.95), (3, 1.0), (-4, 0.1))}


@pytest.fixture(scope="module")
def grids(spark):
    found = odd_grids()
    rows = [(p, y, x) for p, at in found.items() for y, x in at]
    return found, spark.createDataFrame(rows, "photo_id long, y int, x int")


def places(df):
    rows = [(r["photo_id"], r["y"], r["x"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words_against_brute_force(grids):
    found, table = grids
    every = {(p, y, x) for p, at in found.items() for y, x in at}
    assert places(P.from_words(P.words(table.union(table)))) == every
    assert {(r["photo_id"], r["y"], x) for r in P.runs(table).collect() for x in range(r["l"], r["r"] + 1)} == every
    inner = {(p, y, x) for p, at in found.items() for y, x in at if all((y + dy, x + dx) in at for dy, dx in P.SQUARE)}
    assert inner and places(P.erode(table)) == inner and places(P.inner_boundary(table)) == every - inner
    other = table.where("(x + y) % 3 = 0").unionByName(table.selectExpr("photo_id", "y + 4 as y", "x + 33 as x")).distinct()
    assert places(P.outside(table, other)) == every - places(other) and places(P.within(table, other)) == every & places(other)
    for offsets in (P.disk(3), P.diamond(2), P.SQUARE):
        grown = {(p, y + dy, x + dx) for p, y, x in every for dy, dx in offsets if 0 <= y + dy < 10 and 0 <= x + dx < 130}
        assert places(P.dilate(table, offsets, 10, 130)) == grown
    wide = {(p, y + dy, x + dx) for p, y, x in every for dy, dx in P.disk(2 + p % 2) if 0 <= y + dy < 10 and 0 <= x + dx < 130}
    assert places(P.dilate_by_radius(table.selectExpr("*", "cast(2 + pmod(photo_id, 2) as int) as radius"), 10, 130)) == wide


def test_labels_of_many_photos_at_once(grids):
    found, table = grids
    got = {p: {} for p in found}
    for r in components.label_components(table).collect():
        got[r["photo_id"]][r["y"], r["x"]] = r["label"]
    for p, at in found.items():
        y, x = np.array(sorted(at)).T
        assert got[p] == dict(zip(sorted(at), components.label_pixels(y, x).tolist()))


def test_scenes_equal_their_boxes(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 1, 5, 6, 13, 77, -5)] + [(5,), (None,)], "photo_id long")
    want = {}
    for r in scenes.glyphs(keys.distinct().where("photo_id is not null")).collect():
        for y in range(r["y0"] - 4, r["y1"] + 5):
            for x in range(r["x0"] - 4, r["x0"] + 16):
                inside = r["y0"] <= y <= r["y1"] and r["x0"] <= x < r["x0"] + 12
                at = (r["photo_id"], y, x)
                want[at] = want.get(at, False) or inside
    for k in (1, 5, 13, 77):
        want |= {(k, y, x): True for top, left, n in scenes.SQUARES for y in range(top, top + n) for x in range(left, left + n)}
    rows = scenes.scene_pixels(keys).collect()
    assert len(rows) == len(want)
    assert {(r["photo_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) == scenes.ORANGE for r in rows} == want


def test_names_of_every_row(spark):
    """Repeated orders, and rows without path or order, are rows of the result."""
    rows = [("a.jpg", 1), ("a.jpg", 1), ("A.jpg", 2), ("a_2.jpg", 1), ("a_2.jpg", None), (None, 3), (None, None), ("b.jpg", 4)]
    got = batch.output_names(spark.createDataFrame(rows, "path string, id long"), "path", "id").select("path", "id", "stem").collect()
    assert len(got) == len(rows)
    stems = [r["stem"].lower() for r in got if r["stem"] is not None]
    assert len(stems) == len(set(stems)) == 6 and {"a", "a_2", "b"} <= set(stems)
    assert sorted(map(tuple, [r for r in got if r["path"] is None]), key=str) == [(None, 3, None), (None, None, None)]


def test_repeated_names_equal_the_sql(spark, tmp_path):
    """Each document twice, two without text, and device names."""
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.union(docs).union(spark.createDataFrame([(-1, None), (-2, None), (-3, "con"), (-4, "Con\nx"), (-5, "LPT1")], "doc_id long, text string")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, stem, output, mask, report from ({registry.ORACLES['output_names']})").fetchall()
    got = registry.QUERIES["output_names"](spark, str(tmp_path)).select("doc_id", "stem", "output", "mask", "report").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_neighbours_are_compared_in_blocks(spark, monkeypatch):
    """Equal to brute force with ties, copies and blocks smaller than k; no pair of vectors is a row."""
    monkeypatch.setattr(nearest, "BLOCK", 8)
    monkeypatch.setattr(nearest, "QUERIES", 5)
    x = np.random.default_rng(8).integers(0, 4, (400, 3)).astype(float)
    v = spark.createDataFrame([(k, r.tolist(), k % 3) for k, r in enumerate(x)], "id long, e array<double>, label int")
    found = nearest.nearest(v, v.where("id % 9 = 0").selectExpr("id as q", "e as qe"), pivots=7)
    text = "\n".join(plan(found))
    assert "CoGroups" in text and "zip_with" not in text
    got = sorted(tuple(r) for r in found.select("q", "rank", "id", "label", "d2").collect())
    want = []
    for k in range(0, 400, 9):
        d2 = ((x - x[k]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(400), d2)) if j != k][:12]
        want += [(k, i + 1, int(j), int(j) % 3, float(d2[j])) for i, j in enumerate(order)]
    assert got == want
