"""Tiles, binned pairs, nearest vectors and free numbers against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import batch, components, detect, free_numbers, nearest, tiles


def odd_photo(rng, photo, size=50):
    kind = photo % 5
    y, x = np.nonzero(rng.random((size, size)) < (0.25, 0.45, 0.6)[kind % 3])
    if kind == 3:  # one snake through all tiles
        y, x = zip(*[(r, c) for r in range(0, size, 2) for c in range(size)] + [(r, size - 1 if r % 4 == 1 else 0) for r in range(1, size, 2)])
    if kind == 4:  # diagonals that meet tiles at their corners only
        y, x = zip(*[(k, k) for k in range(size)] + [(k, size - 1 - k) for k in range(0, size // 3)])
    return [(photo, int(a), int(b)) for a, b in zip(y, x)]


@pytest.mark.parametrize("tile", [7, 64])
def test_tiles_equal_whole_photos(spark, tile):
    rng = np.random.default_rng(tile)
    pixels = spark.createDataFrame(sum([odd_photo(rng, p, 50) for p in range(5)], []), "photo_id long, y int, x int")
    want = components.label_components(pixels)
    key = lambda df: sorted(map(tuple, df.select("photo_id", "y", "x", "label").collect()))
    assert key(tiles.label_tiled(pixels.union(pixels.limit(9)), tile)) == key(want)
    table = lambda df: sorted(map(tuple, df.select("photo_id", "label", "area", "x0", "y0", "x1", "y1", "cx", "cy").collect()))
    assert table(tiles.tiled_component_table(pixels, tile)) == table(components.component_table(want))


def test_tiles_of_odd_tables(spark):
    schema = "photo_id long, y int, x int"
    assert tiles.label_tiled(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, 1), (1, None, 2), (1, 255, 255), (1, 256, 256), (1, 0, 0), (1, 5000, 70_000)]
    got = sorted((r["y"], r["x"], r["label"]) for r in tiles.label_tiled(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 1), (255, 255, 2), (256, 256, 2), (5000, 70_000, 3)]


def test_binned_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), k, float(rng.integers(0, 400)) / 2, int(h)) for k, h in enumerate(np.exp(rng.uniform(0, 5, 400)).astype(int))]
    table = spark.createDataFrame(rows, "photo_id long, label long, cy double, height int")
    got = sorted((r["photo_id"], r["label"], r["anchor"]) for r in detect.aligned(table).collect())
    want = sorted((p, k, a) for p, k, cy, h in rows for q, a, ay, ah in rows if p == q and abs(cy - ay) <= 0.34 * max(h, ah) and 0.55 <= h / ah <= 1.8)
    assert got == want and len(want) > 1000


def test_binned_pairs_of_many_specks(spark):
    n = 20_000
    specks = spark.range(n).selectExpr("1L as photo_id", "id as label", "cast(pmod(id * 7919, 6000) as double) / 2 as cy", "cast(8 + id % 5 as int) as height")
    assert detect.binned_pairs(specks).count() < n * n / 50
    plan = detect.aligned(specks)._jdf.queryExecution().optimizedPlan().toString()
    assert "scale" in plan and "bin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def brute_numbers(rows):
    used, out = set(), {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        n = 1
        while (name := key if n == 1 else f"{key}_{n}") in used:
            n += 1
        used.add(name)
        out[at] = n
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_free_numbers_equal_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "a_1", "a_2", "a_3", "a_5", "a_2_2", "a_2_3", "a_2_2_2", "b", "b_02", "b_2", "c_4", "_2", "a_99999999999999999999"] + [f"a_{k}" for k in range(6, 60)]
    weights = np.array([20, 1, 3, 3, 3, 3, 1, 2, 8, 1, 2, 1, 1, 1] + [0.3] * 54)
    rows = [(str(rng.choice(names, p=weights / weights.sum())), int(at)) for at in rng.permutation(5000)[:300]]
    got = {r["at"]: r["number"] for r in free_numbers.free_numbers(spark.createDataFrame(rows, "key string, at long"), block=64).collect()}
    assert got == brute_numbers(rows)


def test_output_names_of_a_hot_family(spark):
    files = spark.range(3000).selectExpr("id", "case when id % 10 = 7 then concat('p/Photo_', id div 3, '.jpg') when id % 2 = 0 then 'p/photo.JPG' else 'p/PHOTO.png' end as path")
    out = batch.output_names(files, "path", "id")
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["id"]: r["stem"] for r in out.collect()}
    want = brute_numbers([((f"photo_{k // 3}" if k % 10 == 7 else "photo"), k) for k in range(3000)])
    base = lambda k: f"Photo_{k // 3}" if k % 10 == 7 else "photo" if k % 2 == 0 else "PHOTO"
    assert rows == {k: base(k) + (f"_{n}" if n > 1 else "") for k, n in want.items()}
    assert len({v.lower() for v in rows.values()}) == 3000


def test_nearest_equals_brute_force_and_prunes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(3000, 5)) + rng.integers(0, 6, (3000, 1)) * 3, 3)
    x[100:160] = x[100]  # copies, so ties and a hot cell
    monkeypatch.setattr(nearest, "BLOCK", 300)
    counted = []
    compared = nearest.compared_pairs
    monkeypatch.setattr(nearest, "compared_pairs", lambda *a: counted.append(compared(*a)) or counted[-1])
    v = spark.createDataFrame([(k, r.tolist(), k % 3) for k, r in enumerate(x)], "id long, e array<double>, label int")
    q = v.where("id % 40 = 0").selectExpr("id as q", "e as qe")
    got = {}
    for r in nearest.nearest(v, q).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["d2"], r["id"], r["label"]))
    for k in range(0, 3000, 40):
        d2 = np.round(((x - x[k]) ** 2).sum(1), 9)
        order = [j for j in np.lexsort((np.arange(3000), d2)) if j != k][:12]
        assert [(i, j) for i, _, j, _ in sorted(got[k])] == [(i + 1, j) for i, j in enumerate(order)]
        assert np.allclose([d for _, d, _, _ in sorted(got[k])], d2[order], atol=2e-9)
    assert sum(df.count() for df in counted) < 0.3 * 3000 * 75
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, e array<double>")
    assert sorted((r["q"], r["id"]) for r in nearest.nearest(few, few.selectExpr("id as q", "e as qe")).collect()) == [(1, 2), (2, 1)]
    assert nearest.nearest(few.limit(0), few.selectExpr("id as q", "e as qe")).count() == 0
