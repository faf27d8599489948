"""The fixture scene, the detector, kernels, PNG files and the solver's guarantees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import kernels as K
from glyphlake.functions import png
from glyphlake.operators import batch, detect, pixels, scenes, web_audit
from glyphlake.operators.components import label_pixels
from glyphlake.operators.pixels import disk

LEFT = (500, 517, 549, 566, 598, 615, 632, 649)


def scene():
    image, core, boxes = np.full((1152, 864, 3), 112.0), np.zeros((1152, 864), bool), []
    for x in LEFT:
        image[1016:1050, x - 4 : x + 16] = 4
    for x in LEFT:
        image[1020:1046, x : x + 12] = (250, 95, 5)
        core[1020:1046, x : x + 12] = True
        boxes.append((x, 1020, x + 11, 1045))
    return image, core, K.dilate(core, disk(3)), boxes


def test_fixture_and_imprint():
    image, core, mask, boxes = scene()
    assert core.sum() == 2496 and mask.sum() == 4318
    clean = image.copy()
    clean[mask] = 112
    assert not K.imprint(image, clean, core, mask, boxes, 3)["detected"]
    dirty, outline = clean.copy(), K.dilate(core, disk(3)) & ~core
    dirty[outline] = image[outline]
    found = K.imprint(image, dirty, core, mask, boxes, 3)
    assert found["detected"] and found["affected_glyphs"] >= 3
    with pytest.raises(ValueError):
        K.imprint(image, clean, core, mask, boxes[:7], 3)


def test_reconstructions_keep_the_outside():
    image, core, mask, _ = scene()
    crop, m = image[900:1140, 420:760], mask[900:1140, 420:760]
    found, _ = K.candidates(crop, m, 3.0)
    assert tuple(found) == K.METHODS
    for candidate in found.values():
        assert np.isfinite(candidate).all() and np.abs(candidate - crop)[~m].max() == 0 and K.quality(crop, candidate, m)["score"] >= 0
    with pytest.raises(ValueError):
        K.candidates(crop, m, 3.0, ("nonsense",))


def test_detector(spark):
    keys = spark.createDataFrame([(0,), (6,), (5,), (77,)], "photo_id long")
    found = {r["photo_id"]: r for r in detect.detect(scenes.scene_pixels(keys), 1152, 864).collect()}
    assert set(found) == {0, 77} and found[0]["radius"] in (3, 14) and len(found[0]["s"]) == 8
    same = spark.createDataFrame([(1, y, x, 250, 95, 5) for left in LEFT for y in range(1020, 1046) for x in range(left, left + 12)], "photo_id long, y int, x int, r int, g int, b int")
    best = detect.detect(same, 1152, 864).first()
    assert best["score"] == pytest.approx(12.149293053339173, abs=1e-12) and best["median_h"] == 26 and best["radius"] == 3


def test_labels_against_flood_fill():
    rng = np.random.default_rng(2)
    grid = rng.random((40, 50)) < 0.4
    y, x = np.nonzero(grid)
    got = dict(zip(zip(y.tolist(), x.tolist()), label_pixels(y, x).tolist()))
    seen, n = {}, 0
    for start in got:
        if start not in seen:
            n += 1
            todo = [start]
            while todo:
                p = todo.pop()
                if p in got and p not in seen:
                    seen[p] = n
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert got == seen


def test_set_operations(spark):
    a = spark.createDataFrame([(1, 5, x) for x in range(10)], "photo_id long, y int, x int")
    assert pixels.dilate(a, disk(1), 100, 100).count() == 31
    assert {(r["y"], r["x"]) for r in pixels.erode(pixels.dilate(a, pixels.SQUARE, 100, 100)).collect()} == {(5, x) for x in range(10)} - {(5, 0)}
    boxes = pixels.bounding_box(a.where("x > 5"))
    assert pixels.crop(a, boxes, 2, 100, 100).count() == 6
    rgb = lambda df, v: df.selectExpr("*", f"{v} as r", f"{v} as g", f"{v} as b")
    mixed = pixels.composite(rgb(a, 1), rgb(a, 2), a.where("x < 3")).collect()
    assert sorted((r["x"], r["r"]) for r in mixed) == [(x, 2 if x < 3 else 1) for x in range(10)]
    assert pixels.bounding_box(a).first()[1:] == (10, 0, 5, 9, 5)
    assert pixels.outside(a, a.where("x < 3")).count() == 7 and pixels.within(a, a.where("x < 3")).count() == 3


def test_png_round_trip():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (13, 17, 3), dtype=np.uint8)
    assert (png.decode(png.encode(image)) == image).all()
    grey = image[..., 0]
    assert (png.decode(png.encode(grey)) == grey[..., None]).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing")
    assert png.upright(image, 6).shape == (17, 13, 3) and png.exif_orientation(b"\xff\xd8\xff\xd9") == 1


def test_names(spark):
    cases = {"../CON.jpg": "photo_con", "trip:day?1.jpg": "trip_day_1", ".jpg": "jpg", "a/ .jpg": "photo"}
    rows = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", batch.safe_stem(F.col("path"))).collect()
    assert all(r["got"] == r["want"] for r in rows), rows
    files = spark.createDataFrame([(1, "photo.jpg"), (2, "b/photo.jpg"), (3, "photo_2.jpg"), (4, "PHOTO.png")], "k long, path string")
    assert [r["stem"] for r in batch.output_names(files, "path", "k").orderBy("k").collect()] == ["photo", "photo_2", "photo_2_2", "PHOTO_3"]


def test_audit_gate(spark):
    row = spark.createDataFrame([(True, False, True, False, 26011), (True, False, True, True, 0), (True, False, None, False, 0)], "outside_mask_rgb_exact boolean, timestamp_sequence_redetected boolean, timestamp_imprint_check_applied boolean, timestamp_imprint_detected boolean, remaining int")
    assert [r["ok"] for r in row.select(batch.passes_audit().alias("ok")).collect()] == [True, False, False]


def test_model_fallback():
    calls = []

    def model(image, mask, optimised):
        calls.append((mask, optimised))
        return "grey" if len(calls) == 3 else image

    assert batch.with_model_fallback("image", "m", "r", model, lambda x: x == "image") == ("grey", "model_rescue")
    assert calls == [("m", True), ("m", False), ("r", False)]


def test_web_rules(spark):
    agents = [("Mozilla (Windows NT 10.0)", "", "windows"), ("x", "MacIntel", "macos"), ("iPhone Mac OS X", "", "other"), ("Android Mobile", "Win32", "other"), ("X11 Linux", "", "other")]
    got = spark.createDataFrame(agents, "ua string, pf string, want string").withColumn("got", web_audit.platform_of(F.col("ua"), F.col("pf"))).collect()
    assert all(r["got"] == r["want"] for r in got)
    domains = [("a.example", "https://a.example"), ("  ", "d"), (None, "d"), ("a.example/x", "d"), ("u@a.example", "d"), ("a.example?q", "d")]
    got = spark.createDataFrame(domains, "domain string, want string").withColumn("got", web_audit.origin_or_default(F.col("domain"), "d")).collect()
    assert all(r["got"] == r["want"] for r in got)
    page = spark.createDataFrame([(1, "<script>self.push(1)</script><script src='a'></script><style>p{}</style><p style='x'>")], "page_id long, html string")
    kinds = lambda p: sorted(r["kind"] for r in web_audit.findings(page.withColumn("policy", F.lit(p))).collect())
    assert kinds("script-src 'self'; style-src 'self'") == ["script", "style", "style_attribute"]
    assert kinds("default-src 'unsafe-inline'") == [] and kinds("script-src 'unsafe-inline' 'nonce-a'; style-src 'unsafe-inline'") == ["script"]
    assert kinds(None) == []
    odd = """<SCRIPT data-src='x'>a</SCRIPT><script type="Application/JSON">{}</script><script title="a > b" src=x>b</script><script nonce=n>c</script><p data-style="x">"""
    one = spark.createDataFrame([(1, odd, "script-src 'nonce-n'; STYLE-SRC 'none'; style-src 'self'")], "page_id long, html string, policy string")
    assert [r["preview"] for r in web_audit.findings(one).collect()] == ["a"]
    rules = one.select(web_audit.parse_policy(F.col("policy")).alias("p")).first()["p"]
    assert rules == {"script-src": ["'nonce-n'"], "style-src": ["'self'"]}
    bad = one.select(web_audit.boundary_errors(F.lit("default-src 'none'; script-src 'wasm-unsafe-eval'; worker-src x")).alias("e")).first()["e"]
    assert bad == ["worker-src", "script-src"]
    assert one.select(web_audit.forbidden_tokens(F.lit("a.fetch(x)"), ["fetch(", "XMLHttpRequest"]).alias("t")).first()["t"] == ["fetch("]


def test_mask_holds_only_the_chosen_components(spark):
    keys = spark.createDataFrame([(77,)], "photo_id long")  # 77 % 4 = 1: two orange squares that are no date
    found, core = detect.detect_core(scenes.scene_pixels(keys), 1152, 864)
    assert found.count() == 1
    places = {(r["y"], r["x"]) for r in core.collect()}
    assert places and all(y >= 1020 and x >= 500 for y, x in places)


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert [value(batch.byte_size(F.lit(n))) for n in (1, 1536, 2560, 1048576, 1572864)] == ["1 KB", "2 KB", "2 KB", "1.0 MB", "1.5 MB"]
    at = F.lit("2024-03-05 06:07:08.5").cast("timestamp")
    assert value(batch.run_folder(at)) == "2024-03-05 060708" and value(batch.utc_iso(at)) == "2024-03-05T06:07:08.500000+00:00"
    assert [value(batch.is_finite(F.lit(x))) for x in (1.0, float("nan"), float("inf"), None)] == [True, False, False, False]
    white, black = batch.luminance(F.lit(255), F.lit(255), F.lit(255)), batch.luminance(F.lit(0), F.lit(0), F.lit(0))
    assert value(batch.contrast_ratio(white, black)) == pytest.approx(21.0)
    assert value(batch.merged_reports(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")))) == {"a": "1", "b": "2"}


def test_names_of_a_large_family(spark):
    names = [("photo.jpg", k) for k in range(0, 60, 3)] + [("IMG_0001.jpg", k) for k in (1, 4)] + [(f"IMG_{k:04}.jpg", k + 100) for k in range(2, 40)] + [("photo_3.jpg", 5), ("photo_3_2.jpg", 7)]
    files = spark.createDataFrame(names, "path string, k long")
    got = {r["k"]: r["stem"] for r in batch.output_names(files, "path", "k", block=8).collect()}
    used, want = set(), {}
    for path, k in sorted(names, key=lambda x: x[1]):
        base, n = path[:-4], 1
        while (name := base if n == 1 else f"{base}_{n}") in used:
            n += 1
        used.add(name)
        want[k] = name
    assert got == want


def test_kernels_against_brute_force():
    rng = np.random.default_rng(4)
    mask = rng.random((23, 31)) < 0.8
    clean = np.argwhere(~mask)
    dist, y, x = K.nearest_outside(mask)
    for k, p in enumerate(np.argwhere(mask)):
        d = ((clean - p) ** 2).sum(1)
        best = min(map(tuple, clean[d == d.min()]))
        assert dist[k] == pytest.approx(d.min() ** 0.5) and (y[k], x[k]) == best
    assert (K.erode(mask)[1:-1, 1:-1] == np.lib.stride_tricks.sliding_window_view(mask, (3, 3)).all((2, 3))).all() and not K.erode(mask)[0].any()
    image, small = rng.random((40, 50, 3)) * 255, np.zeros((40, 50), bool)
    small[15:22, 20:31] = True
    want = image.copy()
    _, ny, nx = K.nearest_outside(small)
    want[small] = want[ny, nx]
    for _ in range(3):
        old = want.copy()
        for a, b in np.argwhere(small):
            near = [(old[a + dy, b + dx], 1 if 0 in (dy, dx) else 0.5**0.5) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
            want[a, b] = sum(v * w for v, w in near) / sum(w for _, w in near)
    assert np.allclose(K.harmonic(image, small, rounds=3, tolerance=0), want)
