"""The pinned model: each way through it, and files that aren't the model."""

import numpy as np
import pytest

from glyphlake.operators import model


def load(path):
    grey = int(np.load(path)[0])

    def fill(image, mask, optimised):
        # a stand-in: the first pixel of a photo says which way works
        want = int(image[0, 0, 0])
        works = want == 1 or (want == 2 and not optimised) or (want == 3 and mask.sum() > 4)
        return np.full_like(image, grey if works else 250)

    return fill


def test_each_way_is_a_row(spark, tmp_path):
    path = str(tmp_path / "model.npy")
    np.save(path, np.array([77]))
    digest = model.file_sha256(path)
    rows = []
    for want in (1, 2, 3, 4, 5, 6):
        image = np.full((6, 6, 3), 9, np.uint8)
        image[0, 0] = want if want < 5 else 3
        mask, rescue = np.zeros((6, 6), np.uint8), np.zeros((6, 6), np.uint8)
        mask[2:4, 2:4], rescue[1:5, 1:5] = 1, 1
        rows.append((str(want), 6, 6, bytearray(image.tobytes()), None if want == 6 else bytearray(mask.tobytes()), None if want == 5 else bytearray(rescue.tobytes())))
    photos = spark.createDataFrame(rows, "path string, height int, width int, rgb binary, mask binary, rescue_mask binary")
    got = {r["path"]: r for r in model.inpaint(photos, path, digest, load, lambda before, after, row: bool((after == 250).any())).collect()}
    assert [got[k]["way"] for k in "123456"] == ["model", "model", "model_rescue", None, None, None]
    assert "outline" in got["4"]["error"] and "no rescue mask" in got["5"]["error"] and "no mask" in got["6"]["error"]
    for k, n in (("1", 4), ("3", 16)):
        image = np.frombuffer(got[k]["rgb"], np.uint8).reshape(6, 6, 3)
        assert (image == 77).all(2).sum() == n and (image[0, 0] == int(k)).all()
    assert {r["model_sha256"] for r in got.values()} == {digest}


def test_another_file_stops_the_job(spark, tmp_path):
    path = tmp_path / "other.npy"
    np.save(path, np.array([1]))
    photos = spark.createDataFrame([], "path string, height int, width int, rgb binary, mask binary, rescue_mask binary")
    with pytest.raises(ValueError, match="SHA-256"):
        model.inpaint(photos, str(path), "0" * 64, load, lambda *a: False)
    digest = model.file_sha256(str(path))
    row = [("a", 1, 1, bytearray(3), bytearray(b"\1"), None)]
    job = model.inpaint(spark.createDataFrame(row, photos.schema), str(path), digest, load, lambda *a: False)

    def tampered(name):
        raise AssertionError("never loaded")

    # what a worker finds is checked again: a digest that no shipped file has
    late = spark.createDataFrame(row, photos.schema).mapInArrow(lambda batches: (b for b in [model.loaded("other.npy", "f" * 64, tampered)]), model.OUT)
    with pytest.raises(Exception, match="SHA-256"):
        late.collect()
    assert job.count() == 1
