"""An inpainting model as an operator: a pinned file that travels with the job, and every way through it as a column.

The file's SHA-256 is checked on the driver before anything starts and again by each worker that loads it; where it
differs the job stops. A worker loads the model once, however many photos and tasks it sees. Each photo is filled with the
mask, where the date's outline is left once more without the optimised way, then with the rescue mask
(``batch.with_model_fallback``); which of them worked is the column ``way``.

Defined cases: a photo whose filling fails, or keeps the outline every way, has a null result and an error; a null mask is an
error; a missing rescue mask only fails where it is needed; rows that share a path are done one by one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .batch import with_model_fallback

OUT = "path string, rgb binary, way string, error string, model_sha256 string"
_LOADED: dict[tuple[str, str], object] = {}


def file_sha256(path: str) -> str:
    """Read in pieces; a model may be large."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def _checked(path: str, sha256: str) -> None:
    if (found := file_sha256(path)) != sha256:
        raise ValueError(f"{os.path.basename(path)} has the SHA-256 {found}, not {sha256}")


def loaded(name: str, sha256: str, load: Callable[[str], object]) -> object:
    """The model of a shipped file, loaded by this worker at most once and only with the right digest."""
    key = (name, sha256)
    if key not in _LOADED:
        path = SparkFiles.get(name)
        _checked(path, sha256)
        _LOADED[key] = load(path)
    return _LOADED[key]


def inpaint(photos: DataFrame, path: str, sha256: str, load: Callable[[str], Callable], leaves_imprint: Callable) -> DataFrame:
    """(path, rgb, way, error, model_sha256) of photos (path, height, width, rgb, mask, rescue_mask; masks as bytes 0 or 1).

    path: the model's file, on the driver. load(file) gives a function of (image, mask, optimised);
    leaves_imprint(before, after, row) says whether the date can still be made out.
    """
    _checked(path, sha256)
    photos.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def one(model, row) -> tuple:
        image = np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)
        masks = [None if m is None else np.frombuffer(m, np.uint8).reshape(row.height, row.width) > 0 for m in (row.mask, row.rescue_mask)]
        if masks[0] is None:
            raise ValueError("no mask")

        def fill(image, mask, optimised):
            if mask is None:
                raise ValueError("no rescue mask")
            filled = model(image, mask, optimised)
            return np.where(mask[..., None], filled, image).astype(np.uint8)  # a model changes nothing outside the mask

        result, way = with_model_fallback(image, masks[0], masks[1], fill, lambda after: leaves_imprint(image, after, row))
        return result.tobytes(), way

    def run(batches):
        model = loaded(name, sha256, load)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                row = SimpleNamespace(**batch.slice(k, 1).to_pylist()[0])
                try:
                    rgb, way = one(model, row)
                    rows.append((row.path, rgb, way, None, sha256))
                except Exception as error:
                    rows.append((row.path, None, None, f"{type(error).__name__}: {error}", sha256))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(c, pa.binary() if c == "rgb" else pa.string()) for c in names]))

    return photos.select("path", "height", "width", "rgb", "mask", "rescue_mask").mapInArrow(run, OUT)
