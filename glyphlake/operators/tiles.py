"""Eight-connected components of photos of any size: labels inside tiles, joined across their borders.

A task labels one tile, whose pixels become runs with labels of the tile. Border pixels that touch one of another
tile link the two labels; rounds of joins bring every label to the smallest of its component. Only runs and the labels
at borders move, and no task holds a photo.

Defined cases: repeated pixels count once; rows without photo_id, y or x are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.sources.folders import written

from .components import label_pixels, runs
from .ranking import group_index

TILE = 256
RUNS = "photo_id long, ty int, tx int, y int, l int, r int, node long"


def tile_runs(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(photo_id, ty, tx, y, l, r, node): the runs of each tile; node tells a tile's component from all others of the photo."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["y", "x"]).sort_values(["y", "x"])
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        labels = label_pixels(y, x)
        _, first = runs(y, x)
        last = np.append(first[1:], len(y)) - 1
        row = pdf.iloc[0]
        node = (int(row["ty"]) << 40) + (int(row["tx"]) << 20) + labels[first]
        return pd.DataFrame({"photo_id": row["photo_id"], "ty": row["ty"], "tx": row["tx"], "y": y[first], "l": x[first], "r": x[last], "node": node})

    if not 1 <= tile <= 1024:
        raise ValueError("a tile has 1 to 1024 pixels a side")
    tiles = pixels.where("photo_id is not null and y is not null and x is not null").select("photo_id", "y", "x", F.expr(f"cast(y div {tile} as int) as ty"), F.expr(f"cast(x div {tile} as int) as tx"))
    return tiles.groupBy("photo_id", "ty", "tx").applyInPandas(label, RUNS)


def border_links(found: DataFrame, tile: int = TILE) -> DataFrame:
    """(photo_id, a, b): nodes of different tiles that touch, a > b, each pair once."""
    ends = F.array_distinct(F.array(F.col("l"), F.col("r")))
    edge_row = (F.col("y") % tile == 0) | (F.col("y") % tile == tile - 1)
    # all pixels of a tile's first and last row, and of other rows those in its first and last column
    x = F.when(edge_row, F.sequence("l", "r")).otherwise(F.filter(ends, lambda v: (v % tile == 0) | (v % tile == tile - 1)))
    border = found.select("photo_id", "y", "node", F.explode(x).alias("x"))
    # half of the eight neighbours; the others see it from their side
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reached = border.select("photo_id", F.col("node").alias("other"), F.explode(steps).alias("s"), "y", "x").selectExpr("photo_id", "other", "y + s.dy as y", "x + s.dx as x")
    met = border.join(reached, ["photo_id", "y", "x"]).where("node <> other")
    return met.select("photo_id", F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def joined_labels(links: DataFrame, most: int = 60) -> DataFrame:
    """(photo_id, node, root) of the linked nodes: the smallest node each is connected with, in rounds of joins.

    A round turns every node's links to larger nodes, then those to smaller ones, towards the smallest node beside it,
    until all links of a component lead to its smallest node. Each round is written to the folder of
    spark.checkpoint.dir.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("photo_id", "a", "b").cast("decimal(38,0)"))).first())

    links = written(links, "tiles")
    before = mark(links)
    for _ in range(most):
        if not before[0]:
            break
        both = links.toDF("photo_id", "u", "v").union(links.select("photo_id", "b", "a"))
        low = both.groupBy("photo_id", "u").agg(F.min("v").alias("m")).select("photo_id", "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, ["photo_id", "u"]).select("photo_id", F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("photo_id", "a").agg(F.min("b").alias("m"))
        turned = large.join(down, ["photo_id", "a"]).where("b <> m").select("photo_id", F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(turned.union(down.toDF("photo_id", "a", "b")).distinct(), "tiles")
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"labels did not settle in {most} rounds")
    return links.toDF("photo_id", "node", "root")


def component_runs(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(photo_id, y, l, r, label): runs with the labels that ``components.label_components`` gives, by first pixel from 1 on.

    A run that crosses a border is one row for each tile.
    """
    found = written(tile_runs(pixels, tile), "tiles")
    roots = joined_labels(border_links(found, tile))
    named = found.join(roots, ["photo_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("photo_id", "root").agg(F.min(F.struct("y", "l")).alias("f")).selectExpr("photo_id", "root", "f.y as fy", "f.l as fx")
    ranked = group_index(firsts, ["photo_id"], F.expr("fy div 64"), ["fy", "fx"], "rank").select("photo_id", "root", (F.col("rank") + 1).alias("label"))
    return named.join(ranked, ["photo_id", "root"]).select("photo_id", "y", "l", "r", "label")


def label_tiled(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(photo_id, y, x, label) of all pixels."""
    return component_runs(pixels, tile).select("photo_id", "y", F.explode(F.sequence("l", "r")).alias("x"), "label")


def tiled_component_table(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """As ``components.component_table``: area, bounds, size and centre of each component, from runs alone."""
    rows = component_runs(pixels, tile)
    c = rows.groupBy("photo_id", "label").agg(F.sum(F.col("r") - F.col("l") + 1).alias("area"), F.min("l").alias("x0"), F.min("y").alias("y0"), F.max("r").alias("x1"), F.max("y").alias("y1"))
    return c.selectExpr("*", "x1 - x0 + 1 as width", "y1 - y0 + 1 as height", "(x0 + x1) / 2.0D as cx", "(y0 + y1) / 2.0D as cy")
