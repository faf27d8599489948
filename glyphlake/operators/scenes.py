"""Synthetic dated scenes as sparse pixel tables, one per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the fixture scene: its size, and the glyphs' left edges, rows and width.
HEIGHT, WIDTH, BACKGROUND = 1152, 864, 112
GLYPH_LEFT = (500, 517, 549, 566, 598, 615, 632, 649)
TOP, BOTTOM, GLYPH_WIDTH = 1020, 1045, 12
ORANGE, BLACK = (250, 95, 5), (4, 4, 4)
#: Orange things that are no date: top, left and side of a square in the upper part, and of one in the search window.
SQUARES = ((100, 200, 30), (800, 400, 9))


def dealt(keys: DataFrame) -> DataFrame:
    """The keys, each once, dealt out by photo. What is derived from them lies in its photo's task, so grouping it by photo needs no shuffle of pixels."""
    return keys.select("photo_id").repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "photo_id").distinct()


def _glyph_boxes() -> str:
    """The glyphs of a photo_id as an array of (i, x0, y0, y1); some scenes lack one or have a low one."""
    box = (
        f"named_struct('i', i, 'x0', l + cast(photo_id % 5 as int), 'y0', {TOP} + cast((i + photo_id) % 3 as int), "
        f"'y1', case when photo_id % 11 = 5 and i = 6 then {TOP} + cast((i + photo_id) % 3 as int) + 9 else {BOTTOM} - cast((i * photo_id) % 4 as int) end)"
    )
    return f"filter(transform(array{GLYPH_LEFT}, (l, i) -> {box}), g -> not (photo_id % 7 = 6 and g.i = 3))"


def glyphs(keys: DataFrame) -> DataFrame:
    """(photo_id, i, x0, y0, y1) of the glyphs of each photo_id."""
    return keys.selectExpr("photo_id", f"inline({_glyph_boxes()})")


def scene_pixels(keys: DataFrame) -> DataFrame:
    """(photo_id, y, x, r, g, b): the glyphs in orange and their black surroundings; all else is background.

    A row of a photo is drawn at once, from the boxes that cross it, so pixels of several boxes come once.
    """
    box = lambda x0, y0, x1, y1, room: f"named_struct('x0', {x0}, 'y0', {y0}, 'x1', {x1}, 'y1', {y1}, 'room', {room})"
    side = ", ".join(box(left, top, left + n - 1, top + n - 1, 0) for top, left, n in SQUARES)
    boxes = f"concat(transform({_glyph_boxes()}, g -> {box('g.x0', 'g.y0', f'g.x0 + {GLYPH_WIDTH - 1}', 'g.y1', 4)}), filter(array({side}), s -> photo_id % 4 = 1))"
    rows = dealt(keys).selectExpr("photo_id", f"{boxes} as boxes").selectExpr("photo_id", "boxes", "explode(array_distinct(flatten(transform(boxes, c -> sequence(c.y0 - c.room, c.y1 + c.room))))) as y")
    rows = rows.selectExpr("photo_id", "y", "filter(boxes, c -> y between c.y0 - c.room and c.y1 + c.room) as boxes")
    rows = rows.selectExpr("photo_id", "y", "boxes", "array_distinct(flatten(transform(filter(boxes, c -> y between c.y0 and c.y1), c -> sequence(c.x0, c.x1)))) as inner")
    rows = rows.selectExpr("photo_id", "y", "inner", "array_except(flatten(transform(boxes, c -> sequence(c.x0 - c.room, c.x1 + c.room))), inner) as outer")
    pixels = rows.selectExpr("photo_id", "y", "size(inner) as n", "posexplode(concat(inner, outer)) as (k, x)")
    return pixels.select("photo_id", "y", "x", *[F.when(F.col("k") < F.col("n"), o).otherwise(k).cast("int").alias(c) for c, o, k in zip("rgb", ORANGE, BLACK)])
