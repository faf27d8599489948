"""Pixel predicates, offset tables, morphology and set operations on sparse pixel tables (photo_id, y, x).

Morphology and set operations work on words, WORD pixels of a row as the bits of one number: photo_id, y, w, bits;
bit k of word w is the pixel at WORD * w + k. Grouping by photo, row and word needs no shuffle where a table is dealt out by
photo. A pixel table's size says little to Spark's planner, as most are exploded from few rows, so none is ever broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["photo_id", "y", "x"]
#: Pixels of a word; words are bigints, so that sums and shifts of twice as many bits have room.
WORD = 32
ALL = (1 << WORD) - 1
PLACE = ["photo_id", "y", "w"]


def is_orange() -> Column:
    """The colour of the camera's date; channels are widened before they are subtracted."""
    r, g, b = (F.col(c).cast("int") for c in "rgb")
    return (r >= 210) & g.between(55, 140) & (b <= 40) & (r - g >= 90) & (g - b >= 35)


def in_search_window(height, width) -> Column:
    """The lower right part of the photo, where the camera prints its date; sizes are numbers or names of columns."""
    return F.expr(f"y >= cast(0.68D * {height} as int) and x >= cast(0.38D * {width} as int)")


def orange_core(pixels: DataFrame) -> DataFrame:
    return pixels.where(is_orange()).select(*KEY)


def disk(radius: float) -> list[tuple[int, int]]:
    """Offsets within a Euclidean radius."""
    n = math.ceil(radius)
    return [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dy * dy + dx * dx <= radius * radius]


def diamond(steps: int) -> list[tuple[int, int]]:
    """Offsets within so many steps along the axes."""
    return [(dy, dx) for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1) if abs(dy) + abs(dx) <= steps]


SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def shifted(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every pixel at every offset; the offsets are a literal array, not a join."""
    rows = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return pixels.select(*KEY, F.explode(rows).alias("o")).select("photo_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))


def words(pixels: DataFrame, *more: str) -> DataFrame:
    """(photo_id, further columns that are equal in a photo, y, w, bits) of the pixels."""
    return pixels.groupBy("photo_id", *more, "y", F.expr("shiftright(x, 5)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 31 as int)))").alias("bits"))


def from_words(found: DataFrame, *more: str) -> DataFrame:
    """The pixels of words, each once."""
    bit = found.select("photo_id", *more, "y", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("k")).where("shiftright(bits, k) & 1 = 1")
    return bit.select("photo_id", "y", F.expr(f"w * {WORD} + k").alias("x"), *more)


def runs(pixels: DataFrame, *more: str) -> DataFrame:
    """(photo_id, y, l, r): stretches of neighbouring pixels in a row, cut where words end; bounds inclusive."""
    start = words(pixels, *more).select("*", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("k")).where("shiftright(bits & ~shiftleft(bits, 1), k) & 1 = 1")
    # the ones from bit k on: adding 1 to what stands there turns them and the zero behind
    rest = start.withColumn("_v", F.expr("shiftright(bits, k)")).withColumn("_n", F.expr("bit_count(_v ^ (_v + 1)) - 1"))
    return rest.select("photo_id", *more, "y", F.expr(f"w * {WORD} + k").alias("l"), F.expr(f"w * {WORD} + k + _n - 1").alias("r"))


def span_words(spans: DataFrame, height: int, width: int, *more: str) -> DataFrame:
    """The words of spans (photo_id, y, l, r) inside the photo; spans may overlap."""
    inside = spans.where(F.col("y").between(0, height - 1)).select("photo_id", *more, "y", F.greatest(F.lit(0), "l").alias("l"), F.least(F.lit(width - 1), "r").alias("r")).where("l <= r")
    cut = inside.select("*", F.explode(F.sequence(F.expr("shiftright(l, 5)"), F.expr("shiftright(r, 5)"))).alias("w"))
    bits = f"shiftleft(1L, cast(least(r - w * {WORD}, {WORD - 1}) as int) + 1) - shiftleft(1L, cast(greatest(l - w * {WORD}, 0) as int))"
    return cut.groupBy("photo_id", *more, "y", "w").agg(F.expr(f"bit_or({bits})").alias("bits"))


def from_spans(spans: DataFrame, height: int, width: int, *more: str) -> DataFrame:
    """The pixels of spans (photo_id, y, l, r) inside the photo, each once."""
    return from_words(span_words(spans, height, width, *more), *more)


def dilate(pixels: DataFrame, offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Dilation by offsets whose rows have no holes, as disks, diamonds and squares: stretches grow, not pixels."""
    rows = {dy: sorted(dx for y, dx in offsets if y == dy) for dy, _ in offsets}
    if any(dx[-1] - dx[0] + 1 != len(dx) for dx in rows.values()):
        raise ValueError("offsets with holes in a row")
    grown = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx[0]).alias("lo"), F.lit(dx[-1]).alias("hi")) for dy, dx in rows.items()])
    spans = runs(pixels).select("*", F.explode(grown).alias("o")).selectExpr("photo_id", "y + o.dy as y", "l + o.lo as l", "r + o.hi as r")
    return from_spans(spans, height, width)


def dilate_by_radius(core: DataFrame, height: int, width: int) -> DataFrame:
    """Dilate each photo by its own disk: (photo_id, y, x, radius).

    core: pixels (photo_id, y, x) or runs (photo_id, y, l, r) with a column radius of whole numbers, one per photo.
    """
    pieces = core if "l" in core.columns else runs(core, "radius")
    spans = pieces.selectExpr("*", "explode(sequence(-radius, radius)) as dy").withColumn("half", F.expr("cast(floor(sqrt(cast(radius * radius - dy * dy as double)) + 1e-9D) as int)"))
    return from_spans(spans.selectExpr("photo_id", "radius", "y + dy as y", "l - half as l", "r + half as r"), height, width, "radius")


def _eroded(pixels: DataFrame) -> DataFrame:
    """(photo_id, y, w, own, inner): words of the pixels, and of those of them whose whole 3 x 3 square is set."""
    # a word with its neighbours' nearest bits on both sides: bit k + 1 is the word's bit k
    side = f"case d when 0 then shiftleft(bits, 1) when 1 then shiftright(bits, {WORD - 1}) else shiftleft(bits & 1, {WORD + 1}) end"
    wide = words(pixels).selectExpr("photo_id", "y", "w", "bits", "explode(array(-1, 0, 1)) as d").selectExpr("photo_id", "y", "w + d as w", f"{side} as bits").groupBy(*PLACE).agg(F.bit_or("bits").alias("wide"))
    rows = wide.selectExpr("photo_id", "y", "w", f"shiftright(wide, 1) & {ALL} as own", f"wide & shiftright(wide, 1) & shiftright(wide, 2) & {ALL} as level").where("own <> 0")
    near = rows.selectExpr("photo_id", "y", "w", "own", "level", "explode(array(-1, 0, 1)) as d").selectExpr("photo_id", "y + d as y", "w", "if(d = 0, own, null) as own", "level")
    inner = F.when(F.count("*") == 3, F.bit_and("level")).otherwise(F.lit(0).cast("long"))
    return near.groupBy(*PLACE).agg(F.max("own").alias("own"), inner.alias("inner"))


def erode(pixels: DataFrame) -> DataFrame:
    """Pixels whose whole 3 x 3 square is set; what lies outside of the photo is not set."""
    return from_words(_eroded(pixels).select(*PLACE, F.col("inner").alias("bits")).where("bits <> 0"))


def inner_boundary(mask: DataFrame) -> DataFrame:
    return from_words(_eroded(mask).where("own is not null").selectExpr(*PLACE, "own & ~inner as bits").where("bits <> 0"))


def bounding_box(mask: DataFrame) -> DataFrame:
    """(photo_id, pixels, x0, y0, x1, y1), bounds inclusive; photos without a pixel have no row."""
    return mask.groupBy("photo_id").agg(F.count("*").alias("pixels"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def differing(pairs: DataFrame) -> DataFrame:
    """Pixels of which any channel differs; pairs: (photo_id, y, x, r, g, b, r2, g2, b2), a colour of nulls for a missing pixel."""
    same = F.lit(True)
    for c in "rgb":
        same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
    return pairs.where(~same).select(*KEY)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pixels of which any channel differs; both tables have (photo_id, y, x, r, g, b)."""
    return differing(before.join(after.select(*KEY, *[F.col(c).alias(f"{c}2") for c in "rgb"]), KEY, "full"))


def word_pairs(one: DataFrame, other: DataFrame) -> DataFrame:
    """(photo_id, y, w, a, b): the words of two pixel tables next to each other, 0 for one without pixels there."""
    both = words(one).selectExpr(*PLACE, "bits as a", "0L as b").unionByName(words(other).selectExpr(*PLACE, "0L as a", "bits as b"))
    return both.groupBy(*PLACE).agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))


def outside(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels (photo_id, y, x) that aren't in the mask."""
    return from_words(word_pairs(pixels, mask).selectExpr(*PLACE, "a & ~b as bits").where("bits <> 0"))


def within(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels (photo_id, y, x) that are in the mask."""
    return from_words(word_pairs(pixels, mask).selectExpr(*PLACE, "a & b as bits").where("bits <> 0"))


def composite(source: DataFrame, generated: DataFrame, mask: DataFrame) -> DataFrame:
    """The generated colour inside the mask, the source's elsewhere."""
    inside = generated.join(mask.hint("merge"), KEY, "left_semi")
    return source.join(mask.hint("merge"), KEY, "left_anti").unionByName(inside)


def crop(pixels: DataFrame, boxes: DataFrame, padding: int, height: int, width: int) -> DataFrame:
    """Pixels in the padded bounding box of their photo."""
    b = boxes.selectExpr("photo_id", f"greatest(0, x0 - {padding}) as _x0", f"greatest(0, y0 - {padding}) as _y0", f"least({width - 1}, x1 + {padding}) as _x1", f"least({height - 1}, y1 + {padding}) as _y1")
    return pixels.join(b, "photo_id").where("x between _x0 and _x1 and y between _y0 and _y1").drop("_x0", "_y0", "_x1", "_y1")


def rescue_boxes(glyph_boxes: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Rounded, padded glyph boxes."""
    pad = max(2, int(round(radius * 0.35)))
    rows = glyph_boxes.selectExpr("photo_id", f"explode(sequence(y0 - {pad}, y1 + {pad})) as y", f"x0 - {pad} as l", f"x1 + {pad} as r")
    return dilate(from_spans(rows, height, width), disk(max(1.0, radius * 0.25)), height, width)


def rescue_mask(mask: DataFrame, glyph_boxes: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Rounded, padded glyph boxes and the mask itself."""
    return from_words(word_pairs(rescue_boxes(glyph_boxes, radius, height, width), mask).selectExpr(*PLACE, "a | b as bits"))
