"""Batch relations: safe names, unique output names, result rows and manifests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from glyphlake.sources.folders import written

from .free_numbers import free_numbers

EXTENSIONS = ("jpg", "jpeg", "png")
#: Device names that a file must not have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))]


@F.pandas_udf(StringType())
def composed(names: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no such function."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def stem(path: Column) -> Column:
    """File name without its last extension; a name that is only an extension is all stem."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def safe_stem(path: Column, normalise: bool = True, reserved: bool = True) -> Column:
    """A file's stem that any system takes as a name; reserved: device names get photo_ in front."""
    s = composed(stem(path)) if normalise else stem(path)
    s = F.btrim(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" ."))
    s = F.regexp_replace(s, r"\s+", " ")
    named = F.when(s == "", "photo")
    s = (named.when(F.upper(s).isin(RESERVED), F.concat(F.lit("photo_"), F.lower(s))) if reserved else named).otherwise(s)
    s = F.rtrim(F.substring(s, 1, 100), F.lit(" ."))
    return F.when(s == "", "photo").otherwise(s)


def output_names(files: DataFrame, path: str, order: str, normalise: bool = True, block: int = 4096, reserved: bool = True) -> DataFrame:
    """Add stem (unique but for case), output, mask and report paths; ``order`` is a whole number.

    In the given order each file takes its safe stem or the first free one of stem_2, stem_3, and so on (see
    ``free_numbers``). Ranks are counted in blocks of ``block`` orders. Every row stays: those of one order are
    numbered one after another, those without order last, and those without a path have no names.
    """
    columns = files.columns
    based = files.withColumn("_base", safe_stem(F.col(path), normalise, reserved)).withColumns({"key": F.lower("_base"), "at": F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1))})
    rows = written(based.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "_base", "key", "at"), "names")  # read several times
    numbers = free_numbers(rows.where("key is not null").select("key", "at"), block)
    same = lambda by: F.row_number().over(Window.partitionBy("key", "at").orderBy(by)).alias("same")
    joined = rows.select("*", same("_base")).join(numbers.select("*", same("number")).hint("merge"), ["key", "at", "same"], "left")
    named = joined.select("_row.*", F.expr("if(number = 1, _base, concat(_base, '_', number))").alias("stem"))
    return named.withColumns({
        "output": F.concat(F.lit("images/"), "stem", F.lit("_date_removed.png")),
        "mask": F.concat(F.lit("masks/"), "stem", F.lit("_timestamp_mask.png")),
        "report": F.concat(F.lit("reports/"), "stem", F.lit("_report.json")),
    })


def accepted_files(files: DataFrame, path: str, order: str, most: int = 500) -> DataFrame:
    """Supported files, the first of each path but for case, at most ``most`` (a limit of the feature)."""
    ok = files.where(F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*EXTENSIONS))
    first = ok.groupBy(F.lower(path).alias("_k")).agg(F.min_by(F.struct(*files.columns), F.col(order)).alias("r")).select("r.*")
    return first.orderBy(order).limit(most)


def rejected_files(files: DataFrame, path: str, order: str, most: int = 500) -> DataFrame:
    """One row of counts: offered, unsupported, repeated, over_limit and accepted files."""
    ok = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*EXTENSIONS)
    n = files.agg(F.count("*").alias("offered"), F.count_if(~ok).alias("unsupported"), F.countDistinct(F.when(ok, F.lower(path))).alias("distinct"))
    return n.selectExpr("offered", "unsupported", "offered - unsupported - distinct as repeated", f"greatest(0L, distinct - {most}) as over_limit", f"least(distinct, {most}L) as accepted")


def with_reports(results: DataFrame, reports: DataFrame, key: str = "report") -> DataFrame:
    """Results with their report's columns; reading a column of a report that doesn't exist stops the job with its name."""
    joined = results.join(reports.withColumn("_found", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("no report at "), F.coalesce(F.col(key), F.lit("an unnamed path"))))
    return joined.withColumns({c: F.when(F.col("_found"), F.col(c)).otherwise(lost) for c in reports.columns if c != key}).drop("_found")


def outcomes(succeeded: DataFrame, failed: DataFrame, canceled: DataFrame) -> DataFrame:
    """The rows of all three outcomes with a status; columns that an outcome lacks are null."""
    parts = [df.withColumn("status", F.lit(name)) for df, name in ((succeeded, "succeeded"), (failed, "failed"), (canceled, "canceled"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def merged_reports(*parts: Column) -> Column:
    """Report parts (maps of strings) as one; of a key in several parts the last one's value counts."""
    without = lambda out, part: F.map_filter(out, lambda k, v: ~F.map_contains_key(part, k))
    out = parts[0]
    for part in parts[1:]:
        out = F.map_concat(without(out, part), part)
    return out


def byte_size(n: Column) -> Column:
    """A file size as shown: whole KB (at least 1) below a mebibyte, else MB with one digit."""
    return F.when(n < 1048576, F.format_string("%d KB", F.greatest(F.lit(1), F.rint(n / 1024).cast("long")))).otherwise(F.format_string("%.1f MB", n / 1048576))


def run_folder(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HHmmss")


def utc_iso(at: Column) -> Column:
    """A UTC timestamp in ISO form, in microseconds where there are any; the session's zone must be UTC."""
    return F.concat(F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("+00:00"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of a colour of bytes."""
    linear = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, 2.4))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_ratio(a: Column, b: Column) -> Column:
    """Contrast of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def review_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A glyph row's box with room around it for review, inside the photo: struct of x0, y0, x1, y1 (inclusive)."""
    wide = F.greatest(F.lit(30), F.rint((x1 - x0 + 1) * 0.08).cast("int"))
    high = F.greatest(F.lit(24), F.rint((y1 - y0 + 1) * 0.55).cast("int"))
    return F.struct(F.greatest(F.lit(0), x0 - wide).alias("x0"), F.greatest(F.lit(0), y0 - high).alias("y0"), F.least(F.lit(width - 1), x1 + wide).alias("x1"), F.least(F.lit(height - 1), y1 + high).alias("y1"))


def passes_audit() -> Column:
    """The gate of a report: pixels outside exact, date not found again, imprint checked and absent; missing fields don't pass.

    Orange left inside the mask is reported but is no gate.
    """
    no = F.lit(False)
    return (
        F.coalesce("outside_mask_rgb_exact", no) & ~F.coalesce("timestamp_sequence_redetected", F.lit(True))
        & F.coalesce("timestamp_imprint_check_applied", no) & ~F.coalesce("timestamp_imprint_detected", F.lit(True))
    )


def manifest_counts(results: DataFrame, *by: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.groupBy(*by).agg(F.count("*").alias("total"), count("succeeded"), count("failed"), count("canceled"))


def audit_errors() -> Column:
    """What is wrong with a report, in a fixed order."""
    rules = [
        (~F.coalesce("verified", F.lit(False)), "verify"),
        (F.coalesce("changed_pixels_outside_mask", F.lit(1)) != 0, "outside"),
        (~F.coalesce("outside_mask_rgb_exact", F.lit(False)), "flag"),
        (F.coalesce("timestamp_sequence_redetected", F.lit(True)), "redetected"),
        (~F.coalesce("timestamp_imprint_check_applied", F.lit(False)), "check_missing"),
        (F.coalesce("timestamp_imprint_detected", F.lit(True)), "imprint"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def with_model_fallback(image, mask, rescue_mask, model, leaves_imprint) -> tuple[object, str]:
    """Inpaint with a model; where its result still shows the date's outline, once more plainly, then with the rescue mask.

    model(image, mask, optimised) gives an image, leaves_imprint(image) says whether the outline is still
    there. Returns the image and the name of the way that worked; raises where none did.
    """
    for used, optimised, name in ((mask, True, "model"), (mask, False, "model"), (rescue_mask, False, "model_rescue")):
        result = model(image, used, optimised)
        if not leaves_imprint(result):
            return result, name
    raise RuntimeError("the date's outline is still visible")
