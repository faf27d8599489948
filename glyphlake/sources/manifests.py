"""Manifest and report documents, and the base64 line stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import claim

RESULT = "status string, source string, output string, mask string, report string, error string, traceback string, audit_passed boolean"
MANIFEST = f"created_at timestamp, method string, total int, succeeded int, failed int, canceled int, results array<struct<{', '.join(c.replace(' ', ':', 1) for c in RESULT.split(', ')) }>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per result of all manifests at a path; each manifest is one JSON document."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.col("method"), F.explode("results").alias("r")).select("method", "r.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line per report, nulls included; an existing folder is an error, never overwritten."""
    reports.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """A batch's result rows as JSON lines, in parts: a batch of any size has no single manifest task."""
    results.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def decode_base64_lines(lines: DataFrame, stream: str = "stream", number: str = "number", line: str = "line", end: str = "__END__") -> DataFrame:
    """(stream, number, bytes, valid) of the lines before each stream's end mark; blank lines are skipped."""
    ends = lines.where(F.trim(F.col(line)) == end).groupBy(stream).agg(F.min(number).alias("_end"))
    before = lines.join(ends, stream, "left").where(F.col("_end").isNull() | (F.col(number) < F.col("_end"))).where(F.trim(F.col(line)) != "")
    data = F.try_to_binary(F.trim(F.col(line)), F.lit("base64"))
    return before.select(stream, number, data.alias("bytes"), data.isNotNull().alias("valid"))


def read_reports(spark: SparkSession, results: DataFrame, folder: str, schema: str) -> DataFrame:
    """Results with the reports that lie in a folder as JSON files, by file name; a result without its file stops the job."""
    from glyphlake.operators.batch import with_reports

    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    reports = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("_name", name(F.input_file_name()))
    return with_reports(results.withColumn("_name", name(F.col("report"))), reports, "_name").drop("_name")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_manifest(results: DataFrame, path: str, method: str) -> None:
    """A batch's manifest: a folder with ``head`` (one document of method, time and counts) and ``results`` (rows in parts).

    Both are written beside the path and moved there at once, so a reader finds a whole manifest or none; an
    existing one is never overwritten.
    """
    from glyphlake.operators.batch import manifest_counts

    spark = results.sparkSession
    place, files = _files(spark, path)
    if files.exists(place):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part"
    part_place, _ = _files(spark, part)
    files.delete(part_place, True)
    write_results(results, f"{part}/results")
    rows = spark.read.schema(results.schema).json(f"{part}/results")
    head = manifest_counts(rows).select(F.current_timestamp().alias("created_at"), F.lit(method).alias("method"), "*")
    head.coalesce(1).write.option("ignoreNullFields", "false").json(f"{part}/head")
    if not files.rename(part_place, place):
        raise FileExistsError(path)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(head, results) of a manifest that ``write_manifest`` wrote."""
    return spark.read.schema("created_at timestamp, method string, total long, succeeded long, failed long, canceled long").json(f"{path}/head"), spark.read.schema(RESULT).json(f"{path}/results")


def write_audit(reports: DataFrame, path: str) -> bool:
    """Audit rows with their errors in parts under ``rows``, totals under ``head``; returns whether every report passed."""
    from glyphlake.operators.batch import audit_errors

    audited = reports.withColumn("errors", audit_errors()).withColumn("status", F.when(F.size("errors") == 0, "passed").otherwise("failed"))
    audited.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/rows")
    rows = reports.sparkSession.read.schema(audited.schema).json(f"{path}/rows")
    head = rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed"), F.array_sort(F.collect_set("model_sha256")).alias("model_sha256_values"))
    head.write.option("ignoreNullFields", "false").json(f"{path}/head")
    return rows.where("status = 'failed'").isEmpty()


def new_run_folder(spark: SparkSession, root: str, name: str) -> str:
    """Make ``root/name``, or the first free one of ``name 2``, ``name 3`` and so on, and return it."""
    n = 1
    while not claim(spark, path := f"{root.rstrip('/')}/{name}" + (f" {n}" if n > 1 else "")):
        n += 1
    return path


def whole_streams(decoded: DataFrame, expected: DataFrame, stream: str = "stream") -> DataFrame:
    """The rows of streams without a broken line whose bytes are as many as expected says (stream, bytes); others are dropped whole."""
    found = decoded.groupBy(stream).agg(F.sum(F.octet_length("bytes")).alias("_found"), F.bool_and("valid").alias("_valid"))
    whole = found.join(expected.select(stream, F.col("bytes").alias("_wanted")), stream).where("_valid and _found = _wanted").select(stream)
    return decoded.join(whole, stream, "left_semi")
