"""A transactional sink and source of photo batches: ``format("photo_batch")``.

``df.write.format("photo_batch").mode("append").option("method", ...).save(path)`` takes a batch's rows (ROWS, by
name). Each task stages the files of its succeeded photos and its part of the result rows in a folder that only
this attempt has. The commit is one file, the batch's marker, which names the parts of the tasks that count
together with the batch's head; readers follow markers only. So a batch is there whole or not at all, whatever
tasks, attempts or drivers are lost, and a repeated attempt leaves no second copy. A failed job's folder is
deleted, and tasks of it that still run can't stage into it any more (tasks make no folder but their own). What
lost attempts of a committed job and lost drivers leave behind is never read and goes with ``sweep``.

A batch has an id (option ``batch``, by default a new one). A batch that is committed stays: writing its id again
changes nothing, so a job or a micro-batch can be run again. As a stream sink each micro-batch is a batch.

    path/_batches/<batch>.json                                               the marker
    path/parts/<batch>/<job>/<task>-<attempt>/{images,masks,reports}/...     files of succeeded photos
    path/parts/<batch>/<job>/<task>-<attempt>/results.jsonl                  result rows

``spark.read.format("photo_batch").load(path)`` gives the result rows with the files' paths, one partition for each
part; option ``files`` true adds the files' contents.

Defined cases: rows that didn't succeed have no files; succeeded rows without a stem or a png stop the job; null
masks and reports are left out; an empty table commits an empty batch; further columns are ignored. Stems must be
unique in a batch (``operators.batch.output_names`` makes them so); parts keep equal ones apart.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = "stem string, status string, source string, png binary, mask_png binary, report string, error string, traceback string, audit_passed boolean"
RESULTS = "batch string, status string, source string, output string, mask string, report string, error string, traceback string, audit_passed boolean"
CONTENTS = "png binary, mask_png binary, report_json string"
#: Where the three files of a photo go and how they are named.
FILES = {"png": ("output", "images", "_date_removed.png"), "mask_png": ("mask", "masks", "_timestamp_mask.png"), "report": ("report", "reports", "_report.json")}
STATUSES = ("succeeded", "failed", "canceled")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    found, place = pafs.FileSystem.from_uri(path)
    return found, place.rstrip("/")


def read_text(files: pafs.FileSystem, place: str) -> str:
    with files.open_input_stream(place) as f:
        return f.readall().decode()


def publish(files: pafs.FileSystem, place: str, text: str) -> bool:
    """Put a file in place at once; False where one is there already.

    Exclusive on local disks (a hard link) and on file systems whose rename refuses an existing target.
    """
    folder = place.rsplit("/", 1)[0]
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as f:
        f.write(text.encode())
    try:
        if isinstance(files, pafs.LocalFileSystem):
            os.link(part, place)
            return True
        if files.get_file_info(place).type != pafs.FileType.NotFound:
            return False
        files.move(part, place)
        return True
    except FileExistsError:
        return False
    finally:
        if files.get_file_info(part).type != pafs.FileType.NotFound:
            files.delete_file(part)


def _drop(files: pafs.FileSystem, folder: str) -> None:
    if files.get_file_info(folder).type != pafs.FileType.NotFound:
        files.delete_dir(folder)


@dataclass
class Part(WriterCommitMessage):
    """What one task staged."""

    name: str
    bytes: int = 0
    counts: dict = field(default_factory=dict)


class Stager:
    """Staging, commit and abort of one job's parts at a path; made on the driver."""

    def __init__(self, path: str, method: str, batch: str):
        self.path, self.method = path, method
        self.job = f"{batch}/{uuid.uuid4().hex}"
        files, root = located(path)
        files.create_dir(f"{root}/parts/{self.job}", recursive=True)

    def stage(self, batches) -> Part:
        from pyspark import TaskContext

        files, root = located(self.path)
        part = Part(f"{self.job}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0, dict.fromkeys(STATUSES, 0))
        folder = f"{root}/parts/{part.name}"
        try:
            for place in ("", "/images", "/masks", "/reports"):
                files.create_dir(f"{folder}{place}", recursive=False)
            with files.open_output_stream(f"{folder}/results.jsonl") as out:
                for rows in batches:
                    for k in range(rows.num_rows):
                        row = rows.slice(k, 1).to_pylist()[0]
                        out.write((json.dumps(self._put(files, folder, row, part), ensure_ascii=False) + "\n").encode())
        except BaseException:
            _drop(files, folder)
            raise
        return part

    def _put(self, files: pafs.FileSystem, folder: str, row: dict, part: Part) -> dict:
        """Write a row's files; gives its result row, with paths from the part's folder on."""
        status = row["status"]
        if status not in STATUSES:
            raise ValueError(f"a row's status is {status!r}")
        out = {"status": status, "source": row["source"], "output": None, "mask": None, "report": None}
        if status == "succeeded":
            stem = row["stem"]
            if not stem or "/" in stem or row["png"] is None:
                raise ValueError(f"a succeeded photo without a file or with the stem {stem!r}: {row['source']}")
            for column, (key, kind, ending) in FILES.items():
                if (data := row.get(column)) is not None:
                    data = data.encode() if isinstance(data, str) else data
                    out[key] = f"{kind}/{stem}{ending}"
                    with files.open_output_stream(f"{folder}/{out[key]}") as f:
                        f.write(data)
                    part.bytes += len(data)
        part.counts[status] += 1
        return out | {"error": row.get("error"), "traceback": row.get("traceback"), "audit_passed": row.get("audit_passed")}

    def commit(self, batch: str, messages: list) -> bool:
        """Publish the parts as a batch by its marker; False (and nothing changes) where it was published before."""
        files, root = located(self.path)
        parts = [m for m in messages if m is not None]
        counts = {s: sum(p.counts[s] for p in parts) for s in STATUSES}
        head = {"batch": batch, "created_at": datetime.now(UTC).isoformat(), "method": self.method, "total": sum(counts.values()), **counts, "bytes": sum(p.bytes for p in parts)}
        if publish(files, f"{root}/_batches/{batch}.json", json.dumps(head | {"parts": [p.name for p in parts]})):
            return True
        self.forget(messages)
        return False

    def forget(self, messages: list) -> None:
        files, root = located(self.path)
        for p in messages:
            if p is not None:
                _drop(files, f"{root}/parts/{p.name}")

    def abort(self) -> None:
        files, root = located(self.path)
        _drop(files, f"{root}/parts/{self.job}")


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, stager: Stager, batch: str):
        self.stager, self.batch = stager, batch

    def write(self, iterator) -> Part:
        return self.stager.stage(iterator)

    def commit(self, messages) -> None:
        if not self.stager.commit(self.batch, messages):
            self.stager.abort()

    def abort(self, messages) -> None:
        self.stager.abort()


class StreamWriter(DataSourceStreamArrowWriter):
    """Micro-batches as batches; the ids of a query's batches are the same when one is run again."""

    def __init__(self, stager: Stager, name: str):
        self.stager, self.name = stager, name

    def write(self, iterator) -> Part:
        return self.stager.stage(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.stager.commit(f"{self.name}-{batchId:010d}", messages)

    def abort(self, messages, batchId: int) -> None:
        self.stager.forget(messages)


@dataclass
class PartOf(InputPartition):
    batch: str
    folder: str


class BatchReader(DataSourceReader):
    """The parts that markers name, each read by a task of its own."""

    def __init__(self, path: str, contents: bool):
        self.path, self.contents = path, contents

    def partitions(self) -> list[PartOf]:
        _, root = located(self.path)
        return [PartOf(m["batch"], f"{root}/parts/{name}") for m in markers(self.path) for name in m["parts"]]

    def read(self, partition: PartOf):
        files, _ = located(self.path)
        names = ["batch", "status", "source", "output", "mask", "report", "error", "traceback", "audit_passed"]
        schema = pa.schema([(c, pa.bool_() if c == "audit_passed" else pa.string()) for c in names])
        for c in ("png", "mask_png", "report_json") if self.contents else ():
            schema = schema.append(pa.field(c, pa.string() if c == "report_json" else pa.binary()))
        rows: list[dict] = []
        size = 0
        with files.open_input_file(f"{partition.folder}/results.jsonl") as f:
            for line in io.BufferedReader(f):
                row = json.loads(line) | {"batch": partition.batch}
                for key, column in (("output", "png"), ("mask", "mask_png"), ("report", "report_json")):
                    if row[key] is not None:
                        row[key] = f"{partition.folder}/{row[key]}"
                        if self.contents:
                            with files.open_input_stream(row[key]) as g:
                                row[column] = g.readall()
                            size += len(row[column])
                if row.get("report_json") is not None:
                    row["report_json"] = row["report_json"].decode()
                rows.append(row)
                if len(rows) >= 1000 or size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class PhotoBatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "photo_batch"

    def schema(self) -> str:
        return RESULTS + (f", {CONTENTS}" if self._contents() else "")

    def _contents(self) -> bool:
        return str(self.options.get("files", "false")).lower() == "true"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["path"], self._contents())

    def _stager(self, schema: StructType, overwrite: bool, batch: str) -> Stager:
        if overwrite:
            raise ValueError("batches are never overwritten; use mode append")
        missing = {"stem", "status", "source", "png"} - set(schema.names)
        if missing:
            raise ValueError(f"a photo batch needs the columns {', '.join(sorted(missing))}")
        if not re.fullmatch(r"[\w-][\w.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return Stager(self.options["path"], self.options.get("method", ""), batch)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        batch = self.options.get("batch") or uuid.uuid4().hex
        return BatchWriter(self._stager(schema, overwrite, batch), batch)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        name = self.options.get("batch") or "stream"
        return StreamWriter(self._stager(schema, overwrite, name), name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PhotoBatch)


def markers(path: str) -> list[dict]:
    """The heads of a path's batches with the names of their parts, by batch id."""
    files, root = located(path)
    found = files.get_file_info(pafs.FileSelector(f"{root}/_batches", allow_not_found=True))
    return [json.loads(read_text(files, f.path)) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".json")]


def batch_heads(spark: SparkSession, path: str) -> DataFrame:
    """(batch, created_at, method, total, succeeded, failed, canceled, bytes) of a path's batches, read by Spark from their markers."""
    schema = "batch string, created_at timestamp, method string, total long, succeeded long, failed long, canceled long, bytes long"
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/_batches")


def sweep(path: str, running: tuple[str, ...] = ()) -> list[str]:
    """Delete the staged parts that no marker names, but those of batches still running; gives their folders."""
    files, root = located(path)
    kept = {f"{root}/parts/{name}" for m in markers(path) for name in m["parts"]}
    inside = lambda folder: [f.path for f in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
    gone = [part for batch in inside(f"{root}/parts") if batch.rsplit("/", 1)[1] not in running for job in inside(batch) for part in inside(job) if part not in kept]
    for part in gone:
        files.delete_dir(part)
    return sorted(gone)


def batch_rows(processed: DataFrame, named: DataFrame, key: str = "path") -> DataFrame:
    """Rows for the sink from ``operators.process.process`` and the stems of ``operators.batch.output_names``, by path.

    The report of a succeeded photo holds every column but the files, nulls included.
    """
    facts = [c for c in processed.columns if c not in ("png", "mask_png")]
    report = F.when(F.col("status") == "succeeded", F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}))
    rows = processed.join(named.select(key, "stem"), key)
    return rows.select("stem", "status", F.col(key).alias("source"), "png", "mask_png", report.alias("report"), "error", F.lit(None).cast("string").alias("traceback"), (F.col("status") == "succeeded").alias("audit_passed"))
