"""Photos offered batch by batch: the first of each path is taken, all others are counted by reason, each batch once.

Which paths were taken is keyed state: a key for each path but for case, so a batch costs what it holds,
however many paths came before. What a batch decided goes to a log: its rows in parts, and a marker with its counts
that is put in place at once. A batch whose marker is there is passed over when it comes again, so rows
and counts are there once. The log's limit on taken photos (a limit of the feature) holds over all batches.

Defined cases: a null path is unsupported; of equal paths in one batch that with the smallest order is taken; what
came over the limit stays known, so it is ``repeated`` when offered again; an empty batch counts nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from glyphlake.operators.batch import EXTENSIONS
from glyphlake.operators.ranking import global_index
from glyphlake.sources.photo_batch import located, publish, read_text

from .lines import with_state_store

REASONS = ("unsupported", "repeated", "over_limit", "accepted")
ROWS = "path string, at long, reason string"


class FirstOfPath(StatefulProcessor):
    def init(self, handle) -> None:
        self.taken = handle.getValueState("taken", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.taken.exists(), None
        for pdf in rows:
            pdf = pdf[["path", "at"]].sort_values(["at", "path"], kind="stable")
            if not known:
                # the smallest so far is held back, all others of the key are repeats
                first = tuple(pdf.iloc[0])
                best, other = (first, best) if best is None or (first[1], first[0]) < (best[1], best[0]) else (best, first)
                pdf = pd.concat([pdf.iloc[1:], pd.DataFrame([other] if other else [], columns=["path", "at"])])
            if len(pdf):
                yield pdf.assign(reason="repeated").astype({"at": "int64"})
        if best is not None:
            self.taken.update((int(best[1]),))
            yield pd.DataFrame([(best[0], int(best[1]), "accepted")], columns=["path", "at", "reason"])

    def close(self) -> None:
        pass


def admissions(offered: DataFrame, path: str = "path", order: str = "at") -> DataFrame:
    """(path, at, reason) of a stream or table of offered files: unsupported, repeated or accepted."""
    with_state_store(offered.sparkSession)
    rows = offered.select(F.col(path).cast("string").alias("path"), F.col(order).cast("long").alias("at"))
    supported = F.coalesce(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*EXTENSIONS), F.lit(False))
    keyed = rows.where(supported).withColumn("key", F.lower("path")).groupBy("key")
    taken = keyed.transformWithStateInPandas(FirstOfPath(), ROWS, "append", "none")
    return taken.unionByName(rows.where(~supported).withColumn("reason", F.lit("unsupported")))


class AdmissionLog:
    """The batches' decisions at a path; ``write`` is what foreachBatch calls."""

    def __init__(self, path: str, most: int = 500):
        self.path, self.most = path.rstrip("/"), most

    def markers(self) -> list[dict]:
        from pyarrow import fs as pafs

        files, root = located(self.path)
        found = files.get_file_info(pafs.FileSelector(f"{root}/_batches", allow_not_found=True))
        return [json.loads(read_text(files, f.path)) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".json")]

    def write(self, decided: DataFrame, batch: int) -> None:
        """Log a batch of ``admissions``; changes nothing where the batch is in the log."""
        spark = decided.sparkSession
        before = self.markers()
        if any(m["batch"] == batch for m in before):
            decided.write.format("noop").mode("overwrite").save()  # the query's state is still to be carried on
            return
        part = f"parts/{batch:010d}-{uuid.uuid4().hex}"
        staged = f"{self.path}/staged/{batch:010d}-{uuid.uuid4().hex}"
        decided.write.parquet(staged)  # the state is asked once; all that follows reads this
        rows = spark.read.schema(decided.schema).parquet(staged)
        room = max(0, self.most - sum(m["counts"]["accepted"] for m in before))
        ranked = global_index(rows.where("reason = 'accepted'"), F.expr("at div 4096"), ["at", "path"], "rank")
        limited = ranked.withColumn("reason", F.when(F.col("rank") < room, "accepted").otherwise("over_limit")).drop("rank")
        rows.where("reason <> 'accepted'").unionByName(limited).write.parquet(f"{self.path}/{part}")
        counts = {r["reason"]: r["count"] for r in spark.read.schema(decided.schema).parquet(f"{self.path}/{part}").groupBy("reason").count().collect()}
        files, root = located(self.path)
        publish(files, f"{root}/_batches/{batch:010d}.json", json.dumps({"batch": batch, "part": part, "counts": {r: counts.get(r, 0) for r in REASONS}}))
        files.delete_dir(f"{root}/staged/{staged.rsplit('/', 1)[1]}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """(path, at, reason) of all logged batches."""
        parts = [f"{self.path}/{m['part']}" for m in self.markers()]
        return spark.read.schema(ROWS).parquet(*parts) if parts else spark.createDataFrame([], ROWS)

    def totals(self) -> dict[str, int]:
        """offered files and how many of each reason, over all logged batches."""
        counts = [m["counts"] for m in self.markers()]
        total = {r: sum(c[r] for c in counts) for r in REASONS}
        return {"offered": sum(total.values()), **total}


def admit(stream: DataFrame, log: AdmissionLog, checkpoint: str, path: str = "path", order: str = "at"):
    """Start the query that decides about a stream's files and logs each batch once; all that is there is taken, then it stops."""
    decided = admissions(stream, path, order)
    return decided.writeStream.foreachBatch(log.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
