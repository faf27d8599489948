"""Progress and cancelling of batches: waves of photos with a tag, observed counts, and rows for what wasn't done.

A batch is dealt into waves by the photos' keys. A wave is one job that writes to the transactional sink
(``sources.photo_batch``) as a batch of its own: it counts whole or not at all. After each wave an event says how far
the batch is, from counts observed while the wave was written. ``cancel`` interrupts the jobs of the run's tag: the
running wave is aborted without a trace, finished waves stay, and ``finish`` gives every photo without a result a row
``canceled``. A run that was lost goes on from its folder: waves that are there aren't done again.

For streams ``ProgressLog`` listens to queries and turns their observed counts into the same events.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from glyphlake.sources import photo_batch

COUNTS = ("succeeded", "failed", "canceled")


def observed_counts(rows: DataFrame, name: str | Observation) -> DataFrame:
    """The rows, with the number of each status observed as they pass."""
    return rows.observe(name, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in COUNTS])


class BatchRun:
    """One batch of photos (a table with the key column) through ``work``, wave by wave, into a sink's folder.

    work turns a wave's photos into rows for the sink. on_progress gets a dict after each wave: wave, waves,
    completed and the counts of the wave's statuses.
    """

    def __init__(self, photos: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str = "path", waves: int = 16, method: str = "", on_progress: Callable[[dict], None] | None = None):
        self.spark, self.photos, self.work, self.path, self.key, self.waves, self.method = photos.sparkSession, photos, work, path, key, waves, method
        self.on_progress = on_progress or (lambda event: None)
        self.tag = f"glyphlake-{uuid.uuid4().hex}"
        self.canceled = threading.Event()
        photo_batch.register(self.spark)

    def wave(self, k: int) -> DataFrame:
        return self.photos.where(F.pmod(F.xxhash64(self.key), F.lit(self.waves)) == k)

    def run(self) -> bool:
        """Do the waves that aren't there yet; False where the run was canceled before its end."""
        # sources are looked up in the thread's session, which a new thread hasn't
        self.spark._jvm.org.apache.spark.sql.SparkSession.setActiveSession(self.spark._jsparkSession)
        done = {m["batch"]: m for m in photo_batch.markers(self.path)}
        completed = sum(m["total"] for m in done.values())
        for k in range(self.waves):
            name = f"wave-{k:05d}-of-{self.waves:05d}"
            if self.canceled.is_set():
                return False
            if name in done:
                continue
            counts = Observation(f"{self.tag}-{k}")
            self.spark.addTag(self.tag)
            try:
                rows = observed_counts(self.work(self.wave(k)), counts)
                rows.write.format("photo_batch").mode("append").option("method", self.method).option("batch", name).save(self.path)
            except Exception:
                if self.canceled.is_set():
                    return False
                raise
            finally:
                self.spark.removeTag(self.tag)
            completed += counts.get["total"]
            self.on_progress({"wave": k, "waves": self.waves, "completed": completed, **{s: counts.get[s] for s in COUNTS}})
        return True

    def cancel(self) -> None:
        """Stop as soon as possible, from any thread; what is running is given up."""
        self.canceled.set()
        self.spark.interruptTag(self.tag)

    def finish(self) -> DataFrame:
        """The result rows of the batch: those of finished waves, and a canceled one for every other photo; these are written too."""
        results = self.spark.read.format("photo_batch").load(self.path)
        source = F.col(self.key).cast("string").alias("source")
        open_ = self.photos.select(source).join(results.select("source"), "source", "left_anti")
        text = F.lit(None).cast("string")
        rows = open_.select(text.alias("stem"), F.lit("canceled").alias("status"), "source", F.lit(None).cast("binary").alias("png"), text.alias("error"))
        rows.write.format("photo_batch").mode("append").option("method", self.method).option("batch", "wave-canceled").save(self.path)
        return self.spark.read.format("photo_batch").load(self.path)


class ProgressLog(StreamingQueryListener):
    """Events of streaming queries whose rows are observed as ``name`` by ``observed_counts``: batch, completed so far and counts."""

    def __init__(self, name: str, on_progress: Callable[[dict], None] | None = None):
        self.name, self.events, self.on_progress = name, [], on_progress or (lambda event: None)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and row["total"]:
            before = self.events[-1]["completed"] if self.events else 0
            self.events.append({"batch": event.progress.batchId, "completed": before + row["total"], **{s: row[s] for s in COUNTS}})
            self.on_progress(self.events[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
