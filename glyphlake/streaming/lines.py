"""Base64 line streams as keyed state: open streams go on from batch to batch until their end mark.

Rows are lines (stream, number, line, expected): numbers count a stream's lines from 0 on without a gap; expected
is the number of bytes that the stream should have, null where a line doesn't say (the last line up to the end that does counts). Lines may come in any batch and any
order; what came too early waits in the state. For each stream the state holds its next line, bytes and payload
lines so far, and the number it should reach.

A line is stripped; blank ones are skipped, the end mark closes the stream, and any other must be strict base64.
Each payload line is passed on at once (with the offset of its bytes), so no state or task holds a stream's
payload. A closing row follows when a stream ends: ``whole``, ``broken`` at the first line that isn't base64, or
``short`` where the bytes differ from what was expected. Payloads of streams that didn't close as whole are
dropped by ``whole_payloads``, over what was written. Lines behind the closing one are ignored.

The same operator runs over streams and over tables; any split of a table into batches gives the same rows.

Defined cases: rows without a stream or a number are left out, a null line is a blank one; of lines with the same
number the first to come counts (in one batch the smallest by text); a stream without an end mark stays open and has no closing row.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

END = "__END__"
OUT = "stream string, number long, offset long, bytes binary, status string, total long, lines long"
STATE = "next long, bytes long, lines long, expected long, status string, waiting long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def payload(line: str | None) -> bytes | None:
    """The bytes of a line; None where it isn't base64. Blank lines and the end mark aren't payload."""
    try:
        return base64.b64decode((line or "").strip(), validate=True)
    except (binascii.Error, ValueError):
        return None


class LineStreams(StatefulProcessor):
    def init(self, handle) -> None:
        self.state = handle.getValueState("stream", STATE)
        self.early = handle.getMapState("early", "number long", "line string, expected long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # waiting: how many early lines there are, so that streams in order never ask for one
        at, size, lines, expected, status, waiting = self.state.get() if self.state.exists() else (0, 0, 0, None, None, 0)
        if status:
            return
        out: list[tuple] = []
        for pdf in rows:
            pdf = pdf.sort_values(["number", "line"], kind="stable", na_position="first")
            for number, line, wanted in zip(pdf["number"].tolist(), pdf["line"].tolist(), pdf["expected"].tolist()):
                new = ("" if pd.isna(line) else line, None if pd.isna(wanted) else int(wanted))
                if number > at and not status and not self.early.containsKey((number,)):
                    self.early.updateValue((number,), new)
                    waiting += 1
                while number == at and new and not status:
                    text, wanted = new[0].strip(), new[1]
                    expected = wanted if wanted is not None else expected
                    if text == END:
                        status = "whole" if expected in (None, size) else "short"
                    elif text and (data := payload(text)) is None:
                        status = "broken"
                    elif text:
                        out.append((key[0], at, size, data, None, None, None))
                        size, lines = size + len(data), lines + 1
                    at, new = at + 1, None
                    if waiting and not status and self.early.containsKey((at,)):
                        number, new = at, self.early.getValue((at,))
                        self.early.removeKey((at,))
                        waiting -= 1
                if len(out) >= 1000:
                    yield self._frame(out)
                    out = []
        if status:
            out.append((key[0], at - 1, size, None, status, size, lines))
            if waiting:
                self.early.clear()
        self.state.update((at, size, lines, expected, status, waiting))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])
        return frame.astype({"number": "Int64", "offset": "Int64", "total": "Int64", "lines": "Int64"})

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Keyed state needs this store; naming the session's streams starts what finds a store's tasks, which tables need too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.streams  # noqa: B018


def line_streams(lines: DataFrame) -> DataFrame:
    """(stream, number, offset, bytes, status, total, lines): payload rows (status null) and closing rows of a stream or table of lines."""
    with_state_store(lines.sparkSession)
    expected = F.col("expected").cast("long") if "expected" in lines.columns else F.lit(None).cast("long")
    rows = lines.where("stream is not null and number is not null and number >= 0").select(F.col("stream").cast("string").alias("stream"), F.col("number").cast("long").alias("number"), "line", expected.alias("expected"))
    return rows.groupBy("stream").transformWithStateInPandas(LineStreams(), OUT, "append", "none")


def whole_payloads(rows: DataFrame) -> DataFrame:
    """(stream, number, offset, bytes) of the streams that closed as whole, from the written rows of ``line_streams``."""
    whole = rows.where("status = 'whole'").select("stream").distinct()
    return rows.where("status is null").join(whole, "stream", "left_semi").select("stream", "number", "offset", "bytes")
