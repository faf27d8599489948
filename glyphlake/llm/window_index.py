"""Substring deduplication over a log-structured index of window fingerprints.

The index holds sorted, immutable runs of fingerprints of the texts seen so far, with the texts
themselves beside them. Fingerprints are content-defined: of all 25-word windows inside a 50-word window
the one with the smallest hash, so equal 50-word windows always share theirs, and about one word in
thirteen gets one. A new batch is merge-joined with the runs (and itself) on the fingerprints; only around
shared ones are 50-word windows formed, from the new and the old texts, and verified: the first hash finds
equal windows, a second one of other tables confirms them (128 bits in all). The smallest id that starts a
window owns it; in every text with a larger id its words go. The batch's fingerprints then become a run,
and more than ``fanout`` runs are compacted into one. Runs and what is known of each text are immutable tables in
the index's folder; a later job opens them there.

Equal texts are settled first: all but the one with the smallest id lose everything (if they hold a
window). Windows common to any number of texts cost a row per text, never a pair.

Defined cases: null, empty and short texts lose nothing and own nothing; a row without id loses nothing
and owns nothing; rows with the same id don't take words from each other; repeats inside one text stay;
an empty batch adds nothing. Batches must come with ids larger than all before for results that equal a
single batch's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import Scratch, small_batches, wanted_rows

WINDOW = 50
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TEXTS = "doc_id long, n_words long, digest long, sha string"


def _parts(batch: pa.RecordBatch, size: int = 256):
    """(first row, texts as bytes, words per text, word hashes of two seeds)."""
    texts = textops.blobs(batch.column("text"))
    for at in range(0, len(texts), size):
        some = texts[at : at + size]
        counts, hashes = textops.word_hashes(some, seeds=(1, 2))
        yield at, some, counts, hashes


def _least(words: np.ndarray, window: int) -> np.ndarray:
    """For each window by its first word: the smallest hash of the half windows in it."""
    half = window // 2
    grams = textops.window_hashes(words, half)
    if len(words) < window:
        return np.zeros(0, np.uint64)
    wide = window - half + 1
    # a sliding minimum by doubling
    span, low = 1, grams
    while span * 2 <= wide:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[: len(grams) - wide + 1], low[wide - span : wide - span + len(grams) - wide + 1])


def _whole(counts: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of joined texts lie inside one text, and in which."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if total < window:
        return np.zeros(0, bool), owner
    return owner[: total - window + 1] == owner[window - 1 :], owner


def _digests(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of each text's word sequence."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    rank = np.arange(len(words), dtype=np.uint64) - np.repeat(ends[:-1], counts).astype(np.uint64)
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(words ^ textops.mix(rank + np.uint64(1))), dtype=np.uint64)])
    return ((mixed[ends[1:]] - mixed[ends[:-1]]) ^ counts.astype(np.uint64)).view(np.int64)


def _sha(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _scan(window: int):
    """Rows (kind, doc_id, n, value, sha): 0, a text with its words and digest; 1, a fingerprint of a text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            known, numbers = np.array(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for at, texts, counts, (words, _) in _parts(batch):
                some = ids.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(texts), np.int8)), some, pa.array(counts), pa.array(_digests(words, counts)), pa.array([_sha(x) for x in texts])], ["kind", "doc_id", "n", "value", "sha"]
                )
                inside, owner = _whole(counts, len(words), window)
                if inside.any():
                    inside &= known[at + owner[: len(inside)]]
                    low, of = _least(words, window)[inside], owner[: len(inside)][inside]
                    change = np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])]) if len(low) else np.zeros(0, bool)
                    low, of = low[change], of[change]
                    k = len(low)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.array(numbers[at + of]), pa.nulls(k, pa.int64()), pa.array(low.view(np.int64)), pa.nulls(k, pa.string())], ["kind", "doc_id", "n", "value", "sha"])

    return run


def _windows(window: int):
    """Rows (h1, h2, doc_id, digest, pos) of the windows with a fingerprint in ``shared``, of texts with the wanted digest."""

    def run(batches):
        for batch in batches:
            ids, shared, digest = batch.column("doc_id").to_numpy(), batch.column("shared"), batch.column("digest").to_numpy()
            for at, texts, counts, (one, two) in _parts(batch, 64):
                inside, owner = _whole(counts, len(one), window)
                if not inside.any():
                    continue
                inside &= (_digests(one, counts) == digest[at : at + len(counts)])[owner[: len(inside)]]
                low = _least(one, window)
                starts = np.cumsum(counts) - counts
                take = np.zeros(len(low), bool)
                for k, n in enumerate(counts.tolist()):
                    if n >= window:
                        s = slice(starts[k], starts[k] + n - window + 1)
                        take[s] = np.isin(low[s].view(np.int64), shared[at + k].values.to_numpy())
                rows = np.flatnonzero(take & inside)
                h1, h2 = textops.window_hashes(one, window)[rows].view(np.int64), textops.window_hashes(two, window, seed=3)[rows].view(np.int64)
                doc, text, pos = ids[at + owner[rows]], digest[at + owner[rows]], (rows - starts[owner[rows]]).astype(np.int32)
                for b in range(0, len(rows), 1 << 16):
                    s = slice(b, b + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(h1[s]), pa.array(h2[s]), pa.array(doc[s]), pa.array(text[s]), pa.array(pos[s])], ["h1", "h2", "doc_id", "digest", "pos"])

    return run


def _strip(window: int, keep_text: bool):
    """Rows (doc_id, digest, n_removed, sha[, text]) of texts without the words of the windows at ``places``."""

    def run(batches):
        for batch in batches:
            texts = textops.blobs(batch.column("text"))
            counts, (hashes,) = textops.word_hashes(texts)
            fits = _digests(hashes, counts) == batch.column("digest").to_numpy()
            batch = batch.filter(pa.array(fits))  # rows may share an id
            removed, shas, kept = [], [], []
            for text, places in zip([x for x, fit in zip(texts, fits) if fit], batch.column("places")):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                places = places.values.to_numpy()
                np.add.at(gone, places, 1)
                np.add.at(gone, places + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                rest = b" ".join(w for w, x in zip(words, gone.tolist()) if not x)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "replace"))
            columns, names = [batch.column("doc_id"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "digest", "n_removed", "sha"]
            if keep_text:
                columns, names = [*columns, pa.array(kept)], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


class WindowIndex:
    """add() takes batches of (doc_id, text), in order of their ids, and says what each text loses."""

    def __init__(self, spark, window: int = WINDOW, fanout: int = 8, path: str | None = None):
        """path: a folder for an index that is to outlive the job (see ``open``); else a new one in the shared folder."""
        self.spark, self.window, self.fanout = spark, window, fanout
        self.scratch = Scratch(spark, "window-index", path)
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.history: DataFrame | None = None

    @classmethod
    def open(cls, spark, path: str, history: DataFrame, **options) -> WindowIndex:
        """The index that a former job left at ``path``; history: the (doc_id, text) of all that was added to it."""
        index = cls(spark, path=path, **options)
        index.runs, index.texts = index.scratch.found("run"), index.scratch.found("texts")
        index.history = history.select("doc_id", "text")
        return index

    def add(self, batch: DataFrame, keep_text: bool = False) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of the batch; keep_text: also kept_text, null where nothing went.

        The batch's table must stay readable for as long as batches are added.
        """
        with small_batches(self.spark):
            return self._add(batch, keep_text)

    def _add(self, batch: DataFrame, keep_text: bool) -> DataFrame:
        put = self.scratch.put
        batch = batch.select("doc_id", "text")
        scan = put(batch.mapInArrow(_scan(self.window), "kind byte, doc_id long, n long, value long, sha string"), "scan")
        texts = scan.where("kind = 0").select("doc_id", F.col("n").alias("n_words"), F.col("value").alias("digest"), "sha")
        fresh = scan.where("kind = 1").select(F.col("value").alias("print"), "doc_id")
        run = put(fresh.distinct().repartitionByRange("print", "doc_id").sortWithinPartitions("print", "doc_id"), "run")

        # the texts of this batch that stand for their equals; equals with a smaller id may be older
        all_texts = _union([*self.texts, texts])
        firsts = put(all_texts.where("doc_id is not null").groupBy("digest", "n_words").agg(F.min("doc_id").alias("first")), "firsts")
        known = texts.join(firsts, ["digest", "n_words"], "left")
        copies = known.where(f"doc_id > first and n_words >= {self.window}")
        stands = firsts.where(f"n_words >= {self.window}").select(F.col("first").alias("doc_id"), "digest")

        # fingerprints of the batch that some other text has too
        both = run.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        met = [both.where("low < high").select("print")]
        met += [both.select("print").join(old, "print", "left_semi") for old in self.runs]
        shared = put(met[0] if len(met) == 1 else _union(met).distinct(), "shared")
        found = _union([r.join(shared, "print") for r in [*self.runs, run]])
        involved = put(found.groupBy("doc_id").agg(F.collect_set("print").alias("shared")).join(stands, "doc_id"), "involved")

        source = batch if self.history is None else self.history.unionByName(batch)
        texts_of = wanted_rows(source, involved)
        windows = put(texts_of.mapInArrow(_windows(self.window), "h1 long, h2 long, doc_id long, digest long, pos int"), "windows")
        owners = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
        owners = put(owners.select("h1", "h2", "owner"), "owners")
        marks = windows.join(owners, ["h1", "h2"]).where("owner < doc_id").groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("places"))
        marks = put(marks, "marks")
        schema = "doc_id long, digest long, n_removed long, sha string" + (", kept_text string" if keep_text else "")
        stripped = put(wanted_rows(batch, marks).mapInArrow(_strip(self.window, keep_text), schema).dropDuplicates(["doc_id", "digest"]), "stripped")

        gone = copies.select("doc_id", "digest", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA).alias("sha"))
        if keep_text:
            gone = gone.withColumn("kept_text", F.lit(""))
        changed = stripped.unionByName(gone.distinct())
        out = texts.withColumnRenamed("sha", "whole").join(changed, ["doc_id", "digest"], "left")
        out = out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"), *(["digest", "kept_text"] if keep_text else []))
        result = put(out, "result")

        self.texts.append(put(texts, "texts"))
        self.scratch.drop(firsts, shared, involved, windows, owners, marks, stripped, scan)
        self.history = source
        self.runs.append(run)
        if len(self.runs) > self.fanout:
            self.compact()
        return result

    def compact(self) -> None:
        """Merge all runs into one sorted run, and the tables of texts into one."""
        merged = self.scratch.put(_union(self.runs).distinct().repartitionByRange("print", "doc_id").sortWithinPartitions("print", "doc_id"), "run")
        texts = self.scratch.put(_union(self.texts), "texts")
        self.scratch.drop(*self.runs, *self.texts)
        self.runs, self.texts = [merged], [texts]

    def close(self, keep: DataFrame | None = None) -> None:
        self.scratch.close(keep)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def in_batches(docs: DataFrame, batches: int, **options) -> tuple[WindowIndex, list[DataFrame]]:
    """Feed documents to a new index in ``batches`` ranges of ids; rows without id go with the first."""
    index = WindowIndex(docs.sparkSession, **{k: v for k, v in options.items() if k != "keep_text"})
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("q")).first()["q"] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    results, low = [], None
    for high in [*cuts, None]:
        part = docs
        if low is None and high is not None:
            part = docs.where((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        elif low is not None:
            part = docs.where(F.col("doc_id") > low)
            if high is not None:
                part = part.where(F.col("doc_id") <= high)
        results.append(index.add(part, keep_text=options.get("keep_text", False)))
        low = high
    return index, results


def op10_window_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index, results = in_batches(docs, 2, fanout=1)  # so the second batch's run is compacted with the first's
    out = index.scratch.put(_union(results), "all")
    index.close(keep=out)
    return out


def without_repeats(docs: DataFrame, batches: int = 2) -> DataFrame:
    """The documents with repeated windows cut out of their text and n_chars counted anew.

    Texts that lose nothing keep their white space, others have their words joined by one blank;
    documents left without a word go. Rows without id stay as they are.
    """
    index, results = in_batches(docs.select("doc_id", "text"), batches, keep_text=True)
    changed = _union(results).where("n_removed > 0 and doc_id is not null")
    changed = index.scratch.put(changed.groupBy("doc_id", "n_words", "digest").agg(F.first("kept_text").alias("kept_text")), "changed")
    index.close(keep=changed)
    changed = changed.select(F.col("doc_id").alias("_id"), F.col("kept_text").alias("_kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(changed, F.col("_row.doc_id") == F.col("_id"), "left").where("_kept is null or _kept <> ''")
    columns = {"text": F.coalesce("_kept", F.col("_row.text")), "n_chars": F.when(F.col("_kept").isNotNull(), F.length("_kept").cast("long")).otherwise(F.expr("cast(_row.n_chars as bigint)") if "n_chars" in docs.columns else F.lit(None))}
    return joined.select(*[columns.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
v as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50),
h as (select doc_id, i, array_to_string(ws[i : i + 49], ' ') as win from v),
o as (select win, min(doc_id) as owner from h group by win having min(doc_id) < max(doc_id)),
m as (select distinct doc_id, i + k as j from h join o using (win), range(0, 50) r(k) where owner < doc_id),
u as (select w.doc_id, ws, unnest(range(1, len(ws) + 1)) as j from w),
k as (select u.doc_id, string_agg(ws[j], ' ' order by j) as kept, count(*) as n from u anti join m on u.doc_id = m.doc_id and u.j = m.j group by u.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""
