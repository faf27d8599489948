"""Language proportions of multilingual texts by expectation maximisation.

Training counts hashed byte trigrams (word edges included) of every labelled training text. A text is a
mixture: each word comes from one language, with the likelihood of its trigrams. EM estimates the
language proportions of each document; the language set is the one with the best penalised likelihood
(half a log of the number of words, times ``penalty``, for each language), found from all languages by
dropping the weakest while that costs less than the penalty.

Defined cases: null, empty or letterless texts get ``und`` with score 0; rows without a language don't
train; without any training row every text is ``und``; repeated rows are predicted alike; ties go to the
language that sorts first. The model is (languages x 65,536) floats, the only thing broadcast; more
languages than MAX_LANGUAGES are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import mapped_rows, without

BUCKETS = 1 << 16
MAX_LANGUAGES = 512
#: EM runs over the words of several documents at once, this many or one document's.
WORDS_AT_ONCE = 400_000


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hashed trigram starting at each byte; white space counts as a blank, A-Z as a-z."""
    folded = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    folded = np.where((folded >= 9) & (folded <= 13), np.uint8(32), folded).astype(np.uint32)
    padded = np.concatenate([folded, np.full(2, 32, np.uint32)])
    key = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(16)).astype(np.uint16)


def _sections(texts: list[bytes]):
    """(text index of each word, first and last gram + 1 of each word, grams), section by section."""
    for group in textops._sections(texts):
        buf = np.frombuffer(b" " + b" ".join(x for _, x in group) + b" ", np.uint8)
        starts, ends = textops.cut(buf)
        letter = ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
        has = np.concatenate([[0], np.cumsum(letter)])
        wordy = has[ends] > has[starts]
        starts, ends = starts[wordy], ends[wordy]
        bounds = 1 + np.cumsum([len(x) + 1 for _, x in group])
        owner = np.array([k for k, _ in group])[np.searchsorted(bounds, starts, side="right")]
        yield owner, starts - 1, ends - 1, _grams(buf)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) of a table (text, lang)."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                rows = pa.array([x == lang for x in langs])
                into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, first, last, grams in _sections(textops.blobs(batch.column("text").filter(rows))):
                    inside = np.zeros(len(grams) + 1, np.int32)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, last, -1)
                    into += np.bincount(grams[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bucket", "n"])

    return labelled.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Trigram log-likelihoods by language."""

    def __init__(self, langs: list[str], logs: np.ndarray, penalty: float = 2.0, rounds: int = 12):
        self.langs, self.logs, self.penalty, self.rounds = langs, logs, penalty, rounds

    @classmethod
    def fit(cls, labelled: DataFrame, smoothing: float = 0.5, **options) -> LanguageModel:
        many = labelled.where("lang is not null").select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
        if many > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        counts = count_grams(labelled).toPandas()  # at most MAX_LANGUAGES x BUCKETS rows
        langs = sorted(counts["lang"].unique())
        table = np.full((len(langs), BUCKETS), smoothing)
        table[counts["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy()
        return cls(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32), **options)

    def _words(self, texts: list[bytes]):
        """(text index of each word, language x word log-likelihoods), in groups of whole texts."""
        held, size = [], 0
        for owner, first, last, grams in _sections(texts):
            found = np.empty((len(self.langs), len(owner)), np.float32)
            # word by word, so that a word's likelihood doesn't depend on what stands before it
            bounds = np.stack([first, last], axis=1).ravel()
            for k, logs in enumerate(self.logs):
                found[k] = np.where(last > first, np.add.reduceat(np.append(logs[grams], np.float32(0)), bounds, dtype=np.float64)[::2], 0.0) if len(owner) else 0.0
            if held and size >= WORDS_AT_ONCE and len(owner) and held[-1][0][-1:] != owner[:1]:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], axis=1)
                held, size = [], 0
            if len(owner):
                held.append((owner, found))
                size += len(owner)
        if held:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], axis=1)

    def proportions(self, texts: list[bytes]) -> np.ndarray:
        """Text x language; a row of zeros where no word has a letter."""
        out = np.zeros((len(texts), len(self.langs)))
        if self.langs:
            for owner, logs in self._words(texts):
                begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sizes = np.diff(np.concatenate([begins, [len(owner)]]))
                out[owner[begins]] = self._select(np.exp(logs - logs.max(0)), sizes)
        return out

    def _em(self, like: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares (text x language, zeros stay zero) and log-likelihoods of the texts under them.

        A text's shares stay once a round moves them by less than 1e-3, whatever texts stand beside it.
        """
        share = share.copy()
        live = np.arange(len(sizes))
        some, size = like, sizes
        for _ in range(rounds):
            begins = np.concatenate([[0], np.cumsum(size)[:-1]])
            parts = [x * np.repeat(share[live, k].astype(np.float32), size) for k, x in enumerate(some)]
            total = np.maximum(sum(parts), np.float32(1e-30))
            new = np.stack([np.add.reduceat(x / total, begins, dtype=np.float64) for x in parts], axis=1) / size[:, None]
            new /= np.maximum(new.sum(1, keepdims=True), 1e-30)
            moving = np.abs(new - share[live]).max(1) >= 1e-3
            share[live] = new
            if not moving.any():
                break
            if not moving.all():
                some, size, live = some[:, np.repeat(moving, size)], size[moving], live[moving]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mixed = np.maximum(sum(x * np.repeat(share[:, k].astype(np.float32), sizes) for k, x in enumerate(like)), np.float32(1e-30))
        return share, np.add.reduceat(np.log(mixed, dtype=np.float64), begins)

    def _select(self, like: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        many = like.shape[0]
        share, fit = self._em(like, sizes, np.full((len(sizes), many), 1.0 / many), self.rounds)
        price = self.penalty * 0.5 * np.log(sizes + 1.0)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        best = share.argmax(1)
        alone = np.stack([np.add.reduceat(np.log(np.maximum(x, np.float32(1e-30)), dtype=np.float64), begins) for x in like], axis=1)[np.arange(len(sizes)), best]
        active = (share > 0).sum(1)
        single = fit - alone < price * (active - 1)
        share[single] = np.eye(many)[best[single]]
        open_ = np.flatnonzero(~single)
        while len(open_):
            words = np.repeat(np.isin(np.arange(len(sizes)), open_), sizes)
            sub, size = like[:, words], sizes[open_]
            trial = share[open_].copy()
            weakest = np.where(trial > 0, trial, 2.0).argmin(1)
            trial[np.arange(len(open_)), weakest] = 0.0
            trial /= np.maximum(trial.sum(1, keepdims=True), 1e-30)
            trial, now = self._em(sub, size, trial, self.rounds)
            drop = fit[open_] - now < price[open_]
            share[open_[drop]], fit[open_[drop]] = trial[drop], now[drop]
            open_ = open_[drop & ((share[open_] > 0).sum(1) > 1)]
        return share


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def language_mixture(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and the selected languages with their proportions.

    Columns of the input with these names are replaced.
    """
    names = ["lang_pred", "score", "languages", "proportions"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = [f"_{n}" for n in names]

    def run(batches, kept):
        model = shared.value
        for batch in batches:
            texts = textops.blobs(batch.column("_in"))
            share = model.proportions(texts)
            pred, score, sets, parts = [], [], [], []
            for x, row in zip(texts, share):
                used = np.flatnonzero(row)
                if not len(used) or not _has_letter(x[:4096]) and not _has_letter(x):
                    pred.append("und"), score.append(0.0), sets.append([]), parts.append([])
                    continue
                best = int(row.argmax())
                pred.append(model.langs[best]), score.append(min(1.0, float(row[best])))
                sets.append([model.langs[k] for k in used]), parts.append([float(row[k]) for k in used])
            found = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, *made])

    return mapped_rows(docs, without(docs, *names), text, run, "_lang_pred string, _score double, _languages array<string>, _proportions array<double>", names)


def op1_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = LanguageModel.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("text", "lang"))
    found = language_mixture(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")
