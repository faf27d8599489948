"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of digits, letters and characters beyond ASCII, A-Z as a-z. Every text is covered by blocks of
words: for a template of n words, blocks of twice the next power of two from n on that start at each half
block, so that any place where the template stands lies whole in a block. A block meets a template if it
holds at least ``percent`` of the template's distinct words, and every such block is found:

* Words are ordered by the number of texts of the whole table that hold them, rarest first. Only words of
  some template count; others can't add to an overlap.
* Prefix filter: with n distinct words in the template and a needed, a block that meets it holds one of the
  template's n - a + 1 rarest words, within its own first words up to the a-th last. The scan keeps the blocks
  with such a word; the join meets them with the templates on it (a template's table is a parameter of
  bounded size and is broadcast).
* Length filter: the block has at least a words. Positional filter: words behind the first common one must
  still suffice. The rest is verified by counting the common words.

Where the words of one met template are a part of those of another met by the same block, only the larger one
counts (a lesser license's text holds the words of the greater one). Phrases are matched word by word beside
that and are never taken back. Places of the two kinds are returned with their words' numbers.

Defined cases: null and empty texts have no words and no labels; rows are judged one by one, so repeated rows
and ids give repeated results; a table without rows gives none; further columns are left out. Memory of a
task is bounded by its longest text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import Scratch

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices by label: how texts commonly say what they are licensed under.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("all-rights-reserved", "no part of this publication may be reproduced without the prior written permission of the publisher"),
)
PERCENT = 92
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: The largest sum of the templates' words that is broadcast.
MAX_TEMPLATE_WORDS = 100_000
PLACES = "array<struct<label:string,first_word:bigint,last_word:bigint>>"
SPANS = "array<struct<label:string,template:int,first_word:bigint,last_word:bigint,common:int,words:int>>"


class Vocabulary:
    """Numbers of the words of templates and phrases, and the templates as sets of them."""

    def __init__(self, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT):
        self.templates = [(label, WORD.findall(text.lower().encode())) for label, text in templates]
        self.phrases = [(label, WORD.findall(text.lower().encode())) for text, label in phrases.items()]
        if sum(len(w) for _, w in self.templates) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        self.code: dict[bytes, int] = {}
        for _, words in [*self.templates, *self.phrases]:
            for w in words:
                self.code.setdefault(w, len(self.code))
        self.sets = [sorted({self.code[w] for w in words}) for _, words in self.templates]
        self.needed = [-(-percent * len(s) // 100) for s in self.sets]
        self.half = [1 << max(0, len(words) - 1).bit_length() for _, words in self.templates]

    def coded(self, texts: list[bytes], size: int = 1 << 17):
        """(first text, words per text, codes of their words or -1) of texts in groups of about ``size`` words."""
        group, total, at = [], 0, 0
        for k, text in enumerate(texts):
            words = WORD.findall(text.lower())
            if group and total + len(words) > size:
                yield at, *self._codes(group)
                group, total, at = [], 0, k
            group.append(words)
            total += len(words)
        if group:
            yield at, *self._codes(group)

    def _codes(self, group: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        words = pa.array([x for w in group for x in w], pa.binary()).dictionary_encode()
        number = np.array([self.code.get(x, -1) for x in words.dictionary.to_pylist()] or [-1], np.int64)
        return np.array([len(w) for w in group], np.int64), number[words.indices.to_numpy()]


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, texts): how many texts of the whole table hold each word of the vocabulary."""

    def run(batches):
        total = np.zeros(len(vocabulary.code), np.int64)
        for batch in batches:
            for _, counts, codes in vocabulary.coded(textops.blobs(batch.column("text"))):
                owner = np.repeat(np.arange(len(counts)), counts)
                known = codes >= 0
                total += np.bincount(np.unique(owner[known] * len(total) + codes[known]) % len(total), minlength=len(total))
        words = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(total[words])], ["word", "texts"])

    return docs.select("text").mapInArrow(run, "word int, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def _scan(vocabulary: Vocabulary, rank: np.ndarray):
    """Rows (doc_id, n_words, places, blocks): places of phrases, and the blocks that hold a rare word of a template of their size.

    A block is (half, first_word, last_word, ranks): the ranks of its template words, ascending.
    """
    prefix: dict[int, np.ndarray] = {}
    for size in set(vocabulary.half):
        rare = np.zeros(len(rank) + 1, bool)
        for s, need, half in zip(vocabulary.sets, vocabulary.needed, vocabulary.half):
            if half == size and need:
                rare[sorted(s, key=lambda w: rank[w])[: len(s) - need + 1]] = True
        prefix[size] = rare
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    block = pa.struct([("half", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("ranks", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), textops.blobs(batch.column("text"))
            for at, counts, codes in vocabulary.coded(texts):
                starts = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(len(counts)), counts)
                places: list[list] = [[] for _ in counts]
                for label, words in vocabulary.phrases:
                    n = len(words)
                    if not n or len(codes) < n:
                        continue
                    hit = owner[: len(codes) - n + 1] == owner[n - 1 :]
                    for k, w in enumerate(words):
                        hit &= codes[k : len(codes) - n + 1 + k] == vocabulary.code[w]
                    for i in np.flatnonzero(hit).tolist():
                        first = i - int(starts[owner[i]])
                        places[owner[i]].append({"label": label, "first_word": first, "last_word": first + n - 1})
                blocks: list[list] = [[] for _ in counts]
                inside = np.arange(len(codes)) - starts[owner]
                known = np.flatnonzero(codes >= 0)
                for half, rare in prefix.items():
                    seed = known[rare[codes[known]]]
                    # the block of each rare word, and the one half a block earlier
                    now = inside[seed] // half
                    wanted = np.unique(np.concatenate([np.stack([owner[seed], now], 1), np.stack([owner[seed], now - 1], 1)]), axis=0)
                    for text, number in wanted.tolist():
                        first = number * half
                        if first < 0:
                            continue
                        last = min(first + 2 * half, int(counts[text]))
                        some = codes[starts[text] + first : starts[text] + last]
                        ranks = np.unique(rank[some[some >= 0]])
                        blocks[text].append({"half": half, "first_word": first, "last_word": last - 1, "ranks": ranks.tolist()})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(counts)), pa.array(counts), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block))], ["doc_id", "n_words", "places", "blocks"]
                )

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, places, matches) of a table with doc_id and text.

    places: the label, first and last word of each place of a phrase. matches: of each block that meets a template
    the template's label and number, the block's first and last word, and the words that both have.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = Vocabulary(templates, phrases, percent)
    frequency = np.zeros(len(vocabulary.code), np.int64)
    for r in word_counts(rows, vocabulary).collect():  # at most one row for each word of a template
        frequency[r["word"]] = r["texts"]
    rank = np.empty(len(frequency), np.int32)
    rank[np.lexsort((np.arange(len(rank)), frequency))] = np.arange(len(rank))

    blocks = "blocks array<struct<half:int,first_word:bigint,last_word:bigint,ranks:array<int>>>"
    scanned = rows.mapInArrow(_scan(vocabulary, rank), f"doc_id long, n_words long, places {PLACES}, {blocks}")
    scanned = scratch.put(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    prefixes = []
    for k, ((label, _), half, need, words) in enumerate(zip(vocabulary.templates, vocabulary.half, vocabulary.needed, vocabulary.sets)):
        ranks = sorted(int(rank[w]) for w in words)
        prefixes += [(k, label, half, need, ranks, i, ranks[i]) for i in range(len(ranks) - need + 1) if need]
    side = spark.createDataFrame(prefixes, "template int, label string, t_half int, need int, of array<int>, i int, rank int")
    found = scratch.put(scanned.select("doc_id", "n_words", "places", "row").join(_met(scanned, F.broadcast(side)), "row", "left"), "found")
    scratch.close(keep=found)
    return found.select("doc_id", "n_words", "places", F.coalesce("matches", F.array().cast(SPANS)).alias("matches"))


def _met(scanned: DataFrame, side: DataFrame) -> DataFrame:
    """(row, matches): blocks and templates that share a word of both prefixes, with lengths and places that allow it, verified."""
    blocks = scanned.where("size(blocks) > 0").select("row", F.explode("blocks").alias("block"))
    words = blocks.select("row", "block", F.posexplode("block.ranks").alias("j", "rank"))
    size = F.size("block.ranks")
    behind = F.least(F.size("of") - F.col("i"), size - F.col("j"))
    fits = (F.col("t_half") == F.col("block.half")) & (size >= F.col("need")) & (F.col("j") <= size - F.col("need")) & (behind >= F.col("need"))
    met = words.join(side, "rank").where(fits).withColumn("common", F.size(F.array_intersect("block.ranks", "of"))).where("common >= need")
    span = ("label", "template", "block.first_word", "block.last_word", "common", F.size("of").alias("words"), "of")
    within = "y.first_word = x.first_word and y.last_word = x.last_word and size(y.of) > size(x.of) and size(array_except(x.of, y.of)) = 0"
    own = F.expr(f"array_sort(filter(found, x -> not exists(found, y -> {within})))")
    found = met.groupBy("row").agg(F.collect_set(F.struct(*span)).alias("found"))
    return found.select("row", F.transform(own, lambda x: F.struct(*[x[c].alias(c) for c in ("label", "template", "first_word", "last_word", "common", "words")])).alias("matches"))


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.col("places.first_word")
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat(F.col("places.label"), F.col("matches.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.expr("transform(matches, x -> x.common / x.words)")), F.lit(0.0))).alias("score"),
    )


def _op12_sql() -> str:
    v = Vocabulary()
    names = {code: word.decode() for word, code in v.code.items()}
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({k}, '{label}', {half}, {need}, {lists(names[w] for w in s)})" for k, ((label, _), half, need, s) in enumerate(zip(v.templates, v.half, v.needed, v.sets)))
    phrases = ", ".join(f"('{label}', {lists(w.decode() for w in words)})" for label, words in v.phrases)
    return rf"""
with t(k, label, half, need, ws) as (values {templates}),
ph(label, ws) as (values {phrases}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
p as (select doc_id, len(ws) as n, unnest(ws) as word, unnest(range(0, len(ws))) as i from d),
b as (select doc_id, i, label from (select d.doc_id, d.ws, p.i, ph.label, ph.ws as pw from p join d using (doc_id) join ph on p.word = ph.ws[1]) where ws[i + 1 : i + len(pw)] = pw),
bs as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as labels from b group by doc_id),
tw as (select k, half, unnest(ws) as word from t),
m as (select doc_id, n, k, half, i // half - o as block, count(distinct word) as common from p join tw using (word), (values (0), (1)) x(o) where i // half - o >= 0 group by doc_id, n, k, half, block),
f as (select doc_id, m.k, t.label, block * m.half as s, least((block + 2) * m.half, n) as e, common, t.ws from m join t on m.k = t.k where common >= need),
g as (select * from f where not exists (select 1 from f y where y.doc_id = f.doc_id and y.s = f.s and y.e = f.e and len(y.ws) > len(f.ws) and list_has_all(y.ws, f.ws))),
gs as (select doc_id, list(distinct label) as labels, max(common::double / len(ws)) as score from g group by doc_id)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(bs.labels, ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(gs.labels, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(score, 0.0::double) end as score
from d left join bs using (doc_id) left join gs using (doc_id)
"""


OP12_SQL = _op12_sql()
