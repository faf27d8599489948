"""Runs of words that repeat with a period, found by internal pattern matching.

A run is a longest stretch of words with smallest period q (words q apart are equal) that holds at least
``least`` words and two periods. Texts are worked on in groups of about GROUP_WORDS words:

* Ranks of the words' blocks of 1, 2, 4, ... words come from prefix doubling, which ends in a suffix array in
  which the suffixes of each text lie together. The ranks of every length are kept: two compared blocks tell
  how far two places of a text agree, in as many steps as there are lengths.
* Dyadic blocks: of each length m from 4 on, the blocks that start at multiples of m/2. Every run of a period
  between 1.5m - 1 and 3m - 2 (1 and 10 for m = 4) holds such a block together with the block's copy one
  period on. A block that stands only once is left at once.
* A wavelet tree over the suffix array (bit vectors with popcount directories) answers how many of a block's
  occurrences lie in a neighbouring window, and which is the next one: the range successor. In a window of
  m + 1 places they form an arithmetic progression, so first, second and number say them all.
* The distances to a progression's members are candidate periods. Where the block belongs to the progression's
  own periodic stretch only the first can be new. Each candidate is extended in both directions, must reach
  the length, and of equal stretches the smallest period stands.

Everything is exact. Memory is some 200 bytes for each word of a group; a text longer than a group is a group
of its own.

Defined cases: null, empty and short texts have no runs and nothing to drop; rows are judged one by one, so
repeated ids and rows give repeated results; a table without rows gives none; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

LEAST = 12
GROUP_WORDS = 1 << 17
#: Candidates that are extended at once.
AT_ONCE = 1 << 19
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class WaveletTree:
    """Whole numbers below 2**bits by position: counts and order statistics of any range of positions, many at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.levels = []
        for bit in reversed(range(self.bits)):
            ones = (values >> bit) & 1 == 1
            packed = np.zeros((len(values) // 64 + 1) * 8, np.uint8)
            some = np.packbits(ones, bitorder="little")
            packed[: len(some)] = some
            words = packed.view(np.uint64)
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = int(len(values) - ones.sum())
            self.levels.append((bit, words, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        _, words, before, _ = level
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & low)

    def below(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of the positions [left, right) are smaller than limit."""
        limit = np.minimum(limit, (1 << self.bits) - 1)
        count = np.zeros(len(left), np.int64)
        for level in self.levels:
            bit, _, _, zeros = level
            l1, r1 = self._ones(level, left), self._ones(level, right)
            up = (limit >> bit) & 1 == 1
            count += np.where(up, (right - left) - (r1 - l1), 0)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k smaller ones in [left, right); with k = below(.., x) that is the successor of x."""
        value = np.zeros(len(left), np.int64)
        for level in self.levels:
            bit, _, _, zeros = level
            l1, r1 = self._ones(level, left), self._ones(level, right)
            low = (right - left) - (r1 - l1)
            up = k >= low
            k = np.where(up, k - low, k)
            value |= np.where(up, 1 << bit, 0)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return value


class Suffixes:
    """Suffix array of joined texts (each apart from the others), ranks of blocks of every length, and the repeated dyadic blocks."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        n = self.n = len(codes)
        key = owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        self.array = np.argsort(key)
        slots, pos, key = np.arange(n), self.array, key[self.array]
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        self.ranks: list[np.ndarray] = []
        blocks = []
        while len(pos):
            first = np.empty(len(pos), bool)
            first[0] = True
            np.not_equal(key[1:], key[:-1], out=first[1:])
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(pos)))
            rank[pos] = np.repeat(slots[starts], sizes)
            alone = np.repeat(sizes == 1, sizes)
            if alone.all() and self.ranks:
                break
            k = len(self.ranks)
            self.ranks.append(rank.copy())
            slots, pos, sizes = slots[~alone], pos[~alone], np.repeat(sizes, sizes)[~alone]
            if k >= 2 and len(pos):
                take = pos % (1 << (k - 1)) == 0
                left = rank[pos[take]].astype(np.int64)
                blocks.append((np.full(int(take.sum()), k), pos[take], left, left + sizes[take]))
            step = 1 << k
            after = np.minimum(pos + step, n)
            inside = (after < n) & (owner[np.minimum(after, n - 1)] == owner[pos])
            key = rank[pos].astype(np.int64) * (n + 1) + np.where(inside, rank[after], -1) + 1
            order = np.argsort(key)
            pos, key = pos[order], key[order]
            self.array[slots] = pos
        self.blocks = [np.concatenate(x) for x in zip(*blocks)] if blocks else [np.zeros(0, np.int64)] * 4

    def agree_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for i < j in one text."""
        begin = i
        for k in reversed(range(len(self.ranks))):
            equal = self.ranks[k][i] == self.ranks[k][j]
            i, j = i + (equal.astype(np.int64) << k), j + (equal.astype(np.int64) << k)
        return i - begin

    def agree_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        begin = i
        for k in reversed(range(len(self.ranks))):
            size = 1 << k
            room = i >= size
            equal = room & (self.ranks[k][np.where(room, i - size, self.n)] == self.ranks[k][np.where(room, j - size, self.n)])
            i, j = i - (equal.astype(np.int64) << k), j - (equal.astype(np.int64) << k)
        return begin - i


def _progressions(suffixes: Suffixes):
    """(block, level, first, step, number) of each block's occurrences in the two windows behind it."""
    level, b, left, right = suffixes.blocks
    if not len(b):
        return [np.zeros(0, np.int64)] * 5
    tree = WaveletTree(suffixes.array)
    m = np.left_shift(1, level)
    low, high = np.where(level == 2, 1, 3 * m // 2 - 1), 3 * m - 2
    middle = np.where(level == 2, 5, low + 3 * m // 4 - 1)
    counts = [tree.below(left, right, b + x) for x in (low, middle + 1, high + 1)]
    out = []
    for c, d in zip(counts, counts[1:]):
        at = np.flatnonzero(d > c)
        first = tree.smallest(left[at], right[at], c[at])
        more = np.flatnonzero(d[at] > c[at] + 1)
        step = np.zeros(len(at), np.int64)
        step[more] = tree.smallest(left[at[more]], right[at[more]], c[at[more]] + 1) - first[more]
        out.append((b[at], level[at], first, step, (d - c)[at]))
    return [np.concatenate(x) for x in zip(*out)]


def find_runs(codes: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of joined texts, ordered by start and period; owner: the text of each word, ascending.

    least must be 12 or more: shorter runs need not hold a block of four words and its copy.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words aren't looked for")
    none = np.zeros(0, np.int64)
    if len(codes) < least:
        return none, none, none
    suffixes = Suffixes(codes, owner)
    b, level, first, step, number = _progressions(suffixes)
    own = np.zeros(len(b), bool)
    far = np.flatnonzero(number >= 3)
    # a block within the progression's own periodic stretch has no other new period than the first distance
    together = (first[far] - b[far]) % step[far] == 0
    far = far[together]
    own[far] = suffixes.agree_after(b[far], b[far] + step[far]) >= first[far] + (1 << level[far]) - b[far] - step[far]
    number = np.where(own, 1, number)
    found = []
    ends = np.cumsum(number)
    at = 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
        n = number[at:to]
        of = np.repeat(np.arange(at, to), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i, d = b[of], first[of] + nth * step[of] - b[of]
        after, before = suffixes.agree_after(i, i + d), suffixes.agree_before(i, i + d)
        length = before + after + d
        good = length >= np.maximum(least, 2 * d)
        found.append(np.unique(np.stack([(i - before)[good], length[good], d[good]], 1), axis=0))
        at = to
    if not found:
        return none, none, none
    rows = np.unique(np.concatenate(found), axis=0)
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[keep]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _groups(texts: list[bytes]):
    """Texts' words in groups of about GROUP_WORDS: lists of (number of the text, words)."""
    group, size = [], 0
    for k, text in enumerate(texts):
        words = text.split()
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append((k, words))
        size += len(words)
    if group:
        yield group


def _judge(least: int):
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), textops.blobs(batch.column("text"))
            for group in _groups(texts):
                counts = np.array([len(w) for _, w in group], np.int64)
                starts = np.cumsum(counts) - counts
                codes = pa.array([x for _, w in group for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(group)), counts)
                long = (counts >= least)[owner]
                places = np.flatnonzero(long)
                begin, length, period = find_runs(codes[long], owner[long], least)
                begin = places[begin]
                gone = np.zeros(len(codes) + 1, np.int64)
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, begin + length, -1)
                kept = np.cumsum(gone)[:-1] == 0
                of = owner[begin]
                sizes = np.bincount(of, minlength=len(group))
                collapsed = []
                for k, (_, words) in enumerate(group):
                    if sizes[k]:
                        words = [w for w, x in zip(words, kept[starts[k] : starts[k] + counts[k]].tolist()) if x]
                    collapsed.append(b" ".join(words))
                runs = pa.StructArray.from_arrays([pa.array(begin - starts[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), runs)
                some = ids.slice(group[0][0], len(group))
                yield pa.RecordBatch.from_arrays([some, pa.array(counts), lists, pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)], names)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of a table with doc_id and text.

    runs: start, length and period of every run, by start and period. collapsed: the words that no run
    contains behind its first period, joined by one blank.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judge(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id's crc32 ends in 0 repeat their words from a place on, as the query's contract says."""
    words = "regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    again = "transform(sequence(0L, n - 1), i -> get(ws, cast(if(i < a, i, a + (i - a) % p) as int)))"
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", "crc32(cast(doc_id as string)) as h").withColumn("g", F.expr("h div 10"))
    change = f"aggregate(array({words}), text, (t, ws) -> if(size(ws) = 0, t, aggregate(array(cast(size(ws) as bigint)), t, (u, n) -> " + (
        "aggregate(array(g % n), u, (v, a) -> aggregate(array(1 + (n - a) div (3 + g % 8)), v, (x, p) -> array_join(" + again + ", ' '))))))"
    )
    return rows.selectExpr("doc_id", f"if(h % 10 = 0, {change}, text) as text")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p)))")
    line = "concat(r.start, ',', r.length, ',', r.period, '\\n')"
    found = periodic_runs(planted(docs)).withColumn("_l", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_l.s").alias("start"),
        (-F.col("_l.l")).alias("length"),
        F.col("_l.p").alias("period"),
        F.expr("1000 * -_l.l div _l.p").alias("exponent_milli"),
        F.expr(f"sha2(array_join(transform(runs, r -> {line}), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
with recursive crc as (
  select list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(0, 8)), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t),
w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as o,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from documents, crc),
a as (select *, len(o)::bigint as n, (h // 10) % greatest(len(o), 1) as a, 3 + (h // 10) % 8 as z from w),
d as (select doc_id, n, if(h % 10 = 0 and n > 0, list_transform(range(0, n), lambda i: o[if(i < a, i, a + (i - a) % (1 + (n - a) // z)) + 1]), o) as ws from a),
p as (select doc_id, unnest(range(0, n)) as i, unnest(ws) as word from d),
e as (select x.doc_id, x.i, y.i - x.i as q from p x join p y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i),
s as (select doc_id, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as g from e) group by doc_id, q, g),
r as (select doc_id, s, l, min(q) as q from s where l >= greatest(12, 2 * q) group by doc_id, s, l),
b as (select doc_id, count(*) as n_runs, min(struct_pack(l := -l, s := s, q := q)) as best, string_agg(concat(s, ',', l, ',', q, chr(10)), '' order by s, q) as lines from r group by doc_id),
g as (select distinct doc_id, unnest(range(s + q, s + l)) as i from r),
k as (select p.doc_id, string_agg(word, ' ' order by p.i) as kept from p anti join g on p.doc_id = g.doc_id and p.i = g.i group by p.doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, (-best.l)::bigint as length, best.q::bigint as period,
  (1000 * -best.l // best.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join b using (doc_id) left join k using (doc_id)
"""
