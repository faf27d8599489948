"""Exact Jaccard self-join of word n-gram sets by vertical partitioning.

Equal sets become one class first. Which classes may link at all is settled by two orders of all n-grams:

1. By hash. Two sets that link share ``extra`` n-grams of their prefixes, the first n - ceil(t n) + extra
   n-grams of each, and extra is an eighth of a set's size. Classes that share fewer prefix n-grams with
   all others together are done.
2. By the number of remaining classes that hold an n-gram, rarest first. Linked sets share an n-gram of their
   prefixes of n - ceil(t n) + 1. Classes that do, in the same band of sizes, form clusters.

A cluster's sets are then compared block against block: the order of n-grams is cut into FRAGMENTS
fragments, the overlaps of all pairs of a block are counted fragment by fragment, apart from each other, as
matrix products, and summed. Pairs are never rows: a block returns for each set its links' number and
the smallest set that it hangs together with. A large cluster has more blocks, not larger ones.

An n-gram found in many texts is counted where it is read: of each run of RUN prefix n-grams a task sends
one row per n-gram, so a common n-gram's rows grow with the number of runs. All links are counted, also
those inside components.

Defined cases: null, empty and wordless texts have empty sets, link with nothing and are their own
component; a text of fewer words than n is one n-gram; repeated rows and equal texts are linked; rows that
share an id but not the text are judged apart; a row without id belongs to the component of an equal text
with an id, else to none (null); other columns of the input, whatever their names, are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops
from .shared import Scratch, connected_components, small_batches, wanted_rows

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
FRAGMENTS = 8
#: Prefix n-grams that a task counts before it sends them on.
RUN = 1 << 20
#: A block holds about so many n-grams and so many sets at most.
BLOCK_GRAMS = 1 << 19
BLOCK_SETS = 512
#: Columns of one matrix product.
COLUMNS = 2048
#: Classes that a task remembers, so as to send each of them once.
SEEN = 1 << 20


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, A-Z as a-z."""
    counts, (words,) = textops.word_hashes(texts, lower=True)
    grams = textops.gram_hashes(words, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            short = words[at : at + n]
            out.append(textops.mix(np.array([int(textops.gram_hashes(short, n, seed=n)[0])], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: the class of all texts with this set."""
    halves = [int(textops.mix(grams ^ np.uint64(x)).sum(dtype=np.uint64)) ^ len(grams) for x in (0x5851F42D4C957F2D, 0xD1342543DE82EF95)]
    return tuple(a - (1 << 64) if a >= 1 << 63 else a for a in halves)


def least_overlap(n, percent: int = PERCENT):
    """n-grams that a set of n has in common with every set that it links with."""
    return -(-n * percent // 100)


def extra(n):
    """How many prefix n-grams two linked sets share, by the smaller one's size."""
    return np.maximum(1, n // 8)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return int(min(n, n - least_overlap(n, percent) + extra(n)))


def _batched(batch: pa.RecordBatch, width: int, size: int = 256):
    """(row number, n-gram set), some texts at a time."""
    texts = textops.blobs(batch.column("text"))
    for at in range(0, len(texts), size):
        yield from enumerate(shingle_sets(texts[at : at + size], width), at)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _scan(width: int):
    """Rows (doc_id, n, d1, d2): a text's set."""

    def run(batches):
        for batch in batches:
            found = [(len(grams), *digest(grams)) for _, grams in _batched(batch, width)]
            n, d1, d2 = (np.array([x[k] for x in found], np.int64) for k in range(3))
            yield _record(doc_id=batch.column("doc_id"), n=n.astype(np.int32), d1=d1, d2=d2)

    return run


def _prefixes(width: int, percent: int):
    """Rows (kind, d1, id, n): 1, n-gram d1 in the prefix of class id (null: of several); 2, class d1 shares n of its prefix n-grams."""

    def flush(held):
        gram, node = (np.concatenate(x) for x in held)
        order = np.argsort(gram, kind="stable")
        gram, node = gram[order], node[order]
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        starts = np.flatnonzero(first)
        several = np.diff(np.append(starts, len(gram))) > 1
        where, times = np.unique(node[several[np.cumsum(first) - 1]], return_counts=True)
        k = len(where)
        yield _record(kind=np.full(k, 2, np.int8), d1=where, id=where, n=times.astype(np.int32))
        for at in range(0, len(starts), 1 << 16):
            s = slice(at, at + (1 << 16))
            k = len(starts[s])
            yield _record(kind=np.ones(k, np.int8), d1=_signed(gram[starts[s]]), id=pa.array(node[starts[s]], mask=several[s]), n=np.zeros(k, np.int32))

    def run(batches):
        seen: set[int] = set()
        held, size = ([], []), 0
        for batch in batches:
            for _, grams in _batched(batch, width):
                node = digest(grams)[0]
                if not len(grams) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                prefix = grams[: prefix_size(len(grams), percent)]
                held[0].append(prefix)
                held[1].append(np.full(len(prefix), node, np.int64))
                size += len(prefix)
                if size >= RUN:
                    yield from flush(held)
                    held, size = ([], []), 0
        if size:
            yield from flush(held)

    return run


def _met(batches):
    """From rows sorted by (kind, d1, id), null ids first: (id, times), how many of a class's prefix n-grams others have too."""
    gram, node, sure = None, None, False  # of the last n-gram: itself, the class that still waits for another one, whether others have it
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == 2).any():
            told = batch.filter(pa.array(kind == 2))
            yield _record(id=told.column("d1"), times=told.column("n").cast(pa.int64()))
            batch = batch.filter(pa.array(kind == 1))
        if not batch.num_rows:
            continue
        grams = batch.column("d1").to_numpy()
        ids = batch.column("id")
        known = np.array(ids.is_valid())
        nodes = ids.fill_null(0).to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[gram is None or grams[0] != gram], grams[1:] != grams[:-1]])
        group = np.cumsum(fresh)  # 0: goes on with the last batch's n-gram
        again = np.concatenate([[False], (group[1:] == group[:-1]) & known[1:] & known[:-1] & (nodes[1:] == nodes[:-1])])
        if group[0] == 0 and known[0] and node is not None and nodes[0] == node:
            again[0] = True
        count = np.bincount(group[known & ~again], minlength=group[-1] + 1) + 2 * (np.bincount(group[~known], minlength=group[-1] + 1) > 0)
        before = node is not None or sure
        if before:
            count[0] += 2 if sure else 1
        several = count > 1
        out = nodes[known & ~again & several[group]]
        if before and several[0] and not sure and node is not None:
            out = np.append(out, node)
        where, times = np.unique(out, return_counts=True)
        if len(where):
            yield _record(id=where, times=times.astype(np.int64))
        last = group == group[-1]
        if group[-1] == 0:
            sure = sure or bool(several[0])
            ends = nodes[last & known]
            node = int(ends[-1]) if len(ends) else node
        else:
            sure = bool(several[-1])
            ends = nodes[last & known]
            node = int(ends[-1]) if len(ends) else None
        gram = grams[-1]


def _sets(width: int):
    """Rows (node, n, copies, grams) of the texts whose set is the wanted one."""

    def run(batches):
        for batch in batches:
            want = list(zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist()))
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [(k + at, g) for k, g in _batched(part, width) if digest(g) == want[k + at]]
                if not found:
                    continue
                rows, grams = pa.array([k for k, _ in found]), [g for _, g in found]
                ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                yield _record(node=batch.column("node").take(rows), n=batch.column("n").take(rows), copies=batch.column("copies").take(rows), grams=pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(grams)))))

    return run


def overlaps(grams: np.ndarray, owner: np.ndarray, n: int, fragments: int) -> np.ndarray:
    """Intersection sizes of all pairs of n sets: partial overlaps by fragment of the order, summed.

    grams: distinct within each set; owner: the set's number for each.
    """
    total = np.zeros((n, n), np.float32)
    cuts = np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments)
    part = np.searchsorted(cuts, grams, side="right")
    for f in range(fragments):
        inside = part == f
        _, column, times = np.unique(grams[inside], return_inverse=True, return_counts=True)
        rows = owner[inside][times[column] > 1]
        shared = np.cumsum(times > 1) - 1
        column = shared[column[times[column] > 1]]
        for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            here = (column >= low) & (column < low + COLUMNS)
            marks = np.zeros((n, min(COLUMNS, int(column[here].max()) - low + 1)), np.float32)
            marks[rows[here], column[here] - low] = 1
            total += marks @ marks.T
    return total


def _smallest(linked: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each row can reach."""
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (low == label).all():
            return label
        label = low


def _compare(percent: int, fragments: int):
    """Of one pair of blocks (or one block with itself): (node, low, links) of the sets with a link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        rows = table.take(pa.array(first))
        size, copies, block = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "copies", "block"))
        lists = rows.column("grams").combine_chunks()
        grams = lists.flatten().to_numpy().view(np.uint64)
        common = overlaps(grams, np.repeat(np.arange(len(node)), size), len(node), fragments).astype(np.int64)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        some = linked.any(axis=1)
        links = linked.astype(np.int64) @ copies
        low = _smallest(linked, node.copy())
        return pa.table({"node": node[some], "low": low[some], "links": links[some]})

    return run


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) of a table (doc_id, text); n_links: other rows linked directly."""
    with small_batches(docs.sparkSession):
        return _components(docs, width, percent, fragments)


def _components(docs: DataFrame, width: int, percent: int, fragments: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select("doc_id", "text")

    texts = scratch.put(docs.mapInArrow(_scan(width), "doc_id long, n int, d1 long, d2 long"), "texts")
    classes = texts.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    # d1 names a class, but for those that share it with another
    rank = F.row_number().over(Window.partitionBy("d1").orderBy("d2"))
    classes = scratch.put(classes.withColumn("rank", rank).withColumn("node", F.expr("if(rank = 1, d1, xxhash64(d1, d2, rank))")).drop("rank"), "classes")

    prefixes = docs.mapInArrow(_prefixes(width, percent), "kind byte, d1 long, id long, n int").repartition("d1").sortWithinPartitions("kind", "d1", "id")
    times = prefixes.mapInArrow(_met, "id long, times long").groupBy(F.col("id").alias("d1")).agg(F.sum("times").alias("times"))
    overlap = f"ceil(n * {percent} / 100.0D - 1e-9)"
    met = classes.join(times, "d1").where(f"doc_id is not null and times >= greatest(1L, cast({overlap} as bigint) div 8)").drop("times")
    met = scratch.put(met, "met")
    sets = wanted_rows(docs, met).mapInArrow(_sets(width), "node long, n int, copies long, grams array<long>")
    if not texts.where("n > 0 and doc_id is not null").groupBy("doc_id", "d1", "d2").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])
    sets = scratch.put(sets, "sets")

    # prefixes by rarity among the classes left: a class's own n-grams come first
    rows = sets.select("node", "n", F.explode("grams").alias("gram"))
    several = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(several, "gram")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "gram")) + F.col("n") - F.count("*").over(Window.partitionBy("node"))
    shared = shared.withColumn("place", place).where(f"place <= n - {overlap} + 1")
    band = "cast(floor(ln(n) / ln(100.0D / {0})) as int)".format(percent)
    shared = scratch.put(shared.select("node", "gram", F.explode(F.expr(f"array({band}, {band} + 1)")).alias("band")), "shared")
    centres = shared.groupBy("gram", "band").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a < high").drop("high")
    clusters = connected_components(scratch, shared.join(centres, ["gram", "band"]).where("node <> a").select("a", F.col("node").alias("b")).distinct())

    placed = sets.select("node", "n").join(clusters, "node")
    blocks = placed.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    placed = placed.join(blocks, "component").selectExpr("node", "component", "blocks", "cast(pmod(xxhash64(node), blocks) as int) as block")
    copies = sets.join(placed, "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    copies = copies.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "copies", "block", "grams")
    found = scratch.put(copies.groupBy("component", "i", "j").applyInArrow(_compare(percent, fragments), "node long, low long, links long"), "links")

    groups = connected_components(scratch, found.where("low < node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    named = classes.join(groups, "node", "left").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = scratch.put(named.join(lowest, "component").select("d1", "d2", "component_id", F.expr("copies - 1 + coalesce(links, 0L)").alias("links")), "named")
    out = texts.join(named, ["d1", "d2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.expr("if(n = 0, doc_id, component_id)").alias("component_id"))
    result = scratch.put(out, "result")
    scratch.close(keep=result)
    return result


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents that are their component's representative, the row with the smallest id.

    Rows without id or text stay. Rows that share the smallest id all stay.
    """
    gone = jaccard_components(docs, **options).groupBy("doc_id").agg(F.bool_or(F.expr("doc_id = component_id")).alias("first")).where("not first").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) end as grams from w),
t as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
p as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as common
  from t x join t y on x.gram = y.gram and x.doc_id <> y.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by 1, 2),
l as (select a, b from p where 100 * common >= 80 * (n + m - common)),
c(a, c) as (select a, a from l union select l.a, c.c from c join l on l.b = c.a where c.c < l.a)
select doc_id, len(grams)::bigint as n_shingles, (select count(*) from l where l.a = s.doc_id) as n_links, coalesce(least(doc_id, (select min(c.c) from c where c.a = doc_id)), doc_id) as component_id from s
"""

