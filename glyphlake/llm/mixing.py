"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Every source is cut into blocks. Block i (from 1) of a source with weight w of W in all may not run
before slot floor((i - 1) W / w) and must have run by slot ceil(i W / w); earliest deadline first, among
the released blocks, keeps each source less than one block from its target share after every slot. The
schedule repeats after W slots, so one period is computed (a fold over W slots for k sources, on one
row) and every block finds its slot by division. A source that has run out leaves its slots empty.

Ranks inside a source come from the counts of its hash buckets, so that no task holds a whole source.

Defined cases: a null source is a source of its own; sources without a target weight, or with weight 0,
get weight 1; sources named in the weights but without rows leave empty slots; an empty table gives an
empty result; rows that tie in ``key`` stand next to each other in any order; input columns named like
the results (block, slot, place) are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import without

#: More sources than this are refused: the schedule of one period is a table of their weights' sum.
MAX_SOURCES = 10_000
PERIOD = 1000
BLOCK = 16


def spread_rank(df: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Rank from 0 in each group by (bucket, order); tasks hold one bucket of a group, not a group.

    The bucket must not be null; group values may be. Rows move once: the ranks inside a bucket and the bucket's
    start meet on the same keys.
    """
    keys = [f"_g{k}" for k in range(len(group))]
    df = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for k, g in zip(keys, group)})
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    joined = inner.join(starts, [*keys, bucket])
    return joined.withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_rn", "_start", *keys)


def integer_weights(sizes: list[tuple[str | None, int]], weights: dict | None, period: int) -> list[tuple[str | None, int]]:
    """Whole weights of at least 1 with sum ``period`` (or the number of sources, if larger): the targets.

    Without weights a source's target grows with the square root of its rows. Largest remainders first,
    ties by name.
    """
    if not sizes:
        return []
    weights = {None if s is None else str(s): w for s, w in weights.items()} if weights is not None else None
    wanted = [max(0.0, float(weights.get(s, 0.0))) if weights is not None else float(n) ** 0.5 for s, n in sizes]
    spare = max(0, period - len(sizes))
    total = sum(wanted) or 1.0
    exact = [w * spare / total for w in wanted]
    whole = [int(x) for x in exact]
    left = spare - sum(whole) if sum(wanted) else 0
    order = sorted(range(len(sizes)), key=lambda k: (-(exact[k] - whole[k]), str(sizes[k][0])))
    for k in order[:left]:
        whole[k] += 1
    return [(s, 1 + whole[k]) for k, (s, _) in enumerate(sizes)]


def period_schedule(spark, targets: list[tuple[str | None, int]]) -> DataFrame:
    """(source, weight, ordinal, slot) of one period; the table has as many rows as the weights' sum."""
    # from Arrow: rows of Python objects would be read by Python workers, on the executors
    rows = spark.createDataFrame(pa.table({"sources": pa.array([[s for s, _ in targets]], pa.list_(pa.string())), "w": pa.array([[w for _, w in targets]], pa.list_(pa.int32()))}))
    total = sum(w for _, w in targets)
    pick = (
        f"array_min(filter(transform(w, (x, j) -> if(get(s.next, j) <= x and floor((get(s.next, j) - 1) * {total}L / x) <= t, "
        f"struct(ceil(get(s.next, j) * {total}L / x) as due, j as j, get(s.next, j) as i), null)), c -> c is not null))"
    )
    step = f"transform(array({pick}), c -> struct(transform(s.next, (v, j) -> if(j = c.j, v + 1, v)) as next, array_append(s.chosen, struct(c.j as j, c.i as i)) as chosen))[0]"
    fold = f"aggregate(sequence(0, {total - 1}), struct(transform(w, x -> 1) as next, cast(array() as array<struct<j:int,i:int>>) as chosen), (s, t) -> {step}, s -> s.chosen)"
    chosen = rows.select("sources", "w", F.posexplode(F.expr(fold)).alias("slot", "c"))
    return chosen.selectExpr("get(sources, c.j) as source", "get(w, c.j) as weight", "c.i - 1 as ordinal", "slot")


def _sizes(docs: DataFrame, source: str) -> list[tuple[str | None, int]]:
    """Rows by source, in the order of the sources' names, null first."""
    sizes = docs.groupBy(F.col(f"`{source}`").cast("string").alias("s")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted(((r["s"], r["n"]) for r in sizes), key=lambda x: (x[0] is not None, x[0] or ""))


def _ranked(docs: DataFrame, source: str, key: str) -> DataFrame:
    """(_row, _s, _rank): the rows with their rank in their source, by md5(key)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{source}`").cast("string").alias("_s"), F.col(f"`{key}`").alias("_k"))
    rows = rows.withColumn("_h", F.md5(F.coalesce(F.col("_k").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_h", 1, 3))
    return spread_rank(rows, ["_s"], "_bucket", ["_h", "_k"], "_rank")


def _placed(ranked: DataFrame, targets: list[tuple[str | None, int]], block_rows: int) -> DataFrame:
    """Add block, slot and place to rows with _s and _rank."""
    total = sum(w for _, w in targets) or 1
    ranked = ranked.withColumn("block", F.expr(f"_rank div {block_rows}")).withColumn("place", F.expr(f"_rank % {block_rows}"))
    if not targets:
        return ranked.withColumn("slot", F.lit(0).cast("long"))
    plan = F.broadcast(period_schedule(ranked.sparkSession, targets).withColumnsRenamed({"source": "_t", "slot": "_slot"}))
    placed = ranked.join(plan, F.col("_s").eqNullSafe(F.col("_t")) & (F.expr("block % weight") == F.col("ordinal")))
    return placed.withColumn("slot", F.expr(f"(block div weight) * {total}L + _slot"))


def pfair_mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, block_rows: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The rows with block (of their source, from 0), slot (of the block) and place (in the block).

    All rows stay. Read in the order (slot, place), every prefix of slots holds each source's target
    share to less than one block until the first source runs out. Rows of a source are dealt to its
    blocks in the order of md5(key).
    """
    targets = integer_weights(_sizes(docs, source), weights, period)
    kept = without(docs, "block", "slot", "place")
    return _placed(_ranked(docs.select(*[f"`{c}`" for c in kept]), source, key), targets, block_rows).select("_row.*", "block", "slot", "place")


def row_hashes(docs: DataFrame) -> list[Column]:
    """128 bits of a whole row, equal for its copies only."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit("copy"), *columns).alias("_b")]


def _distinct_weights(docs: DataFrame, source: str) -> dict:
    """Targets as the square root of a source's distinct rows: the same before and after rows are repeated."""
    return {s: n**0.5 for s, n in _sizes(docs.select(F.col(f"`{source}`"), *row_hashes(docs)).distinct(), source)}


def _room(sizes: list[tuple[str | None, int]], targets: list[tuple[str | None, int]], schedule: list, block_rows: int) -> list[tuple[str | None, int, int]]:
    """(source, rows, room): room is how many rows the schedule takes from a source until every source has been read once."""
    total = sum(w for _, w in targets)
    slots: dict = {s: [0] * w for s, w in targets}
    for r in schedule:
        slots[r["source"]][r["ordinal"]] = r["slot"]
    ends = []
    for s, n in sizes:
        last = (n - 1) // block_rows
        ends.append(last // len(slots[s]) * total + slots[s][last % len(slots[s])] + 1)
    whole, rest = divmod(max(ends), total)
    return [(s, n, block_rows * (whole * len(slots[s]) + sum(x < rest for x in slots[s]))) for s, n in sizes]


def repeat_to_targets(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, block_rows: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The rows, repeated so that every source has its target share of the table to less than one block.

    The schedule runs until each source has been read once; a source that ends before begins again, and
    all blocks are full. So no row is dropped, and a source's rows are repeated equally often but for one.
    Copies of a row leave next to each other. ``scheduled`` finds their slots again.
    """
    spark = docs.sparkSession
    sizes = _sizes(docs, source)
    if not sizes:
        return docs
    targets = integer_weights(sizes, _distinct_weights(docs, source) if weights is None else weights, period)
    found = list(zip(*_room(sizes, targets, period_schedule(spark, targets).collect(), block_rows)))
    room = spark.createDataFrame(pa.table([pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.int64(), pa.int64()))], names=["_t", "_size", "_room"]))
    rows = _ranked(docs, source, key).join(F.broadcast(room), F.col("_s").eqNullSafe(F.col("_t")))
    copies = rows.withColumn("_copy", F.explode(F.expr("sequence(1L, (_room - _rank + _size - 1) div _size)")))
    return copies.select("_row.*")


def scheduled(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, block_rows: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """Slots of a table made by ``repeat_to_targets`` with the same targets: (_a, _b, _slots).

    _a and _b are the ``row_hashes``; _slots holds (slot, place) for each copy of the row. All first
    copies of a source come before its second ones.
    """
    weights = _distinct_weights(docs, source) if weights is None else weights
    targets = integer_weights(_sizes(docs, source), weights, period)
    rows = docs.select(F.col(f"`{source}`").cast("string").alias("_s"), F.col(f"`{key}`").alias("_k"), *row_hashes(docs)).groupBy("_s", "_k", "_a", "_b").agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_pass", F.explode(F.expr("sequence(0L, _n - 1)"))).withColumn("_h", F.md5(F.coalesce(F.col("_k").cast("string"), F.lit(""))))
    rows = rows.withColumn("_bucket", F.concat(F.lpad(F.col("_pass").cast("string"), 19, "0"), F.substring("_h", 1, 3)))
    # spread_rank has a column _b of its own
    ranked = spread_rank(rows.withColumnsRenamed({"_a": "_x", "_b": "_y"}), ["_s"], "_bucket", ["_h", "_k", "_x", "_y"], "_rank")
    placed = _placed(ranked, targets, block_rows)
    return placed.groupBy(F.col("_x").alias("_a"), F.col("_y").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("slot", "place"))).alias("_slots"))


def distinct_with_slots(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """Each distinct row of a repeated table once, with the places of all its copies in ``_slots`` (see ``scheduled``).

    Copies that lie next to each other meet before rows move.
    """
    once = docs.select("*", *row_hashes(docs)).dropDuplicates(["_a", "_b"])
    return once.join(slots, ["_a", "_b"]).drop("_a", "_b")


def spread_over_slots(rows: DataFrame) -> DataFrame:
    """A row for each entry of ``_slots``, with slot and place in its stead."""
    return rows.withColumn("_at", F.explode("_slots")).withColumns({"slot": F.col("_at.slot"), "place": F.col("_at.place")}).drop("_slots", "_at")


def op3_pfair_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", "block", "slot", "place")


OP3_SQL = f"""
with recursive n as (select source, count(*) as n from documents group by source),
k as (select greatest({PERIOD} - count(*), 0) as spare, sum(sqrt(n)) as total from n),
e as (select source, sqrt(n::double) * spare / total as exact, spare from n, k),
f as (select *, row_number() over (order by exact - floor(exact) desc, source) as rk, spare - sum(floor(exact)) over () as short from e),
w as (select source, 1 + floor(exact)::int + (rk <= short)::int as weight, row_number() over (order by source) as j from f),
a as (select list(weight order by j) as w, sum(weight)::bigint as total from w),
s as (
  select 0::bigint as t, list_transform(w, lambda x: 1::bigint) as nxt, 0::bigint as c, 0::bigint as i from a
  union all
  select t + 1, list_transform(range(1, len(w) + 1), lambda j: nxt[j] + (j = pick.j)::bigint), pick.j, pick.i
  from (select t, nxt, w, total, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda j: nxt[j] <= w[j] and (nxt[j] - 1) * total // w[j] <= t),
    lambda j: {{'due': (nxt[j] * total + w[j] - 1) // w[j], 'j': j, 'i': nxt[j]}})) as pick from s, a where t < total)),
p as (select t - 1 as slot, c as j, i - 1 as ordinal from s where t > 0),
r as (select doc_id, source, row_number() over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as rk from documents)
select doc_id, r.source, rk // {BLOCK} as block, ((rk // {BLOCK}) // weight) * (select total from a) + slot as slot, rk % {BLOCK} as place
from r join w on r.source is not distinct from w.source join p on p.j = w.j and p.ordinal = (rk // {BLOCK}) % weight
"""
