"""A Merkle tree over a dataset: leaves by source and doc_id, proofs for every row, verification by folding.

Leaves are SHA-256 digests of rows. In each source they stand by ascending doc_id; 16 consecutive nodes become
one digest until one is left, the source's subroot. The subroots, by source, become the root likewise.

* A leaf's place in its source is a rank query, not a sort. The ids of a source are a bitmap of 64-bit words;
  only words with a bit are rows, and those of all tasks are merged by OR. Popcount directories hold the
  number of leaves before each word: sums over 1,024 words, over 1,024 of those, and so on as far as the ids reach,
  each summed up inside its parent only, so no window is longer. The rank is the word's directory entry
  plus the bits below the id's own.
* Levels are reduced by key: a node goes to slot (rank mod 16) of the array of its parent (source, rank div 16).
  A hot source is spread over its parents; each level is a sixteenth of the one below.
* Paths go from the root down: the children of a node get its path with their own siblings before it, so what
  the leaves of one parent share travels once. A proof is a path's digests, bottom up, left to right.

Defined cases: a null source is a source of its own and the first; a null id comes before all ids of its source;
rows that share a source and an id stand by their digests, equal ones in any order (their tree is the same);
a table without rows gives no rows; further columns are left out; text length is bounded by a string's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

FAN = 16
#: Directory entries that are summed in one place: 2**10.
STEP = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields=FIELDS, **changed: Column) -> Column:
    """The digest of a row: of each field '-' where it is null, else its length in bytes, a colon and its value."""
    parts = []
    for name in fields:
        value = changed.get(name, F.col(f"`{name}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf up, left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


# places of the leaves ------------------------------------------------------------------------------------


def _earlier(value: str, *group: str, order: list[str]) -> Column:
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _directory(ids: DataFrame, low: int, high: int) -> DataFrame:
    """(g, word, bits, n, start): the bitmap of each g's ids with the number of leaves before each word."""
    tables = [ids.groupBy("g", F.expr("shiftright(doc_id, 6)").alias("k0")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 as int))")).alias("bits"), F.count("*").alias("n"))]
    reach = 6
    while (high >> reach) - (low >> reach) >= 1 << STEP:
        reach += STEP
        k = len(tables)
        tables.append(tables[-1].groupBy("g", F.shiftright(f"k{k - 1}", STEP).alias(f"k{k}")).agg(F.sum("n").alias("n")))
    top = len(tables) - 1
    starts = tables[top].withColumn("start", _earlier("n", "g", order=[f"k{top}"]))
    for k in range(top - 1, -1, -1):
        up = starts.select("g", f"k{k + 1}", F.col("start").alias("_up"))
        inside = tables[k].withColumn(f"k{k + 1}", F.shiftright(f"k{k}", STEP)).withColumn("_inside", _earlier("n", "g", f"k{k + 1}", order=[f"k{k}"]))
        starts = inside.join(up, ["g", f"k{k + 1}"]).withColumn("start", F.col("_up") + F.col("_inside")).drop("_up", "_inside", f"k{k + 1}")
    return starts.withColumnRenamed("k0", "word")


def _tied(rows: DataFrame) -> DataFrame:
    """rank of rows (g, word, start, doc_id, leaf, u) whose word holds repeated ids: by id and digest; u tells rows apart.

    Sums go from ids and the digests' first digits to digests to rows, copies dealt by u, so no window holds
    all rows of a repeated id.
    """
    rows = rows.withColumns({"_bit": F.coalesce(F.expr("doc_id & 63"), F.lit(0)), "_head": F.substring("leaf", 1, 4), "_salt": F.expr("pmod(xxhash64(u), 1024)")})
    heads = rows.groupBy("g", "word", "_bit", "_head").agg(F.count("*").alias("_n"))
    heads = heads.withColumn("_a", _earlier("_n", "g", "word", order=["_bit", "_head"])).drop("_n")
    parts = rows.groupBy("g", "word", "_bit", "_head", "leaf", "_salt").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_b", _earlier("_n", "g", "word", "_bit", "_head", order=["leaf", "_salt"])).drop("_n")
    starts = parts.join(heads, ["g", "word", "_bit", "_head"])
    inside = F.row_number().over(Window.partitionBy("g", "word", "_bit", "_head", "leaf", "_salt").orderBy("u")) - 1
    placed = rows.withColumn("_c", inside).join(starts, ["g", "word", "_bit", "_head", "leaf", "_salt"])
    return placed.withColumn("rank", F.expr("start + _a + _b + _c")).drop("word", "start", "_bit", "_head", "_salt", "_a", "_b", "_c")


def _placed(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """The leaves (g, doc_id, leaf, u, ...) with their rank in g."""
    reach = leaves.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    parts = []
    if reach["low"] is not None:
        directory = scratch.put(_directory(leaves.where("doc_id is not null").select("g", "doc_id"), reach["low"], reach["high"]), "directory")
        if reach["nulls"]:
            before = leaves.where("doc_id is null").groupBy("g").agg(F.count("*").alias("_before"))
            directory = directory.join(before, "g", "left").withColumn("start", F.expr("start + coalesce(_before, 0)")).drop("_before")
        at = leaves.where("doc_id is not null").withColumn("word", F.expr("shiftright(doc_id, 6)")).join(directory, ["g", "word"])
        rank = F.expr("start + bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 as int)))")
        parts.append(at.where("n = bit_count(bits)").withColumn("rank", rank).drop("word", "bits", "n", "start"))
        if not directory.where("n > bit_count(bits)").isEmpty():
            parts.append(_tied(at.where("n > bit_count(bits)").drop("bits", "n")))
    if reach["nulls"]:
        parts.append(_tied(leaves.where("doc_id is null").withColumns({"word": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})))
    out = parts[0] if parts else leaves.withColumn("rank", F.lit(0).cast("long"))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# levels --------------------------------------------------------------------------------------------------


def _left_over(level: int) -> Column:
    """How many nodes of g a level holds, from the number n of its leaves."""
    return F.expr(f"(n + {FAN**level - 1}L) div {FAN**level}L")


def _reduced(scratch: Scratch, nodes: DataFrame, most: int, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (g, n, i, h, payload) and the last node of each g: (g, h).

    A level's rows are (g, n, i, slots, h): the parent's slots in order, and its digest.
    """
    levels, tops = [], [nodes.where("n = 1").select("g", "h")]
    while most > 1:
        level = len(levels) + 1
        some = nodes.where(_left_over(level - 1) > 1)
        slot = F.struct(F.expr(f"i % {FAN}").alias("slot"), "h", *(payload if level == 1 else []))
        level_rows = some.groupBy("g", "n", F.expr(f"i div {FAN}").alias("i")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
        nodes = scratch.put(level_rows.withColumn("h", F.sha2(F.array_join("slots.h", ""), 256)), f"level{level}")
        levels.append(nodes)
        tops.append(nodes.where(_left_over(level) == 1).select("g", "h"))
        most = -(-most // FAN)
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return levels, out


def _children(parents: DataFrame, *more: str) -> DataFrame:
    """The slots of nodes (g, n, i, slots, path) as rows (g, n, i, s, path), each path with the own siblings before it."""
    side = lambda part: F.array_join(part, "")
    rows = parents.select("g", "n", "i", *more, "path", F.col("slots.h").alias("_hs"), F.posexplode("slots").alias("_k", "s"))
    own = F.struct(side(F.expr("slice(_hs, 1, _k)")).alias("left"), side(F.expr(f"slice(_hs, _k + 2, {FAN})")).alias("right"))
    return rows.select("g", "n", F.expr(f"i * {FAN} + _k").alias("i"), *more, "s", F.concat(F.array(own), "path").alias("path"))


def _descended(levels: list[DataFrame], tops: DataFrame, *more: str) -> DataFrame | None:
    """The slots of the lowest level with their paths, from (g, path) of the last nodes; None without a level."""
    paths = None
    for level in range(len(levels), 0, -1):
        rows = levels[level - 1]
        last = rows.where(_left_over(level) == 1).join(tops, "g")
        here = last if paths is None else last.unionByName(rows.where(_left_over(level) > 1).join(paths, ["g", "i"]))
        below = _children(here, *more)
        paths = below.select("g", "i", *more, "path")
    return below if levels else None


def _ordinals(scratch: Scratch, tops: DataFrame) -> DataFrame:
    """tops (g, ...) with i, the place of g among all: sorted by ranges, then numbered by the sizes of the ranges before."""
    ranged = tops.repartitionByRange("g").sortWithinPartitions("g")
    ranged = scratch.put(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.expr(f"monotonically_increasing_id() & {(1 << 33) - 1}L")}), "sources")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").withColumn("i", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def merkle_manifest(leaves: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, payload) of leaves (doc_id, source, leaf, payload).

    path: for each level from the leaf to the root the digests left and right of the own node, each side as one string.
    """
    spark = leaves.sparkSession
    scratch = Scratch(spark, "merkle")
    g = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = scratch.put(leaves.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("g"), "leaf", *payload, F.monotonically_increasing_id().alias("u")), "leaves")
    sizes = leaves.groupBy("g").agg(F.count("*").alias("n"))
    most, sources = sizes.agg(F.max("n"), F.count("*")).first()
    placed = _placed(scratch, leaves).join(sizes, "g").withColumnsRenamed({"rank": "i", "leaf": "h"}).drop("u")
    if not sources:
        scratch.close()
        empty = spark.createDataFrame([], leaves.drop("g", "u").schema)
        return empty.selectExpr("doc_id", "leaf", "'' as subroot", "'' as root", "cast(array() as array<struct<left:string,right:string>>) as path", *payload)
    alone = placed.where("n = 1") if most == 1 else scratch.put(placed.where("n = 1"), "alone")
    levels, tops = _reduced(scratch, placed, most, ["doc_id", *payload])

    tops = _ordinals(scratch, tops).withColumn("n", F.lit(sources).cast("long"))
    upper, root = _reduced(scratch, tops.withColumns({"subroot": F.col("h"), "of": F.col("g"), "g": F.lit("")}), sources, ["of"])
    root = root.first()["h"]
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = spark.range(1).select(F.lit("").alias("g"), none.alias("path"))
    below = _descended(upper, start)
    if below is None:
        ways = tops.select("g", none.alias("path"), F.col("h").alias("subroot"))
    else:
        ways = below.select(F.col("s.of").alias("g"), "path", F.col("s.h").alias("subroot"))
    ways = scratch.put(ways, "ways")
    single = alone.join(ways, "g").select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *payload)
    below = _descended(levels, ways, "subroot")
    if below is None:
        out = single
    else:
        out = below.select("s.doc_id", F.col("s.h").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *[F.col("s")[c].alias(c) for c in payload]).union(single)
    out.scratch = scratch
    return out


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = leaf_digest(text=F.translate("text", UPPER, LOWER))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered)
    tree = merkle_manifest(docs.select("doc_id", "source", leaf_digest().alias("leaf"), tampered.alias("tampered")), ("tampered",))
    out = tree.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    if not hasattr(tree, "scratch"):
        return out
    kept = tree.scratch.put(out, "manifest")
    tree.scratch.close(keep=kept)
    return kept


def _op13_sql(depth: int = 5, width: int = 3) -> str:
    """Levels up to ``depth`` of a source and ``width`` of the sources, each a table of its own."""
    field = lambda c: f"case when {c} is null then '-' else concat(octet_length(encode({c}::varchar)), ':', {c}::varchar) end"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(c) for c in FIELDS[:-1]) + f", {field(text)}))"
    sql = [
        "with recursive crc as (select list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(0, 8)), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t)",
        f"""l as (select doc_id, source, {leaf('text')} as h, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} as low,
  coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0, false) as bad from documents, crc)""",
        "a0 as (select if(source is null, '', concat('=', source)) as g, *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i, count(*) over (partition by source) as n from l)",
    ]
    up = lambda name, below, k: f"{name}{k} as (select g, n, i // 16 as i, array_agg(h order by i) as hs, sha256(string_agg(h, '' order by i)) as h from {below} where n > 16 ** {k - 1} group by g, n, i // 16)"
    sql += [up("a", f"a{k - 1}", k) for k in range(1, depth + 1)]
    tops = " union all ".join(["select g, h from a0 where n = 1", *[f"select g, h from a{k} where n > 16 ** {k - 1} and n <= 16 ** {k}" for k in range(1, depth + 1)]])
    sql += [f"b0 as (select '' as g, g as of, h, row_number() over (order by encode(g)) - 1 as i, count(*) over () as n from ({tops}))"]
    sql += [up("b", f"b{k - 1}", k) for k in range(1, width + 1)]
    sql += ["root as (" + " union all ".join(["select h from b0 where n = 1", *[f"select h from b{k} where n > 16 ** {k - 1} and n <= 16 ** {k}" for k in range(1, width + 1)]]) + ")"]
    tables = [("a", "x", k) for k in range(1, depth + 1)] + [("b", "y", k) for k in range(1, width + 1)]
    joins = " ".join(f"left join {t}{k} on {t}{k}.g = {'x.g' if t == 'a' else chr(39) * 2} and {t}{k}.i = {row}.i // (16 ** {k})::bigint" for t, row, k in tables)
    place = lambda row, k: f"({row}.i // (16 ** {k - 1})::bigint % 16)"
    left = lambda t, row, k: f"coalesce(array_to_string({t}{k}.hs[1 : {place(row, k)}], ''), '')"
    right = lambda t, row, k: f"coalesce(array_to_string({t}{k}.hs[{place(row, k)} + 2 :], ''), '')"
    columns = ["if(x.bad, x.low, x.h) as f0"]
    for j, (t, row, k) in enumerate(tables, 1):
        columns.append(f"if({t}{k}.hs is null, f{j - 1}, sha256(concat({left(t, row, k)}, f{j - 1}, {right(t, row, k)}))) as f{j}")
    siblings = ", ".join(f"{left(t, row, k)}, {right(t, row, k)}" for t, row, k in tables)
    sql += [f"o as (select x.doc_id, x.h as leaf, y.h as subroot, root.h as root, sha256(concat({siblings})) as proof_sha256, {', '.join(columns)} from a0 x join b0 y on y.of = x.g {joins}, root)"]
    return ",\n".join(sql) + f"\nselect doc_id, leaf, subroot, root, proof_sha256, f{len(tables)} as folded_root, f{len(tables)} = root as verified from o"


OP13_SQL = _op13_sql()
