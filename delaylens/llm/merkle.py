"""Merkle manifest of a table, with leaf coordinates ranked in bitmaps.

A row's leaf is the SHA-256 of its fields; leaves of one group (language) in
ascending id form a tree with runs of two, and the groups' roots in order of the
groups form the tree above. Nothing is sorted to find a leaf's place:

1. ``coordinates``: every group's ids are a compressed bitmap, 64-bit words kept
   only where an id is set, merged over all partitions by OR. A popcount
   directory of four levels (words, then 2^16, 2^32 and 2^48 ids) holds the
   number of rows before each word, so the place of an id is its word's number
   plus the bits below its own. A window of the directory has at most 65,536
   entries, whatever the ids.
2. ``layers``: the places key slot arrays of 1,024 leaves; an array is reduced ten
   levels at once, the arrays' roots are the leaves of the next layer.
3. ``proofs``: siblings pass down the layers, an array at a time.

Rows that share an id (a null id included) are ordered by leaf; they alone are
ranked by range partitions, copies of one row counted first, so no task holds
all rows of one id.

Defined results: null fields are part of the leaf; a null group comes first.
Copies of a row have leaves of their own beside each other. One row alone is its
group's root; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 10  # levels reduced in one slot array
WIDTHS = (10, 16, 16)  # id bits between the levels of the directory, above words of 6

_before = (Window.unboundedPreceding, -1)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as part of a leaf: its UTF-8 length and itself, ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def leaves(docs: DataFrame, id_col: str, group_col: str, values: Sequence[Column], altered: Column | None = None) -> DataFrame:
    """(g, id, leaf, altered): ``g`` orders groups as text, a null one first;
    ``altered`` is another leaf to be checked in the row's place."""
    group = F.col(group_col).cast("string")
    return docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("g"),
        F.col(id_col).cast("long").alias("id"),
        leaf_of(values).alias("leaf"),
        (altered if altered is not None else F.lit(None).cast("string")).alias("altered"),
    )


# --------------------------------------------------------------------------- places

def bitmap_directory(rows: DataFrame) -> DataFrame:
    """(g, word, bits, n, before): the bitmap words of (g, id) rows, the number
    of rows in a word, and of rows of the group in words before it."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    words = rows.groupBy("g", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = stage(words, "bitmap-words")
    levels = [words.select("g", F.col("word").alias("k"), "n")]
    for width in WIDTHS:
        levels.append(levels[-1].groupBy("g", F.shiftright("k", width).alias("k")).agg(F.sum("n").alias("n")))
    running = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("k").rowsBetween(*_before)), F.lit(0))
    found = levels[-1].select("g", "k", running.alias("before"))
    for level, width in zip(levels[-2::-1], WIDTHS[::-1]):
        above = found.select("g", F.col("k").alias("up"), F.col("before").alias("base"))
        inside = Window.partitionBy("g", "up").orderBy("k").rowsBetween(*_before)
        ranked = level.withColumn("up", F.shiftright("k", width)).withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        found = ranked.join(above, ["g", "up"]).select("g", "k", (F.col("base") + F.col("inner")).alias("before"))
    return words.join(found.withColumnRenamed("k", "word"), ["g", "word"])


def ordered(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over all rows before this one in the order
    of ``by`` (unique), over range partitions whose sums are run up."""
    placed = stage(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), name)
    sums = placed.groupBy("part").agg(F.sum("n").alias("sum"))  # one row a partition
    running = Window.orderBy("part").rowsBetween(*_before)
    sums = sums.select("part", F.coalesce(F.sum("sum").over(running), F.lit(0)).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*by).rowsBetween(*_before))
    out = placed.withColumn("inner", F.coalesce(inside, F.lit(0))).join(F.broadcast(sums), "part")
    return out.withColumn("before", F.col("base") + F.col("inner")).drop("part", "base", "inner")


def coordinates(rows: DataFrame) -> DataFrame:
    """(g, pos, id, leaf, altered): each leaf's place in its group, from 0."""
    real = rows.filter(F.col("id").isNotNull())
    unnamed = rows.filter(F.col("id").isNull())
    first = unnamed.groupBy("g").agg(F.count(F.lit(1)).alias("unnamed"))
    directory = bitmap_directory(real.select("g", "id")).join(first, "g", "left")
    directory = stage(directory.select("g", "word", "bits", "n", (F.col("before") + F.coalesce("unnamed", F.lit(0))).alias("start")), "bitmap-directory")
    met = real.withColumn("word", F.shiftright("id", 6)).join(directory, ["g", "word"])
    single = F.bit_count("bits") == F.col("n")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))")
    plain = met.filter(single).select("g", (F.col("start") + below).alias("pos"), "id", "leaf", "altered")

    shared = met.filter(~single).select("g", "word", "start", "id", "leaf", "altered")
    shared = shared.unionByName(unnamed.select("g", F.lit(None).cast("long").alias("word"), F.lit(0).cast("long").alias("start"), "id", "leaf", "altered"))
    # null ids sort before all others, and in ranges as well
    counted = shared.groupBy("g", "word", "start", "id", "leaf").agg(F.first("altered").alias("altered"), F.count(F.lit(1)).alias("n"))
    ranked = stage(ordered(counted, ["g", "id", "leaf"], "shared-ids"), "shared-ranks")
    origin = ranked.groupBy("g", "word").agg(F.min("before").alias("origin")).withColumnsRenamed({"g": "og", "word": "ow"})
    ranked = ranked.join(origin, (F.col("g") == F.col("og")) & F.col("word").eqNullSafe(F.col("ow")))
    at = F.col("start") + F.col("before") - F.col("origin")
    copies = ranked.select("g", F.explode(F.sequence(at, at + F.col("n") - 1)).alias("pos"), "id", "leaf", "altered")
    return plain.unionByName(copies)


# --------------------------------------------------------------------------- trees

def _parents(nodes: Column) -> Column:
    pair = lambda i: digest(F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def _reduced(nodes: Column, steps: Column) -> Column:
    """All levels of a slot array, from its leaves up ``steps`` levels."""
    up = F.slice(F.sequence(F.lit(1), F.lit(BITS)), F.lit(1), steps)
    return F.aggregate(up, F.array(nodes), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def layers(nodes: DataFrame) -> list[DataFrame]:
    """The slot arrays of trees over (g, pos, leaf, further columns), a staged
    table (g, block, steps, slots, tree) a layer; the last has one array a tree."""
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    sizes = stage(sizes.select("g", height.cast("int").alias("height")), "tree-heights")
    highest = sizes.agg(F.max("height")).first()[0]
    if highest is None:
        return []
    out, j = [], 0
    while not out or j * BITS < highest:
        content = F.struct("pos", *[c for c in nodes.columns if c not in ("g", "pos")])
        arrays = nodes.groupBy("g", F.shiftright("pos", BITS).alias("block")).agg(F.array_sort(F.collect_list(content)).alias("slots"))
        steps = F.least(F.lit(BITS), F.greatest(F.lit(0), F.col("height") - j * BITS))
        arrays = arrays.join(sizes, "g").withColumn("steps", steps).drop("height")
        out.append(stage(arrays.withColumn("tree", _reduced(F.col("slots.leaf"), F.col("steps"))), f"slots-{j}"))
        nodes = out[-1].select("g", F.col("block").alias("pos"), F.element_at(F.element_at("tree", -1), 1).alias("leaf"))
        j += 1
    return out


def roots(top: DataFrame) -> DataFrame:
    """(g, root) of the last layer."""
    return top.select("g", F.element_at(F.element_at("tree", -1), 1).alias("root"))


def proofs(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """The slots of a layer with their ``proof``: for each level the sibling's
    digest (null: none) and whether it stands left, the siblings in the array
    first, then those ``above`` (g, block, chain)."""
    own = lambda i: F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(1), F.col("steps")),
        lambda level: F.struct(
            F.get(F.get("tree", level), F.call_function("shiftright", i, level).bitwiseXOR(F.lit(1))).alias("sibling"),
            (F.call_function("shiftright", i, level).bitwiseAND(F.lit(1)) == 1).alias("left"),
        ),
    )
    slots = F.transform("slots", lambda s, i: F.struct(s.alias("slot"), F.concat(own(i), F.col("chain")).alias("proof")))
    joined = arrays.join(above, ["g", "block"]).select("g", F.explode(slots).alias("e"))
    return joined.select("g", "e.slot.*", "e.proof")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(node: Column, at: Column) -> Column:
        s = at["sibling"]
        return digest(F.when(s.isNull(), node).when(at["left"], F.concat(s, node)).otherwise(F.concat(node, s)))

    return F.aggregate(proof, start, step)


def manifest(rows: DataFrame) -> DataFrame:
    """The tree over ``leaves`` rows: (g, pos, id, leaf, altered, subroot, root,
    proof, proof_sha256, folded_root, verified), the last two of the altered leaf
    where there is one."""
    rows = stage(rows, "leaves")
    nodes = stage(coordinates(rows), "coordinates")
    own = layers(nodes)
    if not own:
        schema = "g string, pos long, id long, leaf string, altered string, subroot string, root string, proof array<struct<sibling: string, left: boolean>>, proof_sha256 string, folded_root string, verified boolean"
        return rows.sparkSession.createDataFrame([], schema)
    groups = roots(own[-1]).select("g", F.col("root").alias("leaf"), F.lit(1).alias("n"))
    groups = ordered(groups, ["g"], "groups").select(F.lit("").alias("g"), F.col("before").alias("pos"), "leaf", F.col("g").alias("name"))
    forest = layers(stage(groups, "forest"))  # stored: a join on a constant would become a nested loop
    root = roots(forest[-1]).withColumnRenamed("root", "top")  # one row

    nothing = F.array().cast("array<struct<sibling: string, left: boolean>>")
    chain = forest[-1].select("g", "block", nothing.alias("chain"))
    for layer in forest[:0:-1]:
        chain = proofs(layer, chain).select("g", F.col("pos").alias("block"), F.col("proof").alias("chain"))
    tops = proofs(forest[0], chain).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), F.col("leaf").alias("subroot"), F.col("proof").alias("chain"))
    tops = stage(tops.withColumn("top", root.select("top").scalar()), "group-proofs")
    chain = tops.select("g", "block", "chain")
    for layer in own[:0:-1]:
        chain = proofs(layer, chain).select("g", F.col("pos").alias("block"), F.col("proof").alias("chain"))
    found = proofs(own[0], chain).join(tops.select("g", "subroot", F.col("top").alias("root")), "g")
    heads = F.array_join(F.transform("proof", lambda p: p["sibling"]), "")
    out = found.withColumn("proof_sha256", digest(heads)).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
