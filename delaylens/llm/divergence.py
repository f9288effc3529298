"""Source divergence audit: how far each source's term use is from that of the
other sources of its language, and which terms stand out.

Terms are counted once, in one pass over the texts. Per language the terms found
in enough documents are kept; a group's smoothed price of a term is

    p = 1 + floor(10^9 (count + 2) / (N + 2 V)),

and two prices p, q differ by floor((p - q)^2 / (p + q)). The distance of two
groups is the sum over all kept terms.

One-hot level products: in a block of terms, a group's counts fall on few
levels. An indicator matrix has a column for each (group, level) and a row for
each term; the product of its transpose with itself holds the joint table of
every two groups: how many terms stand at level x in the one and y in the
other. Each cell is priced once and multiplied by its number of terms, in
integers. Blocks cover terms of like frequency (common terms have many levels, so
their blocks are short) and two parcels of groups, so a task's matrices are
bounded whatever the vocabulary and the number of groups; joint tables add up over
blocks, and so do their prices. Products are exact: entries count at most the
terms of a block, far below 2^24.

Defined results: null text, group and part read as ''. A group without terms has
rows of part ``pair`` like any other; a language without kept terms has values
of 0. Copies of a row count as often as they stand. Extra columns are ignored;
an empty table gives no rows. A term may be as long as its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage

SCALE, PSEUDO = 1_000_000_000, 2
TERMS, LEAST_TERMS = 2048, 64  # of a block: rare terms, common terms
PARCEL = 24  # groups in a parcel, about
HELD = 400_000  # counts that a task holds before it passes them on

#: Separators become blanks, A-Z lower case; all other bytes belong to terms.
_FOLD = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters A-Z, lower-cased, and of
    characters beyond ASCII."""
    return text.translate(_FOLD).split()


_COUNTS = "grp string, part string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by (group, part) in what the task
    has read since it last passed counts on."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

    def out() -> pa.RecordBatch:
        rows = [(g, p, t, n, d) for (g, p), terms in held.items() for t, (n, d) in terms.items()]
        held.clear()
        cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["grp", "part", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for g, p, text in zip(*(batch.column(i) for i in range(3))):
            terms = held.setdefault((g.as_py(), p.as_py()), {})
            before = len(terms)
            for t, n in Counter(terms_of(text.as_py())).items():
                have = terms.get(t)
                if have is None:
                    terms[t] = [n, 1]
                else:
                    have[0] += n
                    have[1] += 1
            size += len(terms) - before
            if size >= HELD:
                yield out()
                size = 0
    yield out()


def term_counts(docs: DataFrame, group: str, part: str, text: str) -> DataFrame:
    """(grp, part, term, n, docs) of all texts, n occurrences in docs documents."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (group, part, text)]
    read = docs.select(columns[0].alias("grp"), columns[1].alias("part"), columns[2].cast("binary").alias("text"))
    return map_arrow(read, _count, _COUNTS).groupBy("grp", "part", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _level_product(a_cols: np.ndarray, b_cols: np.ndarray, rows: int, a_n: int, b_n: int) -> np.ndarray:
    """Transposed indicator matrix times indicator matrix; ``*_cols`` hold the
    column of each (row, group)."""
    left, right = np.zeros((rows, a_n), np.float32), np.zeros((rows, b_n), np.float32)
    at = np.arange(rows)[:, None]
    left[at, a_cols] = 1
    if a_cols is b_cols:
        return left.T @ left
    right[at, b_cols] = 1
    return left.T @ right


def _columns(group: np.ndarray, term: np.ndarray, price: np.ndarray, names: int, rows: int, zero: np.ndarray):
    """One-hot columns of a parcel: the column of each (term, group), and each
    column's price and group. A level is a distinct price of a group; terms that
    a group lacks stand at its zero level."""
    at = np.empty((rows, names), np.int64)
    at[:] = zero
    at[term, group] = price
    cols, prices, groups, base = np.empty_like(at), [], [], 0
    for g in range(names):
        levels, place = np.unique(at[:, g], return_inverse=True)
        cols[:, g] = place.reshape(-1) + base
        prices.append(levels)
        groups.append(np.full(len(levels), g))
        base += len(levels)
    return cols, np.concatenate(prices), np.concatenate(groups)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _price_block(table: pa.Table) -> pa.Table:
    """The summed differences of all pairs of groups of two parcels over one block
    of terms. Rows without a term tell a group's zero level and the block's number
    of terms: those that both parcels lack are rows of the matrices too."""
    marks, entries = table.filter(pc.is_null(table["term"])), table.filter(pc.is_valid(table["term"]))
    terms = entries["term"].combine_chunks().dictionary_encode()
    row, rows = terms.indices.to_numpy(), marks["terms"][0].as_py()
    price, side = entries["price"].to_numpy(), entries["side"].to_numpy()
    parts = entries["part"].combine_chunks().dictionary_encode()
    parcels = []
    for s in (0, 1):
        own = marks.filter(pc.equal(marks["side"], s))
        names, here = own["part"].to_pylist(), side == s
        index = {n: k for k, n in enumerate(names)}
        code = np.array([index.get(n, -1) for n in parts.dictionary.to_pylist()], np.int64)
        parcels.append((names, code[parts.indices.to_numpy()[here]], row[here], price[here], own["price"].to_numpy()))
    alone = table["low"][0].as_py() == table["high"][0].as_py()  # a parcel with itself
    a, b = parcels[0], parcels[0] if alone else parcels[1]
    sums = np.zeros((len(a[0]), len(b[0])), np.int64)
    if sums.size and rows:
        a_cols = _columns(*a[1:4], len(a[0]), rows, a[4])
        b_cols = a_cols if alone else _columns(*b[1:4], len(b[0]), rows, b[4])
        joint = _level_product(a_cols[0], b_cols[0], rows, len(a_cols[1]), len(b_cols[1]))
        x, y = np.nonzero(joint)
        value = joint[x, y].astype(np.int64) * difference(a_cols[1][x], b_cols[1][y])
        np.add.at(sums, (a_cols[2][x], b_cols[2][y]), value)
    out = [(p, q, int(sums[i, k])) for i, p in enumerate(a[0]) for k, q in enumerate(b[0]) if not (alone and i == k)]
    if not alone:
        out += [(q, p, v) for p, q, v in out]
    cols = list(zip(*out)) if out else [(), (), ()]
    grp = pa.array([table["grp"][0].as_py()] * len(out), pa.string())
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.table([grp, *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["grp", "part", "item", "value"])


def _price(n: str, total: str, kept: str):
    """p of a count, in decimals: a count of 10^10 is beyond a long's range."""
    return F.expr(f"1 + (cast({n} + {PSEUDO} as decimal(20,0)) * {SCALE}) div (cast({total} as decimal(20,0)) + 2 * {kept})")


def audit(docs: DataFrame, group: str = "lang", part: str = "source", text: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(grp, part, kind, item, value, rank): kind ``pair`` has the distance to each
    other part of the group, kind ``term`` the ``top`` terms by which a part exceeds
    its group."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (group, part)]
    parts = stage(docs.select(names[0].alias("grp"), names[1].alias("part")).distinct(), "audit-parts")
    counts = stage(term_counts(docs, group, part, text), "audit-counts")
    whole = counts.groupBy("grp", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs"))
    kept = whole.filter(F.col("all_docs") >= least_docs).drop("all_docs")
    # blocks: terms of like frequency, the more common the fewer
    kept = stage(kept.withColumn("band", (F.length(F.bin("all_n")) - 1).cast("int")), "audit-kept")
    room = F.greatest(F.lit(LEAST_TERMS), F.least(F.lit(TERMS), F.expr("shiftright(16384, band)")))
    room = F.when(F.col("band") < 31, room).otherwise(LEAST_TERMS)
    bands = kept.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("terms")).select("grp", "band", F.ceil(F.col("terms") / room).alias("blocks"))
    kept = kept.join(bands, ["grp", "band"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    kept = stage(kept, "audit-terms")
    blocks = kept.groupBy("grp", "band", "block").agg(F.count(F.lit(1)).cast("int").alias("terms"))
    entries = stage(counts.drop("docs").join(kept, ["grp", "term"]), "audit-entries")

    # sizes: of a group's kept terms and of each part's
    groups = kept.groupBy("grp").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    totals = entries.groupBy("grp", "part").agg(F.sum("n").alias("total"))
    parcels = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("grp")) / PARCEL)
    sizes = parts.join(totals, ["grp", "part"], "left").join(groups, "grp", "left")
    sizes = sizes.select(
        "grp", "part", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_total", F.lit(0)).alias("all_total"),
        F.pmod(F.xxhash64("part"), parcels).cast("int").alias("parcel"), parcels.cast("int").alias("parcels"),
    )
    sizes = stage(sizes, "audit-sizes")

    priced = entries.join(sizes, ["grp", "part"]).select(
        "grp", "part", "term", "parcel", "parcels", "band", "block",
        _price("n", "total", "v").alias("price"), _price("all_n", "all_total", "v").alias("whole_price"),
    )
    priced = stage(priced, "audit-priced")

    # zero levels: one for each part and block; a group without terms has one block
    none = sizes.filter("v = 0").select("grp", F.lit(0).alias("band"), F.lit(0).alias("block"), F.lit(0).alias("terms")).distinct()
    zero = F.when(F.col("v") > 0, _price("0", "total", "greatest(v, 1)")).otherwise(F.lit(1))
    marks = sizes.withColumn("price", zero.cast("long")).join(blocks.unionByName(none), "grp")
    fields = ["grp", "part", "parcel", "parcels", "band", "block", "price"]
    cells = priced.select(*fields, "term", F.lit(None).cast("int").alias("terms"))
    cells = cells.unionByName(marks.select(*fields, F.lit(None).cast("binary").alias("term"), "terms"))
    # a parcel meets itself and every other one: side 0 is the lower
    met = F.transform(
        F.sequence(F.lit(0), F.col("parcels") - 1),
        lambda o: F.struct(F.least("parcel", o).alias("low"), F.greatest("parcel", o).alias("high"), F.when(F.col("parcel") > o, 1).otherwise(0).alias("side")),
    )
    cells = cells.withColumn("m", F.explode(met)).select("grp", "part", "term", "terms", "price", "band", "block", "m.*")
    partial = cells.groupBy("grp", "band", "block", "low", "high").applyInArrow(_price_block, "grp string, part string, item string, value long")
    pairs = partial.groupBy("grp", "part", "item").agg(F.sum("value").alias("value")).withColumn("kind", F.lit("pair"))

    p, q = F.col("price"), F.col("whole_price")
    above = priced.filter(p > q).select("grp", "part", F.col("term").cast("string").alias("item"), F.expr("((price - whole_price) * (price - whole_price)) div (price + whole_price)").alias("value"), F.lit("term").alias("kind"))
    order = Window.partitionBy("grp", "part", "kind").orderBy(F.desc("value"), "item")
    first = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["grp", "part", "kind", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(first.select(*columns))
