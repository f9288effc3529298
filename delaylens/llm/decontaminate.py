"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``width`` consecutive words (one window if it
has fewer). A window's tokens are its shingles of ``gram`` words. A window can
only occur where all its shingles stand, so one shingle, the rarest over all
documents, is a sufficient prefix.

1. One pass over the documents keeps the places of benchmark shingles
   (postings) and one row per document with its number of words.
2. Shingles are ordered by their frequency over all documents. Windows with a
   shingle that no document has are dropped; of the others the rarest shingle
   joins the postings, under length and positional bounds.
3. A candidate place is verified against every shingle of its window at its own
   offset. Neighbouring shingles overlap in all but one word, so agreement of
   all of them (64-bit hashes) is agreement word by word.
4. Hit words are the union of the verified places.

Built-in expressions only. The benchmark's tables are stored, so Spark knows
their bytes when it plans the joins: below the session's broadcast threshold
they are broadcast, beyond it shuffled, and AQE splits hot shingles.

Defined results: a null text, of a document or an item, has no words; an item
without words has no windows; a document without hits is not contaminated.
Items that share an id count once; a null item id is no id and isn't listed.
Rows that share id and text are copies with equal results; rows that share an
id only stay apart. Extra columns are ignored. An empty benchmark leaves all
documents clean; empty documents give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_on_rows, stage, text_key, text_or_empty

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, GRAM = 13, 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + F.lit(k)) for k in range(size)])


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by their start."""
    none = F.array().cast("array<bigint>")
    at = F.sequence(F.lit(0), F.size(words) - F.lit(size))
    return F.when(F.size(words) < size, none).otherwise(F.transform(at, lambda i: shingle(words, i, size)))


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, window, n): the windows of every item, as arrays of words."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words_of(text_or_empty(text_col)).alias("words"))
    n = F.least(F.lit(width), F.size("words"))
    at = F.sequence(F.lit(1), F.size("words") - n + 1)
    return (
        rows.filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(at, lambda i: F.slice("words", i, n))).alias("window"))
        .distinct()
        .withColumn("n", F.size("window"))
    )


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM):
    """(rows, places): a row (__id, __key, n_words) per document, and the
    verified places (__id, __key, start, n, window_id), start from 0."""
    spark = docs.sparkSession
    names = stage(windows.select("window", "n").distinct().withColumn("window_id", F.sha2(F.array_join("window", " "), 256)), "windows")
    sizes = sorted({min(gram, r.n) for r in names.select("n").distinct().collect()})  # 1 to gram
    size_of = F.least(F.lit(gram), F.col("n"))
    parts = [
        names.filter(size_of == s).select("window_id", "n", F.lit(s).alias("size"), F.posexplode(shingles(F.col("window"), s)).alias("offset", "gram"))
        for s in sizes
    ]
    empty = "window_id string, n int, size int, offset int, gram bigint"
    grams = stage(reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], empty), "window-grams")

    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("__id"), text_key(text).alias("__key"), words_of(text).alias("words"))
    first = F.array(F.lit(None).cast("bigint"))  # stands for the document itself
    every = F.concat(first, *[shingles(F.col("words"), s) for s in sizes])
    places = base.select("__id", "__key", F.size("words").alias("n_words"), F.posexplode(every).alias("at", "gram"))
    wanted = stage(grams.select("gram", "size").distinct(), "wanted-grams")
    matched = places.join(wanted, "gram", "left").filter((F.col("at") == 0) | F.col("size").isNotNull())
    ahead, start = F.lit(1), F.lit(None).cast("int")  # places of the sizes before
    for s in sizes:
        start = F.coalesce(start, F.when(F.col("size") == s, F.col("at") - ahead))
        ahead = ahead + F.greatest(F.col("n_words") - s + 1, F.lit(0))
    postings = stage(matched.select("__id", "__key", F.col("n_words").cast("long").alias("n_words"), "gram", start.alias("at")), "postings")

    rows = postings.filter(F.col("gram").isNull()).select("__id", "__key", "n_words")
    # A copy of a row repeats its postings; one of each is enough.
    held = postings.filter(F.col("gram").isNotNull())
    frequency = held.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    prefix = (
        grams.join(frequency, "gram")
        .groupBy("window_id", "n", "size")
        .agg(F.min(F.struct("f", "offset", "gram")).alias("rarest"), F.count(F.lit(1)).alias("present"))
        .filter(F.col("present") == F.col("n") - F.col("size") + 1)
        .select("window_id", "n", "size", "rarest.offset", "rarest.gram")
    )
    prefix = stage(prefix, "window-prefixes")
    at = F.col("at") - F.col("offset")
    candidates = (
        held.join(prefix, "gram")
        .select("__id", "__key", "window_id", "n", "size", at.alias("start"), "n_words")
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    )
    checks = candidates.join(grams.select("window_id", "offset", "gram"), "window_id").select(
        "__id", "__key", "window_id", "n", "size", "start", (F.col("start") + F.col("offset")).alias("at"), "gram"
    )
    have = held.select(F.col("__id").alias("h_id"), F.col("__key").alias("h_key"), F.col("at").alias("h_at"), F.col("gram").alias("h_gram"))
    verified = (
        checks.distinct()
        .join(
            have,
            F.col("__id").eqNullSafe(F.col("h_id")) & (F.col("__key") == F.col("h_key")) & (F.col("at") == F.col("h_at")) & (F.col("gram") == F.col("h_gram")),
            "left_semi",
        )
        .groupBy("__id", "__key", "window_id", "n", "size", "start")
        .agg(F.count(F.lit(1)).alias("agreed"))
        .filter(F.col("agreed") == F.col("n") - F.col("size") + 1)
        .select("__id", "__key", "start", "n", "window_id")
    )
    return rows, verified


def covered_words(places: Column) -> Column:
    """Length of the union of (start, n) ranges that are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))

    def step(a: Column, p: Column) -> Column:
        stop = (p["start"] + p["n"]).cast("long")
        return F.struct(
            (a["total"] + F.greatest(F.lit(0).cast("long"), stop - F.greatest(a["end"], p["start"].cast("long")))).alias("total"),
            F.greatest(a["end"], stop).alias("end"),
        )

    return F.aggregate(places, zero, step, lambda a: a["total"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    share: int = 20,
) -> DataFrame:
    """One row per document: __id, __key, n_words, n_hit, items (sorted) and
    contaminated (a ``share``-th of the words or more are hit)."""
    windows = stage(benchmark_windows(items, item_col, item_text_col, width), "benchmark-windows")
    rows, places = find_windows(docs, windows, id_col, text_col, gram)
    places = stage(places, "window-places")
    hit = places.select("__id", "__key", "start", "n").distinct().groupBy("__id", "__key").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("p"))
    hit = hit.select("__id", "__key", covered_words(F.col("p")).alias("n_hit"))
    owners = windows.filter(F.col("item").isNotNull()).select(F.sha2(F.array_join("window", " "), 256).alias("window_id"), "item")
    found = (
        places.select("__id", "__key", "window_id")
        .distinct()
        .join(stage(owners, "window-items"), "window_id")
        .groupBy("__id", "__key", "item")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("__id", "__key")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    out = join_on_rows(join_on_rows(rows, hit, "left"), found, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "__id",
        "__key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    judged = contamination(docs, items, id_col, text_col, **options)
    bad = stage(judged.filter("contaminated").select("__id", "__key").distinct(), "contaminated")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        text_key(text_or_empty(text_col)).alias("__key"),
    )
    return join_on_rows(packed, bad, "left_anti").select("__row.*")
