"""M2: exact stratified train/test split that depends on the rows alone.

Per label, exactly round(fraction x n_label) rows go to test: those with the
least seeded content hashes. Partitioning, task order and repeated evaluation
don't matter, and no row needs an id.

The hash that holds a label's last test row is found in two steps: a histogram
over the first 16 bits (a partial aggregate; a window of at most 65,536 rows per
label, which also tells the label's rows and so how many go to test), then the
counts of the hashes in the one cell that holds the row, 1 in 65,536 of the
rows. The cut is one row per label, stored once: train and test read it instead
of finding it again. Rows are tagged in one projection that compares their hash
with the cut. Rows whose hash is the cut itself are counted by content, and the
counts are dealt out, so copies of one row that straddle the cut never meet in a
window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import stored_side

BITS = 60  # of the hash: 15 hexadecimal digits


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    assigned: DataFrame  # input columns + is_test

    @classmethod
    def of(cls, assigned: DataFrame) -> Split:
        return cls(assigned.filter(~F.col("is_test")).drop("is_test"), assigned.filter(F.col("is_test")).drop("is_test"), assigned)


def content_hash(columns: Sequence[str], seed: int = 42) -> Column:
    """A non-negative 60-bit hash of the columns' text, reproducible in any
    engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def _cut(labelled: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """(label, __cut, __take): the hash of each label's last test row, and how many
    rows of that hash go to test. Labels without test rows have none."""
    high = F.shiftright("__h", BITS - 16)
    of_label = Window.partitionBy(label)
    counts = labelled.groupBy(label, high.alias("__d")).agg(F.count(F.lit(1)).alias("__c"))
    ran = counts.select(
        label, "__d", "__c",
        F.round(F.sum("__c").over(of_label) * F.lit(float(test_fraction))).cast("long").alias("__k"),
        F.sum("__c").over(of_label.orderBy("__d").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__cum"),
    )
    ran = ran.withColumn("__rest", F.col("__k") - F.col("__cum") + F.col("__c"))
    cell = ran.filter((F.col("__rest") > 0) & (F.col("__cum") >= F.col("__k"))).select(label, "__d", "__rest")

    inside = labelled.join(F.broadcast(cell), label).filter(high == F.col("__d"))  # one row per label
    hashes = inside.groupBy(label, "__rest", "__h").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(label).orderBy("__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = hashes.withColumn("__cum", F.sum("__c").over(upto)).withColumn("__take", F.col("__rest") - F.col("__cum") + F.col("__c"))
    return found.filter((F.col("__take") > 0) & (F.col("__cum") >= F.col("__rest"))).select(label, F.col("__h").alias("__cut"), "__take")


def assign_split(
    df: DataFrame, label: str, test_fraction: float = 0.2, seed: int = 42, hash_columns: Sequence[str] | None = None
) -> DataFrame:
    """Add ``is_test`` to every row (exact per-label test counts).

    ``hash_columns`` (default: all) decide a row's place. Rows without a label
    stay in train.
    """
    cols = df.columns
    base = df.withColumn("__h", content_hash(hash_columns or cols, seed))
    h = F.col("__h")
    cut = stored_side(_cut(base.filter(F.col(label).isNotNull()).select(label, "__h"), label, test_fraction), "split-cut")

    tagged = base.join(F.broadcast(cut), label, "left")
    plain = tagged.filter(F.col("__cut").isNull() | (h != F.col("__cut")))
    plain = plain.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(h < F.col("__cut"), F.lit(False)).alias("is_test"))
    # Rows on the cut: their counts by content, the first __take go to test.
    edge = tagged.filter(h == F.col("__cut")).groupBy(*[F.col(f"`{c}`") for c in cols], "__take").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(label).orderBy(*[F.col(f"`{c}`") for c in cols]).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("__left", F.col("__take") - F.coalesce(F.sum("__c").over(before), F.lit(0)))
    edge = edge.select(*[F.col(f"`{c}`") for c in cols], "__left", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__c"))).alias("__i"))
    return plain.unionByName(edge.select(*[F.col(f"`{c}`") for c in cols], (F.col("__i") <= F.col("__left")).alias("is_test")))


def stratified_split(
    df: DataFrame, label: str, test_fraction: float = 0.2, seed: int = 42, hash_columns: Sequence[str] | None = None
) -> Split:
    return Split.of(assign_split(df, label, test_fraction, seed, hash_columns))


def stratified_split_counts(
    df: DataFrame, label: str, test_fraction: float = 0.2, seed: int = 42, hash_columns: Sequence[str] | None = None
) -> DataFrame:
    """Per label: rows in train and in test, and an order-independent digest of
    the test rows (sum of their hashes modulo a prime)."""
    assigned = assign_split(df, label, test_fraction, seed, hash_columns)
    h = content_hash(hash_columns or df.columns, seed) % 1_000_003
    return assigned.groupBy(F.col(label).alias("label")).agg(
        F.count_if(~F.col("is_test")).alias("train_rows"),
        F.count_if(F.col("is_test")).alias("test_rows"),
        F.coalesce(F.sum(F.when(F.col("is_test"), h)), F.lit(0)).cast("long").alias("test_digest"),
    )
