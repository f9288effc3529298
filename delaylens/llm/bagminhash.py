"""Near-duplicates by BagMinHash signatures of word-shingle multisets.

A text is the bag of its shingles of five words (lower-cased runs of letters,
digits and underscores; a text of one to four words is one shingle). The weight
of a shingle is its count. Weights are discretised at the integers and covered
by the dyadic bands (0,1], (1,2], (2,4], (4,8] ... Each pair of shingle and band
owns a Poisson process whose rate is the band's width, drawn from a hash of the
pair alone. A band wholly below the weight counts in full; the band that holds
the weight is halved again and again, each point falling to one half by a hash
bit, until it is settled on which side of the weight the point lies. A point
belongs to one of ``m`` components at random; a component's value is the first
arrival. Two bags agree in a component with a probability of exactly their
weighted Jaccard similarity. Processes stop at the largest value still standing,
so a bag of n shingles needs about n + m log m points.

Steps: signatures (one pass, no shuffle) -> one representative per bag -> band
keys -> buckets of two and more. Every bag meets the centre of a bucket that it
shares most buckets with; the exact multiset overlap of the texts decides, and
links make components. Where components have formed, bags outside them meet
further members. Bags whose buckets then still hold several components go
through an exact prefix join with positional bound, which finds every pair of
them, in different components, that can reach the similarity; these are verified
too. Pairs inside one component can't change a class, so they are never formed;
no bucket is capped. Classes are the components of all verified links.

Defined results: a null text is empty. Texts without words have no shingles;
they are of one class if their texts are equal, and else alone. Equal bags are
one class at once. A class is named by its least id (null only if all its ids
are null). Rows that share id and text are copies. Extra columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_on_rows, map_arrow, stage, text_key, text_or_empty
from .components import components

WORDS = 5
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8^5)^24 < 0.0001.
BANDS, ROWS = 24, 5
SIMILARITY = 0.8
#: Texts are signed together until they have so many shingles.
TOGETHER = 100_000
KNOWN_WORDS = 400_000
#: Rounds in which bags outside a bucket's main component meet single members.
TURNS = 2
#: Bounds on integer weights give way by this much: 1 - 0.8 is below a fifth in
#: floating point, and pairs of exactly the similarity must not be lost.
ROUNDING = 1e-6

_word = re.compile(r"\w+").findall
_known: dict[str, int] = {}
_u = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the text's shingles and their counts."""
    known, hashes = _known, []
    for w in _word(text.lower()):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[w] = h
        hashes.append(h)
    if not hashes:
        return np.empty(0, _u), np.empty(0, np.int64)
    words = np.array(hashes, _u)
    n = max(1, len(words) - WORDS + 1)
    total = np.zeros(n, _u)
    for k in range(min(WORDS, len(words))):
        total = mix(total + words[k : k + n] + _u(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    return np.unique(total, return_counts=True)


def processes(hashes: np.ndarray, counts: np.ndarray):
    """Seed, lower end, width and weight of the bands of each shingle: the
    band (0,1], and (2^j, 2^(j+1)] for every 2^j below the weight."""
    seeds, low, width, owner = [mix(hashes)], [np.zeros(len(hashes))], [np.ones(len(hashes))], [np.arange(len(hashes))]
    j = 0
    while len(at := np.flatnonzero(counts > 2.0**j)):
        seeds.append(mix(hashes[at] + _u((j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)))
        low.append(np.full(len(at), 2.0**j))
        width.append(np.full(len(at), 2.0**j))
        owner.append(at)
        j += 1
    return np.concatenate(seeds), np.concatenate(low), np.concatenate(width), np.concatenate(owner)


def signatures(hashes: np.ndarray, counts: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """First arrivals [n_docs, m] of bags whose shingles are given in a row."""
    values = np.full(n_docs * m, np.inf)
    seed, low, width, owner = processes(hashes, counts)
    weight, doc = counts[owner].astype(float), doc[owner]
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        x = mix(seed + _u(step * 0xA0761D6478BD642F & (1 << 64) - 1))
        time = time - np.log(((x >> _u(11)).astype(float) + 0.5) * 2.0**-53) / width
        y = mix(x ^ _u(0xE7037ED1A0B428DB))
        # The bits of y's lower half choose a half of the band, then a half of
        # that, and so on: together, the point's place in the band.
        place = np.floor((y & _u(0xFFFFFFFF)).astype(float) * 2.0**-32 * width)
        inside = low + place < weight
        component = ((y >> _u(32)) * _u(m) >> _u(32)).astype(np.int64)
        np.minimum.at(values, doc[inside] * m + component[inside], time[inside])
        if step < 8 or step % 4 == 0:
            latest = values.reshape(n_docs, m).max(axis=1)
            going = time < latest[doc]
            if not going.all():
                seed, low, width, weight, doc, time = (v[going] for v in (seed, low, width, weight, doc, time))
    return values.reshape(n_docs, m)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys [n_docs, bands] of the bands' values; bands never mix."""
    bits = values.view(_u).reshape(len(values), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=_u) * _u(0x9E3779B97F4A7C15), (len(values), bands))
    for r in range(rows):
        keys = mix(keys + bits[:, :, r])
    return keys


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(__id, __key, bag, weight, keys): the digest of each text's bag, its
    total weight and its band keys (none for texts without words)."""
    text = text_or_empty(text_col)
    given = docs.select(F.col(id_col).alias("__id"), text_key(text).alias("__key"), text.alias("__text"))
    ddl = ", ".join(f"{c} {t}" for c, t in given.dtypes[:2]) + ", bag binary, weight bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, weights, keys, wait = [], [], [], []

            def flush() -> None:
                full = [(i, h, c) for i, h, c in wait if len(h)]
                if full:
                    doc = np.repeat(np.arange(len(full)), [len(h) for _, h, _ in full])
                    values = signatures(np.concatenate([h for _, h, _ in full]), np.concatenate([c for _, _, c in full]), doc, len(full), bands * rows)
                    for (i, _, _), k in zip(full, band_keys(values, bands, rows).view(np.int64).tolist(), strict=True):
                        keys[i] = k
                wait.clear()

            held = 0
            for i, value in enumerate(batch.column(2)):
                body = value.as_py()
                h, c = bag(body)
                content = h.tobytes() + c.astype("<i8").tobytes() if len(h) else b"\x00" + body.encode()
                names.append(xxhash.xxh3_128_digest(content))
                weights.append(int(c.sum()))
                keys.append([])
                wait.append((i, h, c))
                held += len(h)
                if held >= TOGETHER:
                    flush()
                    held = 0
            flush()
            out = [*batch.columns[:2], pa.array(names, pa.binary()), pa.array(weights, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["__id", "__key", "bag", "weight", "keys"])

    return map_arrow(given, run, ddl)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - common
    return common / total if total else 0.0


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of bags whose texts have at least ``similarity``."""
    b = texts.select(F.col("bag").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("bag").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, known = None, None  # rows with the same ``a`` mostly follow each other
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                this = batch.column(0)[i].as_py()
                if this != name:
                    name, known = this, bag(batch.column(2)[i].as_py())
                if overlap(known, bag(batch.column(3)[i].as_py())) >= similarity:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return map_arrow(rows, run, "a binary, b binary")


def near_size(x: str, y: str, similarity: float):
    """Bags whose weights differ more can't be similar enough."""
    return (F.col(x) >= F.col(y) * similarity - ROUNDING) & (F.col(y) >= F.col(x) * similarity - ROUNDING)


def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the component of their bag in ``root``."""
    if roots is None:
        return members.withColumn("root", F.col("bag"))
    named = roots.select(F.col("node").alias("bag"), "root")
    return members.join(named, "bag", "left").withColumn("root", F.coalesce("root", "bag"))


def with_main(members: DataFrame, key: str) -> DataFrame:
    """Rows of ``members`` (key, bag, root ...) whose key has several roots, with
    the key's most frequent root in ``main`` and its rows in ``main_n``."""
    sizes = members.groupBy(key, "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(key).agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return members.join(main.select(key, F.col("m.root").alias("main"), F.col("m.n").alias("main_n")), key)


def proposals(buckets: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """One pair (a, b) per bag b: the centre of another component with which it
    shares most buckets."""
    pairs = buckets.join(centres, "band").filter((F.col("root") != F.col("centre_root")) & near_size("weight", "centre_weight", similarity))
    pairs = pairs.groupBy(F.col("centre").alias("a"), F.col("bag").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("a").alias("a"))).alias("best")).select("best.a", "b")


def centres_of(buckets: DataFrame, order) -> DataFrame:
    """The bag of each bucket with the greatest ``order``."""
    top = buckets.groupBy("band").agg(F.max(F.struct(order.alias("o"), "bag", "weight", "root")).alias("c"))
    return top.select("band", F.col("c.bag").alias("centre"), F.col("c.weight").alias("centre_weight"), F.col("c.root").alias("centre_root"))


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(bag, shingle, count) of the staged texts."""
    given = texts.select("bag", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, c = bag(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(c)], names=["bag", "shingle", "count"])

    return map_arrow(given, run, "bag binary, shingle bigint, count bigint")


def rest_pairs(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of ``members`` (bag, weight, root) in different
    components that may reach ``similarity``: an exact prefix join.

    Shingles are ordered by rarity. If two bags are similar enough, the first
    shingle they share in this order lies so early in both that what follows it
    can still make up the overlap they need. Shingles of a passage that many
    texts share come last, behind the texts' own; pairs that have only such a
    passage in common are never formed. Of the rows of a shingle, only those
    outside its most frequent component look for partners.
    """
    rows = stage(shingle_rows(texts.join(members.select("bag"), "bag", "left_semi")), "bag-shingles")
    known = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("bags"))
    ranked = rows.join(known, "shingle").groupBy("bag").agg(F.sort_array(F.collect_list(F.struct("bags", "shingle", "count"))).alias("s"))
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    weight = F.aggregate("s", F.lit(0).cast("bigint"), lambda x, s: x + s["count"])
    ranked = ranked.select("bag", weight.alias("w"), "s")
    # The prefix has at most (1 - similarity) w + 1 shingles of weight one or more.
    most_before = F.col("w") * (1 - similarity) + ROUNDING
    head = F.slice("s", 1, F.least(F.size("s"), F.floor(most_before).cast("int") + 1))
    before = F.aggregate(head, zero, lambda x, s: F.struct((x["sum"] + s["count"]).alias("sum"), F.concat(x["before"], F.array(x["sum"])).alias("before")), lambda x: x["before"])
    prefix = ranked.select("bag", F.explode(F.arrays_zip(head.alias("s"), before.alias("before"))).alias("p"), "w").select(
        "bag", F.col("p.s.shingle").alias("shingle"), F.col("p.s.bags").alias("bags"), F.col("p.before").alias("before"), "w"
    )
    prefix = prefix.filter((F.col("bags") > 1) & (F.col("before") <= most_before))
    placed = with_main(prefix.join(members.select("bag", "root"), "bag"), "shingle")
    placed = stage(placed, "bag-prefixes")
    x = placed.filter("root != main").select("shingle", F.col("bag").alias("a"), F.col("w").alias("wa"), F.col("before").alias("pa"), F.col("root").alias("ra"))
    y = placed.select("shingle", F.col("bag").alias("b"), F.col("w").alias("wb"), F.col("before").alias("pb"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"))
    possible = F.least(F.col("wa") - F.col("pa"), F.col("wb") - F.col("pb"))
    enough = possible * (1 + similarity) >= (F.col("wa") + F.col("wb")) * similarity - ROUNDING
    once = F.col("in_main") | (F.col("a") < F.col("b"))
    return x.join(y, "shingle").filter((F.col("ra") != F.col("rb")) & once & enough & near_size("wa", "wb", similarity)).select("a", "b").distinct()


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(__id, __key, root, class_id): the class of every row of ``docs``."""
    signed = stage(sign(docs, id_col, text_col, bands, rows), "bag-signatures")
    # One representative per bag; copies merge on the map side.
    bags = signed.groupBy("bag").agg(
        F.min(F.struct("__id", "__key")).alias("r"), F.min("__id").alias("least"), F.first("weight").alias("weight"), F.first("keys").alias("keys")
    )
    bags = stage(bags.select("bag", "r.__id", "r.__key", "least", "weight", "keys"), "bags")
    members = bags.select("bag", "weight", F.explode("keys").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = stage(members.join(shared, "band"), "buckets")  # of two and more

    wanted = buckets.select("bag").distinct().join(bags.select("bag", "__id", "__key"), "bag")
    packed = docs.select(F.col(id_col).alias("__id"), text_key(text_or_empty(text_col)).alias("__key"), text_or_empty(text_col).alias("text"))
    texts = join_on_rows(packed, wanted, "inner").groupBy("bag").agg(F.first("text").alias("text"))
    texts = stage(texts, "bag-texts")

    # A bag that has met many others lies in the middle of its group.
    met = buckets.groupBy("bag").agg(F.sum("n").alias("met"))
    placed = stage(rooted(buckets.join(met, "bag"), None), "bucket-members")
    links = stage(verify(proposals(placed, centres_of(placed, F.col("met")), similarity), texts, similarity), "bag-links")
    roots = components(links)
    for turn in range(TURNS):
        # Where a component has formed in a bucket, those outside it meet one
        # of the bucket's members that a hash picks.
        placed = stage(with_main(rooted(buckets, roots), "band"), "bucket-members")
        open_ = placed.filter("main_n > 1")
        if turn + 1 == TURNS or open_.isEmpty():
            break
        pairs = proposals(open_.filter("root != main"), centres_of(open_, F.xxhash64("bag", F.lit(turn))), similarity)
        more = stage(verify(pairs, texts, similarity), "bag-links")
        links = stage(links.unionAll(more), "bag-links")
        roots = components(links)
    if not placed.isEmpty():
        left = stage(rest_pairs(placed.groupBy("bag").agg(F.first("weight").alias("weight"), F.first("root").alias("root")), texts, similarity), "bag-rest")
        more = stage(verify(left, texts, similarity), "bag-links")
        if not more.isEmpty():
            roots = components(links.unionAll(more))

    named = stage(rooted(bags.select("bag", "least"), roots), "bag-roots")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = stage(named.join(least, "root").select("bag", "root", "class_id"), "bag-classes")
    return signed.select("__id", "__key", "bag").join(named, "bag").select("__id", "__key", "root", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` per class, with all its columns: that of the least
    (id, text key); among copies of it, the least by a hash of the row."""
    placed = classes(docs, id_col, text_col, **options)
    first = stage(placed.groupBy("root").agg(F.min(F.struct("__id", "__key")).alias("f")).select("f.__id", "f.__key"), "bag-kept")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        text_key(text_or_empty(text_col)).alias("__key"),
    )
    kept = join_on_rows(packed, first, "left_semi")
    order = F.xxhash64(F.to_json(F.struct("__row")))
    return kept.groupBy("__id", "__key").agg(F.min_by("__row", order).alias("__row")).select("__row.*")
