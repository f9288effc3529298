"""Training-order materialisation of token ids.

Texts are encoded once by a byte-level BPE vocabulary and staged, ids as unsigned
little-endian integers of ``width`` bytes (2 up to 65,534 tokens, else 4). The
first free id ends a text, the largest integer is padding. The ids of a
partition's documents, each followed by the end, run on into sequences of
``length`` ids; only a partition's last sequence is padded.

1. The staged table is counted: the sequences of each of its partitions; running
   sums of these counts number all sequences 0 to N-1 without a sort.
2. A keyed Feistel network over a x b >= N values permutes the numbers; a value
   of N or more is permuted again until it is below N (cycle-walking), so the
   slots are a permutation of 0 to N-1.
3. Sequences go to the partition of their range of slots (``tasks`` partitions at
   most) and are written in slot order, ``per_shard`` records a shard. A record
   has a fixed stride: sequence number, id of the document that its first token
   belongs to and that token's place in it (each a signed 64-bit little-endian
   integer), the ids, and a line feed. Slot s is record s mod per_shard of shard
   s div per_shard, so a reader can start or go on anywhere without an index, and
   finds the shards of a range by their names.

Counting and writing read the same staged files; the second pass checks each
partition's count against the first and fails if they differ.

Defined results: a null text is empty and gives one end; a null id is
written as ``NO_ID`` and read as null. Copies of a row are documents of their
own. Extra columns are ignored. An empty table gives no sequence and no shard.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec_of, read_vocabulary
from .common import map_arrow, stage, text_or_empty

NO_ID = -(1 << 63)
HEAD = 24
LENGTH, PER_SHARD, ROUNDS, TASKS = 2048, 4096, 6, 20_000
LEVEL = 5  # of compression, where ids are staged and shuffled beside the shards
#: Up to so many shards of a range are read by name; more by listing them all.
NAMED_SHARDS = 1000
#: The library's pattern matcher gives up on longer runs of one kind of character.
LONG_RUN = 1000
_spaces = re.compile(rf"\s{{{LONG_RUN}}}")


class Layout(NamedTuple):
    """All a reader needs to know."""

    path: str
    sequences: int
    end: int  # the id that ends a text
    width: int = 2
    length: int = LENGTH
    per_shard: int = PER_SHARD

    @property
    def padding(self) -> int:
        return (1 << 8 * self.width) - 1

    @property
    def stride(self) -> int:
        return HEAD + self.length * self.width + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]


def _network(x: np.ndarray, a: int, b: int, keys: list[int], back: bool) -> np.ndarray:
    """One pass over the domain of a x b numbers (left half mod a, right mod b)."""
    left, right = x // np.uint64(b), x % np.uint64(b)
    for r, k in reversed(list(enumerate(keys))) if back else enumerate(keys):
        # Even rounds add to the left half, odd rounds to the right one.
        fixed, size = (right, a) if r % 2 == 0 else (left, b)
        add = _mix(fixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) % np.uint64(size)
        add = np.uint64(size) - add if back else add
        if r % 2 == 0:
            left = (left + add) % np.uint64(size)
        else:
            right = (right + add) % np.uint64(size)
    return left * np.uint64(b) + right


def permute(numbers: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers below ``n`` (``back``: numbers of slots)."""
    if n < 2:
        return numbers.astype(np.int64)
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    keys = round_keys(key)
    x = _network(numbers.astype(np.uint64), a, b, keys, back)
    while len(out := np.flatnonzero(x >= n)):
        x[out] = _network(x[out], a, b, keys, back)
    return x.astype(np.int64)


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder_of(raw: bytes, pattern: str) -> Callable[[str], np.ndarray]:
    """Text to ids, built once per Python process: the library, and for texts with
    a run of characters that it can't match, the codec of ``bpe``."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _encoders:
        codec = codec_of(raw, pattern)
        fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if max(map(len, text.split()), default=0) >= LONG_RUN or _spaces.search(text):
                return np.frombuffer(codec.encode(text), "<u4")
            return fast.encode_to_numpy(text, disallowed_special=())

        _encoders.clear()
        _encoders[key] = encode
    return _encoders[key]


def token_ids(docs: DataFrame, vocabulary: str, pattern: str, width: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, n, ids) of every text, its end among the ids, and the id of the end."""
    raw = read_vocabulary(vocabulary)
    end = len(codec_of(raw, pattern).tokens)
    if end >= (1 << 8 * width) - 1:
        raise ValueError(f"{end} ids don't fit into {width} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder_of(shared.value, pattern), end.to_bytes(width, "little")
        for batch in batches:
            ids = [encode(text.as_py()).astype(f"<u{width}").tobytes() + stop for text in batch.column(1)]
            counts = pa.array([len(x) // width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names=["id", "n", "ids"])

    return map_arrow(rows, run, "id bigint, n bigint, ids binary"), end


def count_sequences(encoded: DataFrame, length: int) -> dict[int, tuple[int, int]]:
    """First number and number of sequences of each non-empty partition (as
    many entries as the scan has tasks)."""
    tokens = encoded.select(F.spark_partition_id().alias("p"), "n")
    rows = tokens.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    out, first = {}, 0
    for r in rows:
        out[r.p] = (first, -(-r.n // length))
        first += out[r.p][1]
    return out


def sequences(encoded: DataFrame, key: str, width: int, length: int, per_shard: int) -> tuple[DataFrame, int]:
    """(slot, shard, packed) of every sequence of the staged ids, and their
    number. Records are compressed one by one for the shuffle."""
    parts = count_sequences(encoded, length)
    n = sum(c for _, c in parts.values())
    size, padding = length * width, b"\xff"
    shared = encoded.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, expected = shared.value.get(TaskContext.get().partitionId(), (0, 0))
        number = first
        rest, heads = bytearray(), []  # the ids not yet in a record; (id, place) of the record's first token
        out: list[bytes] = []

        def ready() -> pa.RecordBatch:
            nonlocal number
            zstd = pa.Codec("zstd", compression_level=LEVEL)
            numbers = np.arange(number, number + len(out))
            slots = permute(numbers, n, key)
            places = np.array(heads, "<i8").reshape(-1, 2)
            records = [
                x.tobytes() + ids for x, ids in zip(np.column_stack([numbers.astype("<i8"), places]), out, strict=True)
            ]
            number += len(out)
            out.clear()
            heads.clear()
            packed = [zstd.compress(r, asbytes=True) for r in records]
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), pa.array(packed, pa.binary())], names=["slot", "shard", "packed"])

        head = None
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = value.as_py()
                at = 0
                while at < len(ids):
                    if not rest:
                        head = (doc, at // width)
                    take = ids[at : at + size - len(rest)]
                    rest += take
                    at += len(take)
                    if len(rest) == size:
                        out.append(bytes(rest))
                        heads.append(head)
                        rest.clear()
                        if len(out) >= 4096:
                            if number + len(out) > first + expected:
                                raise RuntimeError("the input's partitions changed between the passes")
                            yield ready()
        if rest:
            out.append(bytes(rest).ljust(size, padding))
            heads.append(head)
        if number + len(out) != first + expected:
            raise RuntimeError("the input's partitions changed between the passes")
        yield ready()

    return map_arrow(encoded.select("id", "ids"), run, "slot bigint, shard int, packed binary"), n


def unpacked(rows: DataFrame, size: int) -> DataFrame:
    """(slot, shard, record) of compressed records of ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        for batch in batches:
            records = [zstd.decompress(r.as_py(), decompressed_size=size, asbytes=True) for r in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(records, pa.binary())], names=["slot", "shard", "record"])

    return map_arrow(rows.select("slot", "shard", "packed"), run, "slot bigint, shard int, record binary")


def materialise(
    docs: DataFrame,
    path: str,
    key: str,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 2,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    tasks: int = TASKS,
) -> Layout:
    """Write the shards of ``docs`` under ``path``."""
    ids, end = token_ids(docs, vocabulary, pattern, width, id_col, text_col)
    rows, n = sequences(stage(ids, "token-ids", LEVEL), key, width, length, per_shard)
    layout = Layout(path, n, end, width, length, per_shard)
    if n:
        # Ranges of slots, known without sampling; a task writes one shard or more.
        parts = min(layout.shards, tasks)
        task = (F.col("shard").cast("bigint") * parts / layout.shards).cast("int")
        ranged = unpacked(rows.repartitionById(parts, task), layout.stride - 1).sortWithinPartitions("shard", "slot")
        ranged.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return layout


def _trim(layout: Layout, content: bytes, shard: int, start: int, stop: int) -> tuple[int, int, memoryview]:
    """First slot, number and bytes of a shard's records in [start, stop)."""
    stride, first = layout.stride, shard * layout.per_shard
    if len(content) != stride * min(layout.per_shard, layout.sequences - first):
        raise ValueError(f"shard {shard} has {len(content)} bytes")
    a, b = max(start, first), min(stop, first + layout.per_shard, layout.sequences)
    return a, b - a, memoryview(content)[(a - first) * stride : (b - first) * stride]


def read_slots(spark: SparkSession, layout: Layout, start: int = 0, stop: int | None = None, content: bool = True) -> DataFrame:
    """The sequences of slots [start, stop): slot, shard, place in the shard,
    seq_index, doc_id and doc_place of the first token, n_tokens (without
    padding), n_ended (documents that end in it), ids_sha256 of the tokens, and
    with ``content`` the ids. Only the shards of the range are read."""
    stop = layout.sequences if stop is None else min(stop, layout.sequences)
    ddl = "slot bigint, shard int, place int, seq_index bigint, doc_id bigint, doc_place bigint, n_tokens bigint, n_ended bigint, ids_sha256 string"
    ddl += ", ids binary" if content else ""
    if start >= stop:
        return spark.createDataFrame([], ddl)
    first, last = start // layout.per_shard, (stop - 1) // layout.per_shard
    named = last - first < min(layout.shards - 1, NAMED_SHARDS)
    paths = [f"{layout.path}/shard={k}" for k in range(first, last + 1)] if named else layout.path
    files = spark.read.format("binaryFile").option("basePath", layout.path).load(paths)
    files = files.filter(F.col("shard").between(first, last)).select("shard", "content")
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first, n, view = _trim(layout, data.as_py(), int(shard), start, stop)
                grid = np.frombuffer(view, np.uint8).reshape(n, layout.stride)
                heads = grid[:, :HEAD].copy().view("<i8")
                ids = grid[:, HEAD:-1].copy().view(f"<u{layout.width}")
                used = (ids != layout.padding).sum(axis=1)
                rows = [r[:u].tobytes() for r, u in zip(ids, used.tolist(), strict=True)]
                slots = np.arange(first, first + n)
                columns = [
                    pa.array(slots),
                    pa.array(np.full(n, int(shard), np.int32)),
                    pa.array((slots % layout.per_shard).astype(np.int32)),
                    pa.array(heads[:, 0]),
                    pa.array(heads[:, 1], mask=heads[:, 1] == NO_ID),
                    pa.array(heads[:, 2]),
                    pa.array(used.astype(np.int64)),
                    pa.array((ids == layout.end).sum(axis=1).astype(np.int64)),
                    pa.array([hashlib.sha256(r).hexdigest() for r in rows]),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(rows, pa.binary())] if content else [])], names=names)

    return map_arrow(files, run, ddl)
