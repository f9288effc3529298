"""Byte-level BPE encoding and decoding with a segment tree.

A text is cut by the vocabulary's pattern; each match is encoded on its own.
The leaves of a segment tree stand for byte positions: the leaf of a live
position holds the rank of the pair that starts there, joined with the
position, so the root is the leftmost pair of least rank. A merge clears the
right neighbour's leaf and re-ranks the leaves of the merged pair and of its
live left neighbour, each with one walk to the root: n log n for a match of n
bytes, also for one of megabytes. Tasks remember the ids of short matches in a
dictionary of bounded size.

Defined results: a null text is empty, which has no ids; a null id stays null.
Rows are encoded one by one, so repeated rows give repeated results. Extra
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty

NONE = 1 << 62
#: Matches up to this many characters are remembered, at most so many of them.
SHORT, REMEMBERED = 32, 600_000


class Codec:
    """Ranks and pattern of one vocabulary: {token bytes: id}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        rank = self.ranks.get
        whole = rank(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return []
        bits = n.bit_length()
        mask = (1 << bits) - 1
        width = 1 << (n - 1).bit_length()
        leaves = [NONE] * width
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                leaves[i] = r << bits | i
        tree = [NONE] * width + leaves
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        end = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n))  # start of the live token to the left

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    return
                tree[at] = least
                at >>= 1

        while tree[1] != NONE:
            at = tree[1] & mask
            right = end[at]
            stop = end[at] = end[right]
            put(right, NONE)
            if stop < n:
                before[stop] = at
                r = rank(piece[at : end[stop]])
                put(at, NONE if r is None else r << bits | at)
            else:
                put(at, NONE)
            left = before[at]
            if left >= 0:
                r = rank(piece[left:stop])
                put(left, NONE if r is None else r << bits | left)
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for match in self.find(text):
            ids = known.get(match)
            if ids is None:
                ids = np.array(self.piece(match.encode()), "<u4").tobytes()
                if len(match) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[match] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


_codecs: dict[str, Codec] = {}


def codec_of(raw: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, built once per Python process."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(raw), pattern)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver (its size is that of the
    vocabulary, not of the data) and broadcast, so executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """``keep`` columns beside the ids of each text.

    ``ids`` is binary, little-endian unsigned 32-bit. With ``digests`` the ids
    stay inside the task: the rows carry ids_sha256 and the decoded_sha256 of
    the bytes that decoding these ids gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    kept = rows.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ddl += ", n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            counts, firsts, seconds = [], [], []
            for text in batch.column(len(keep)):
                ids = codec.encode(text.as_py())
                counts.append(len(ids) // 4)
                if digests:
                    firsts.append(hashlib.sha256(ids).hexdigest())
                    seconds.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                else:
                    firsts.append(ids)
            out = [*batch.columns[: len(keep)], pa.array(counts, pa.int64())]
            if digests:
                out += [pa.array(firsts, pa.string()), pa.array(seconds, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                out += [pa.array(firsts, pa.binary())]
                names = [*keep, "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return map_arrow(rows, run, ddl)


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns beside ``decoded``: the bytes of each row's ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = encoded.select(*keep, F.coalesce("ids", F.lit(b"")).alias("__ids"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            decoded = [codec.decode(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(decoded, pa.binary())], names=[*keep, "decoded"])

    return map_arrow(rows, run, ddl)
