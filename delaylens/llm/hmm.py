"""Hidden Markov language model: Baum-Welch training, exact sequence likelihood.

A text is its words and an end; a latent state emits each token and moves on.

1. ``_encode`` cuts what a task reads into blocks of whole documents, encoded by
   the block's own vocabulary. A running sum over the blocks' vocabularies gives
   the count of each word in the training documents, and so the base score.
   Neighbouring blocks form groups of about ``GROUP`` tokens, less only where there
   would be fewer groups than cores: what is known of a word moves once a group and
   step, however little a task reads.
2. A word with at least ``LEAST`` training tokens has emission probabilities of its
   own, in a corpus of any size; the rarer ones, all counted, share the states'
   profile of all such words with a count of as many bits. A state's emission of a word with
   count c follows its expected count, raised by (c + 1) / c as in the base and
   smoothed by ``WEIGHT`` tokens of the base; the unknown word has its base
   probability in every state. The probabilities of a state sum to 1 over all
   words and the unknown one.
3. A Baum-Welch step joins each group's own words with their emissions, runs
   scaled forward and backward recursions over the training documents of its
   blocks, and sums expected counts by word over all groups. Groups and words lie in
   buckets, so only emissions and counts move. Counts are summed as integers, in units of
   2^-16, so the sum doesn't depend on its order. Only transitions, first states,
   the counts of shared words and the states' sums (a few rows) reach the driver.
   First emissions differ by a hash of word and state, first transitions mostly
   stay.
4. The score is the log10 of the likelihood by the scaled forward recursion.

The recursions run over many documents at once. A document of more than ``LONG``
tokens is cut into pieces of ``PIECE``; each piece is first run from every state,
which gives its transfer matrix, and the products of these give every piece's
exact start and end vectors, so pieces run side by side too.

Defined results: a null text is empty, a text of the end alone. Rows with a null
or shared id are scored by their own texts; all copies count in training. Without
training documents every word is unknown (base log10(1/1) each) and the score is
the base score. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage, stage_by

STATES, ROUNDS = 8, 3
STAY = 0.98  # first probability of staying in a state
LEAST, WEIGHT = 32, 200.0
SHARED = 64  # ids of words that share emissions, by the bits of their count
UNIT = 65536
BLOCK, CHUNK = 4_000_000, 100_000  # tokens of a block; of a row of it
GROUP = 24_000_000  # tokens of the blocks that get their emissions together
PART = 8_000_000  # bytes of text split at once
LONG, PIECE = 2048, 512
SIDE, BATCH = 1024, 400_000  # sequences and tokens in one recursion
KEPT = 200_000  # tokens of one that keeps their states
END = b""  # no word is empty

_raw = pa.schema([("block", pa.int64()), ("seq", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()),
                  ("lens", pa.list_(pa.int32())), ("train", pa.list_(pa.bool_())), ("doc_id", pa.list_(pa.int64()))])
_RAW = "block long, seq int, word binary, n long, ids binary, lens array<int>, train array<boolean>, doc_id array<long>"
_CORPUS = "group long, at long, ids binary, lens array<int>, train array<boolean>, doc_id array<long>, known array<int>, base array<double>, plus array<double>"

_corpus = pa.schema([("group", pa.int64()), ("at", pa.int64()), *[f for f in _raw if f.name in ("ids", "lens", "train", "doc_id")],
                     ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("plus", pa.list_(pa.float64()))])

_codec = pa.Codec("zstd")


def _pack(ids: np.ndarray) -> bytes:
    return len(ids).to_bytes(8, "little") + _codec.compress(ids.astype(np.int32).tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(_codec.decompress(data[8:], decompressed_size=4 * n, asbytes=True), np.int32)


# --------------------------------------------------------------------------- blocks

def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 texts one after the other, A-Z lower-cased (what stands
    between ASCII spaces), and their number in each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, size = split.flatten(), pc.list_value_length(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # a space at an end of a text leaves an empty word there
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(size)
    return words.filter(real), before[ends] - before[ends - size]


def _table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))

    def column(f: pa.Field) -> pa.Array:
        x = columns.get(f.name)
        return pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _rows(ids: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of documents with at most ``CHUNK`` tokens, or one longer."""
    start, size = 0, 0
    for i, x in enumerate(ids):
        if size and size + len(x) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(ids):
        yield start, len(ids)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``PART`` bytes of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _tokens(ids: np.ndarray, size: int, some: np.ndarray | None = None) -> np.ndarray:
    """How often each id occurs, in ``some`` places; counted in slices, as numpy widens what it counts."""
    out = np.zeros(size, np.int64)
    for a in range(0, len(ids), 500_000):
        part = ids[a : a + 500_000]
        out += np.bincount(part if some is None else part[some[a : a + 500_000]], minlength=size)
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vocabulary rows (word, n: tokens in training documents) and document rows
    of the blocks of a task. An id is a word's rank in its block, by tokens."""
    block = TaskContext.get().partitionId() << 32
    held: list[tuple] = []  # (id, train, dictionary of words, their places in it, words in each text) of a part
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
        doc_id, train = ([x for h in held for x in h[i].to_pylist()] for i in (0, 1))
        lens = np.concatenate([h[4] for h in held])
        ends = np.cumsum(lens)
        of_part = np.split(coded.indices.to_numpy(), np.cumsum([len(h[2]) for h in held])[:-1])
        every = np.concatenate([p[h[3]] for p, h in zip(of_part, held)])
        held.clear()
        every = np.insert(every, ends, np.int32(len(coded.dictionary)))  # the end of each text
        spelled = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END])])
        order = np.argsort(-_tokens(every, len(spelled)), kind="stable")
        place = np.empty(len(spelled), np.int32)
        place[order] = np.arange(len(spelled), dtype=np.int32)
        every = place[every]
        n = _tokens(every, len(spelled), np.repeat(train, lens + 1))
        spelled = spelled.take(pa.array(order))
        for a in range(0, len(spelled), 100_000):
            part = spelled.slice(a, 100_000)
            yield _table(_raw, block=np.full(len(part), block), seq=np.arange(a, a + len(part), dtype=np.int32), word=part, n=n[a : a + len(part)])
        ids = np.split(every, (ends + np.arange(1, len(ends) + 1))[:-1])
        for a, b in _rows(ids):
            yield _table(_raw, block=[block], seq=[a], ids=[_pack(np.concatenate(ids[a:b]))], lens=[[len(x) for x in ids[a:b]]],
                         train=[train[a:b]], doc_id=[doc_id[a:b]])

    for part in _parts(batches):
        words, lens = words_of(part.column(2))
        coded = words.dictionary_encode()
        held.append((part.column(0), part.column(1), coded.dictionary, coded.indices.to_numpy(), lens))
        size += len(words) + len(lens)
        if size >= BLOCK:
            yield from flush()
            block, size = block + 1, 0
    if held:
        yield from flush()
    pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks


def _recode(tokens: int, types: int):
    """Per block: documents whose ids are below ``SHARED`` for words that share
    emissions, and from there on for the block's own words in the order of their
    ranks; known tokens, base score and the share of counts in the score of each
    document."""

    def task(corpus: pa.Table, vocabulary: pa.Table) -> pa.Table:
        c = np.zeros(vocabulary.num_rows, np.int64)
        c[vocabulary["seq"].to_numpy()] = vocabulary["c"].to_numpy()
        own = c >= LEAST
        new = np.frexp(c)[1].astype(np.int32)  # bits of a count
        new[own] = SHARED + np.arange(own.sum(), dtype=np.int32)
        cost = np.log10((c + 1) / (tokens + types + 1))
        factor = np.where(own, 0, np.log10(c + 1))
        rows = {f.name: [] for f in _corpus}
        for r in corpus.to_pylist():
            ids = _unpack(r["ids"])
            first = np.cumsum(r["lens"]) - r["lens"]
            sums = [np.add.reduceat(x[ids], first).tolist() for x in ((c > 0).astype(np.int32), cost, factor)]
            for k, v in zip(rows, (r["group"], r["at"], _pack(new[ids]), r["lens"], r["train"], r["doc_id"], *sums)):
                rows[k].append(v)
        return pa.Table.from_batches([_table(_corpus, **rows)])

    return task


# --------------------------------------------------------------------------- recursions

class Sequences:
    """Sequences of ids side by side, longest first."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(x) for x in seqs])
        self.order = np.argsort(-lens, kind="stable")
        self.lens = lens[self.order]
        self.ids = np.zeros((self.lens[0], len(seqs)), np.int32)
        for k, i in enumerate(self.order):
            self.ids[: len(seqs[i]), k] = seqs[i]
        #: how many sequences go on at each step
        self.live = np.searchsorted(-self.lens, -np.arange(len(self.ids) + 1), side="left")


def forward(s: Sequences, start: np.ndarray, move: np.ndarray, emit: np.ndarray, room: np.ndarray | None = None):
    """Natural log-likelihood of each sequence, whose first state is distributed as
    ``start``; the filtered states at each step, in ``room`` if there is one."""
    steps, one = len(s.ids), np.ones(move.shape[0])
    scale = np.ones((steps, len(s.lens)))
    states = None if room is None else room[: s.ids.size * len(one)].reshape(*s.ids.shape, len(one))
    ahead = start[s.order].copy()
    for t in range(steps):
        n = s.live[t]
        f = ahead[:n] * emit[s.ids[t, :n]]
        c = f @ one
        f /= c[:, None]
        scale[t, :n] = c
        if states is not None:
            states[t, :n], states[t, n:] = f, 0
        np.matmul(f, move, out=ahead[:n])
    out = np.empty(len(s.lens))
    out[s.order] = np.log(scale).sum(0)
    return out, states


def backward(s: Sequences, states: np.ndarray, after: np.ndarray, final: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Turns filtered into smoothed states, in place; returns the expected moves.
    ``after`` is the likelihood of what follows a sequence by the state of its next
    token; ``final`` sequences end their document."""
    one, moves = np.ones(move.shape[0]), np.zeros_like(move)
    w, final, turned = after[s.order].copy(), final[s.order], np.ascontiguousarray(move.T)
    for t in range(len(s.ids) - 1, -1, -1):
        n, on = s.live[t], s.live[t + 1]
        beta = w[:n] @ turned
        f = states[t, :n]
        g = f * beta
        z = g @ one
        m = f / z[:, None]
        m[on:n][final[on:n]] = 0
        moves += m.T @ w[:n]
        np.divide(g, z[:, None], out=states[t, :n])
        beta *= emit[s.ids[t, :n]]
        beta /= (beta @ one)[:, None]
        w[:n] = beta
    return moves * move


def transfer(s: Sequences, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """For each sequence, its likelihood by first state and by the state of the next
    token, up to a factor."""
    k = len(move)
    ahead = np.broadcast_to(np.eye(k), (len(s.lens), k, k)).copy()
    for t in range(len(s.ids)):
        n = s.live[t]
        f = ahead[:n] * emit[s.ids[t, :n]][:, None, :]
        f /= f.sum((1, 2))[:, None, None]
        ahead[:n] = f @ move
    out = np.empty_like(ahead)
    out[s.order] = ahead
    return out


def _batches(items: list, tokens: int) -> Iterator[list]:
    """Runs of (sequence, ...) of like length."""
    items = sorted(items, key=lambda x: -len(x[0]))
    a = 0
    while a < len(items):
        b = a + max(1, min(SIDE, tokens // len(items[a][0])))
        yield items[a:b]
        a = b


def pieces(docs: list[np.ndarray], first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> list[tuple]:
    """(sequence, document, start, after, opens, ends) for all documents, long ones
    in pieces."""
    k, out, cut = len(first), [], []
    for i, x in enumerate(docs):
        if len(x) <= LONG:
            out.append((x, i, first, np.ones(k), True, True))
        else:
            cut += [(x[a : a + PIECE], i, a // PIECE) for a in range(0, len(x), PIECE)]
    by_doc: dict[int, dict[int, tuple]] = {}
    for batch in _batches(cut, BATCH):
        for (x, i, at), m in zip(batch, transfer(Sequences([b[0] for b in batch]), move, emit)):
            by_doc.setdefault(i, {})[at] = (x, m)
    for i, parts in by_doc.items():
        n = len(parts)
        start, after = [first], [np.ones(k)]
        for at in range(n - 1):
            v = start[-1] @ parts[at][1]
            start.append(v / v.sum())
        for at in range(n - 1, 0, -1):
            v = parts[at][1] @ after[-1]
            after.append(v / v.sum())
        out += [(parts[at][0], i, start[at], after[n - 1 - at], at == 0, at == n - 1) for at in range(n)]
    return out


def likelihoods(docs: list[np.ndarray], first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Log10 of the exact likelihood of each document."""
    out = np.zeros(len(docs))
    for batch in _batches(pieces(docs, first, move, emit), BATCH):
        found, _ = forward(Sequences([b[0] for b in batch]), np.array([b[2] for b in batch]), move, emit)
        np.add.at(out, [b[1] for b in batch], found)
    return out / np.log(10)


def expected(docs: list[np.ndarray], first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected first states, moves, and emissions by id."""
    starts, moves, counts = np.zeros_like(first), np.zeros_like(move), np.zeros_like(emit)
    batches = list(_batches(pieces(docs, first, move, emit), KEPT))
    room = np.empty(max((len(b) * len(b[0][0]) for b in batches), default=0) * len(first))  # one for all batches
    for batch in batches:
        s = Sequences([b[0] for b in batch])
        _, states = forward(s, np.array([b[2] for b in batch]), move, emit, room)
        moves += backward(s, states, np.array([b[3] for b in batch]), np.array([b[5] for b in batch]), move, emit)
        opens = np.array([b[4] for b in batch])[s.order]
        starts += states[0][opens].sum(0)
        flat = s.ids.reshape(-1)
        for k in range(len(first)):
            counts[:, k] += np.bincount(flat, states[:, :, k].reshape(-1), len(emit))
    return starts, moves, counts


# --------------------------------------------------------------------------- training

class Shared:
    """What all tasks of a step get: first states, transitions and the emissions of
    words without their own, by the bits of their count c and without the factor
    c + 1, which is the same in all states."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit

    def of_blocks(self, corpus: pa.Table, words: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """The documents of each block of a group, the rows of its own words among
        those of the group in the order of their ids, and its emissions by id."""
        k = len(self.first)
        places = words["places"].combine_chunks()
        place = places.flatten().to_numpy()
        order = np.argsort(place)
        row, block = pc.list_parent_indices(places).to_numpy()[order], place[order] >> 32
        e = words["e"].combine_chunks().flatten().to_numpy().reshape(-1, k)
        of_row = corpus["at"].to_numpy()
        for b in np.unique(of_row):
            own = row[np.searchsorted(block, b) : np.searchsorted(block, b, side="right")]
            yield corpus.take(pa.array(np.flatnonzero(of_row == b))), own, np.vstack([self.emit, e[own]])


def _documents(corpus: pa.Table, train: bool) -> list[np.ndarray]:
    out = []
    for ids, lens, chosen in zip(*(corpus[c].to_pylist() for c in ("ids", "lens", "train"))):
        parts = np.split(_unpack(ids), np.cumsum(lens)[:-1])
        out += [x for x, t in zip(parts, chosen) if t or not train]
    return out


def _step(shared: Shared):
    """Expected counts of a group: a row (word, n0, n1, ...) for each of its own
    words, rows without a word for first states, transitions and shared words."""

    def task(corpus: pa.Table, words: pa.Table) -> pa.Table:
        k = len(shared.first)
        few, counts = np.zeros((1 + k + SHARED, k), np.int64), np.zeros((words.num_rows, k), np.int64)
        for docs, own, emit in shared.of_blocks(corpus, words):
            starts, moves, found = expected(_documents(docs, True), shared.first, shared.move, emit)
            few += np.rint(np.vstack([starts, moves, found[:SHARED]]) * UNIT).astype(np.int64)
            found *= UNIT
            np.rint(found, out=found)
            counts[own] += found[SHARED:].astype(np.int64)  # a word has one row
        some = np.flatnonzero(counts.any(1))
        word = pa.concat_arrays([pa.nulls(len(few), pa.binary()), words["word"].combine_chunks().take(pa.array(some))])
        row = pa.array([*range(len(few)), *[None] * len(some)], pa.int32())
        n = np.vstack([few, counts[some]])
        return pa.table([word, row, *[pa.array(n[:, i]) for i in range(k)]], ["word", "row", *[f"n{i}" for i in range(k)]])

    return task


def _scores(shared: Shared):
    def task(corpus: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        for docs, _, emit in shared.of_blocks(corpus, words):
            found = likelihoods(_documents(docs, False), shared.first, shared.move, emit)
            flat = {c: [x for row in docs[c].to_pylist() for x in row] for c in ("doc_id", "train", "lens", "known", "base", "plus")}
            found += flat.pop("plus")
            kinds = {"doc_id": pa.int64(), "train": pa.bool_(), "lens": pa.int64(), "known": pa.int64(), "base": pa.float64()}
            out.append(pa.table([*[pa.array(flat[c], t) for c, t in kinds.items()], pa.array(found)], [*kinds, "score"]))
        return pa.concat_tables(out)

    return task


def _groups(blocks: DataFrame) -> DataFrame:
    """(block, group, at: the block's number in its group): runs of blocks of about ``GROUP`` tokens, as many as there are
    cores at least. The driver sees a row for each block, of millions of tokens."""
    spark = blocks.sparkSession
    sizes = blocks.select("block", F.aggregate("lens", F.lit(0).cast("long"), lambda n, x: n + x).alias("n"))
    rows = sizes.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()
    whole = sum(r["n"] for r in rows)
    many = max(-(-whole // GROUP), min(len(rows), spark.sparkContext.defaultParallelism))
    before, out = 0, []
    for r in rows:
        group = (2 * before + r["n"]) * many // (2 * whole)
        out.append((r["block"], group, out[-1][2] + 1 if out and out[-1][1] == group else 0))
        before += r["n"]
    columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3
    return F.broadcast(spark.createDataFrame(pa.table(columns, ["block", "group", "at"])))  # Arrow: no task starts Python for it


class Model:
    """A corpus in blocks and the parameters of the model on it."""

    def __init__(self, docs: DataFrame, held_out: Column, id_col: str, text_col: str, states: int):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        read = docs.select(F.col(id_col).cast("long").alias("id"), ~F.coalesce(held_out, F.lit(False)), text)
        raw = stage_by(map_arrow(read, _encode, _RAW), "hmm-blocks", "block")
        blocks = raw.filter(F.col("word").isNull()).select("block", "ids", "lens", "train", "doc_id")
        groups = _groups(blocks)
        spelled = raw.filter(F.col("word").isNotNull()).select("block", "seq", "word", "n").join(groups, "block")
        of_word = Window.partitionBy("word")  # a row for each block
        counted = spelled.select("block", "group", "at", "seq", "word", F.sum("n").over(of_word).alias("c"), (F.min("block").over(of_word) == F.col("block")).alias("once"))
        counted = stage(counted, "hmm-counts")
        counts = counted.filter("once and c > 0").select("word", "c")
        total = counts.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
        self.states, self.tokens, self.types = states, total["tokens"] or 0, total["types"]
        local = counted.select("block", "seq", "c")
        local = local.toDF(*local.columns)  # both sides stem from one table
        joined = blocks.join(groups, "block").groupBy("block").cogroup(local.groupBy("block")).applyInArrow(_recode(self.tokens, self.types), _CORPUS)
        self.blocks = stage_by(joined, "hmm-corpus", "group")
        #: the words of each group with emissions of their own, and their places in its blocks
        place = F.shiftleft("at", 32) + F.col("seq")
        own = self._by_word(counted.filter(F.col("c") >= LEAST).select("word", "group", place.alias("place")))
        self.words = stage_by(own.groupBy("word", "group").agg(F.collect_list("place").alias("places")), "hmm-words", "word")

        noise = [F.pmod(F.xxhash64("word", F.lit(i)), F.lit(1000)) / 1000 + 0.5 for i in range(states)]
        own = counts.filter(F.col("c") >= LEAST).select("word", "c", *[(F.col("c") * x / states * UNIT).cast("long").alias(f"n{i}") for i, x in enumerate(noise)])
        self.own = stage_by(self._by_word(own), "hmm-emissions", "word")
        self.sizes, self.sums = np.zeros(SHARED), np.zeros(SHARED)  # words that share, and their tokens, by bits
        few = counts.filter(F.col("c") < LEAST).groupBy(F.length(F.bin("c")).alias("bits")).agg(F.count(F.lit(1)).alias("size"), F.sum("c").alias("sum"))
        for r in few.collect():  # fewer than SHARED rows
            self.sizes[r["bits"]], self.sums[r["bits"]] = r["size"], r["sum"]
        self.shared_counts = np.outer(self.sums, np.ones(states) / states)
        self.first = np.full(states, 1 / states)
        self.move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(self.move, STAY if states > 1 else 1.0)

    @staticmethod
    def _by_word(df: DataFrame) -> DataFrame:
        """Dealt as the buckets of tables by word, so that a task writes one."""
        return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")

    def emissions(self) -> tuple[Shared, DataFrame]:
        """The present emissions: of shared words, and (word, e) of the others."""
        k, whole = self.states, self.tokens + self.types + 1
        raised = [F.col(f"n{i}") / UNIT * (F.col("c") + 1) / F.col("c") + WEIGHT * (F.col("c") + 1) / whole for i in range(k)]
        sums = self.own.agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate(raised)]).first()
        shared = self.shared_counts / np.maximum(self.sums, 1)[:, None] + WEIGHT / whole  # times c + 1
        z = ((self.sums + self.sizes)[:, None] * shared).sum(0) + np.array([s or 0.0 for s in sums])
        known = (1 - 1 / whole) / np.where(z > 0, z, 1)
        emit = shared * known
        emit[0] = 1 / whole
        e = F.array(*[(x * float(f)).cast("float") for x, f in zip(raised, known)])
        return Shared(self.first, self.move, emit), self.own.select("word", e.alias("e"))

    def _cogroup(self, task, table: DataFrame, schema: str) -> DataFrame:
        words = self.words.join(table, "word").select("group", "word", "places", "e")
        return self.blocks.groupBy("group").cogroup(words.groupBy("group")).applyInArrow(task, schema)

    def improve(self) -> None:
        """One Baum-Welch step over all training documents."""
        shared, table = self.emissions()
        names = [f"n{i}" for i in range(self.states)]
        found = self._cogroup(_step(shared), table, f"word binary, row int, {', '.join(f'{n} long' for n in names)}")
        sums = stage(found.groupBy("word", "row").agg(*[F.sum(n).alias(n) for n in names]), "hmm-step")
        few = np.zeros((1 + self.states + SHARED, self.states))
        for r in sums.filter(F.col("word").isNull()).collect():  # first states, transitions, shared words
            few[r["row"]] = [r[n] / UNIT for n in names]
        first, move = few[0] + 1, few[1 : 1 + self.states] + 1
        self.first, self.move, self.shared_counts = first / first.sum(), move / move.sum(1)[:, None], few[1 + self.states :]
        counts = self.own.select("word", "c")
        found = counts.join(sums.filter(F.col("word").isNotNull()).drop("row"), "word", "left").fillna(0, names)
        self.own = stage_by(self._by_word(found), "hmm-emissions", "word")

    def score(self) -> DataFrame:
        """(doc_id, train, lens, known, base, score) of every document."""
        shared, table = self.emissions()
        return self._cogroup(_scores(shared), table, "doc_id long, train boolean, lens long, known long, base double, score double")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every
    document by a model of those that aren't held out."""
    model = Model(docs, held_out, id_col, text_col, states)
    for _ in range(rounds):
        model.improve()
    return model.score().select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        F.col("lens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
