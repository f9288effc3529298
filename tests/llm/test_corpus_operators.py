"""Divergence audit, Merkle manifest and hidden Markov model against plain Python."""

import collections
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from delaylens.llm import divergence, hmm, merkle
from delaylens.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.brute import LOWER
from tests.llm.conftest import SCHEMA


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --------------------------------------------------------------------------- op 11

def audit_by_hand(rows, least_docs=10, top=10):
    """rows: (lang, source, text)."""
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least_docs]
        sources = sorted(s for g, s in groups if g == lang)
        v = len(kept)
        whole = {t: sum(counts[lang, s, t] for s in sources) for t in kept}

        def prices(c, v=v):
            total = sum(c.values())
            return {t: 1 + 1_000_000_000 * (n + 2) // (total + 2 * v) for t, n in c.items()}

        price = {s: prices({t: counts[lang, s, t] for t in kept}) for s in sources}
        q = prices(whole)
        diff = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(sum(diff(price[s][t], price[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(diff(price[s][t], q[t]), t) for t in kept if counts[lang, s, t] and price[s][t] > q[t]]
            for kind, found, limit in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.add((lang, s, kind, item, value, rank))
    return out


def audit_rows(df, **options):
    found = divergence.audit(df, **options).collect()
    rows = {tuple(r) for r in found}
    assert len(rows) == len(found)
    return rows


def test_audit_matches_plain_python_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in QUERIES["op11_level_products"](spark, SF_SMALL).collect()}
    assert got == audit_by_hand([(r.lang, r.source, r.text) for r in docs.collect()]) and len(got) > 300


def test_audit_in_many_blocks_and_parcels(spark, monkeypatch):
    """Parcels of two groups, blocks of a few terms, tasks that pass counts on early."""
    monkeypatch.setattr(divergence, "PARCEL", 2)
    monkeypatch.setattr(divergence, "TERMS", 16)
    monkeypatch.setattr(divergence, "LEAST_TERMS", 4)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = audit_by_hand([(r.lang, r.source, r.text) for r in docs.collect()], least_docs=2, top=3)
    assert audit_rows(docs, least_docs=2, top=3) == want


def test_audit_edges(spark, edges, empty):
    rows = [(r.lang, r.source, r.text) for r in edges.collect()]
    assert audit_rows(edges, least_docs=1) == audit_by_hand(rows, least_docs=1)
    # nothing kept: pairs of value 0, ranked by name
    got = audit_rows(edges, least_docs=1000)
    assert got == audit_by_hand(rows, least_docs=1000) and {r[4] for r in got} == {0}
    assert audit_rows(empty) == set()


def test_task_passes_counts_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * 3), pa.array(["s"] * 3), pa.array([b"a b a", b"A c", b""])], ["g", "p", "t"])
    total = collections.Counter()
    parts = list(divergence._count(iter([batch])))
    for out in parts:
        for r in out.to_pylist():
            total[r["term"], "n"] += r["n"]
            total[r["term"], "docs"] += r["docs"]
    assert len(parts) > 1
    assert total == {(b"a", "n"): 3, (b"a", "docs"): 2, (b"b", "n"): 1, (b"b", "docs"): 1, (b"c", "n"): 1, (b"c", "docs"): 1}


# --------------------------------------------------------------------------- op 12

def tree_by_hand(hashes):
    """Root, and for each leaf the siblings with their side (None: alone)."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, k in enumerate(at):
            s = k ^ 1
            proofs[i].append((level[s], s < k) if s < len(level) else None)
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], proofs


def manifest_by_hand(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda n, i=i, text=text, lang=lang, source=source: sha("".join(map(field, (i, source, lang, n, text))))
        bent = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups[b"" if lang is None else b"=" + lang.encode()].append((i is not None, i or 0, leaf(n), i, leaf(n + 1) if bent else leaf(n)))
    subs = {}
    for g in sorted(groups):
        groups[g].sort(key=lambda r: r[:3])
        subs[g] = tree_by_hand([r[2] for r in groups[g]])
    root, tops = tree_by_hand([subs[g][0] for g in subs]) if subs else (None, [])
    out = []
    for (g, (subroot, proofs)), above in zip(subs.items(), tops):
        for (_, _, leaf, i, checked), own in zip(groups[g], proofs):
            path, h = own + above, checked
            for s in path:
                h = sha(h if s is None else s[0] + h if s[1] else h + s[0])
            out.append((i, leaf, subroot, root, sha("".join(s[0] for s in path if s)), h, h == root))
    return out


def manifest_rows(df):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    bent = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_of([*fields[:3], F.col("n_chars") + 1, fields[4]]))
    tree = merkle.manifest(merkle.leaves(df, "doc_id", "lang", fields, bent))
    return [tuple(r) for r in tree.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def by_text(rows):
    return sorted(rows, key=repr)


def test_manifest_edges(spark, edges, empty):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in edges.collect()]
    assert by_text(manifest_rows(edges)) == by_text(manifest_by_hand(rows))
    assert manifest_rows(empty) == []
    one = edges.filter("doc_id = 3")
    assert by_text(manifest_rows(one)) == by_text(manifest_by_hand([r for r in rows if r[0] == 3]))


def test_manifest_of_scattered_ids_and_many_copies(spark):
    """Ids over the whole range of a long, more than one slot array, null and
    shared ids with equal and with different rows."""
    ids = [-(2**63), -(2**40) - 1, -65, -64, -1, 0, 1, 62, 63, 64, 2**16, 2**32 + 5, 2**48, 2**63 - 1, *range(1000, 3300), *range(10**12, 10**12 + 50 * 10**6, 10**6)]
    rows = [(i, f"t{i}", "en", "s", 1) for i in ids]
    rows += [(7, "same", "en", "s", None)] * 40 + [(7, f"other {k}", "en", "s", 2) for k in range(30)] + [(1003, "more", "en", "s", 5)]
    rows += [(None, f"x{k % 9}", "en", "s", 2) for k in range(40)] + [(k, "t", None, None, 1) for k in range(3)] + [(5, "t", "de", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = manifest_rows(df)
    assert len(got) == len(rows) and by_text(got) == by_text(manifest_by_hand(rows))


# --------------------------------------------------------------------------- op 13

def plain_hmm(docs, first, move, emit):
    """Likelihood, expected first states, moves and emissions of each document, in
    the plain recursions of the textbook (short documents only)."""
    k, out = len(first), []
    first, move, emit = (np.asarray(a, np.longdouble) for a in (first, move, emit))  # whose range holds such products
    for x in docs:
        alpha = [first * emit[x[0]]]
        for i in x[1:]:
            alpha.append((alpha[-1] @ move) * emit[i])
        beta = [np.ones(k)]
        for i in x[:0:-1]:
            beta.insert(0, move @ (emit[i] * beta[0]))
        p = alpha[-1].sum()
        gamma = [a * b / p for a, b in zip(alpha, beta)]
        moves = sum((np.outer(alpha[t], emit[x[t + 1]] * beta[t + 1]) * move / p for t in range(len(x) - 1)), np.zeros((k, k)))
        out.append((float(np.log10(p)), gamma, moves))
    return out


@pytest.mark.parametrize("long,piece", [(2048, 512), (5, 3), (4, 1)])
def test_recursions_match_the_textbook(monkeypatch, long, piece):
    monkeypatch.setattr(hmm, "LONG", long)
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "SIDE", 4)
    rng = np.random.default_rng(1)
    k, v = 3, 7
    first, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy()
    docs = [rng.integers(0, v, n).astype(np.int32) for n in (1, 2, 3, 5, 6, 7, 9, 9, 30, 31, 1)]
    want = plain_hmm(docs, first, move, emit)
    assert np.allclose(hmm.likelihoods(docs, first, move, emit), [w[0] for w in want], rtol=1e-12)
    starts, moves, counts = hmm.expected(docs, first, move, emit)
    assert np.allclose(starts, np.sum([w[1][0] for w in want], 0, float)) and np.allclose(moves, np.sum([w[2] for w in want], 0, float))
    by_id = np.zeros((v, k))
    for x, w in zip(docs, want):
        for i, g in zip(x, w[1]):
            by_id[i] += g.astype(float)
    assert np.allclose(counts, by_id)
    # all texts of three tokens together have probability 1
    every = [np.array(x, np.int32) for x in itertools.product(range(v), repeat=3)]
    assert np.isclose((10 ** hmm.likelihoods(every, first, move, emit)).sum(), 1)


def test_states_of_few_tokens_are_held_at_once():
    """However many documents a block has: their states are kept in one room, and
    the memory of a step doesn't hold those of two batches."""
    rng = np.random.default_rng(2)
    k, v = 8, 1000
    docs = [rng.integers(0, v, n).astype(np.int32) for n in rng.integers(300, 500, 4000)]
    first, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy()
    tracemalloc.start()
    starts, moves, counts = hmm.expected(docs, first, move, emit)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 35_000_000  # 1.6 million tokens
    assert np.isclose(starts.sum(), len(docs)) and np.isclose(counts.sum(), sum(map(len, docs))) and np.isclose(moves.sum(), counts.sum() - len(docs))


def test_groups_of_blocks_start_no_python(spark):
    blocks = spark.createDataFrame([(b, [b + 5, 7]) for b in range(9)], "block long, lens array<int>")
    found = hmm._groups(blocks)
    assert "PythonRDD" not in found._jdf.queryExecution().toRdd().toDebugString()
    assert [r["block"] for r in found.orderBy("block").collect()] == list(range(9))
    assert hmm._groups(blocks.limit(0)).collect() == []


def _words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))] + [hmm.END]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def _emission(shared, table):
    own = {bytes(r["word"]): np.array(r["e"], float) for r in table.collect()}
    return lambda word, c: own[word] if word in own else shared.emit[c.bit_length()] * (c + 1)


def test_model_steps_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter("length(text) < 900")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = hmm.Model(docs, held, "doc_id", "text", 4)
    rows = [(r.doc_id, _words(r.text)) for r in docs.select("doc_id", "text").collect()]
    count = collections.Counter(w for i, words in rows if not _held(i) for w in words)
    assert (model.tokens, model.types) == (sum(count.values()), len(count))
    for _ in range(2):
        shared, table = model.emissions()
        of = _emission(shared, table)
        spelled = sorted({w for _, words in rows for w in words})
        emit = np.array([of(w, count[w]) for w in spelled])
        number = {w: k for k, w in enumerate(spelled)}
        # a state's probabilities sum to 1 over all training words and the unknown one
        total = sum(of(w, count[w]) for w in count) + shared.emit[0]
        assert np.allclose(total, 1, atol=1e-5)
        coded = {i: [number[w] for w in words] for i, words in rows}
        want = dict(zip(coded, plain_hmm(coded.values(), model.first, model.move, emit)))
        got = {r.doc_id: r.score for r in model.score().collect()}
        assert all(math.isclose(got[i], want[i][0], rel_tol=1e-9) for i in want) and len(got) == len(rows)
        model.improve()
        train = [w for i, w in want.items() if not _held(i)]
        first = np.sum([w[1][0] for w in train], 0, float) + 1
        move = np.sum([w[2] for w in train], 0, float) + 1
        assert np.allclose(model.first, first / first.sum(), atol=1e-4) and np.allclose(model.move, move / move.sum(1)[:, None], atol=1e-4)
        sums = collections.defaultdict(lambda: np.zeros(4))
        for i, w in want.items():
            if not _held(i):
                for word, g in zip(coded[i], w[1]):
                    sums[spelled[word]] += g.astype(float)
        for r in model.own.collect():
            assert np.allclose([r[f"n{k}"] / hmm.UNIT for k in range(4)], sums[bytes(r["word"])], atol=0.02)


def test_every_word_of_enough_tokens_has_emissions_of_its_own(spark, monkeypatch):
    """Whatever its share of the corpus; the rarer ones are all counted by the bits."""
    monkeypatch.setattr(hmm, "FREQUENT", 5, raising=False)
    rows = [(i, " ".join(["all"] * 200 + [f"w{k}" for k in range(12) if i < 20 + 4 * k])) for i in range(60)]
    model = hmm.Model(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), "doc_id", "text", 2)
    count = collections.Counter(w for _, text in rows for w in _words(text))
    assert {bytes(r["word"]): r["c"] for r in model.own.collect()} == {w: c for w, c in count.items() if c >= hmm.LEAST}
    rare = collections.Counter(c.bit_length() for c in count.values() if c < hmm.LEAST)
    assert {b: int(n) for b, n in enumerate(model.sizes) if n} == rare and len(rare) > 0


def test_a_word_moves_once_a_group_however_small_the_blocks(spark, monkeypatch):
    """Forty tasks of one block each on four cores: a row for each word and group,
    which names the word's places in all blocks; scores are those of few blocks."""
    rows = [(i, " ".join(["all", "of"] * 10 + [f"w{(i + k) % 9}" for k in range(5)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = hmm.Model(docs.repartition(40), F.lit(False), "doc_id", "text", 2)
    found = model.words.collect()
    groups = {r["group"] for r in found}
    assert 1 < len(groups) <= spark.sparkContext.defaultParallelism and len(found) == len({(r["word"], r["group"]) for r in found})
    blocks = model.blocks.select("group", "at").distinct().count()
    assert blocks > 20 and sum(len(r["places"]) for r in found if bytes(r["word"]) == b"all") == blocks
    few, many = ({r.doc_id: r.score for r in hmm.score(docs.repartition(n), F.lit(False), states=2, rounds=2).collect()} for n in (1, 40))
    assert len(many) == 200 and all(math.isclose(few[i], many[i], rel_tol=1e-6) for i in few)


def test_scores_of_documents_and_gain_over_the_base(spark):
    got = QUERIES["op13_hidden_markov"](spark, SF_SMALL).collect()
    rows = {r.doc_id: _words(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    count = collections.Counter(w for i, words in rows.items() if not _held(i) for w in words)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        words = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (_held(r.doc_id), len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_markov_edges(spark, edges, empty, monkeypatch):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    want = collections.Counter((r.doc_id, len(_words(r.text))) for r in edges.collect())
    got = hmm.score(edges, held, rounds=1).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(empty, held, rounds=1).collect() == []
    # nothing to learn from: every word is the unknown one, which is certain
    none = hmm.score(edges, F.lit(True), rounds=1).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}
