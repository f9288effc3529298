"""The corpus pipeline against plain Python, and its place in the repository."""

import collections
import os
import subprocess
import sys

import duckdb
import numpy as np
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from delaylens.llm import bpe, quality_rules, queries
from delaylens.llm.oracle import ORACLES
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import EDGES
from tools.oracle_check import TABLES, frame_hash


def brute_pipeline(docs, items):
    """Digests of the token ids of what is left of (doc_id, text, lang, source)."""
    docs = [r for r in docs if brute.keeps(r[1], quality_rules.STOP_WORDS)]
    docs.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    first = brute.near_classes([r[1] for r in docs])
    docs = [r for i, r in enumerate(docs) if first[i] == i]
    bad = brute.contamination([r[1] for r in docs], items)
    docs = [r for r, b in zip(docs, bad, strict=True) if not b[3]]
    owners = collections.defaultdict(set)
    for r in docs:
        for s in brute.secrets(r[1]):
            owners[s[3]].add(r[3] or "")
    path, pattern = queries.byte_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(bpe.read_vocabulary(path)), special_tokens={})
    out = collections.Counter()
    for r in docs:
        text, at = "", 0
        for a, _, b, value in brute.secrets(r[1]):
            if len(owners[value]) < 3:
                if a >= at:
                    text += r[1][at:a] + "[SECRET]"
                at = max(at, b)
        text += r[1][at:]
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        out[(r[0], len(ids) // 4, brute.sha(ids), brute.sha(text))] += 1
    return out


def test_pipeline_matches_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF_SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    want = brute_pipeline(docs, items)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert 0 < len(got) < len(docs)


def test_stages_take_edge_rows_and_empty_tables(spark, edges, empty):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "bagminhash", "decontamination", "secrets", "byte_bpe"]
    for docs, rows in ((edges, EDGES), (empty, [])):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, SF_SMALL)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            assert out.count() <= len(rows)


def test_queries_are_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) <= set(found) and "pipeline" in found
    assert set(ORACLES) <= set(queries.QUERIES)


def test_sql_oracles_agree(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns), name
        assert len(got) == len(want) and frame_hash(got) == frame_hash(want), name


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the training-data folders."""
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kpis' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert 'kpis' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
