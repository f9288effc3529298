"""Quality rules, byte-level BPE, near-duplicates, decontamination, secrets."""

import collections
import random
import re
import time

import duckdb
import numpy as np
import pytest

from delaylens.llm import bagminhash, bpe, decontaminate, quality_rules, queries, secrets
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import EDGES
from tests.planutil import plan_text


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# --------------------------------------------------------------------- rules

def test_quality_rules_match_brute_force(spark, edges, documents):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df, rows in ((edges, EDGES), (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), documents)):
        want = collections.Counter()
        for r in rows:
            q = brute.quality(r[1])
            failed = q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"]
            want[(r[0], *(q[n] for n in names), failed, brute.keeps(r[1], quality_rules.STOP_WORDS))] += 1
        assert rows_of(quality_rules.apply_rules(df), "doc_id", *names, "base_failed", "kept") == want


def test_repeated_windows_of_every_shape(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 12, 40, 200)] + ["x " * 5000, "a b c d e f g a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(df).collect()}
    assert got == {i: brute.quality(t)["n_repeat_words"] for i, t in enumerate(texts)}


def test_rules_are_one_projection_without_user_functions(spark):
    plan = plan_text(queries.op7_quality_rules(spark, SF_SMALL))
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))


def test_kept_rows_have_the_columns_of_the_input(edges, empty):
    kept = quality_rules.keep_good(edges)
    assert kept.columns == edges.columns
    assert rows_of(kept, "doc_id", "text") == collections.Counter(
        (r[0], r[1]) for r in EDGES if brute.keeps(r[1], quality_rules.STOP_WORDS)
    )
    assert quality_rules.keep_good(empty).collect() == []


SHORT_TEXTS = {
    "en": "Bees visit flowering clover fields before noon, gathering nectar while summer temperatures remain mild",
    "de": "Bienen besuchen blühende Kleefelder vormittags, sammeln Nektar, solange sommerliche Temperaturen angenehm bleiben",
    "fr": "Abeilles sauvages visitent champs fleuris chaque matin, récoltant nectar tant que températures estivales restent douces",
    "es": "Abejas silvestres visitan campos floridos cada mañana, recogen néctar mientras temperaturas estivales siguen suaves",
}


def test_stop_words_judge_texts_of_every_length(spark):
    words = "in der la de".split()
    short = [(lang, t, lang == "fr") for lang, t in SHORT_TEXTS.items()] + [(f"{lang}+", f"{t} {w}", True) for (lang, t), w in zip(SHORT_TEXTS.items(), words)]
    runs = [(n, " ".join(f"bare{chr(97 + i % 26)}{i}" for i in range(n)), False) for n in (10, 33, 34, 60)]
    df = spark.createDataFrame([(str(a), b) for a, b, _ in short + runs], "doc_id string, text string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    for name, text, kept in short + runs:
        assert got[str(name)].kept == brute.keeps(text, quality_rules.STOP_WORDS)
        assert got[str(name)].kept is kept
        assert got[str(name)].broken_rules == ([] if kept else ["few_stop_words"])


def test_own_rule_table(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj"), (2, "a " * 4 + "longer words in this one are many")], "doc_id long, text string")
    rules = [quality_rules.Rule("short", "mean_word_chars", "<", 2.5)]
    got = {r.doc_id: (r.broken_rules, r.kept) for r in quality_rules.apply_rules(df, rules).collect()}
    assert got[1] == (["short"], False) and got[2][0] == []


# ----------------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def vocabulary():
    import tiktoken

    path, pattern = queries.byte_vocabulary()
    ranks = bpe.parse_ranks(bpe.read_vocabulary(path))
    return path, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks, pattern)


def test_codec_equals_the_library(vocabulary, documents):
    _, _, library, codec = vocabulary
    rnd = random.Random(5)
    texts = [r[1] for r in documents] + [r[1] or "" for r in EDGES] + ["", " ", "\n\n  x", "x" * 50_000, "ab" * 20_000 + "!" * 20_000]
    texts += ["".join(chr(rnd.choice((32, 10, 65, 97, 233, 0x4E2D, 0x1F600, 0x85, 0x1C, 0x2028))) for _ in range(60)) for _ in range(200)]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_every_character_class_splits_like_the_library(vocabulary):
    _, _, library, codec = vocabulary
    points = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(points), 64):
        for t in ("a".join(points[k : k + 64]), " ".join(points[k : k + 64])):
            assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_bpe_operator_and_round_trip(edges, empty, vocabulary):
    path, pattern, library, _ = vocabulary
    want = collections.Counter()
    for r in EDGES:
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want[(r[0], len(ids) // 4, brute.sha(ids), brute.sha(r[1] or ""))] += 1
    assert rows_of(bpe.encode_documents(edges, path, pattern, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    encoded = bpe.encode_documents(edges, path, pattern)
    decoded = bpe.decode_ids(encoded, path, pattern)
    assert collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in decoded.collect()) == collections.Counter((r[0], r[1] or "") for r in EDGES)
    assert bpe.encode_documents(empty, path, pattern).collect() == []


# ----------------------------------------------------------- near-duplicates

def near_group(rnd, n_words, copies, edits):
    """A text and copies with some words replaced."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rnd.randrange(1, edits + 1)):
            words[rnd.randrange(n_words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def check_classes(spark, rows):
    """Classes of (doc_id, text) rows equal those of all pairs."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_classes([t for _, t in rows])
    ids = collections.defaultdict(list)
    for (i, _), c in zip(rows, want, strict=True):
        ids[c].append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    got = rows_of(bagminhash.classes(df), "__id", "class_id")
    assert got == collections.Counter((i, least[c]) for (i, _), c in zip(rows, want, strict=True))


def test_classes_match_all_pairs(spark):
    rnd = random.Random(11)
    texts = []
    for n, copies, edits in ((60, 8, 3), (150, 60, 6), (30, 5, 1), (400, 6, 12)):
        texts += near_group(rnd, n, copies, edits)
    passage = " ".join(f"p{i}" for i in range(90))  # common to texts that differ elsewhere
    texts += [passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(m)) for m in (10, 20, 30, 31, 32, 40, 60) for _ in range(3)]
    texts += ["same text here again"] * 4 + ["x y", "x y", "x", "spam " * 50, "spam " * 45, "spam " * 20]
    rnd.shuffle(texts)
    check_classes(spark, list(enumerate(texts)))


@pytest.mark.parametrize("similarity", [0.8, 0.56])
def test_rest_pairs_find_texts_cut_to_exactly_the_similarity(spark, similarity):
    texts, want = [], set()
    for n in (25, 50, 75, 100, 225, 300, 1000):
        words = [f"w{n}x{i}" for i in range(n + 4)]  # n shingles
        cut = round(n * similarity)
        for name, these in ((f"{n}-whole", words), (f"{n}-cut", words[: cut + 4])):
            texts.append((name.encode(), " ".join(these)))
        assert brute.similar(brute.bag(texts[-2][1]), brute.bag(texts[-1][1])) == similarity
        want.add((f"{n}-cut".encode(), f"{n}-whole".encode()))
    frame = spark.createDataFrame(texts, "bag binary, text string")
    weights = [(name, brute.bag(t).total(), name) for name, t in texts]
    members = spark.createDataFrame(weights, "bag binary, weight long, root binary")
    pairs = bagminhash.rest_pairs(members, frame, similarity)
    got = {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in bagminhash.verify(pairs, frame, similarity).collect()}
    assert got == want


def test_classes_of_edge_rows(spark, edges, empty):
    check_classes(spark, [(r[0], r[1]) for r in EDGES])
    assert bagminhash.classes(edges).count() == len(EDGES)
    assert bagminhash.classes(empty).collect() == []


def test_one_row_of_each_class_stays(spark, edges, empty):
    kept = bagminhash.keep_one(edges)
    assert kept.columns == edges.columns
    classes = brute.near_classes([r[1] for r in EDGES])
    assert kept.count() == len(set(classes))
    texts = [r.text or "" for r in kept.collect()]
    assert len(set(brute.near_classes(texts))) == len(texts)
    assert bagminhash.keep_one(empty).collect() == []


def test_signature_agreement_is_weighted_jaccard():
    """Shares of equal components over many components: unbiased estimates."""
    rnd = random.Random(2)
    m = 8192
    for _ in range(4):
        words = [f"t{i}" for i in range(40)]
        a = {w: rnd.choice((1, 1, 2, 3, 5, 17)) for w in words[:30]}
        b = {w: rnd.choice((1, 2, 3, 6, 40)) for w in words[10:]}
        j = sum(min(a.get(w, 0), b.get(w, 0)) for w in words) / sum(max(a.get(w, 0), b.get(w, 0)) for w in words)
        sigs = []
        for x in (a, b):
            h = np.array([hash_of(w) for w in x], np.uint64)
            sigs.append(bagminhash.signatures(h, np.array(list(x.values())), np.zeros(len(x), int), 1, m)[0])
        assert abs((sigs[0] == sigs[1]).mean() - j) < 4 * (j * (1 - j) / m) ** 0.5 + 1e-9


def hash_of(word):
    import xxhash

    return xxhash.xxh64_intdigest(word)


def test_signatures_do_not_depend_on_the_batch():
    rnd = random.Random(8)
    docs = [bagminhash.bag(" ".join(rnd.choice("abcdef") for _ in range(n))) for n in (1, 7, 40, 300)]
    together = bagminhash.signatures(
        np.concatenate([h for h, _ in docs]), np.concatenate([c for _, c in docs]), np.repeat(range(4), [len(h) for h, _ in docs]), 4, 64
    )
    for k, (h, c) in enumerate(docs):
        assert (bagminhash.signatures(h, c, np.zeros(len(h), int), 1, 64)[0] == together[k]).all()


# ------------------------------------------------------------ decontamination

def check_contamination(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter(
        (i, n, h, ",".join(ids), bad) for (i, _), (n, h, ids, bad) in zip(docs, brute.contamination([t for _, t in docs], items), strict=True)
    )
    got = decontaminate.contamination(df, bench, **options).selectExpr("__id", "n_words", "n_hit", "array_join(items, ',') AS items", "contaminated")
    assert rows_of(got, "__id", "n_words", "n_hit", "items", "contaminated") == want


def test_contamination_matches_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((13, 14, 20, 40, 12, 5, 3, 2, 1, 4))]
    items += [(20, items[2][1]), (20, items[3][1]), (21, ""), (22, None), (None, items[1][1]), (23, "-- !! --")]
    docs = [(100 + i, " ".join(word() for _ in range(rnd.randrange(200)))) for i in range(40)]
    for i, (_, t) in enumerate(items):
        words = (t or "").split()
        around = " ".join(word() for _ in range(30))
        docs += [(200 + i, f"{around}, {(t or '').upper()}! {around}"), (300 + i, " ".join(words[1:])), (400 + i, " ".join([*words, *words])), (500 + i, t)]
    docs += [(1, docs[0][1]), (1, docs[0][1]), (1, "other"), (2, None), (3, ""), (None, items[0][1]), (None, None)]
    check_contamination(spark, docs, items)


def test_contamination_beyond_the_broadcast_bound(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_contamination(spark, [(1, "a b c d e f g h i j k l m n o p"), (2, "x y"), (3, "n o p q")], [(7, "b c d e f g h i j k l m n o"), (8, "n o p"), (9, "x")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_contamination_of_edges_and_empty_tables(spark, edges, empty):
    check_contamination(spark, [(r[0], r[1]) for r in EDGES], [(1, "the dog sat by it"), (2, None)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(edges, none).filter("contaminated").count() == 0
    items = spark.createDataFrame([(1, "the dog sat by it the cat sat on the mat and the")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(edges, items)
    assert clean.columns == edges.columns and clean.count() == len(EDGES) - 2  # both copies go
    assert decontaminate.drop_contaminated(empty, items).collect() == []
    assert decontaminate.contamination(empty, items).collect() == []


def test_decontamination_runs_no_python(spark):
    plan = plan_text(queries.op8_decontamination(spark, SF_SMALL))
    assert "Python" not in plan and "Arrow" not in plan


# -------------------------------------------------------------------- secrets

KEYS = ["ghp_" + "a1B2" * 10, "sk_live_" + "x9" * 12]
SECRET_ROWS = [
    (101, 'token = "abcdefgh1" and secret: short', "en", "a", 1),
    (102, "secret: token: abcdefghij", "en", "b", 1),
    (103, 'Api_Key="' + "0f" * 20 + '" AKIAABCDEFGH1234 ' + "a0" * 16 + " " + "a0" * 15, "en", "c", 1),
    (104, f"common {KEYS[0]} and own {KEYS[1]}", "en", "a", 1),
    (105, f"common {KEYS[0]}", "en", "b", 1),
    (106, f"common {KEYS[0]}", "en", "c", 1),
    (107, "ſecret=abcdefghijk toKen=abcdefghijk", "en", "a", 1),
    (108, "password=samesame1", "en", "a", 1),
    (109, "password=samesame1", "de", "b", 1),
    (110, "password=samesame1", "fr", "c", 1),
]


def secret_frame(spark):
    return spark.createDataFrame(SECRET_ROWS + EDGES, "doc_id long, text string, lang string, source string, n_chars long")


def test_base_secrets_match_brute_force(spark):
    got = secrets.scan_documents(secret_frame(spark), *queries.owner_and_repository())
    want = collections.Counter()
    for r in SECRET_ROWS + EDGES:
        spans = brute.secrets(r[1])
        count = collections.Counter(k for _, k, _, _ in spans)
        want[(r[0], count[0], count[1], count[2], brute.sha(brute.span_text(spans)))] += 1
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_web_tokens_are_found_in_linear_time():
    pattern = re.compile(dict(secrets.MORE_KINDS)["jwt"])
    rnd = random.Random(1)
    parts = ["eyJ", "abcdefgh", ".", ".", ".eyJ", "abcdefghijk", "x", " ", "-"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(1, 22)))
        assert secrets._tokens(text) == [(m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    start = time.process_time()
    for text in ("eyJ" * 350_000, ".eyJ" * 260_000, "eyJaaaaaaaa." * 87_000):
        secrets.candidates(text)
    assert time.process_time() - start < 3


def test_widely_held_values_are_examples(spark):
    got = {r.doc_id: r for r in secrets.scan_documents(secret_frame(spark), *queries.owner_and_repository()).collect()}
    a = SECRET_ROWS[3][1].index(KEYS[1])
    assert got[104].spans == f"stripe:{a}:{a + len(KEYS[1])}"  # the common one isn't reported
    assert (got[104].n_live, got[104].n_example) == (1, 1)
    assert got[105].spans == "" and got[105].n_example == 1
    assert (got[108].n_live, got[108].n_example) == (0, 1) and got[108].spans == "assign:0:18"  # base spans stay
    assert got[101].n_live == 1


def test_live_values_are_masked(spark, edges, empty):
    df = secret_frame(spark)
    masked = secrets.mask_live(df, *queries.owner_and_repository())
    assert masked.columns == df.columns and masked.count() == df.count()
    got = {r.doc_id: r.text for r in masked.filter("doc_id > 100").collect()}
    assert got[101] == '[SECRET]" and secret: short'
    assert got[103] == '[SECRET]" [SECRET] [SECRET] ' + "a0" * 15
    assert got[104] == f"common {KEYS[0]} and own [SECRET]"
    assert got[108] == "password=samesame1"
    assert rows_of(secrets.mask_live(edges, *queries.owner_and_repository()), "doc_id", "text") == collections.Counter((r[0], r[1]) for r in EDGES)
    assert secrets.mask_live(empty, *queries.owner_and_repository()).collect() == []
    assert secrets.scan_documents(empty, *queries.owner_and_repository()).collect() == []
