import pytest

LONG = " ".join(f"wort{i % 9973} the {i}" for i in range(30_000))

#: Nulls in any column, empty and very long texts, ties and repeated rows.
EDGES = [
    (1, "the cat sat on the mat and the dog sat by it " * 3, "en", "a", 3),
    (1, "the cat sat on the mat and the dog sat by it " * 3, "en", "a", 3),
    (1, "another text under the same id, of the house and for the garden by the sea", "en", "b", 3),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (None, "no id at all but the words of it are as good as any other in the list", None, None, None),
    (None, None, None, None, None),
    (4, LONG, "en", "a", len(LONG)),
    (5, "!!! ??? ...", "en", "a", 1),
    (6, "!!! ??? ...", "en", "a", 1),
    (7, "Ünïcode ß 漢字 😀 text\x00with\tcontrol\x0bcharacters\r\nand lines\n\n", "de", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with further columns whose names clash with results."""
    df = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("n_words", "kept", "score", "held_out", "bag", "id", "ids", "__id", "__key", "__text", "__row", "n_tokens", "spans"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
