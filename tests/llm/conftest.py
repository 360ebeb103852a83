import pytest

from storyloom.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
#: Column names that the operators use themselves.
CLASHING = "kept string, score string, posterior string, n_words string, ids string, hits string, t string, text_ string, fp string"
LONG = " ".join(f"word{n} of a long text." for n in range(30_000))

EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "Ünïcode 日本語 😀 \x1c\x85 token = \"abcdef123\""),
    (7, "the same text twice " * 20), (8, "the same text twice " * 20), (8, "the same text twice " * 20), (9, LONG), (10, LONG + " tail"),
    (None, "a row without an id, of some length, with words in it"), (None, None), (11, "line\n\nline\nline\n"), (-3, "negative id, plain words to read here now."),
]


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: read_table(spark, SMALL, name)


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty, long, equal and repeated rows, and columns whose names clash."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    rows = [(i, t, None, "src0", len(t) if t else None, *["x"] * len(names)) for i, t in EDGES]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1), (9, 0, 0), (10, 1, 1), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
