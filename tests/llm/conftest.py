import pytest

from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the cat sat on a mat and the dog ran to the red barn at noon while rain fell over old roofs near town".split()
LONG = " ".join(f"{w}{i % 97}" for i, w in enumerate(WORDS * 900))

#: Null and empty texts, no words, a very long text, copies, repeated rows, a null id, odd characters.
ROWS = [
    (1, " ".join(WORDS), "en", "a", 1),
    (2, " ".join(WORDS), "en", "b", 1),
    (2, " ".join(WORDS), "en", "b", 1),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, " \t\n ", "en", "a", 4),
    (6, LONG, "en", "c", len(LONG)),
    (7, "x" * 50_000, "en", "c", 50_000),
    (8, "a " * 300, "en", "d", 600),
    (9, "Ça va? 日本語 😀 it's  we'll\n\nok end \x00", "fr", "e", 30),
    (None, "no id " + " ".join(WORDS[:12]), "en", "f", 3),
    (10, "before " + " ".join(WORDS) + " after", "en", "a", 9),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
