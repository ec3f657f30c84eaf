import pytest

LONG = "word " * 3000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the very angry bear in the deep dark wood tonight again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the very angry bear in the deep dark wood tonight again", "en", "a"),
    (3, "The Quick brown fox jumps over the lazy dog and runs away from the very angry bear in the deep dark wood tonight", "en", "b"),
    (4, "", "en", "b"),
    (5, None, "en", None),
    (None, "released under the MIT License by some one", "en", "b"),
    (None, None, None, None),
    (7, LONG, "fr", "c"),
    (8, "le chat noir dort sur le grand lit bleu de la petite maison", "fr", "c"),
    (8, "le chat noir dort sur le grand lit bleu de la petite maison", "fr", "c"),
    (9, " \t\n ", None, "c"),
    (10, "one two", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept string, shard string, taken string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, and extra columns whose names the operators use too."""
    return spark.createDataFrame([(*r, None, "s", "x", "y", "z", "t") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [("i1", "jumps over the lazy dog and runs away from the very angry"), ("i2", "Noir dort!"), ("i3", None), (None, "one two"), ("i5", ""), ("i6", "nowhere to be found")]
    return spark.createDataFrame(rows, "item_id string, text string")


def counted(rows):
    from collections import Counter

    return Counter(tuple(r) for r in rows)


