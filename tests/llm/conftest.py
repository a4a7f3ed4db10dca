import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, rank int, slot int, digest string, node int, root int, branch int, norm string, words int, bucket int, _H int, _bits int, _gone int, _masked string, _hidden string, _score double, _hash string, _line int, _words string, _slot int, _found int"


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, "d", 3, 4, 5, "n", 6, 7, 8, 9, 10, "m", "hid", 0.25, "ha", 11, "wo", 12, 13) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


PROSE = "the quick brown fox jumps over the lazy dog while seven small wizards mix a pale jug of rich liquor and count every single coin twice before the old bell rings in town and nobody ever hears the sound again tonight because all windows are shut tight"
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d"), (6, PROSE), (7, PROSE), (8, PROSE + " indeed"), (9, "  " + PROSE.replace(" ", "  ")),
    (10, "Und " * 200), (11, "x y " * 90), (12, "p q r " + "x y " * 40), (13, "é ü 日本 \U0001f600 ok"), (14, "w" * 5000), (15, " ".join(f"w{i}" for i in range(3000))),
    (16, "THE QUICK Brown " + PROSE), (17, None), (18, "a b c d"), (19, PROSE.upper()), (-5, PROSE), (None, "no id here but text"), (6, PROSE),
]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
