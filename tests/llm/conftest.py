import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside, as columns of other types
CLASHING = ", number string, node string, prefix string, start string, kept string, of string, good string, n string"
EXTRA = ("x",) * 8


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from (id, text) or (id, text, source, lang), with extra columns whose names clash."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, source, lang = (*r, *("src0", "en")[len(r) - 2 :]) if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text or ""), *EXTRA))
        return spark.createDataFrame(full, COLUMNS + CLASHING)

    return make


@pytest.fixture(scope="session")
def prose():
    """Made-up words: ``prose(n, seed)`` gives n of them."""

    def words(n, seed=0, vocabulary=3000):
        rng = random.Random(seed)
        return ["".join("bcdfghklmnprstvw"[x >> s & 15] + "aeio"[x >> s & 3] for s in (0, 4, 8)) for x in (rng.randrange(vocabulary) for _ in range(n))]

    return words


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and blank texts, a very long one, a repeated row, an id with two texts, equal texts."""
    text = " ".join(prose(80, 1))
    return [
        (1, text),
        (1, text),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, " ".join(prose(30_000, 2))),
        (None, text),
        (None, None),
        (6, "short one"),
        (7, text),
        (8, " ".join(prose(70, 3))),
        (8, " ".join(prose(90, 4))),
        (9, text, None, None),
        (10, "the " * 400),
        (11, "ünïcode \x00 ‮ 😀 " * 30),
    ]
