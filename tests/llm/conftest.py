import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Invented prose: ``prose(seed, n)`` gives n words."""
    syllables = "ba ke lo mi nu ra se ti vo zu dan fer gol hin jas".split()

    def write(seed, n):
        rng = random.Random(seed)
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
        return ". ".join(" ".join(words[i:i + 9]) for i in range(0, n, 9))

    return write


@pytest.fixture(scope="session")
def odd_documents(spark, prose):
    """Null ids and texts, empty, wordless, repeated and very long texts, and columns that operators use themselves."""
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "!!! ???"),
            (5, " \n\t "), (6, "na " * 30_000), (7, prose(1, 20_000)), (7, "the same id again"), (8, "é" * 5_000 + "漢字 😀")]
    rows = [(i, t, "en", None, None, 1, 2, 3.0, "x") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, key int, "
                                       "score double, node string")
