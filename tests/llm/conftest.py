import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, norm string, fp string, _size int, value string"
WORDS = "the of and river stone falls under green light moves slowly over hills toward a distant shore where birds rest".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.4 else "") for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append(w.capitalize() if k % 9 == 0 else w)
        if k % 9 == 8:
            out[-1] += ".\n" if k % 27 == 26 else "."
    return " ".join(out).replace("\n ", "\n")


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns that clash with internal names."""
    texts = {
        1: prose(1, 120), 2: prose(1, 120).upper(), 3: prose(1, 120), 4: None, 5: "", 6: " \n\t ", 7: prose(2, 9000),
        8: "one", 9: "one two", 10: prose(3, 80), 11: prose(3, 80) + " indeed", 12: "Straße ÉTÉ naïve 日本語 \U0001f600 á",
        13: prose(4, 60), 14: prose(5, 400), 15: prose(5, 400).replace("river", "stream", 1), 16: "x" * 30_000, 17: "two  blanks\tand tabs", 18: "ONE",
    }
    rows = [(k, t, ["en", None][k % 5 == 0], [None, "a", "b", "ä"][k % 4], None, "clash", "clash", 7, "clash") for k, t in texts.items()]
    return rows + [rows[12], rows[12], (None, "no id", "en", "a", 5, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
