import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n=12):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, ties, and a very long text."""
    r = random.Random(5)
    passage = sentence(r, 60)
    out = []
    for i in range(60):
        text = "\n".join(sentence(r, r.randint(5, 25)) for _ in range(r.randint(1, 8)))
        if i % 6 == 0:
            text += "\n" + passage + "\n" + sentence(r)
        out.append([i, text, "en", "s", len(text)])
    for i in range(60, 75):  # near copies of document 3
        w = out[3][1].split(" ")
        w[r.randrange(len(w))] = "zz"
        out.append([i, " ".join(w), "en", "s", 0])
    out += [[i, out[5][1], "en", "s", 0] for i in range(75, 80)]
    out += [[80, None, None, None, None], [81, "", "en", "s", 0], [82, "   \n\t", "en", "s", 3], [83, "One", "en", "s", 3], [84, "one", "en", "s", 3], [85, sentence(r, 30_000), "en", "s", 0]]
    out += [[None, out[5][1], "en", "s", 0], [1, out[1][1], "en", "s", 0], [86, "naïve <|endoftext|> 日本  x ", "fr", "s", 0]]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
