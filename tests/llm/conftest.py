import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, size int, bands int, own string, copies int"


@pytest.fixture(scope="session")
def documents():
    """Documents with copies, near copies, shared passages and lines, and every odd case; extra columns have
    names that the operators use inside."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(stems) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    texts = [prose(rng.randint(5, 120)) for _ in range(60)]
    long_words = prose(9000).split(" ")
    texts.append(" ".join(long_words))
    base = prose(150).split(" ")
    for i in range(12):  # near copies, in a chain
        base[(7 * i) % 150] = f"edit{i}"
        texts.append(" ".join(base))
    texts += [texts[3]] * 4 + [texts[5].upper()]
    passage = prose(60)
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(6)]
    texts += [f"{prose(8)}\nThe same line in many texts\n{prose(9)}\n\tthe SAME line in many texts \nshort" for _ in range(5)]
    texts += ["", " \n\t ", "one", "two words", "Two  WORDS", "a\nb\n\nc", "x" * 5000, "ab" * 300, "é" * 120, "\x00" * 150, "same same " * 400]
    rows = [
        (i, t, ["en", "de", None][i % 3], ["s1", "s2", "s1", None, ""][i % 5], len(t), i, "k", 1, 2, "o", 7)
        for i, t in enumerate(texts)
    ]
    rows.append((len(texts), None, "en", "s2", None, None, None, None, None, None, None))
    rows.append((len(texts) + 1, "lonely words here", None, "only", None, None, None, None, None, None, None))
    rows += [rows[2]] * 2  # repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def null_id_docs(spark):
    rows = [(None, "no id at all in this row", "en", "s1", 5, *[None] * 6), (1, "no id at all in this row", "en", "s1", 5, *[None] * 6), (None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, DOCS)
