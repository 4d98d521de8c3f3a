import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "li", "mer", "tun", "shi", "ra", "vo") for b in ("da", "lem", "no", "rick", "su", "ty", "wen")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(id, text): nulls, empty and very long texts, copies, near copies, ties, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    near = [" ".join([*base[:i], "xx", *base[i + 1 :]]) for i in (10, 60, 100)]
    chain = [" ".join(prose(random.Random(9), 200).split()[i : i + 100]) for i in range(0, 60, 6)]
    long = prose(rng, 30_000)
    texts = [None, "", "   \n\t", "one", "One", "one two three four", "ONE two three four", "é À ß ﬀ 中文 字 😀", " ".join(base), " ".join(base), *near, *chain, long, long + " end", prose(rng, 40), "a\u00a0b\u2003c \x1c d"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The texts with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", None if i == 3 else f"src{i % 3}", len(t or ""), 7, "x", 1, b"z") for i, t in awkward]
    rows += [(None, "a row without an id", None, None, 0, 7, "x", 1, b"z"), (8, awkward[8][1], "en", "src2", 3, 7, "x", 1, b"z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, size string, comp int, digest binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
