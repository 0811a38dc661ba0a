import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


STOCK = "the of and to a in reed stone river light moves over under quick brown Fox jumps élan über naïve data model. 42".split()


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(STOCK) + (str(r.randrange(50)) if r.random() < 0.4 else "") for _ in range(n))


def rows() -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and long texts, and repeated ids."""
    base = [words(k, 20 + 7 * k) for k in range(30)]
    passage = words(900, 60)
    t: list[tuple[int | None, str | None]] = list(enumerate(base))
    t += [(100 + k, base[k]) for k in range(6)]
    t += [(200 + k, base[20 + k].replace("the", "THE", 3)) for k in range(5)]
    t += [(300 + k, words(500 + k, 30) + "\n" + passage + "  " + words(700 + k, 25)) for k in range(8)]
    t += [(400, None), (401, ""), (402, "   "), (403, "one"), (404, "one two"), (405, words(77, 6000)), (406, "x" * 5000), (None, base[3]), (None, None), (7, base[7]), (7, words(1234, 40))]
    return [(d, x, "en", "s", len(x) if x is not None else None) for d, x in t]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
