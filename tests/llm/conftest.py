import random

import pytest

from tideline.llm.common import let_workers_import

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = ["k", "h", "t", "i", "n", "fp", "root", "name", "kind", "ws", "grams", "id", "own", "start", "bin", "shard", "digest"]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    let_workers_import(spark)


def prose(rng: random.Random, words: int, lines: int = 1) -> str:
    vocabulary = [a + b for a in "ka lo mi ne su tor vel".split() for b in "ran ser dol pim gat wex".split()]
    return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(words)) + "." for _ in range(lines))


def nasty_texts() -> list[tuple[int | None, str | None]]:
    """Keys and texts: null, empty, blank, one word, very long, ties, repeated rows and a null key."""
    rng = random.Random(5)
    long = prose(rng, 60, 300)
    plain = prose(rng, 40, 4)
    other = prose(rng, 50, 2)
    return [
        (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, long), (6, plain), (6, plain), (7, plain), (None, plain),
        (None, other), (9, "ÉÀ ß 漢字 Ω‐x  y"), (10, other + "\n" + plain), (11, "a" * 700), (12, None),
    ]


@pytest.fixture(scope="session")
def nasty(spark):
    rows = [(k, t, *[i % 3 for _ in CLASHING]) for i, (k, t) in enumerate(nasty_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
