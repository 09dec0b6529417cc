import random

import pytest

DOCS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Build documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def build(pairs):
        rows = [(i, t, "en", "src0", None if t is None else len(t), 1, "x", [1]) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS_DDL + ", id int, key string, spans array<int>").repartition(3)

    return build


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture
def hard_pairs():
    """Copies, edited copies, shared passages, repeats inside, nulls, blanks, several bytes per character, a long text."""
    rnd = random.Random(7)
    base, passage = prose(rnd, 130), prose(rnd, 64)
    pairs = [(10, base), (11, base), (3, base + " end"), (12, prose(rnd, 40) + " " + passage + " " + prose(rnd, 30)),
             (4, passage), (5, prose(rnd, 20) + "\n" + passage + "\t" + prose(rnd, 5)), (6, None), (7, ""), (8, " \n\t "),
             (13, "one two three"), (14, "One  two\nthree"), (15, "é" * 150 + " ü日本 " + "é" * 130), (16, "ab " * 120),
             (17, "ab " * 60 + prose(rnd, 30)), (None, passage + " tail"), (None, None), (20, prose(rnd, 6000, 3000)), (21, "x" * 5000)]
    words = base.split()
    for k in range(6):
        copy = list(words)
        for _ in range(2):
            copy[rnd.randrange(len(copy))] = f"new{rnd.randint(0, 99)}"
        pairs.append((30 + k, " ".join(copy)))
    return pairs + [pairs[0], pairs[5]]
