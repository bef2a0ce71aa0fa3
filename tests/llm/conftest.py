import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))



@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) rows: nulls, empty and very long texts, copies, near copies, repeated rows, ties."""
    chance = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]

    def prose(n):
        return " ".join(chance.choice(vocab) for _ in range(n))

    rows = [(i, prose(chance.randint(30, 160)), f"s{i % 4}") for i in range(1, 41)]
    base = prose(120)
    for i in range(50, 70):  # near copies with a few words changed
        changed = base.split()
        for _ in range(chance.randint(0, 4)):
            changed[chance.randrange(len(changed))] = "x" + str(chance.randrange(10**6))
        rows.append((i, " ".join(changed), "s1"))
    passage = prose(90)
    for i in range(80, 86):  # a shared passage inside other text
        rows.append((i, f"{prose(40)}\n{passage}\t{prose(30)}", "s2"))
    rows += [(90, None, "s0"), (91, "", None), (92, "one two", "s3"), (93, "One  TWO", "s3"), (94, "\n \t", "s3")]
    rows += [(95, rows[3][1], "s0"), (96, rows[3][1], None), (97, prose(30) + " " + "ab" * 900, "s0")]
    rows += [(98, "áé ñ " * 400, "s1"), (99, prose(20_000), "s2"), (None, rows[5][1], "s0"), (None, None, None)]
    rows += [rows[7], rows[7]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The rows with columns whose names clash with what the operators add."""
    made = [(*r, 1, 2, "x", 0.5, True, None, 7) for r in corpus]
    return spark.createDataFrame(made, (
        "doc_id long, text string, source string, n int, shard int, key string, score double, kept boolean, "
        "h string, start int")).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
