import random

import pytest
from pyspark.sql import functions as F

from forgetide.llm.queries import prepare

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture
def docs(llm):
    """Documents with all columns of the table, from (id, text) pairs."""
    def make(rows, extra=()):
        frame = llm.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SHAPE)
        return frame.withColumns({name: F.lit("x") for name in extra})
    return make


#: Column names that operators use inside.
CLASHING = ("id", "_id", "_gone", "node", "key", "row", "severity", "toxic", "component_id", "spans", "bucket", "sketch")


def words(seed, n):
    """n made-up words."""
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def text(seed, n=120):
    return " ".join(words(seed, n))


def edited(base, seed, edits):
    """A copy with some words replaced."""
    rng, parts = random.Random(seed), base.split(" ")
    for place in rng.sample(range(len(parts)), edits):
        parts[place] = f"w{rng.randrange(10 ** 6)}"
    return " ".join(parts)


def corpus():
    """Null and empty values, repeated rows and ids, copies, near copies, a shared passage, a very long text."""
    base, passage = text(1), text(2, 60)
    rows = [(i, edited(base, i, i % 7)) for i in range(10, 24)]
    rows += [(i, f"{text(100 + i, 50)}\n{passage}\n{text(200 + i, 50)}") for i in range(30, 36)]
    rows += [(40, text(3)), (41, text(3)), (41, text(3)), (42, text(3).upper()), (43, ""), (44, None), (45, " \n\t "), (46, "two words"),
             (47, "two words"), (48, "Two  words"), (None, text(3)), (None, None), (None, "no id"), (49, text(4, 30_000)),
             (50, text(4, 30_000) + " end"), (51, "\U0001F600 é ▁ ñ" * 30), (52, "ab" * 400), (53, text(5)), (53, text(6))]
    return rows
