import random

import pytest

#: Columns that clash with names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, rest int, label string, packed string, key int, line int, id string, n int, component string"
WORDS = "the of and house river stone light water green path north wind tree bird song day night road hill cloud".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """A function from (doc_id, text[, lang]) rows to documents with clashing columns, over several partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, "x", 7, "l", "p", 3, 4, "i", 5, "c") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empties, repeats, near copies, shared passages and a long text."""
    passage = prose(1, 60)
    near = prose(2, 120).split()
    rows = [(i, prose(100 + i, 40 + i)) for i in range(12)]
    rows += [(20, passage + " " + prose(3, 30)), (21, prose(4, 10) + "\n" + passage), (22, passage), (23, passage)]
    for i in range(6):
        own = list(near)
        own[10 * i] = f"edit{i}"
        rows.append((30 + i, " ".join(own)))
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "one"), (45, "Two words"), (46, "two words"), (47, "a b c d e"), (48, "a b c d e")]
    rows += [(50, prose(5, 25)), (50, prose(5, 25)), (60, "x " * 3000), (61, prose(6, 20000)), (62, "é" * 5000), (None, prose(7, 30))]
    return rows
