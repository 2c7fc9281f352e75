import random

import pytest


@pytest.fixture(scope="session")
def spark(spark):
    """The suite's session, with few partitions for the many small jobs of these tests."""
    return spark


def prose(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ke", "lu", "so") for b in ("n", "ra", "lo", "mi", "st", "ve", "x")]
    out = []
    while len(out) < n:
        sentence = [rng.choice(words) + rng.choice(("", "a", "e", "io")) for _ in range(rng.randint(5, 14))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:n])


DOC_SCHEMA = "doc_id long, text string, source string, kept string, size string, n_chars long, component_id string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, clashing extra columns."""
    shared = prose(80, 99)
    base = prose(300, 1)
    near = base.replace("tan", "zzz", 1)
    rows = [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (3, near, "a"), (4, None, "a"), (5, "", None), (6, " \n\t", "b"),
        (7, prose(40_000, 2), "c"), (8, f"{prose(120, 3)}\n{shared}", None), (9, f"{prose(150, 4)}\n{shared}", "a"),
        (10, "### $$$ %%% " * 60, "b"), (11, "one two", "c"), (12, "one two", "c"), (None, prose(90, 5), "a"),
        (13, "same line here\n" * 40, None), (14, "naïve Straße ΣΑΣ 日本 <|endoftext|>\x1cx\u00a0y", "d"),
        (15, prose(60, 6) + " Released under the MIT License. Licensed under CC BY-NC 4.0.", "d"),
    ]
    return [(i, t, s, "x", "y", len(t) if t else None, None) for i, t, s in rows]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
