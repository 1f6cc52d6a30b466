"""Tables with every awkward row: nulls, empties, one very long text, ties, repeats and columns with clashing names."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(7)
    words = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(130)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90))), ["en", "de"][i % 2], f"s{i % 4}") for i in range(40)]
    for i in range(40, 60):
        near = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near), "en", "s0"))
    rows += [(60, None, None, None), (61, "", "en", None), (62, " \n\t ", "de", "s1"), (63, "one", "en", "s9"), (64, "one", "en", "s9"), (65, " ".join(rng.choice(words) for _ in range(30_000)), "en", "s2"), (66, "日本語 \U0001f600 \x00 ﬁ", None, "s3"), (67, rows[41][1], "en", "s1"), (68, rows[41][1].upper(), "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    df = spark.createDataFrame(awkward_rows, "doc_id long, text string, lang string, source string")
    # Columns with names that operators use inside.
    from pyspark.sql import functions as F

    for c in ("id", "n", "h", "size", "kept", "score", "key", "row", "component", "target", "n_chars"):
        df = df.withColumn(c, F.lit(f"clash {c}"))
    return df


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)
