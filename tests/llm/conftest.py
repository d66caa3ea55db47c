import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "fp long, size long, key string, bucket int, extra string, score double, whole int, _id long, component_id string"
WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls in any column, empty and long texts, ties, repeats, clashing extra columns."""
    rng = random.Random(1)
    base = [text(rng, rng.randint(1, 80)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de"]), f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    long = text(rng, 60_000)
    rows += [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, "   \n\t ", "en", None, 6), (103, long, "en", "s1", len(long)), (104, base[0], "en", "s1", len(base[0])),
        (105, base[0] + " end", "de", "s2", 0), (106, "ÀÉ ñandú 東京 \U0001f600 word", None, "s2", 20), (107, "x", "en", "é", 1), (108, "Released under the MIT License.", "en", "s0", 31), (5, rows[5][1], *rows[5][2:]),
        (None, base[1], "en", "s0", 1),
    ]
    full = [(*r, 1, 2, "k", 3, "e", 0.5, 7, 9, "c") for r in rows]
    return spark.createDataFrame(full, f"{DOCS}, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{DOCS}, {EXTRA}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] + [(41, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
