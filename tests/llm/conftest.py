import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, u long, v string, fp string, k int, n int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(7)
    words = ["lo", "mar", "ten", "vi", "sor", "e", "quan", "die", "und"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(40000))
    base = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(400))
    near = base.replace(base.split()[200], "changed", 1)
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t", "en", "a", 5), (3, base, "en", "a", 1), (4, base, "en", "a", 1),
        (5, near, "en", "b", 1), (6, long, "de", "b", 1), (7, "One", "fr", "b", 3), (8, "one", "fr", "b", 3), (9, "Ünïcode ß 中文 \U0001f600 x\x1cy z", "es", None, 1),
        (3, base, "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (12, "a" * 3000, "en", "a", 1), (13, base + "\n" + long[:5000], "de", "b", 1),
        (14, "\n".join([base[:700]] * 3), "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
