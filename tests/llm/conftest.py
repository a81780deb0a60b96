import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID string, print string, digest string"


def rows():
    """Odd documents: nulls, empty and very long texts, copies, near copies, repeated rows."""
    dice = random.Random(5)
    words = [f"w{i}é" if i % 7 else f"W{i}" for i in range(400)]
    out = []
    for i in range(60):
        text = " ".join(dice.choice(words) for _ in range(dice.randint(1, 120)))
        out.append((i, text, "en", f"s{i % 4}"))
    base = " ".join(dice.choice(words) for _ in range(600))
    out += [(100 + i, base.replace(" ", "  " if i % 2 else "\n"), "en", "s0") for i in range(6)]
    out += [(110 + i, base + " tail" * (i + 1), "fr", "s1") for i in range(4)]
    out += [(120, base.upper(), "de", None), (121, None, None, None), (122, "", "en", "s2"), (123, " \t\n", "en", "s2")]
    out += [(124, "one two", "en", "s3"), (125, "ONE two", "en", "s3"), (126, None, "en", "s1"), (None, "no id here", "en", "s1")]
    out += [(130, " ".join(dice.choice(words) for _ in range(30000)), "es", "big")]
    out += [(131, "x" * 50000, "es", "big"), (132, "日本語 \U0001f600 text <|endoftext|> [INST]", "ja", "s2")]
    out += [(140, "repeated row", "en", "s1")] * 3
    return [(*r, None if r[1] is None else len(r[1]), "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
