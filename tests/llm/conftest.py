import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and house river letter stone green water under paper light seven walk night bread small winter".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (draw.choice(["", "", "", ",", "."])) + str(draw.randint(0, 99)) * (draw.random() < 0.1) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank, wordless and long texts, copies, repeated rows and ids."""
    long_text = prose(1, 9000)
    return [
        (1, prose(2, 80), "en", "s", 1),
        (2, prose(2, 80), "en", None, None),
        (2, prose(2, 80), "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (None, "no id here", "en", "s", 3),
        (5, " \n\t ", "en", "s", 3),
        (6, "%%% $$$ 123", None, "s", 9),
        (7, long_text, "en", "s", len(long_text)),
        (8, "x" * 30_000, "en", "s", 30_000),
        (9, "Über ça: 漢字 👍 \u0000 end", "de", "s", 5),
        (10, "word", "en", "s", 4),
        (11, prose(2, 80) + " tail", "en", "s", 4),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The same rows with columns named as results and helpers of the operators."""
    names = (
        "ids decoded items spans n_words n_hit tokens part lang_pred score labels fingerprint findings class_id n_bytes kept "
        "_key _text _words _places _range k1"
    ).split()
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).select("*", *[F.lit("mine").alias(n) for n in names])
