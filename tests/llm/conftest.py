import random

import pytest
from pyspark.sql import functions as F

PASSAGE = " ".join(f"shared{i} text" for i in range(60))


def hand_made():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta été straße über eta theta iota kappa the of and x9".split()) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))
    base = say(300)
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, base + " tail"), (8, base + " other tail"),
        (9, base.replace("alpha", "omega", 3)), (None, "no id here " + say(40)), (None, None), (10, say(9000)), (11, "a" * 5000), (12, "ab " * 3000),
        (13, PASSAGE + " " + say(50)), (14, say(50) + " " + PASSAGE), (15, say(20) + " " + PASSAGE + " " + say(900)), (16, "\x00\x1c\x85 odd seps\x0b!"),
        (17, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. GNU General Public License"),
        (18, "mail a.b@ex1.org card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112; ip 10.20.30.40 on 2024-02-29, 29/02/2023"),
        (19, "# * $ % & | < > " * 20), (20, "LOUD!! WORDS!! HERE!! " * 40), (21, "same line\n" * 60), (22, "é" * 399 + "é"), (23, "é" * 400),
    ]
    return rows + [(100 + i, say(rng.randint(1, 120))) for i in range(40)] + [(200 + i, base + " " + say(3)) for i in range(12)]


@pytest.fixture(scope="session")
def rows():
    return hand_made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Awkward documents over several partitions, with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *(F.lit("x").alias(c) for c in ("key", "pos", "n", "words", "start", "length", "w", "_part", "digest", "first")))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
