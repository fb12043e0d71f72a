import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): fresh texts, exact and near copies, shared passages, leaks, odd rows."""
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.choice([3, 30, 80, 200, 400])), "en", f"s{i % 4}") for i in range(80)]
    big = prose(rng, 300)
    passage = prose(rng, 70)
    rows += [(100 + i, big, "en", "s0") for i in range(12)]
    rows += [(120 + i, edited(rng, big, 0.03), "en", "s1") for i in range(20)]
    rows += [(150 + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30), "fr", "s2") for i in range(10)]
    rows += [(170, "", "en", "s0"), (171, None, "en", "s1"), (172, " \n\t ", "en", "s2"), (173, "!!! ???", "en", None), (174, "Ünï ÉCOLE", "fr", "s3"), (175, "w1 " * 3000, "en", "s3")]
    rows += [(180, prose(rng, 60_000), "en", "s3")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def awkward(spark, corpus):
    """Few rows with a null id, repeated rows, and columns whose names operators use themselves."""
    rows = [(None, "w1 w2 w3", "en", "s0"), *corpus[:6], corpus[0], (171, None, None, None), (172, "", "en", "s0")]
    names = ["path", "root", "id", "s1", "block", "shard", "position", "p", "uses", "fp", "n", "y", "key", "words", "__key", "hash", "bucket", "a", "b", "team", "slot", "rank", "begin"]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x' as `{n}`" for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
