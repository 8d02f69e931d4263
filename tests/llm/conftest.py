import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with ids from 0 on, or from (id, text[, source]) tuples; columns that clash with the operators' own are added."""

    def build(items, extra=True):
        data = []
        for k, item in enumerate(items):
            doc_id, text, source = (*item, "s")[:3] if isinstance(item, tuple) else (k, item, "s")
            data.append((doc_id, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(data, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            names = "id key score size row n word part label held_out component piece hash codes shard signature bucket budget epochs".split()
            inner = "size source doc tie key total target epochs part row bucket base budget prior sum text n rank row base h own".split()
            for name in dict.fromkeys([*names, *(f"__{x}" for x in inner)]):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words, repeatable."""

    def write(n, seed=0, words=400):
        r = random.Random(seed)
        stock = ["".join(r.choice(["ba", "ko", "ri", "tu", "é", "ne", "So"]) for _ in range(r.randint(1, 4))) for _ in range(words)]
        return " ".join(r.choice(stock) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))

    return write


EDGES = [None, "", " ", "\n\n", "a", "a a a", "x" * 5000, "word " * 30000]


@pytest.fixture(scope="session")
def edges():
    return list(EDGES)
