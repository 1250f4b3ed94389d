import random

import pytest

#: Extra columns whose names the operators use themselves.
CLASHES = ["id", "fp", "rn", "y", "count", "hash", "text_hash", "media", "score", "tokens", "_id", "path", "key", "n_tokens", "bin"]


def words(seed, n, letters="abcdefghij"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


LONG = words(99, 60_000)

#: doc_id, text: a null id, null and empty texts, white space alone, exact copies, repeated rows, a very long text, one word.
ODD = [
    (1, words(1, 80)), (2, None), (3, ""), (4, " \n\t "), (5, words(1, 80)), (6, words(2, 50)), (6, words(2, 50)), (None, words(3, 40)),
    (7, LONG), (8, "one"), (9, "ça été <|endoftext|> naïve 😀"), (10, words(1, 40) + " " + words(4, 40)), (2**40, words(5, 3)),
]


def documents(spark, rows, clash=True):
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHES if clash)
    made = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if k % 5 == 0 else len(t or "")) + (("x",) * len(CLASHES) if clash else ()) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, kinds)


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
