import pytest

WORDS = "alpha beta gamma delta the of and to in house river stone cloud green under over again never always".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and long texts, ties and repeats, and columns whose names the operators use themselves."""
    a, b = prose(1, 120), prose(2, 130)
    texts = [None, "", "   \n\t ", "one", "two words", a, a, b, b + " tail end here", a + "\n" + b, "#$%& 12 34 !!", prose(3, 6000), "x" * 5000, "é ü 漢字 " * 30, a]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2", "s1"][i % 4]) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s1"), (None, a, "en", "s1"), (None, None, None, None)]
    return [(*r, 1, "k", True, 2, 3, "c") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, size int, key string, kept boolean, copies int, word int, mix_copies string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
