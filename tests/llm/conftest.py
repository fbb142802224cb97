import pytest

from tabulyze.llm.queries import tokenizer_definition
from tabulyze.llm.shipping import ship

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = ("The quick brown fox jumps over the lazy dog while seven wizards quietly mix a bright "
         "potion of silver leaves and winter honey near the old harbour wall")


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def documents(shipped):
    return shipped.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_items(shipped):
    return shipped.read.parquet(f"{SMALL}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, ties, a very long text, odd white space."""
    texts = [
        (1, None), (2, ""), (3, "  \n\t "), (4, PROSE), (4, PROSE), (None, PROSE), (5, PROSE + "!"),
        (6, "a " * 30), (7, (PROSE + "\n") * 40), (8, " ".join(f"w{i}" for i in range(60_000))),
        (9, "x" * 5000), (10, "1 2 " * 3000 + "café naïve thé <|endoftext|> 's it's"),
        (11, "mail a.b@c.de and +1 (555) 010-9999 or 10.0.0.256 10.0.0.25, 4111 1111 1111 1111"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def odd(shipped, odd_rows):
    return shipped.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(shipped):
    return shipped.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(shipped, odd_rows):
    """The odd rows with extra columns named like those of results and helpers."""
    names = ("fp fingerprint component_id m id n_words kept spans row_uid row_uid_ key n hits "
             "measures piece length rank shard held_out score _offers").split()
    frame = shipped.createDataFrame(odd_rows, SCHEMA)
    from pyspark.sql import functions as F
    return frame.select("*", *(F.lit(7).alias(n) for n in names))


@pytest.fixture(scope="session")
def definition():
    return tokenizer_definition()
